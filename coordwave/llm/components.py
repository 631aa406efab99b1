"""Connected components of a table of links, by alternating star steps; nothing is collected but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Links up to this number (16 bytes each) are small enough to be sent to each executor; it is counted before.
BROADCAST_LINKS = 100_000
#: Beyond that number, rows of a node are dealt over this many tasks.
SALTS = 16


def _with_least(pairs: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """Each pair (u, v) with m, the least neighbour of u. A node with very many neighbours is salted."""
    if links <= BROADCAST_LINKS:
        return pairs.join(F.broadcast(least), "u")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, ["u", "salt"]).drop("salt")


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.select("u", "v").union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _with_least(both, least, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def components(links: DataFrame) -> DataFrame:
    """(u, v): each linked node u that is not the least of its component, and that least node v.

    links: two columns of integers, in any order or direction, repeats allowed; null and self links are ignored.
    """
    a, b = links.columns
    now = materialise(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct(), "links")
    state = _state(now)
    while state[0]:
        now = materialise(_small_star(_large_star(now, state[0]), state[0]), "links")
        new = _state(now)
        if new == state:
            break
        state = new
    return now
