"""Places of windows and groups on a map, as arithmetic on their order; overlap by grid cells; rows for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: Steps and margins of tiles and islands (fixed values).
STEP_X, STEP_Y, MARGIN_X, MARGIN_Y, LEAST_WIDTH, LEAST_HEIGHT, BETWEEN = 188, 140, 36, 76, 320, 210, 100
#: Boxes of a cell that are compared with the cell's others at once, and tasks at most.
BLOCK, MOST_TASKS = 2000, 20_000


def _sizes(n):
    columns = F.greatest(F.lit(1), F.ceil(F.sqrt(n) * 1.2)).cast("long")
    rows = F.ceil(n / columns).cast("long")
    return columns, F.greatest(F.lit(LEAST_WIDTH), columns * STEP_X + MARGIN_X), F.greatest(F.lit(LEAST_HEIGHT), rows * STEP_Y + MARGIN_Y)


def islands(windows: DataFrame) -> DataFrame:
    """L1: (stream_id, n, x, y, width, height): streams in order on a square grid whose cells fit the largest.
    windows: (window_id, stream_id). Streams are few, so their order is one window over them."""
    n = windows.where("stream_id IS NOT NULL").groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    _, width, height = _sizes(F.col("n"))
    sized = n.withColumn("width", width).withColumn("height", height)
    whole = sized.agg(F.max("width").alias("w"), F.max("height").alias("h"), F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("columns"))
    place = F.row_number().over(Window.orderBy("stream_id")) - 1
    rows = sized.withColumn("place", place).join(F.broadcast(whole))  # one row
    return rows.select("stream_id", "n", ((F.col("place") % F.col("columns")) * (F.col("w") + BETWEEN)).alias("x"), (F.floor(F.col("place") / F.col("columns")) * (F.col("h") + BETWEEN)).alias("y"), "width", "height")


def tiles(windows: DataFrame, areas: DataFrame) -> DataFrame:
    """L3: (window_id, x, y): the tiles of each area's windows, row by row in order of id."""
    columns, _, _ = _sizes(F.col("n"))
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("window_id")) - 1
    met = windows.select("window_id", "stream_id", place.alias("place")).join(areas, "stream_id")
    x = F.col("x") - F.col("width") / 2 + 98 + (F.col("place") % columns) * STEP_X
    y = F.col("y") - F.col("height") / 2 + 110 + F.floor(F.col("place") / columns) * STEP_Y
    return met.select("window_id", x.alias("x"), y.alias("y"))


def in_view(points: DataFrame, left: float, top: float, right: float, bottom: float, overscan: float = 0.0) -> DataFrame:
    """The points inside a viewport that is wider by overscan on each side."""
    return points.where(F.col("x").between(left - overscan, right + overscan) & F.col("y").between(top - overscan, bottom + overscan))


def overlaps(boxes: DataFrame, gap: float = 48.0, cell: float = 500.0) -> DataFrame:
    """(a, b), a < b: boxes (box_id, left, top, right, bottom) that aren't gap apart on either axis.

    Boxes meet in the cells of a grid that they (half a gap wider) touch, so only near ones are compared; a pair that
    shares several cells comes from the one of its common corner alone. A cell's boxes are dealt into blocks of up to BLOCK,
    and each box meets every block of its cell: these rows are few but heavy, so they have a number of tasks of their own."""
    ends = lambda low, high: F.sequence(F.floor((F.col(low) - gap / 2) / cell), F.floor((F.col(high) + gap / 2) / cell))
    dealt = boxes.withColumn("cx", F.explode(ends("left", "right"))).withColumn("cy", F.explode(ends("top", "bottom")))
    cells = materialise(dealt.groupBy("cx", "cy").agg((F.count(F.lit(1)) / BLOCK).alias("share")), "cells")
    work = cells.agg(F.sum(F.col("share") * F.col("share"))).first()[0] or 0
    tasks = max(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(work), MOST_TASKS))
    placed = dealt.join(cells.select("cx", "cy", F.ceil("share").alias("blocks")), ["cx", "cy"])
    block = {"a": F.pmod(F.xxhash64("box_id"), F.col("blocks")), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))}
    side = lambda s: placed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("box_id", "left", "top", "right", "bottom")], "cx", "cy", block[s].alias("block")).repartition(tasks, "cx", "cy", "block")
    met = side("a").hint("shuffle_hash").join(side("b"), ["cx", "cy", "block"]).where("box_id_a < box_id_b")
    near = (F.col("right_a") + gap > F.col("left_b")) & (F.col("right_b") + gap > F.col("left_a")) & (F.col("bottom_a") + gap > F.col("top_b")) & (F.col("bottom_b") + gap > F.col("top_a"))
    corner = [F.floor((F.greatest(f"{e}_a", f"{e}_b") - gap / 2) / cell) for e in ("left", "top")]
    return met.where(near & (F.col("cx") == corner[0]) & (F.col("cy") == corner[1])).select(F.col("box_id_a").alias("a"), F.col("box_id_b").alias("b"))


def joint_points(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The rows where both quantities are present, for a scatter."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def repeated(samples: DataFrame, times: int) -> DataFrame:
    """(cycle_id, repeat, t, f): a cycle's samples several times in a row, each a period later. samples: (cycle_id,
    period, t, f)."""
    again = samples.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return again.select("cycle_id", "repeat", (F.col("t") + F.col("repeat") * F.col("period")).alias("t"), "f")


def plot_trace(samples: DataFrame, most: int) -> DataFrame:
    """Every stride-th sample of each recording, so that at most `most` are drawn. samples: (recording_id, event_idx, ...)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id"))
    return samples.withColumn("stride", F.greatest(F.lit(1), F.ceil(n / most)).cast("long")).where(F.col("event_idx") % F.col("stride") == 0).drop("stride")


def edges(relationships: DataFrame, suggested: DataFrame, selected: int, everywhere: bool) -> DataFrame:
    """L4: (edge_id, from_id, to_id, kind): reviewed relationships (relation_id, from_id, to_id), those of the selected
    window or all, and the suggestions that are drawn (query_id, target_id, kind), with kinds from their coverage."""
    here = (F.col("from_id") == selected) | (F.col("to_id") == selected) | F.lit(everywhere)
    reviewed = relationships.where(here).select(F.col("relation_id").cast("string").alias("edge_id"), "from_id", "to_id", F.lit("reviewed").alias("kind"))
    name = F.concat_ws(":", F.lit("suggestion"), F.col("query_id").cast("string"), F.col("target_id").cast("string"))
    return reviewed.unionByName(suggested.select(name.alias("edge_id"), F.col("query_id").alias("from_id"), F.col("target_id").alias("to_id"), "kind"))


def aligned_trace(points: DataFrame, alignment: DataFrame) -> DataFrame:
    """A related window's points on the selected one's time axis and range; missing values stay missing, so gaps do
    too. points: (window_id, t, value); alignment: (window_id, offset, scale, low, high, to_low, to_high)."""
    rows = points.join(alignment, "window_id")
    place = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).when(F.col("value").isNotNull(), 0.5)
    return rows.select("window_id", (F.col("offset") + F.col("scale") * F.col("t")).alias("t"), (F.col("to_low") + place * (F.col("to_high") - F.col("to_low"))).alias("value"))
