"""Helpers shared by the corpus operators: shared storage, sizing, column hygiene."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise, shared_dir, shared_path  # noqa: F401

#: The characters that separate words in every operator: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(df: DataFrame, bytes_each: int, floor: int | None = None) -> int:
    """Parts for a table: floor (the session's shuffle partitions), or more where a part would exceed bytes_each.

    The optimizer's size of a join is the product of its sides; twice the sum of what the plan reads is a bound
    that doesn't multiply."""
    if floor is None:
        floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().optimizedPlan()
    size = lambda node: int(str(node.stats().sizeInBytes()))
    leaves = plan.collectLeaves()
    estimate = min(size(plan), 2 * sum(size(leaves.apply(i)) for i in range(leaves.size())))
    # An unknown size is reported as a number beyond any table; floor then decides.
    return floor if estimate >= 1 << 60 else max(floor, math.ceil(estimate / bytes_each))


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id's decimal text leaves this remainder (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def quiet_threads() -> None:
    """One thread for libraries that start their own; Spark's tasks are the parallelism."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def learning_rows(docs: DataFrame, label: str, sample: int, chars: int, most_labels: int) -> list[tuple[str, str]]:
    """(text, label) of at most `sample` rows of each label: those least by a hash of their id, then by id and text, of
    texts of 1 to `chars` characters. docs: (id, text, label); rows with a null are left out. More labels than
    most_labels are an error, so what comes to the driver is bounded."""
    usable = docs.where(F.col("id").isNotNull() & F.col(label).isNotNull() & F.length("text").between(1, chars))
    keys = materialise(usable.select("id", label, F.xxhash64("id").alias("h")).distinct(), "learned")
    labels = keys.select(label).distinct().limit(most_labels + 1).count()
    if labels > most_labels:
        raise ValueError(f"more than {most_labels} different labels in {label}")
    place = F.row_number().over(Window.partitionBy(label).orderBy("h", "id"))
    chosen = keys.select("id", label, place.alias("place")).where(F.col("place") <= sample).drop("place")
    texts = usable.join(F.broadcast(chosen), ["id", label]).select("id", label, "text", F.xxhash64("id").alias("h"))
    place = F.row_number().over(Window.partitionBy(label).orderBy("h", "id", "text"))  # ids may repeat
    best = texts.select("*", place.alias("place")).where(F.col("place") <= sample)
    return [(r["text"], r[label]) for r in best.orderBy(label, "id", "text").collect()]


def free_name(df: DataFrame, base: str) -> str:
    """base, or base with underscores before it until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df in a clone of its session that sends rows to Python at most so many at a time, as texts are long. Nothing
    changes in the session itself; what is made from the result stays in the clone."""
    session, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if 0 < int(session.conf.get(name)) <= rows:
        return df
    clone = session._jsparkSession.cloneSession()
    clone.conf().set(name, str(rows))
    plan = df._jdf.queryExecution().logical()
    made = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(clone, plan)
    return type(df)(made, SparkSession(session.sparkContext, clone))


def slices(batch, texts: int, most: int = 2 << 20):
    """Parts of an Arrow batch of about `most` bytes of the text column (one row at least), in order."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(texts)), 0), np.int64)
        group = (np.cumsum(size) - size) // most
        cuts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)])).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
