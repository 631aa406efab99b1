"""Exact top-k inner products by distributed histogram selection.

Vectors become integers and are packed into blocks. Scores are computed block by block as one matrix product
wherever they are needed, and never stored. Each round counts, for every query, the scores in BINS equal bins of
the interval that holds its k-th greatest score; the counts are added over all candidates, and the bin that holds
that score is the next interval, until it is a single integer. A last pass keeps the scores from that value up -
of those equal to it the smallest ids of each block, k at most - and ranks what is left.

Queries go through in groups of QUERIES, which are sent to all executors; each group's result is written, and its
vectors are let go, before the next. Histograms are added on the executors; the driver sees their sums, BINS counts
for each query of one group, and chooses the next intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_path

QUERIES = 2048
BLOCK = 4096
BINS = 1024
SCALE = 1024
#: Sums of products are exact as doubles below the first, and fit 64 bits below the second.
_EXACT, _NARROW = 1 << 53, 1 << 62
_LONG = (1 << 63) - 1


def _pack(dims: int):
    """Blocks of vectors: ids, numbers of rows, integers as doubles, the greatest absolute value, which rows ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = np.array(part.column(0).to_pylist(), "<i8")
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                values = np.zeros((len(ids), dims))
                values[np.arange(dims) < sizes[:, None]] = np.floor(SCALE * part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8"))
                asks = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                rows = row + np.arange(len(ids))
                row += len(ids)
                order = np.argsort(ids, kind="stable")
                cells = [x[order].tobytes() for x in (ids, rows, values, asks)]
                yield pa.RecordBatch.from_arrays([*(pa.array([c]) for c in cells), pa.array([float(np.abs(values).max())]), pa.array([bool(asks.any())])], ["ids", "rows", "data", "asks", "most", "some"])

    return run


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks that are queries."""
    for batch in batches:
        for ids, rows, data, asks in zip(*(batch.column(c).to_pylist() for c in ("ids", "rows", "data", "asks")), strict=True):
            at = np.flatnonzero(np.frombuffer(asks, bool))
            ids, rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8")
            vectors = np.frombuffer(data, "<f8").reshape(len(ids), -1)
            yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(ids[at]), pa.array([vectors[i].tobytes() for i in at], pa.binary())], ["row", "id", "v"])


def scores_of(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products: one product of doubles where its sums are exact, else integers of any size; as int64 where
    that holds them, else as Python's integers."""
    most = queries.shape[1] * int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0))
    if most < _EXACT:
        return (queries @ candidates.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, candidates)]
    found = whole[0] @ whole[1].T
    return found.astype(np.int64) if most < _NARROW else found


def _blocks(batches, group) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and rows of candidates, their scores for each query of the group, and which are a query's own row."""
    query_rows, _, queries = group
    for batch in batches:
        for ids, rows, data in zip(*(batch.column(c).to_pylist() for c in ("ids", "rows", "data")), strict=True):
            ids, rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8")
            vectors = np.frombuffer(data, "<f8").reshape(len(ids), -1)
            for at in range(0, len(query_rows), 512):
                yield at, ids, rows, scores_of(queries[at : at + 512], vectors), query_rows[at : at + 512, None] == rows


def _counts(shared, low: np.ndarray, width: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shared.value
        total = np.zeros((len(low), BINS), np.int64)
        for at, _, _, scores, own in _blocks(batches, group):
            n = len(scores)
            offset = scores - low[at : at + n, None]
            bins = np.where((offset < 0) | (offset >= width) | own, BINS, offset // step).astype(np.int64) + (BINS + 1) * np.arange(n)[:, None]
            total[at : at + n] += np.bincount(bins.ravel(), minlength=n * (BINS + 1)).reshape(n, BINS + 1)[:, :BINS]
        for at in range(0, len(low), 256):
            data = zstandard.compress(total[at : at + 256].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([data])], ["part", "data"])

    return run


def _add(table):
    """The counts of one part of a group, added and accumulated from the top bin down."""
    total = sum(np.frombuffer(zstandard.decompress(d), "<i8") for d in table.column("data").to_pylist()).reshape(-1, BINS)
    from_top = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
    return pa.table({"part": [table.column("part")[0].as_py()], "data": [zstandard.compress(np.ascontiguousarray(from_top).tobytes(), 1)]})


def _narrow(from_top: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest bin from which up at least `want` scores lie (bin 0 if there are fewer), and those above it."""
    enough = from_top >= want[:, None]
    enough[:, 0] = True
    found = BINS - 1 - np.argmax(enough[:, ::-1], axis=1)
    above = np.take_along_axis(np.pad(from_top, ((0, 0), (0, 1))), found[:, None] + 1, 1)[:, 0]
    return found, above


def _keep(shared, least: np.ndarray, k: int, bound: int):
    """The rows at or above each query's least score. `height` orders scores of any size: bytes of score + bound."""
    size = (2 * bound).bit_length() // 8 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shared.value
        for at, ids, rows, scores, own in _blocks(batches, group):
            q, c = np.nonzero((scores >= least[at : at + len(scores), None]) & ~own)
            found = scores[q, c]
            order = np.lexsort((rows[c], ids[c], -found, q)) if found.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -found[i], ids[c[i]], rows[c[i]])), np.int64)
            q, c, found = q[order], c[order], found[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, c, found = q[place < k], c[place < k], found[place < k].tolist()
            height = [(x + bound).to_bytes(size, "big") for x in found]
            score = [max(-_LONG - 1, min(_LONG, x)) for x in found]
            cells = [group[0][at + q], group[1][at + q], ids[c], rows[c], np.array(score, np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cells), pa.array(height, pa.binary())], ["query_row", "query_id", "vec_id", "row", "score", "height"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where the column is_query holds, the k other rows with the
    greatest integer inner product of floor(1024 * component), ties to smaller ids; all rows, if fewer.

    Rows with a null id or vector, an empty vector, or null or non-finite components take no part. A shorter vector
    counts as filled up with zeros. Each row is a query and a candidate of its own, also where rows repeat an id; only
    the query's own row is left out. Ranks follow exact scores of any size; a score that a long can't hold is given as
    the nearest that it can.
    """
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    usable = usable.where(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector_col) > 0))
    usable = usable.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    spark = vectors.sparkSession
    dims = usable.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = materialise(usable.mapInArrow(_pack(dims), "ids binary, rows binary, data binary, asks binary, most double, some boolean"), "blocks")
    asking = materialise(blocks.where("some").mapInArrow(_asking, "row long, id long, v binary"), "queries")
    most = int(blocks.agg(F.max("most")).first()[0])
    blocks = blocks.select("ids", "rows", "data")
    bound = dims * most * most + 1
    number = np.int64 if bound < _NARROW else object
    result = "query_row long, query_id long, vec_id long, row long, score long, height binary"
    out, last = shared_path(spark, "nearest"), None
    spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").write.parquet(out)
    while True:
        rows = asking.where(F.col("row") > last) if last is not None else asking
        rows = rows.orderBy("row").limit(QUERIES).collect()
        if not rows:
            return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)
        last = rows[-1]["row"]
        queries = np.frombuffer(b"".join(bytes(r["v"]) for r in rows), "<f8").reshape(len(rows), -1)
        shared = spark.sparkContext.broadcast((np.array([r["row"] for r in rows]), np.array([r["id"] for r in rows]), queries))
        low, want = np.full(len(rows), -bound, number), np.full(len(rows), k)
        width = 2 * bound + 1
        while width > 1:
            step = -(-width // BINS)
            counted = blocks.mapInArrow(_counts(shared, low, width, step), "part long, data binary").groupBy("part").applyInArrow(_add, "part long, data binary")
            for row in counted.collect():
                at = row["part"]
                from_top = np.frombuffer(zstandard.decompress(row["data"]), "<i8").reshape(-1, BINS)
                bins, above = _narrow(from_top, want[at : at + len(from_top)])
                low[at : at + len(from_top)] += bins.astype(number) * step
                want[at : at + len(from_top)] -= above
            width = step
        near = blocks.mapInArrow(_keep(shared, low, k, bound), result)
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("height"), "vec_id", "row"))
        near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        shared.destroy()


def nearest(embeddings: DataFrame) -> DataFrame:
    """The result of the registered query."""
    return top_k(embeddings, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""
