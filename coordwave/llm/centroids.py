"""Exact integer k-means: assignment screened in float32 with rigorous error intervals.

Vectors become integers, floor(scale * component), and are packed into blocks. For a block, one float32 matrix product
gives every inner product; the squared distance to centroid c is |v|^2 plus the score |c|^2 - 2 v.c, and only scores
need comparing. A float32 product of n terms, its factors rounded too, is off by at most g |v| |c| with
g = (n + 2) u / (1 - (n + 2) u), u = 2^-24, in whatever order it was summed. So each score lies in a known interval.
Centroids whose interval reaches below the least upper end are the shortlist. Where it holds one centroid, that is the
nearest; the others' scores are computed anew with exact integers, and the smaller number wins ties. Where float32 would
overflow, intervals are unbounded, and all centroids are on the list.

A round adds up the vectors of each centroid inside tasks, then over tasks; the driver gets k sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 4096
CENTROIDS, ROUNDS, SCALE, DIMS = 16, 3, 64, 64
#: Integers up to this keep every sum of a block, and every squared distance of up to 2^10 components, in 64 bits.
_NARROW = 1 << 25
_LONG = (1 << 63) - 1


def _pack(scale: int, dims: int):
    """Blocks of vectors: ids (null: 0), whether null, integers as doubles (a floor of a double is one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = np.array(part.column(0).fill_null(0).to_pylist(), "<i8")
                null = np.array(part.column(0).is_null().to_pylist(), bool)
                with np.errstate(over="ignore"):
                    values = np.floor(scale * part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8"))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (ids, null, values)], ["ids", "nulls", "data"])

    return run


def _whole(values: np.ndarray, narrow: bool) -> np.ndarray:
    """Doubles that are integers, as int64 or, if they are large, as Python's integers."""
    return values.astype(np.int64) if narrow else np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def nearest(values: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of a block of integers held as doubles: each row's nearest centroid, the exact squared distance, the rows as
    exact integers, and how many (row, centroid) pairs were recomputed."""
    k, n = len(centroids), values.shape[1]
    large = max((abs(x) for c in centroids for x in c), default=0)
    most = max(large, float(np.abs(values).max(initial=0)))
    narrow = most <= _NARROW and n <= 1 << 10
    exact, means = _whole(values, narrow), np.array(centroids, np.int64 if narrow else object).reshape(k, n)
    if most * most * n < 1e37:
        u = 2.0**-24
        gamma = (n + 2) * u / (1 - (n + 2) * u)
        rough = means.astype(np.float64)
        products = (values.astype(np.float32) @ rough.astype(np.float32).T).astype(np.float64)
        square = (rough * rough).sum(axis=1)
        lengths = np.sqrt((values * values).sum(axis=1))[:, None] * np.sqrt(square)
        score = square - 2 * products
        # What doubles lose on the way is a tiny share of the terms: n + 8 roundings of at most 2^-53 each, doubled.
        slack = 2 * gamma * lengths * (1 + 1e-9) + (n + 8) * 2.0**-52 * (square + 4 * lengths)
        listed = score - slack <= (score + slack).min(axis=1, keepdims=True)
    else:
        listed = np.ones((len(values), k), bool)
    found = np.argmax(listed, axis=1)
    rows, which = np.nonzero(listed & (listed.sum(axis=1) > 1)[:, None])
    if len(rows):
        squares = (means * means).sum(axis=1)
        scores = np.empty(len(rows), means.dtype)
        for at in range(0, len(rows), BLOCK):  # no more than a block's bytes at a time
            r, c = rows[at : at + BLOCK], which[at : at + BLOCK]
            scores[at : at + BLOCK] = squares[c] - 2 * (exact[r] * means[c]).sum(axis=1)
        order = np.lexsort((which, scores, rows)) if narrow else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], scores[i], which[i])))
        first = order[np.searchsorted(rows[order], np.unique(rows))]
        found[rows[first]] = which[first]
    away = exact - means[found]
    return found, (away * away).sum(axis=1), exact, len(rows)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int):
    for batch in batches:
        for ids, nulls, data in zip(*(batch.column(c).to_pylist() for c in ("ids", "nulls", "data")), strict=True):
            yield np.frombuffer(ids, "<i8"), np.frombuffer(nulls, bool), np.frombuffer(data, "<f8").reshape(-1, dims)


def _sums(centroids: list[list[int]], dims: int):
    """Per task and centroid: numbers of vectors and of recomputed pairs, sum of distances, sums of components, as JSON
    (integers of any size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for _, _, values in _blocks(batches, dims):
            found, distance, exact, again = nearest(values, centroids)
            for c in np.unique(found).tolist():
                mine = found == c
                # A block's sums of narrow components fit 64 bits; distances are added in Python.
                new = [int(mine.sum()), again, sum(distance[mine].tolist()), *exact[mine].sum(axis=0).tolist()]
                again = 0
                total[c] = [a + b for a, b in zip(total[c], new, strict=True)] if c in total else new
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([json.dumps(x) for x in total.values()])], ["cluster", "sums"])

    return run


def _add(table):
    rows = [json.loads(x) for x in table.column("sums").to_pylist()]
    return pa.table({"cluster": pa.array([table.column("cluster")[0].as_py()], pa.int32()), "sums": [json.dumps([sum(x) for x in zip(*rows, strict=True)])]})


def _totals(blocks: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, list[int]]:
    """_sums over all blocks: one row a centroid comes to the driver."""
    kind = "cluster int, sums string"
    added = blocks.mapInArrow(_sums(centroids, dims), kind).groupBy("cluster").applyInArrow(_add, kind)
    return {r["cluster"]: json.loads(r["sums"]) for r in added.collect()}


def first_centroids(usable: DataFrame, k: int) -> list[list[int]]:
    """The integers of the k vectors with the least sha256 of `1:<id>`; rows that repeat an id in order of their vector."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = usable.where("id IS NOT NULL").select("id", "v", key.alias("key")).orderBy("key", "v").limit(k).collect()
    return [r["v"] for r in rows]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of each usable vector, after so many rounds.

    Usable are vectors with exactly dims components, none null or non-finite (nor so by scale); the others take no part
    and have no row.
    Rows that repeat an id are vectors of their own. A row with a null id is assigned and counts in means, but no
    centroid starts from it. Fewer vectors with an id than k: so many centroids; none, or an empty table: no rows.
    Equal distances go to the smaller number; so of equal centroids the later are empty, and empty ones stay. centroid
    lists its components as decimal integers, joined by commas. Distances and sums are exact at any size; one
    that a long can't hold is given as the greatest long. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    out = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid string"
    v = F.col(vector_col).cast("array<double>")
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.size("v") == dims)
    usable = usable.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))))
    centroids = [[int(x) for x in np.floor(scale * np.array(c, np.float64)).tolist()] for c in first_centroids(usable, k)]
    if not centroids:
        return spark.createDataFrame([], out)
    blocks = materialise(usable.mapInArrow(_pack(scale, dims), "ids binary, nulls binary, data binary"), "blocks")
    for _ in range(rounds):
        totals = _totals(blocks, centroids, dims)
        centroids = [[x // totals[c][0] for x in totals[c][3:]] if c in totals else old for c, old in enumerate(centroids)]
    totals = _totals(blocks, centroids, dims)
    inertia = {c: t[2] for c, t in totals.items()}
    everything = min(_LONG, sum(inertia.values()))
    listed = [",".join(map(str, c)) for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, nulls, values in _blocks(batches, dims):
            found, distance, _, _ = nearest(values, centroids)
            own = found.tolist()
            cells = [pa.array(ids, mask=nulls), pa.array(found.astype(np.int32)), pa.array([min(_LONG, d) for d in distance.tolist()], pa.int64())]
            cells += [pa.array([min(_LONG, inertia[c]) for c in own], pa.int64()), pa.array([everything] * len(own), pa.int64()), pa.array([listed[c] for c in own])]
            yield pa.RecordBatch.from_arrays(cells, ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return blocks.mapInArrow(run, out)


def digest(embeddings: DataFrame) -> DataFrame:
    """The result of the registered query."""
    r = cluster(embeddings)
    return r.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


_ASSIGNED = """{a} AS (
  SELECT r, vec_id, e, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.r, v.vec_id, v.e, m.c, CAST(list_sum(list_transform(list_zip(v.e, m.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, {m} m)
  GROUP BY r, vec_id, e
)"""
_MOVED = """{m} AS (
  SELECT o.c, coalesce(n.e, o.e) AS e
  FROM {o} o LEFT JOIN (
    SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY k) AS e
    FROM (SELECT c, k, CAST(sum(e[k]) AS DOUBLE) AS s, count(*) AS n FROM {a}, range(1, 65) t(k) GROUP BY c, k)
    GROUP BY c
  ) n USING (c)
)"""
_STEPS = ",\n".join(_ASSIGNED.format(a=f"a{i}", m=f"m{i}") + (",\n" + _MOVED.format(m=f"m{i + 1}", o=f"m{i}", a=f"a{i}") if i < ROUNDS else "") for i in range(ROUNDS + 1))

#: Sums of some hundred small integers are exact in doubles, and so is floor of their mean here.
ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), m0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS INTEGER) AS c, e
  FROM v WHERE vec_id IS NOT NULL QUALIFY c < 16
),
{_STEPS}
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m3.e, ',')) AS centroid_sha256
FROM a3 JOIN m3 USING (c)
"""
