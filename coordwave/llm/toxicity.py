"""Toxicity by compression distance: windows of text under a dictionary of ordinary and one of toxic text.

Both zstandard dictionaries are trained by the library's trainer on labelled documents: the ordinary one on windows
of ordinary documents, the toxic one on those windows of toxic documents that hold what makes them toxic. Most of a
toxic document is ordinary text, so these are the words that many more toxic than ordinary documents have, each with
its neighbours. A window's length under the ordinary dictionary alone is compared with that under both, the toxic
one behind, so that both sides know ordinary text alike. A document's features are the differences of its windows:
the largest, the three largest, and the sum over the root of their number. A logistic curve fitted to other labelled
documents turns them into the score, and the threshold is calibrated on that.

Fitting uses at most SAMPLE labelled documents of each class, those least by a hash of their id among texts of
up to SAMPLE_CHARS characters, and runs on the driver in bounded memory. Every text is scored whole, window by
window, so a very long one needs memory for its bytes and a number a window.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, held_out, slices, small_batches

SAMPLE = 3000
SAMPLE_CHARS = 20_000
#: Bytes in a window, and from one window's start to the next.
WINDOW, STEP = 64, 32
ORDINARY_BYTES, TOXIC_BYTES = 32 << 10, 2 << 10
#: The trainer's segments for the toxic dictionary: bytes in a segment, and in the pieces that it counts.
SEGMENT, PIECE = 24, 8
#: Words taken on either side of a typical one.
AROUND = 1
LEVEL = 3
#: Standard errors by which a word's share of toxic documents exceeds its share of ordinary ones.
TYPICAL = 6.0
LEAST_DOCUMENTS = 5
THRESHOLD = 0.3


def windows(data: bytes) -> Iterator[bytes]:
    return (data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP))


def _one_of_each(texts: list[bytes]) -> list[bytes]:
    """The texts without near copies: one for each least hash of four neighbouring words."""
    found: dict[int, bytes] = {}
    for text in texts:
        words = text.split()
        found.setdefault(min(zlib.crc32(b" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))), text)
    return list(found.values())


def typical_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    many, few = len(toxic), len(ordinary)
    one, two = Counter(w for t in toxic for w in set(t.split())), Counter(w for t in ordinary for w in set(t.split()))
    found = set()
    for word, a in one.items():
        b = two[word]
        share = (a + b + 1) / (many + few + 2)
        if a >= LEAST_DOCUMENTS and a / many - b / few > TYPICAL * math.sqrt(share * (1 - share) * (1 / many + 1 / few)):
            found.add(word)
    return found


def toxic_windows(texts: list[bytes], typical: set[bytes]) -> list[bytes]:
    """Each typical word of the texts with its neighbours."""
    split = [t.split() for t in texts]
    return [b" " + b" ".join(ws[max(0, i - AROUND) : i + AROUND + 1]) + b" " for ws in split for i, w in enumerate(ws) if w in typical]


def _trained(size: int, samples: list[bytes], **how) -> bytes:
    """A dictionary; of too few samples for the trainer, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # of the three features, then the constant

    def scorer(self):
        def compressor(content: bytes):
            with_dict = zstandard.ZstdCompressionDict(content or b"\0")
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            with_dict.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=with_dict, compression_params=parameters).compress

        plain, toxic = compressor(self.ordinary), compressor(self.ordinary + self.toxic)

        def features(text: str) -> tuple[float, float, float]:
            gains = [len(plain(w)) - len(toxic(w)) for w in windows(text.lower().encode())]
            best = sorted(gains, reverse=True)[:3]
            return float(min(best[0], 16)), float(min(sum(best), 32)), sum(g - 1 for g in gains if g > 1) / math.sqrt(len(gains))

        return features

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)))


def fit(texts: list[tuple[str, int]]) -> Model | None:
    """A model of (text, 1 toxic or 0 ordinary); None if either class is missing."""
    toxic, ordinary = ([t for t, y in texts if y == k] for k in (1, 0))
    if not toxic or not ordinary:
        return None
    # Two thirds of each class make the dictionaries, the others the curve (all, where there are few).
    for_words, for_curve = ([[t for i, t in enumerate(c) if (i % 3 == 2) == k or len(c) < 6] for c in (toxic, ordinary)] for k in (False, True))
    one, two = (_one_of_each([t.lower().encode() for t in c]) for c in for_words)
    ordinary_dictionary = _trained(ORDINARY_BYTES, [w for t in two for w in windows(t)])
    toxic_dictionary = _trained(TOXIC_BYTES, toxic_windows(one, typical_words(one, two)), k=SEGMENT, d=PIECE, level=LEVEL)
    model = Model(ordinary_dictionary, toxic_dictionary, (0.0,) * 4)
    features = model.scorer()
    x = np.array([features(t) for c in for_curve for t in c])
    y = np.repeat([1.0, 0.0], [len(c) for c in for_curve])
    x1 = np.column_stack((x, np.ones(len(x))))
    weights = np.zeros(4)
    for _ in range(50):  # Newton's steps for the logistic curve with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x1 @ weights, -30, 30)))
        penalty = np.diag([1e-2] * 3 + [1e-6])
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + penalty, x1.T @ (y - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.ordinary, model.toxic, tuple(weights.tolist()))


def training_texts(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The labelled sample, without held-out documents, in an order that depends on nothing but ids and texts.

    An id with several labels is toxic if one of them is. Null ids, labels and texts are left out.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"), 4, 2))
    one = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Twice the sample, as some ids have no text or a long one; a fixed number of ids, so they may be broadcast.
    ids = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE) for k in (0, 1)]
    chosen = ids[0].unionByName(ids[1])
    texts = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id")
    best = [texts.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE) for k in (0, 1)]
    return [(r["text"], r["toxic"]) for r in best[0].unionByName(best[1]).collect()]


def score_documents(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of docs and the score, 0 to 1; 0 for all without a model. Null and empty texts are scored as one
    empty window. Rows are independent, so rows that repeat a text have equal scores."""
    out = free_name(docs, out)
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    at, names = docs.columns.index(text_col), [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = model.scorer()
        for batch in (part for whole in batches for part in slices(whole, at)):
            found = model.score(np.array([features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=names)

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of the registered query. Labels of one class only, or none, leave no model: every score is 0."""
    docs = docs.select("doc_id", "text")
    found = score_documents(docs, fit(training_texts(docs, labels)))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
