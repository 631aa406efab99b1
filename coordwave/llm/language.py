"""Language identification by language-bitmask n-gram filters.

Bit-sliced Bloom filters: one array of slots, each an integer with a bit for each language. An n-gram of a
language sets its bit in PROBES slots; the bits that all slots of an n-gram share name every language that has
it. An n-gram is kept for the languages in which it is frequent, so n-grams that all languages use say nothing.
A text's n-grams are looked up at once, the bits counted by language, and each count is corrected for the false
positives that the language's filter gives; the highest share decides.

Fitting uses at most SAMPLE texts a language, those least by a hash of their id among texts of up to SAMPLE_CHARS
characters, and runs on the driver in bounded memory. Every text is classified whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, held_out, learning_rows, slices, small_batches

SAMPLE = 600
SAMPLE_CHARS = 20_000
#: Bytes in an n-gram, slots (a power of two), probes for each n-gram.
GRAM = 4
SLOTS = 1 << 18
PROBES = 2
#: N-grams kept for each language, and by how much its share of an n-gram must exceed the others' mean share.
KEPT = 8000
RATIO = 2.0
#: Languages that a model may have (more are an error).
MOST_LANGUAGES = 256
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """A hash of each n-gram of the text's bytes in lower case, with white space and ASCII non-letters as one blank."""
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    keep = letter | np.concatenate(([True], letter[:-1]))
    data = np.where(letter, raw, 32)[keep].astype(np.uint64)
    if len(data) < GRAM:
        return np.empty(0, np.uint64)
    h = np.zeros(len(data) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = h << np.uint64(8) | data[k : k + len(h)]
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def slots_of(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    slices: np.ndarray  # slots by words of 64 languages
    false_positives: np.ndarray  # by language

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language and its corrected share of n-grams; `und` for a text without a letter, the first language with
        score 0 for one with letters but no n-gram."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        hashes = grams(text)
        if not len(hashes):
            return self.languages[0], 0.0
        hits = self.slices[slots_of(hashes)[0]]
        for where in slots_of(hashes)[1:]:
            hits = hits & self.slices[where]
        counts = np.array([np.count_nonzero(hits[:, k // 64] & np.uint64(1 << k % 64)) for k in range(len(self.languages))])
        shares = np.clip((counts / len(hashes) - self.false_positives) / (1 - self.false_positives), 0, 1)
        best = int(np.argmax(shares))  # the first in order of name, if equal
        return self.languages[best], float(shares[best])


def fit(texts: list[tuple[str, str]]) -> Filters:
    """Filters of (text, language)."""
    languages = tuple(sorted({lang for _, lang in texts}))
    width = max(1, -(-len(languages) // 64))
    slices = np.zeros((SLOTS, width), np.uint64)
    if not languages:
        return Filters(languages, slices, np.empty(0))
    hashes = {lang: np.concatenate([grams(t) for t, x in texts if x == lang] or [np.empty(0, np.uint64)]) for lang in languages}
    known = np.unique(np.concatenate(list(hashes.values())))
    shares = np.zeros((len(languages), len(known)))
    for k, lang in enumerate(languages):
        found, n = np.unique(hashes[lang], return_counts=True)
        shares[k, np.searchsorted(known, found)] = n / max(1, n.sum())
    total = shares.sum(axis=0)
    for k in range(len(languages)):
        others = (total - shares[k]) / max(1, len(languages) - 1)
        typical = np.flatnonzero((shares[k] > 0) & (shares[k] > RATIO * others))
        kept = known[typical[np.argsort(-shares[k, typical], kind="stable")[:KEPT]]]
        for where in slots_of(kept):
            slices[where, k // 64] |= np.uint64(1 << k % 64)
    used = np.array([np.count_nonzero(slices[:, k // 64] & np.uint64(1 << k % 64)) for k in range(len(languages))]) / SLOTS
    return Filters(languages, slices, used**PROBES)


def training_texts(docs: DataFrame) -> list[tuple[str, str]]:
    """The sample of each language, without held-out documents; rows with a null id, text or language are left out."""
    learned = docs.where(~held_out(F.col("doc_id"), 3, 1)).select(F.col("doc_id").alias("id"), "text", "lang")
    return learning_rows(learned, "lang", SAMPLE, SAMPLE_CHARS, MOST_LANGUAGES)


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", out: str = "language") -> DataFrame:
    """All columns of docs and a struct `out`: lang (`und` for null and for texts without a letter) and score, 0 to 1.

    Of languages with equal shares the first by name is given. Rows are independent. A very long text takes memory for
    a few numbers an n-gram.
    """
    out = free_name(docs, out)
    at, names = docs.columns.index(text_col), [*docs.columns, out]
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (part for whole in batches for part in slices(whole, at)):
            found = [dict(zip(("lang", "score"), own.classify(t.as_py()), strict=True)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=names)

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))]))


def predictions(docs: DataFrame) -> DataFrame:
    """The result of the registered query."""
    found = identify(docs.select("doc_id", "text"), fit(training_texts(docs.select("doc_id", "text", "lang"))))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
