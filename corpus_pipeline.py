"""A corpus pipeline of five of the operators, each stage on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes each result to the shared folder and
reads it back as the next stage's documents. All stages but the last return the columns of `documents`.

quality      documents whose base statistics or log-likelihood ratio fail go
simhash      documents at least 0.8 like one of smaller id, by their five-word shingles, go (the SimHash index and MinHash find them)
suffix       bytes of strings that a document of smaller id has go; characters cut by this go whole
mixing       documents are repeated as often as their rate says; rates are 1 or more, so none goes
encoding     token ids of each remaining text, decoded again

Null texts are empty and fail the quality rules; documents with a null id stay unless one with an id is like them.
Columns that `documents` doesn't have by contract pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordwave.llm import byte_bpe, mixing, quality, simhash, suffix_dedup
from coordwave.llm.common import free_name, materialise, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality rules keep, as they are."""
    ratios = quality.log_ratios(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, ratios)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops near copies: groups of the SimHash index, and bands of minima for the pairs whose fingerprints differ in more than
    its two bits (most pairs with a similarity of 0.8), are candidates that the whole sets of shingles decide."""
    return simhash.keep_first(docs, width=5, similarity=0.8)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings out of texts; n_chars, where there is one, follows. Texts without a cut stay as they are."""
    out = free_name(docs, "repeats")
    cut = suffix_dedup.remove_repeats(docs, out=out)
    text = F.when(F.col(out)["n_removed"] > 0, _whole_characters(F.col("text"), F.col(out)["spans"])).otherwise(F.col("text"))
    kept = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def _whole_characters(text, spans):
    """A text without its spans of bytes. A span that starts or ends inside a character takes the whole character;
    what it doesn't touch, U+FFFD too, stays."""
    data = text.cast("binary")
    # What stays before a cut may end with the beginning of a character, and what stays behind one may begin with the
    # rest of one, up to three bytes each.
    first = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    last = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(data).cast("long")))

    def piece(bounds):
        a, b = bounds["0"], bounds["1"]
        raw = F.hex(F.substring(data, (a + 1).cast("int"), (b - a).cast("int")))
        behind = F.when(a > 0, F.regexp_replace(raw, "^(?:[89AB][0-9A-F]){1,3}", "")).otherwise(raw)
        return F.when(b < F.octet_length(data), F.regexp_replace(behind, "(?:[CDEF][0-9A-F]|E[0-9A-F][89AB][0-9A-F]|F[0-9A-F](?:[89AB][0-9A-F]){1,2})$", "")).otherwise(behind)

    pieces = F.transform(F.arrays_zip(first.alias("0"), last.alias("1")), piece)
    return F.unhex(F.array_join(pieces, "")).cast("string")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of domains (languages) whose expected tokens are under their tempered target."""
    out = free_name(docs, "mix")
    return mixing.repeat_rows(mixing.mix(docs, "lang", out=out), out)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; rows that mixing repeats are repeated here."""
    return byte_bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, byte_bpe.SMALL_TABLES)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level bpe", encoding_stage),
]

#: SQL can't express hashed n-gram ratios, shingles or merges; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result on `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
