"""Quality rules: word and line statistics, and a hashed n-gram log-likelihood ratio of trusted text against the corpus.

Everything on the main path is a DataFrame expression. Words and pairs of words are hashed into buckets, whose number
grows with the corpus; the raw multinomial counts them over all documents, the target's over documents that labels
call good. A document's score is the mean, over its n-grams, of the logarithm of the ratio of the two (smoothed)
probabilities; it is kept if its base statistics pass and the score is at least THRESHOLD. Counts are exact, so
scores depend on nothing but the tables. No step shuffles texts while the good documents' ids are few enough to be
sent to all executors.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

#: Buckets of small corpora; see buckets_for.
LEAST_BUCKETS = 1 << 14
#: Ids of good documents (8 bytes each) that are sent to all executors; they are counted first, and joined beyond.
BROADCAST_IDS = 500_000
#: Natural logarithm; text like the target scores above 0, lists, shouting and symbol noise from -0.1 down.
THRESHOLD = -0.1
#: Words added to each bucket of both multinomials, at the corpus's scale of the target: the prior is the corpus.
SMOOTHING = 20.0
_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "[#*$%&|<>]"


def _words(text: Column) -> Column:
    """The words of a text: runs of characters other than space and \\t to \\r (null or blank: none)."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))


def _grams(words: str, buckets: int) -> Column:
    """Bucket numbers of all words and of all pairs of neighbours."""
    w = F.col(words)
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    pair = F.transform(
        F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.pmod(F.xxhash64(F.get(w, i - 1), F.get(w, i)), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, pair)


def buckets_for(docs: DataFrame, text_col: str = "text") -> int:
    """The power of two next to the root of the corpus's bytes, as the number of different n-grams grows: 2^15 for a
    gigabyte of text, 2^24 (128 MB of ratios in each executor) for 100 TB."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(max(1, size)) / 2))


def _counts(docs: DataFrame, text_col: str, buckets: int, name: str) -> DataFrame:
    words = docs.select(_words(F.col(text_col)).alias("words"))
    return words.select(F.explode(_grams("words", buckets)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias(name))


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float] | None:
    """The log ratio of each bucket, from counts over all documents; None if no labelled text is good.

    labels: (doc_id, quality); 1 is good. An id with several labels is good if one of them is; each row with a good
    id counts. Ids without a document and null ids count for nothing.
    """
    spark, buckets = docs.sparkSession, buckets_for(docs, text_col)
    good = materialise(labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good")).distinct(), "good")
    if good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    target = _counts(named.join(good, F.col("id") == F.col("good"), "left_semi"), "text", buckets, "target")
    counts = materialise(_counts(docs, text_col, buckets, "raw").join(target, "gram", "left"), "grams")
    sums = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if not sums["target"]:
        return None
    share = sums["target"] / sums["raw"]
    ratio = F.log((F.coalesce("target", F.lit(0)) + SMOOTHING) / (share * F.coalesce("raw", F.lit(0)) + SMOOTHING))
    every = spark.range(buckets).join(counts, F.col("id") == F.col("gram"), "left").select("id", ratio.alias("ratio"))
    row = every.agg(F.sort_array(F.collect_list(F.struct("id", "ratio"))).alias("listed")).select(F.transform("listed", lambda x: x["ratio"]).alias("ratios")).first()
    return row["ratios"]  # buckets numbers


def assess(docs: DataFrame, ratios: list[float] | None, text_col: str = "text", out: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs and a struct `out`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, score (double, null without ratios; 0 for a text without words), kept.

    Null text has no words and no lines. Rows are independent: repeated rows get equal results.
    """
    out = free_name(docs, out)
    names = {}
    for base in ("words", "grams", "windows", "sorted", "repeats"):
        names[base] = free_name(docs, f"{out}_{base}")
    w, windows, order, repeats = (F.col(names[x]) for x in ("words", "windows", "sorted", "repeats"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select("*", _words(F.col(text_col)).alias(names["words"]))
    hashes = F.transform(
        F.when(F.size(w) > 2, F.sequence(F.lit(2), F.size(w) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(w, i - 2), F.get(w, i - 1), F.get(w, i)),
    )
    step = step.select("*", hashes.alias(names["windows"]), _grams(names["words"], len(ratios or [0])).alias(names["grams"]))
    # Windows found again stand next to each other when sorted; most texts have none and aren't sorted.
    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    step = step.select("*", F.when(some, F.sort_array(pairs)).otherwise(F.lit(None)).alias(names["sorted"]))
    again = F.filter(order, lambda x, k: (F.get(order, k - 1)["h"] == x["h"]) | F.coalesce(F.get(order, k + 1)["h"] == x["h"], F.lit(False)))
    step = step.select("*", F.sort_array(F.transform(again, lambda x: x["i"])).alias(names["repeats"]))
    covered = F.aggregate(
        repeats,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0)
    names["lines"] = free_name(docs, f"{out}_lines")
    step = step.select("*", lines.alias(names["lines"]))
    n_words = F.size(w).cast("long")
    n_repeat = F.coalesce(covered, F.lit(0).cast("long"))
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    if ratios is None:
        score = F.lit(None).cast("double")
    else:
        table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
        grams = F.col(names["grams"])
        score = F.coalesce(F.try_divide(F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, g)), F.size(grams)), F.lit(0.0))
    first = F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(F.col(names["lines"])) - F.size(F.array_distinct(F.col(names["lines"])))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        score.alias("score"),
    )
    # A condition on the result would be pushed below what it is made of, and words split again for each use of
    # them; it isn't pushed below a column that depends on a row's place.
    mark = free_name(docs, f"{out}_mark")
    step = step.select(*docs.columns, first.alias(out), F.monotonically_increasing_id().alias(mark)).where(F.col(mark) >= 0).drop(mark)
    q = F.col(out)
    fits = F.coalesce(q["score"] >= threshold, F.lit(True))
    return step.withColumn(out, q.withField("kept", ~q["base_failed"] & fits))


def keep_good(docs: DataFrame, ratios: list[float] | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, as they are."""
    out = free_name(docs, "verdict")
    return assess(docs, ratios, text_col, out).where(F.col(out)["kept"]).select(docs.columns)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result of the registered query."""
    docs = docs.select("doc_id", "text")
    found = assess(docs, log_ratios(docs, labels))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return found.select("doc_id", *[F.col("quality")[f].alias(f) for f in fields])
