"""Mixing to target weights by soft membership and projected-gradient least squares.

A multinomial classifier over hashed n-grams, fitted to labelled documents, gives each document a probability for
each domain. Document rates r (how often to take a document, 1 is once) should make the expected tokens of each
domain, the sum of r * tokens * probability, meet its target. The rates start at 1 and follow the gradient of
the squared relative misses, weighted so that a step of 1 is stable; negative rates are set to 0. A step needs
only the misses, one number a domain, so the rates are an expression over stored probabilities, and each round is
one aggregation over all documents; every WRITTEN rounds the rates are stored too. Sums are taken over integers, so
results don't depend on partitions.

Unless targets are given, they are the corpus's expected shares to the power TEMPER, at a total at which no
domain has to shrink: rates then repeat documents of small domains and drop none.

Fitting the classifier uses at most SAMPLE labelled texts a domain, those least by a hash of their id among texts
of up to SAMPLE_CHARS characters. Everything else covers all documents and whole texts.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, learning_rows, materialise, slices, small_batches
from .language import grams

SAMPLE = 400
SAMPLE_CHARS = 20_000
FEATURES = 1 << 15
TEMPER = 0.7
ROUNDS = 60
#: Rounds after which the rates so far are written, so that their expression stays short.
WRITTEN = 8
#: Domains that a model may have (more are an error).
MOST_DOMAINS = 256
TOLERANCE = 1e-6
#: Probabilities and rates are rounded to these decimals.
DIGITS, RATE_DIGITS = 6, 6


def _features(text: str) -> np.ndarray:
    return (grams(text) >> np.uint64(13)).astype(np.int64) & (FEATURES - 1)


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    weights: np.ndarray  # features by domains: log probabilities, scaled
    prior: np.ndarray

    def posteriors(self, text: str | None) -> np.ndarray:
        """The probability of each domain; the prior for texts without n-grams."""
        at = _features(text or "")
        logit = np.log(self.prior) + (self.weights[at].mean(axis=0) if len(at) else 0)
        e = np.exp(logit - logit.max())
        return e / e.sum()


def fit(texts: list[tuple[str, str]]) -> Classifier | None:
    """A classifier of (text, domain); None without texts. The scale of its mean log probabilities is the one of a
    few that gives every other text, which it was then not fitted to, the greatest likelihood."""
    domains = tuple(sorted({d for _, d in texts}))
    if not domains:
        return None
    number = {d: k for k, d in enumerate(domains)}

    def counted(rows):
        counts = np.zeros((FEATURES, len(domains)))
        for text, d in rows:
            counts[:, number[d]] += np.bincount(_features(text), minlength=FEATURES)
        smoothed = counts + 0.5
        return np.log(smoothed / smoothed.sum(axis=0))

    share = np.array([sum(d == x for _, d in texts) for x in domains]) / len(texts)
    half, rest = texts[::2], texts[1::2]
    first = counted(half)
    best = max((5.0, 10.0, 20.0, 40.0, 80.0), key=lambda s: sum(float(np.log(Classifier(domains, s * first, share).posteriors(t)[number[d]] + 1e-12)) for t, d in rest))
    return Classifier(domains, (best * counted(texts)).astype(np.float32), share)


def training_texts(docs: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, str]]:
    """The sample of each domain, in an order that depends on ids and texts alone; null ids, texts and domains are left out."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(domain_col).cast("string").alias("domain"))
    return learning_rows(named, "domain", SAMPLE, SAMPLE_CHARS, MOST_DOMAINS)


def memberships(docs: DataFrame, classifier: Classifier | None, text_col: str = "text", out: str = "soft") -> DataFrame:
    """All columns of docs and a struct `out`: tokens (words of the text) and p, the probability of each domain."""
    out = free_name(docs, out)
    at, names = docs.columns.index(text_col), [*docs.columns, out]
    kind = pa.struct([("tokens", pa.int64()), ("p", pa.list_(pa.float64()))])
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # FEATURES by domains

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (part for whole in batches for part in slices(whole, at)):
            found = [{"tokens": len((t := x.as_py() or "").encode().split()), "p": own.posteriors(t).round(DIGITS).tolist() if own else []} for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=names)

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StructType([T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]))]))


def _totals(soft: DataFrame, rate: Column, domains: int, out: str) -> np.ndarray:
    """Expected tokens of each domain at these rates, in thousandths, summed as integers."""
    each = soft.select((rate * F.col(out)["tokens"]).alias("weight"), F.posexplode(F.col(out)["p"]).alias("k", "p"))
    sums = each.groupBy("k").agg(F.sum(F.round(F.col("weight") * F.col("p") * 1000).cast("decimal(38,0)")).alias("s"))
    found = {r["k"]: int(r["s"] or 0) / 1000 for r in sums.collect()}  # a row a domain
    return np.array([found.get(k, 0.0) for k in range(domains)])


def tempered(totals: np.ndarray) -> np.ndarray:
    """Target tokens: shares to the power TEMPER, at the least total at which no domain shrinks."""
    wanted = np.where(totals > 0, totals, 0) ** TEMPER
    wanted = wanted / max(wanted.sum(), 1e-300)
    return wanted * max((t / w for t, w in zip(totals, wanted, strict=True) if w > 0), default=0.0)


def fit_rates(soft: DataFrame, domains: int, targets=None, out: str = "soft") -> tuple[DataFrame, list[float], list[float]]:
    """soft with `rate` and `miss` in its struct `out`, the targets, and the expected tokens that the rates give.

    miss is the same in every row: the greatest difference between a domain's expected tokens and its target, as a
    share of the domain's tokens. It stays above TOLERANCE where no rates of 0 or more meet the targets (texts that
    aren't of one domain alone can't be weighted apart), or where ROUNDS didn't do; a warning then says so.
    """
    field = lambda r, miss=None: F.col(out).withField("rate", r) if miss is None else F.col(out).withField("rate", r).withField("miss", F.lit(miss))
    one = F.lit(1.0)
    if not domains:
        return soft.withColumn(out, field(one, 0.0)), [], []
    start = _totals(soft, one, domains, out)
    goal = tempered(start) if targets is None else np.array(targets, float) / np.sum(targets) * start.sum()
    scale = np.where(start > 0, start, 1.0)
    p, rate, totals = F.col(out)["p"], one, start
    for k in range(1, ROUNDS + 1):
        miss = (totals - goal) / scale
        if np.abs(miss[start > 0]).max(initial=0) < TOLERANCE:
            break
        step = F.aggregate(F.zip_with(p, F.lit(miss.tolist()), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        rate = F.greatest(F.lit(0.0), rate - step)
        if k % WRITTEN == 0:
            soft = materialise(soft.withColumn(out, field(rate)), "rates")
            rate = F.col(out)["rate"]
        totals = _totals(soft, rate, domains, out)
    miss = float(np.abs((totals - goal) / scale)[start > 0].max(initial=0))
    if miss >= TOLERANCE:
        warnings.warn(f"rates miss a domain's target by {miss:.3g} of its tokens", stacklevel=2)
    return soft.withColumn(out, field(F.round(rate, RATE_DIGITS), miss)), goal.tolist(), totals.tolist()


def copies(rate: Column, id_col: Column) -> Column:
    """A whole number of copies: the rate, rounded up for as large a part of all ids as its fraction says."""
    chance = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, domain_col: str, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", out: str = "mix") -> DataFrame:
    """All columns of docs and a struct `out`: tokens, p (by domain in order of name), rate, miss (see
    fit_rates), copies.

    targets: relative weights of domains (unnamed ones 0) at the present total. Documents of all ids, null and
    repeated ones included, have a rate. Without labelled documents every rate is 1. An empty table stays empty.
    """
    out = free_name(docs, out)
    classifier = fit(training_texts(docs, domain_col, id_col, text_col))
    domains = classifier.domains if classifier else ()
    soft = materialise(memberships(docs, classifier, text_col, out), "soft")
    rated, _, _ = fit_rates(soft, len(domains), [targets.get(d, 0.0) for d in domains] if targets else None, out)
    return rated.withColumn(out, F.col(out).withField("copies", copies(F.col(out)["rate"], F.col(id_col))))


def repeat_rows(mixed: DataFrame, out: str = "mix") -> DataFrame:
    """Each row as often as its copies say, without the struct."""
    names = [c for c in mixed.columns if c != out]
    index = free_name(mixed, "copy")
    several = F.when(F.col(out)["copies"] > 0, F.sequence(F.lit(1), F.col(out)["copies"])).otherwise(F.array().cast("array<int>"))
    return mixed.select("*", F.explode(several).alias(index)).select(names)


def rates(docs: DataFrame) -> DataFrame:
    """The result of the registered query: tokens, probabilities and rate of each document; domains are languages."""
    classifier = fit(training_texts(docs, "lang"))
    n = len(classifier.domains) if classifier else 0
    soft = materialise(memberships(docs.select("doc_id", "text"), classifier).select("doc_id", "soft"), "soft")
    rated, _, _ = fit_rates(soft, n)
    return rated.select("doc_id", F.col("soft.tokens").alias("n_tokens"), F.col("soft.p").alias("posteriors"), "soft.rate", F.round("soft.miss", 9).alias("miss"), copies(F.col("soft.rate"), F.col("doc_id")).alias("copies"))
