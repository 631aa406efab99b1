"""How many messages pass between the parts and shards of the removal of repeats."""

import pytest
from coordwave.llm import suffix_dedup
from pyspark.sql import functions as F


def test_messages_grow_as_the_texts_do():
    a, b = (suffix_dedup.parts_and_shards(n, 12) for n in (1 << 30, 4 << 30))
    assert b[0] * b[1] <= 4.1 * a[0] * a[1]
    assert 50 * 2**20 / suffix_dedup.parts_and_shards(50 << 20, 1)[0] <= suffix_dedup.PART_BYTES
    assert suffix_dedup.parts_and_shards(0, 7) == (7, suffix_dedup.LEAST_SHARDS)
    # A worker's part is bounded whatever the size.
    n = 100 << 40
    assert n / suffix_dedup.parts_and_shards(n, 1)[0] <= suffix_dedup.MOST_TIMES * suffix_dedup.PART_BYTES


@pytest.mark.parametrize("form", ["other columns", "copies"])
def test_parts_and_shards_follow_the_texts(spark, tmp_path, monkeypatch, form):
    """Files of a table with other columns are larger than its texts, those of one with copies smaller."""
    seen, report = [], suffix_dedup._report
    monkeypatch.setattr(suffix_dedup, "_report", lambda shards, *x: seen.append(shards) or report(shards, *x))
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    noise = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 512) for k in range(8)])
    text = F.substring(noise, 1, 1000) if form == "other columns" else F.lit("one text of many copies " * 42)
    docs = spark.range(0, 200, 1, 2).select(F.col("id").alias("doc_id"), text.alias("text"), *([noise.alias(f"extra{k}") for k in range(3)] if form == "other columns" else []))
    docs.write.parquet(str(tmp_path / "docs"))
    got = suffix_dedup.remove_repeats(spark.read.parquet(str(tmp_path / "docs"))).select("doc_id", "text", "repeats.kept").collect()
    n = sum(len(r.text) for r in got)
    assert seen == [-(-n // 2000)]
    assert len(got) == 200 and all(bytes(r.kept) == (b"" if form == "copies" and r.doc_id else r.text.encode()) for r in got)
