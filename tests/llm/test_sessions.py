"""Operators leave the caller's session as it is."""

from coordwave.llm import queries, simhash
from coordwave.llm.common import small_batches


def test_settings_stay_as_they_are(spark, small):
    def settings():
        return {r.key: r.value for r in spark.sql("SET").collect()}

    before = settings()
    assert queries.op5_bitmask_language(spark, small).count() == 200
    found = simhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string"))
    assert found.join(spark.range(5), "id").count() == 2
    assert settings() == before


def test_small_batches(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = spark.range(0, 2500, 1, 1)
    assert [r.n for r in small_batches(rows).mapInArrow(sizes, "n long").collect()] == [1000, 1000, 500]
    assert [r.n for r in rows.mapInArrow(sizes, "n long").collect()] == [2500]
