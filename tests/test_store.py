"""The store of snapshots and backups below a file: URI."""

import hashlib
import json
import threading

import pytest
from coordwave.operators import review, store
from pyspark.sql import functions as F


def test_revisions(spark, tmp_path):
    s = store.SnapshotStore(spark, tmp_path.as_uri())
    one, two = spark.range(3), spark.range(5)
    assert s.revision() == 0 and s.commit({"w": one}, 0) == 1 and s.commit({"w": two, "p": one}, 1) == 2
    with pytest.raises(store.StaleRevision):
        s.commit({"w": one}, 1)
    assert s.revision() == 2 and s.read("w").count() == 5 and s.read("w", 1).count() == 3 and sorted(s.tables()) == ["p", "w"]


def test_two_writers_of_one_revision(spark, tmp_path):
    """Both see revision 0 and write their tables; one of them creates revision 1."""
    out, gate = [], threading.Barrier(2)

    class Slow(store.SnapshotStore):
        def revision(self):
            found = super().revision()
            gate.wait(60)
            return found

    def write(n):
        try:
            out.append(Slow(spark, tmp_path.as_uri()).commit({"w": spark.range(n)}, 0))
        except store.StaleRevision:
            out.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in (2, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(out, key=str) == [1, None] and store.SnapshotStore(spark, tmp_path.as_uri()).read("w").count() in (2, 7)


def plain_hash(rows, digits):
    hashes = sorted(hashlib.sha256(json.dumps({k: v for k, v in sorted(r.items()) if v is not None}, separators=(",", ":")).encode()).hexdigest() for r in rows)
    level = {}
    for h in hashes:
        level.setdefault(h[:digits], []).append(h)
    level = {p: hashlib.sha256("".join(x).encode()).hexdigest() for p, x in level.items()}
    for k in range(digits - 1, -1, -1):
        above = {}
        for p in sorted(level):
            above.setdefault(p[:k], []).append(p + level[p])
        level = {p: hashlib.sha256("".join(x).encode()).hexdigest() for p, x in above.items()}
    return level.get("", hashlib.sha256(b"").hexdigest())


def test_tree_hash(spark, monkeypatch):
    rows = [{"b": i % 40, "a": None if i % 7 == 0 else f"x{i % 50}"} for i in range(400)]
    frame = spark.createDataFrame([(r["b"], r["a"]) for r in rows], "b long, a string")
    assert store.table_hash(frame) == (400, plain_hash(rows, 0)) == store.table_hash(frame.repartition(7).select("a", "b"))
    monkeypatch.setattr(store, "LEAF_ROWS", 4)
    assert store.table_hash(frame) == (400, plain_hash(rows, 2)) and store.table_hash(frame.limit(0)) == (0, plain_hash([], 0))
    assert store.table_hash(frame.where("b > 0")) != store.table_hash(frame)


def test_backups(spark, tmp_path):
    uri = (tmp_path / "b").as_uri()
    tables = {"w": spark.range(50).withColumn("x", F.col("id") % 3), "p": spark.range(0)}
    store.backup(tables, uri)
    found = store.restore(spark, uri)
    assert {n: sorted(map(tuple, d.collect())) for n, d in found.items()} == {n: sorted(map(tuple, d.collect())) for n, d in tables.items()}
    with pytest.raises(Exception):
        store.backup(tables, uri)
    manifest = json.loads((tmp_path / "b" / "manifest.json").read_text())
    spark.range(50).withColumn("x", F.col("id") % 4).write.mode("overwrite").parquet(f"{uri}/w")
    with pytest.raises(store.BrokenBackup, match="w"):
        store.restore(spark, uri)
    manifest["tables"]["w"]["rows"] = 51
    (tmp_path / "b" / "manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(store.BrokenBackup, match="manifest"):
        store.restore(spark, uri)


def test_same_rows(spark):
    assert review.same_rows(spark.range(3), spark.range(3)) and not review.same_rows(spark.range(3), spark.range(4))
