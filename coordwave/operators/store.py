"""A versioned store of tables and backups of them, on any file system that Spark can write to.

The driver handles names, revisions and hashes of hashes; rows are written, read and hashed by tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row hashes in a leaf of a table's tree, about.
LEAF_ROWS = 4096
FORMAT, VERSION = "coordwave-backup", 2


class StaleRevision(Exception):
    """A commit expected another revision than the current one."""


class BrokenBackup(Exception):
    """What a backup says of itself doesn't hold."""


class _Folder:
    """Small files below a URI, through Spark's Hadoop file systems."""

    def __init__(self, spark: SparkSession, uri: str):
        self.uri, self._jvm = uri.rstrip("/"), spark._jvm
        self._path = lambda name: self._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, name: str) -> list[str]:
        path = self._path(name)
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one. Of several that try at once one succeeds: by the file system's create
        without overwriting, and on a local one by the operating system's."""
        path = self._path(name)
        self._fs.mkdirs(path.getParent())
        if self._fs.getUri().getScheme() == "file":
            draft = f"{path.toUri().getPath()}-{uuid.uuid4().hex}.draft"
            with open(draft, "x", encoding="utf-8") as out:
                out.write(text)
            try:
                os.link(draft, path.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        try:
            stream = self._fs.create(path, False)
        except Exception as error:
            if self._fs.exists(path):
                return False
            raise error
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True


class SnapshotStore:
    """Tables by revision below one URI. A commit writes its tables first, then creates the file of its revision,
    which only one writer can; a commit that fails leaves no trace there."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.folder = spark, _Folder(spark, uri)

    def revision(self) -> int:
        return max((int(n.removesuffix(".json")) for n in self.folder.names("revisions") if n.removesuffix(".json").isdigit()), default=0)

    def commit(self, tables: dict[str, DataFrame], expected: int) -> int:
        if expected != self.revision():
            raise StaleRevision(f"expected {expected}, found {self.revision()}")
        data = f"data/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder.uri}/{data}/{name}")
        if not self.folder.create(f"revisions/{expected + 1}.json", json.dumps({"data": data, "tables": sorted(tables)})):
            raise StaleRevision(f"revision {expected + 1} was committed meanwhile")
        return expected + 1

    def tables(self, revision: int | None = None) -> dict[str, DataFrame]:
        at = json.loads(self.folder.read(f"revisions/{revision or self.revision()}.json"))
        return {name: self.spark.read.parquet(f"{self.folder.uri}/{at['data']}/{name}") for name in at["tables"]}

    def read(self, name: str, revision: int | None = None) -> DataFrame:
        return self.tables(revision)[name]


def row_hashes(df: DataFrame) -> DataFrame:
    """(h): the sha256 of each row as JSON with its columns in order of name; a null value is left out, as is its column."""
    return df.select(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256).alias("h"))


def table_hash(df: DataFrame) -> tuple[int, str]:
    """The number of rows and the root of a tree over their hashes: leaves are the sorted hashes that begin alike, as many
    digits as the number of rows asks for; each level above joins sixteen. Rows that repeat count; their order doesn't."""
    hashes = row_hashes(df)
    rows = hashes.count()
    digits = 0
    while 16**digits * LEAF_ROWS < rows:
        digits += 1
    level = hashes.groupBy(F.substring("h", 1, digits).alias("prefix")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    for k in range(digits - 1, -1, -1):
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "h"))), lambda x: F.concat(x["prefix"], x["h"])), "")
        level = level.groupBy(F.substring("prefix", 1, k).alias("prefix")).agg(F.sha2(joined, 256).alias("h"))
    root = level.first()
    return rows, root["h"] if root else hashlib.sha256(b"").hexdigest()


def backup(tables: dict[str, DataFrame], uri: str) -> dict:
    """K4: writes tables below a URI that holds no backup, and last a manifest: of each table its rows, tree hash and schema,
    and a hash over all that. No row passes the driver."""
    spark = next(iter(tables.values())).sparkSession
    listed = {}
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{uri.rstrip('/')}/{name}")
        rows, root = table_hash(spark.read.parquet(f"{uri.rstrip('/')}/{name}"))
        listed[name] = {"rows": rows, "hash": root, "schema": df.schema.json()}
    manifest = {"format": FORMAT, "version": VERSION, "tables": listed, "sha256": _signed(listed)}
    if not _Folder(spark, uri).create("manifest.json", json.dumps(manifest)):
        raise FileExistsError(f"{uri} holds a backup")
    return manifest


def _signed(listed: dict) -> str:
    return hashlib.sha256(json.dumps(listed, sort_keys=True).encode()).hexdigest()


def restore(spark: SparkSession, uri: str) -> dict[str, DataFrame]:
    """The tables of a backup, all checked: format and version, the manifest's own hash, and each table's rows and tree hash.
    The first thing that doesn't hold is raised."""
    manifest = json.loads(_Folder(spark, uri).read("manifest.json"))
    if manifest.get("format") != FORMAT or manifest.get("version") != VERSION:
        raise BrokenBackup("format or version")
    if manifest.get("sha256") != _signed(manifest["tables"]):
        raise BrokenBackup("manifest")
    found = {}
    for name, said in manifest["tables"].items():
        found[name] = spark.read.parquet(f"{uri.rstrip('/')}/{name}")
        if table_hash(found[name]) != (said["rows"], said["hash"]):
            raise BrokenBackup(name)
    return found
