"""Versions of tables that several writers may change: a log of commits, tables in buckets, and tables that only grow.

A commit is a small file with the number of its version. It is created only if it is not there, whole or not at all, so of two writers
who both build on version n one gets n + 1 and the other starts again from it. Data files have names of their own and are never
changed: a commit that fails leaves files that nothing names, and old versions stay readable.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.sources.tables import STATE

#: Key and number of buckets of each table of the state; what the batches of a library touch is a small share of the buckets.
BUCKETS = {"faces": ("face_id", 16), "photos": ("photo_id", 16), "edges": ("photo_id", 16), "roots": ("face_id", 16), "persons": ("person_id", 4), "excluded": ("photo_id", 4), "meta": ("key", 1)}
#: Attempts of a writer before it gives up; each failure means that another writer has got on.
ATTEMPTS = 50


class Conflict(Exception):
    """Another writer has published since."""


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file, whole or not at all; False if one is there. A local folder takes a hard link, which is made only if the name is
    free; any other store the rename of its file system, which must not overwrite (HDFS does not)."""
    place = urlparse(path)
    if place.scheme in ("", "file"):
        name = unquote(place.path)
        os.makedirs(os.path.dirname(name), exist_ok=True)
        own = f"{name}.{uuid.uuid4().hex}.tmp"
        try:
            with open(own, "w", encoding="utf-8") as f:
                f.write(text)
            os.link(own, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(own)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    store = own.getFileSystem(conf)
    out = store.create(own)
    out.write(bytearray(text.encode()))
    out.close()
    done = store.rename(own, jvm.org.apache.hadoop.fs.Path(path))
    if not done:
        store.delete(own, False)
    return done


class Log:
    """Numbered commits in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self, glob: str = "*.json") -> DataFrame | None:
        try:
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", glob).load(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return files.withColumn("version", F.regexp_extract("path", r"([0-9]+)\.json$", 1).cast("long"))

    def latest(self) -> int:
        files = self._files()
        found = None if files is None else files.agg(F.max("version").alias("v")).first()["v"]
        return -1 if found is None else found

    def read(self, version: int) -> dict:
        return json.loads(bytes(self._files(f"{version:012d}.json").select("content").first()["content"]))

    def all(self) -> dict[int, dict]:
        files = self._files()
        return {} if files is None else {r["version"]: json.loads(bytes(r["content"])) for r in files.select("version", "content").collect()}

    def add(self, version: int, entry: dict) -> bool:
        return create(self.spark, f"{self.folder}/{version:012d}.json", json.dumps(entry))


def retried(attempt: Callable[[], int | None]) -> int:
    """The first result of an attempt that is not None."""
    for _ in range(ATTEMPTS):
        result = attempt()
        if result is not None:
            return result
    raise Conflict(f"{ATTEMPTS} attempts")


class Snapshots:
    """The state as numbered versions, each table in buckets by a hash of its key.

    A version is a list of the folders of its buckets. Publishing compares each bucket with that of the version before (its number of rows
    and sums of row hashes) and writes those that differ; `merge` reads and writes only the buckets of the keys it is given."""

    def __init__(self, spark: SparkSession, root: str, buckets: dict[str, tuple[str, int]] = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.log = Log(spark, f"{self.root}/versions")

    def latest(self) -> int:
        return self.log.latest()

    def _manifest(self, version: int) -> dict[str, dict[str, list]]:
        return self.log.read(version) if version >= 0 else {n: {} for n in STATE}

    def _load(self, name: str, entries: dict[str, list]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], STATE[name])
        return self.spark.read.schema(STATE[name]).parquet(*[f"{self.root}/{e[0]}" for e in entries.values()])

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        found = self._manifest(self.latest() if version is None else version)
        return {n: self._load(n, found.get(n, {})) for n in STATE}

    def _bucket(self, name: str) -> Column:
        key, n = self.buckets[name]
        return F.pmod(F.xxhash64(key), F.lit(n)).alias("_b")

    def _prints(self, rows: DataFrame) -> dict[str, list]:
        """Number of rows and sums of their hashes, of each bucket; the same for the same rows in any order."""
        columns = [c for c in rows.columns if c != "_b"]
        part = lambda salt: F.sum(F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 31)))
        found = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), part("x").alias("x"), part("y").alias("y"), F.bit_xor(F.xxhash64(*columns)).alias("z"))
        return {str(r["_b"]): [r["n"], r["x"], r["y"], r["z"]] for r in found.collect()}

    def _written(self, name: str, rows: DataFrame, prints: dict[str, list]) -> dict[str, list]:
        """Entries of the buckets of rows, written side by side."""
        if not prints:
            return {}
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.repartition(len(prints), "_b").write.partitionBy("_b").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return {b: [f"{folder}/_b={b}", *p] for b, p in prints.items()}

    def publish(self, state: dict[str, DataFrame], base: int | None = None) -> int:
        """The number of the version that the state gets. With a base, it must still be the latest, or it is a Conflict."""
        before = self.latest() if base is None else base
        old, new = self._manifest(before), {}
        for name in STATE:
            rows = state[name].select("*", self._bucket(name))
            prints = self._prints(rows)
            held = {b: e for b, e in old.get(name, {}).items() if prints.get(b) == e[1:]}
            fresh = {b: p for b, p in prints.items() if b not in held}
            new[name] = held | self._written(name, rows.where(F.col("_b").isin(*map(int, fresh))), fresh)
        if not self.log.add(before + 1, new):
            raise Conflict(f"version {before + 1}")
        return before + 1

    def update(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> int:
        """Publishes what `change` makes of the latest state; if another writer was first, it is made again of theirs."""

        def attempt() -> int | None:
            base = self.latest()
            try:
                return self.publish(change(self.read(base)), base)
            except Conflict:
                return None

        return retried(attempt)

    def merge(self, name: str, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Rows over those of the same key in one table, without the keys in gone. Only buckets that hold such a key are read and
        written."""
        key, _ = self.buckets[name]
        keys = rows.select(key) if gone is None else rows.select(key).unionByName(gone.select(key))
        keys = keys.distinct()
        touched = [str(r["_b"]) for r in keys.select(self._bucket(name)).distinct().collect()]

        def attempt() -> int | None:
            base = self.latest()
            old = self._manifest(base)
            entries = old.get(name, {})
            held = self._load(name, {b: entries[b] for b in touched if b in entries})
            full = held.join(keys, key, "left_anti").unionByName(rows.select(*held.columns)).select("*", self._bucket(name))
            new = self._written(name, full, self._prints(full))
            kept = {b: e for b, e in entries.items() if b not in touched}
            return base + 1 if self.log.add(base + 1, old | {name: kept | new}) else None

        return retried(attempt)


class Growing:
    """A table that only grows: each commit names the folder that it adds."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.log = Log(spark, f"{self.root}/versions")

    def read(self) -> DataFrame:
        return self._of(self.log.all())

    def _of(self, entries: dict[int, dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{e['folder']}" for _, e in sorted(entries.items())])

    def append(self, rows: DataFrame, key: list[str], check: Callable[[DataFrame], None] | None = None) -> int:
        """Adds the rows whose key is not there yet; of rows that repeat a key one is taken. If another writer was first, what is there is
        looked at again."""

        def attempt() -> int | None:
            entries = self.log.all()
            known = self._of(entries)
            fresh = rows.dropDuplicates(key).join(known.select(*key), key, "left_anti").select(*rows.columns)
            if check:
                check(fresh)
            folder, version = f"data/{uuid.uuid4().hex}", max(entries, default=-1) + 1
            fresh.write.parquet(f"{self.root}/{folder}")
            return version if self.log.add(version, {"folder": folder}) else None

        return retried(attempt)
