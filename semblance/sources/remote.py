"""Adapters to a remote library: listings as a Spark data source, catalogs from them, downloads and albums as sinks.

A client is any importable class with the methods used here; it is named as `module:Class` so that workers can make
their own. `FileClient` reads a folder of JSON files, and `CommandClient` runs a command for each call.
"""

from __future__ import annotations

import importlib
import json
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from semblance.functions import scalars as S
from semblance.operators import relational
from semblance.sources.tables import MANIFEST

SHORT, DETAILED, ALBUMS = "short", "detailed", "albums"
DETAIL = "uid string, name string, mediaType string, totalStorageSize long, creationTime string, photo struct<captureTime: string, contentHash: string>"


class CommandError(RuntimeError):
    """A command that ended with an error: what was run and what it said."""


class CommandClient:
    """Calls `command <what> --json` and the like; options: command."""

    def __init__(self, options: dict[str, str]):
        self.command, self.timeout = options["command"].split(), float(options.get("timeout", 0)) or None

    def run(self, *args: str) -> str:
        done = subprocess.run([*self.command, *args], capture_output=True, text=True, timeout=self.timeout)
        if done.returncode:
            raise CommandError(f"{' '.join([*self.command, *args])}: {done.stderr.strip()}")
        return done.stdout

    def listing(self, what: str) -> list[dict]:
        return json.loads(self.run("list", what, "--json"))

    def download(self, uids: list[str], folder: str) -> None:
        self.run("download", *uids, "--to", folder)

    def create_album(self, name: str) -> None:
        self.run("create-album", name)

    def add_photos(self, album: str, uids: list[str]) -> None:
        self.run("add-photos", album, *uids)


class FileClient:
    """Listings from <root>/<what>.json, downloads as copies; for tests and for saved listings. options: root."""

    def __init__(self, options: dict[str, str]):
        self.root = Path(options["root"])

    def listing(self, what: str) -> list[dict]:
        return json.loads((self.root / f"{what}.json").read_text())

    def download(self, uids: list[str], folder: str) -> None:
        for u in uids:
            (Path(folder) / u).write_bytes((self.root / "files" / u).read_bytes())

    def create_album(self, name: str) -> None:
        known = self.listing("albums")
        uid = f"album{len(known) + 1}"
        (self.root / f"album-{uid}.json").write_text("[]")
        (self.root / "albums.json").write_text(json.dumps([*known, {"uid": uid, "name": name}]))

    def add_photos(self, album: str, uids: list[str]) -> None:
        """A photo whose file is missing is passed over, as remote libraries do."""
        held = self.listing(f"album-{album}")
        new = [{"uid": u} for u in uids if (self.root / "files" / u).exists()]
        (self.root / f"album-{album}.json").write_text(json.dumps(held + new))


def client(name: str, options: dict[str, str]):
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)(options)


class ListingSource(DataSource):
    """format("listing"): one row of JSON text for each entry; options: client, what, and those of the client."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.options.get("what", SHORT))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        for entry in client(self.options["client"], self.options).listing(partition.value):
            # names may be plain or wrapped: both arrive as text
            if isinstance(entry.get("name"), dict):
                entry = entry | {"name": json.dumps(entry["name"], ensure_ascii=False)}
            yield (json.dumps(entry, ensure_ascii=False),)


def listing(spark: SparkSession, what: str, **options: str) -> DataFrame:
    spark.dataSource.register(ListingSource)
    return spark.read.format("listing").options(what=what, **options).load()


def timeline(raw: DataFrame) -> DataFrame:
    """The short listing: uid, captureTime, tags."""
    return raw.select(F.from_json("value", "nodeUid string, captureTime string, tags array<string>").alias("e")).select(F.col("e.nodeUid").alias("uid"), "e.captureTime", "e.tags")


def catalog(raw: DataFrame) -> DataFrame:
    """The detailed listing as catalog entries: wrapped names opened, times and sizes filled; rows without a name go."""
    e = raw.select(F.from_json("value", DETAIL).alias("e")).select("e.*")
    out = e.select("uid", S.unwrapped(F.col("name")).alias("name"), F.col("mediaType").alias("media_type"), F.coalesce("totalStorageSize", F.lit(0).cast("long")).alias("size"),
                   S.filled(F.col("photo.captureTime"), F.col("creationTime")).alias("capture_time"), F.col("photo.contentHash").alias("content_hash"))
    return out.where("name IS NOT NULL AND name <> ''")


def albums(raw: DataFrame) -> DataFrame:
    """name, uid of the albums; a wrapped name is opened whether it is marked ok or not."""
    return raw.select(F.from_json("value", "uid string, name string").alias("e")).select(S.unwrapped_value(F.col("e.name")).alias("name"), "e.uid").where("name IS NOT NULL")


def album_or_new(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted names with the uid of their album, null for those to create."""
    return wanted.join(found.groupBy("name").agg(F.min("uid").alias("uid")), "name", "left")


def pruned(entries: DataFrame, keep_screenshots: bool = False, keep_duplicates: bool = False, all_media: bool = False) -> DataFrame:
    """Catalog entries worth a download: camera photos, one for each content. all_media: no filter at all."""
    if all_media:
        return entries
    if not keep_screenshots:
        entries = entries.where(S.is_camera_photo(F.col("media_type"), F.col("name")))
    return entries if keep_duplicates else relational.keep_first(entries, "content_hash", [F.col("capture_time").asc_nulls_first(), "uid"])


def downloaded(planned: DataFrame, client_name: str, folder: str, **options: str) -> DataFrame:
    """uid, ok, error of the planned entries (uid, batch): each batch in one call, or entry by entry if that fails."""

    def fetch(p: pd.DataFrame) -> pd.DataFrame:
        c, uids = client(client_name, options), p["uid"].tolist()
        try:
            c.download(uids, folder)
            return pd.DataFrame({"uid": uids, "ok": True, "error": None})
        except Exception:
            out = []
            for u in uids:
                try:
                    c.download([u], folder)
                    out.append((u, True, None))
                except Exception as e:
                    out.append((u, False, str(e)[:500]))
            return pd.DataFrame(out, columns=["uid", "ok", "error"])

    return planned.groupBy("batch").applyInPandas(fetch, "uid string, ok boolean, error string")


def matched_files(files: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of a download with the entry of their name, and those that no entry names (to warn about)."""
    return files.join(batch, "name"), files.join(batch, "name", "left_anti")


def unwanted(after: DataFrame, before: DataFrame, keep: list[str]) -> DataFrame:
    """Files that came with a download and have an extension that is not kept."""
    return after.join(before.select("name"), "name", "left_anti").where(~S.has_extension(F.col("name"), keep))


def manifest_with(manifest: DataFrame, results: DataFrame, times: DataFrame) -> DataFrame:
    """The manifest with the entries that came; a failed one is not recorded and comes again."""
    new = results.where("ok").select("uid").join(times.select("uid", "captureTime"), "uid")
    return relational.upsert(manifest, new.select(*[c.split()[0] for c in MANIFEST.split(", ")]), "uid")


def counters(listed: DataFrame, manifest: DataFrame, results: DataFrame) -> DataFrame:
    """One row: listed, already there, kept, failed."""
    done = listed.join(manifest.select("uid"), "uid", "left_semi").agg(F.count(F.lit(1)).alias("already"))
    got = results.agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("failed"))
    return listed.agg(F.count(F.lit(1)).alias("listed")).crossJoin(done).crossJoin(got)


def checked_origin(marker: DataFrame, person: str, stable_id: str) -> None:
    """Refuses to mix people in one folder: a marker must name the same identity."""
    other = marker.where(~F.col("id").eqNullSafe(F.lit(stable_id))).first()
    if other:
        raise ValueError(f"the folder holds {other['pessoa']} ({other['id']}), not {person} ({stable_id})")
