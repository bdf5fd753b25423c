"""Tables that the engine keeps: snapshots, scratch tables in the shared folder, readers with guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.functions import scalars as S
from semblance.functions.images import header

VECTOR = T.ArrayType(T.DoubleType())
FACE = "face_id string, photo_id string, face_index int, embedding array<double>, person_id string, confidence double, status string"
PHOTO = "photo_id string, path string, mtime double, num_faces int, status string"
PERSON = "person_id string, created_at timestamp"
EDGE = "person_a string, person_b string, photo_id string"
EXCLUDED = "photo_id string, reason string"
META = "key string, value string"
#: The component of each face that is decided on: what the next batch's links are added to. settled: a run found nothing to change
#: there; person_id and status are those of that time, so a change made in any other way shows.
ROOT = "face_id string, root string, settled boolean, person_id string, status string"
CATALOG = "uid string, name string, media_type string, size long, capture_time string, content_hash string"
MANIFEST = "uid string, captureTime string"
SCAN_LOG = "uid string, photo_id string, faces int"
STATE = {"faces": FACE, "photos": PHOTO, "persons": PERSON, "edges": EDGE, "excluded": EXCLUDED, "meta": META, "roots": ROOT}


def shared_dir(spark: SparkSession) -> str:
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.semblance.scratch", None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="semblance-")
        spark.conf.set("spark.semblance.scratch", known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """A table, empty where its path is missing; blank lines of text formats are skipped by the reader."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of whichever store Spark reads it from."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def read_or_build(spark: SparkSession, path: str, schema: str, build, refresh: bool = False) -> DataFrame:
    """A cached table; built and saved where it is missing or a refresh is asked for. One that is there and empty stays."""
    if refresh or not exists(spark, path):
        build().write.mode("overwrite").json(path)
    return spark.read.schema(schema).json(path)


def same_model(detections: DataFrame, embedder: str) -> DataFrame:
    """Detections of one model only: vectors of two models never mix."""
    return detections.where(F.col("embedder") == embedder)


def by_name_or_id(ranking: DataFrame) -> DataFrame:
    """A ranking addressable by rank name and by stable id."""
    return ranking.withColumn("name", F.explode(F.array_distinct(F.array("pessoa", "id")))).where(F.col("name").isNotNull())


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """People of a ranking file: a document with a list `pessoas`, or the bare list."""
    person = "pessoa string, id string, rostos long, fotos long, primeiro string, ultimo string, uids array<string>, faces array<string>"
    text = spark.read.text(path, wholetext=True)
    many = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_struct(person)}>>")).otherwise(F.from_json("value", f"pessoas array<struct<{_struct(person)}>>")["pessoas"])
    return text.select(F.explode(many).alias("p")).select("p.*")


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split(" ", 1) for c in ddl.split(", ")))


def find_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None, drop_screenshots: bool = True, drop_video_frames: bool = False) -> DataFrame:
    """Files below a folder with path, size and time, in order of their paths. Contents are read only if a later step asks for
    them, or to leave out frames of videos, which are 16:9."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    if extensions:
        files = files.where(F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*extensions))
    if drop_screenshots:
        files = files.where(~S.is_screenshot(name))
    if drop_video_frames:
        files = files.withColumn("_h", header("content")).where(~S.is_wide_frame(F.col("_h.width"), F.col("_h.height"))).drop("_h")
    return files.withColumn("name", name).orderBy("path")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """uid of each line that is not blank."""
    return spark.read.text(path).select(F.trim("value").alias("uid")).where("uid <> ''")
