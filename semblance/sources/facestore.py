"""The face store: faces and the scan log as Parquet tables, and the index of a folder with its model.

A face is one row that holds vector and metadata, so the two cannot part. Appends leave out keys that the store already has:
a batch that is sent again, after a crash between the two tables say, changes nothing. They are commits of a log, so two writers
at once cannot both add a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.sources.state import Growing
from semblance.sources.tables import SCAN_LOG, read_or_empty, same_model

KEY = ["photo_id", "face_index"]
STORED = "photo_id string, face_index int, uid string, name string, capture_time string, bbox array<double>, det_score double, face_px double, thumb string, embedding array<float>"
INDEX = "path string, mtime double, face_index int, bbox array<double>, det_score double, face_px double, embedding array<double>, embedder string"


def faces(spark: SparkSession, root: str, schema: str = STORED) -> DataFrame:
    return Growing(spark, f"{root}/faces", schema).read()


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """Faces without their vectors, which the scan then does not read."""
    return faces(spark, root).drop("embedding")


def vectors(spark: SparkSession, root: str, dim: int) -> DataFrame:
    """Key and vector of each face; one of another dimension is an error where it is read."""
    wrong = F.raise_error(F.format_string("a vector of %d values, not %d", F.size("embedding"), F.lit(dim)))
    return faces(spark, root).select(*KEY, F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong.cast("array<float>")).alias("embedding"))


def scan_log(spark: SparkSession, root: str) -> DataFrame:
    return Growing(spark, f"{root}/scan_log", SCAN_LOG).read()


def scanned_uids(spark: SparkSession, root: str) -> DataFrame:
    return scan_log(spark, root).select("uid").distinct()


def count(spark: SparkSession, root: str) -> int:
    """Faces of the store, from the footers of its files."""
    return faces(spark, root).count()


def thumb_name(photo_id: str = "photo_id", face_index: str = "face_index"):
    return F.concat(F.substring(photo_id, 1, 16), F.lit("_"), F.col(face_index).cast("string"), F.lit(".jpg"))


def append(spark: SparkSession, root: str, new: DataFrame, dim: int | None = None) -> None:
    """Adds the faces that the store lacks; of repeated keys in `new` one is taken."""
    def same_size(fresh: DataFrame) -> None:
        if dim is not None and not fresh.where(F.size("embedding") != dim).isEmpty():
            raise ValueError(f"vectors that do not have {dim} values")

    Growing(spark, f"{root}/faces", ", ".join(f"`{n}` {t}" for n, t in new.dtypes)).append(new, KEY, same_size)


def mark_scanned(spark: SparkSession, root: str, seen: DataFrame) -> None:
    """Logs what was scanned (uid, photo_id, faces), also where no face was found; what is logged stays."""
    Growing(spark, f"{root}/scan_log", SCAN_LOG).append(seen.select(*(c.split(" ")[0] for c in SCAN_LOG.split(", "))), ["uid"])


def save_index(index: DataFrame, path: str, embedder: str) -> None:
    """The index of a folder, written whole; its model stands in every row."""
    index.withColumn("embedder", F.lit(embedder)).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, embedder: str) -> DataFrame:
    """The index, empty where there is none. An index of another model is as good as none: vectors of two models never mix."""
    return same_model(read_or_empty(spark, path, INDEX, "parquet"), embedder)
