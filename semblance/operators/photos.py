"""Photos, their files and faces: which photo a path is, faces by image, members of groups, status and person lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.functions import scalars as S
from semblance.operators import relational


def photo_of_path(paths: DataFrame, photos: DataFrame, content: str = "content") -> DataFrame:
    """paths (path, content) with photo_id, hashed, orphan: the photo known by that path, else the start of the hash of the
    file, else (no content) an orphan."""
    known = photos.groupBy("path").agg(F.min("photo_id").alias("_known"))
    digest = F.substring(F.sha2(F.col(content).cast("binary"), 256), 1, 16)
    both = paths.join(known, "path", "left")
    photo = F.coalesce(F.col("_known").cast("string"), digest)
    return both.select(*(c for c in both.columns if c != "_known"), photo.alias("photo_id"), (F.col("_known").isNull() & digest.isNotNull()).alias("hashed"), photo.isNull().alias("orphan"))


def first_path_only(faces: DataFrame) -> DataFrame:
    """Faces (photo_id, path, ...) of each photo's first path: the same content under another path adds nothing."""
    first = faces.groupBy("photo_id").agg(F.min("path").alias("path"))
    return faces.join(first, ["photo_id", "path"], "left_semi")


def faces_by_image(faces: DataFrame, min_px: float, min_score: float, order: str = "face_index") -> DataFrame:
    """image, faces: those that pass the gate, in order; images without any vanish."""
    good = faces.where(S.passes_gate(F.col("face_px"), F.col("det_score"), min_px, min_score))
    rest = F.struct(order, *(c for c in good.columns if c not in ("image", order)))
    return good.groupBy("image").agg(F.sort_array(F.collect_list(rest)).alias("faces"))


def members_of(labels: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """place, members: the items of each group in order, groups in the order in which they first appear."""
    lists = labels.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, item))).alias("_m"), F.min(F.struct(order, item)).alias("_first"))
    placed = relational.placed(lists, ["_first"])
    return placed.select(F.col("pos").alias("place"), group, F.col(f"_m.{item}").alias("members"))


def last_rows(store: DataFrame, key: Column, place: str) -> DataFrame:
    """The last row of each key by place."""
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.col(place).desc()))
    return store.withColumn("key", key).withColumn("_n", last).where("_n = 1").drop("_n")


def rare_and_diffuse(sizes: DataFrame, coherence: DataFrame, min_photos: int, limit: float) -> DataFrame:
    """One row: persons (person_id, n_photos), how many are rare, how many diffuse, and how many both."""
    both = sizes.join(coherence, "person_id", "left")
    rare, diffuse = F.col("n_photos") < min_photos, F.coalesce("coherence", F.lit(0.0)) > limit
    return both.agg(F.count(F.lit(1)).alias("persons"), F.count_if(rare).alias("rare"), F.count_if(diffuse).alias("diffuse"), F.count_if(rare & diffuse).alias("both"))


def with_status(photos: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """photos with the status set for the given photo_ids."""
    marked = photos.join(ids.select("photo_id").distinct().withColumn("_set", F.lit(True)), "photo_id", "left")
    new = F.when(F.col("_set"), F.lit(status)).otherwise(F.col("status")).alias("status")
    return marked.select(*(new if c == "status" else c for c in photos.columns))


def status_of(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """photo_id, status of the ids asked for; null for a photo that is not known."""
    return ids.select("photo_id").distinct().join(photos.select("photo_id", "status"), "photo_id", "left")


def person_vectors(faces: DataFrame, person: str) -> DataFrame:
    return faces.where(F.col("person_id") == person).select("face_id", "embedding")


def all_persons(persons: DataFrame) -> DataFrame:
    return persons.select("person_id").distinct().orderBy("person_id")


def ranked_names(names: DataFrame) -> DataFrame:
    """Requested names that are places of a ranking."""
    return names.where(F.startswith("name", F.lit("pessoa_")))


def exclude_paths(state: dict[str, DataFrame], files: DataFrame, reason: str) -> dict[str, DataFrame]:
    """Excludes the photos that the files (path, content) are, by the hash of their content."""
    ids = files.select(F.sha2(F.col("content").cast("binary"), 256).alias("photo_id"), F.lit(reason).alias("reason")).distinct()
    return relational.exclude_photos(state, ids)
