"""Resolving a folder of images from end to end: list, detect what is new, decide, and derive the views.

The index of a library grows by commits: the faces of each image that was looked at, and the images themselves with their time
and the model. An image is looked at again if its time or the model differs. Faces of an image's last time count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.config import ResolveConfig
from semblance.functions import scalars as S
from semblance.operators import photos, relational
from semblance.operators.cluster import coherence
from semblance.plans import resolve as R
from semblance.sources.state import Growing, Snapshots
from semblance.sources.tables import find_files, written
from semblance.streaming import model

INDEX = "path string, photo_id string, mtime double, face_index int, bbox array<double>, det_score double, face_px double, embedding array<double>, embedder string"
SCANNED = "path string, photo_id string, mtime double, embedder string"
FAILED = "path string, mtime double, error string"
#: Images of a commit: what is lost when a run dies, and the paths that are listed at once.
SAVE_EVERY = 10_000


@dataclass(frozen=True)
class Resolved:
    """What a run leaves: the version of the state, the folder of each photo, the largest people, and one row of counts."""

    version: int
    folders: DataFrame
    report: DataFrame
    counts: DataFrame
    failed: DataFrame


def _literal(path: str) -> str:
    """A path for a reader that takes patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _index(spark: SparkSession, root: str, embedder: str) -> DataFrame:
    """Faces of each image's last time, of one model."""
    every = Growing(spark, f"{root}/index", INDEX).read().where(F.col("embedder") == embedder)
    last = Growing(spark, f"{root}/scanned", SCANNED).read().where(F.col("embedder") == embedder).groupBy("path").agg(F.max("mtime").alias("mtime"))
    return every.join(last, ["path", "mtime"])


def indexed(spark: SparkSession, library: str, root: str, name: str, load: Callable, decode: Callable[[bytes], np.ndarray] | None, embedder: str, skip_video_frames: bool = False, save_every: int = SAVE_EVERY) -> DataFrame:
    """Detects faces in the images that the index lacks, some at a time, and returns the images that failed (they come again)."""
    scanned = Growing(spark, f"{root}/scanned", SCANNED)
    images = find_files(spark, library, S.PHOTO_EXTENSIONS, drop_video_frames=skip_video_frames).select("path", F.col("modificationTime").cast("double").alias("mtime"))
    known = scanned.read().where(F.col("embedder") == embedder).select("path", "mtime")
    pending = written(relational.fixed_chunks(images.join(known, ["path", "mtime"], "left_anti"), ["path"], save_every), "pending")
    failed = spark.createDataFrame([], FAILED)
    for (chunk,) in pending.select("chunk").distinct().orderBy("chunk").toLocalIterator():
        paths = [_literal(r["path"]) for r in pending.where(F.col("chunk") == chunk).select("path").collect()]
        files = spark.read.format("binaryFile").load(paths).select("path", F.col("modificationTime").cast("double").alias("mtime"), F.sha2("content", 256).alias("photo_id"), "content")
        found = written(model.detected(files, name, load, decode, ("path", "photo_id", "mtime")), "detected")
        good = found.where("error IS NULL").withColumn("embedder", F.lit(embedder))
        columns = [c.split(" ")[0] for c in INDEX.split(", ")]
        faces = good.where("face_index IS NOT NULL").withColumn("embedding", F.col("embedding").cast("array<double>")).select(*columns)
        Growing(spark, f"{root}/index", INDEX).append(faces, ["path", "mtime", "face_index", "embedder"])
        # faces first: a run that dies between the two looks at the images again and adds nothing
        scanned.append(good.select("path", "photo_id", "mtime", "embedder").distinct(), ["path", "mtime", "embedder"])
        failed = failed.unionByName(found.where("error IS NOT NULL").select("path", "mtime", "error"))
    return failed


def excluded(spark: SparkSession, state: R.State, library: str, exclude: Iterable[tuple[str, str]]) -> R.State:
    """The state without the photos that the files are (relative to the library, or whole paths), for a reason each."""
    for name, reason in exclude:
        path = name if "://" in name or name.startswith("/") else f"{library.rstrip('/')}/{name}"
        state = R.with_views(photos.exclude_paths(state, spark.read.format("binaryFile").load(_literal(path)).select("path", "content"), reason))
    return state


def views(state: R.State, cfg: ResolveConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """folders, report, counts (persons, rare, diffuse, both, links)."""
    faces = state["faces"].where("person_id IS NOT NULL")
    mean = written(coherence(faces, "person_id", "face_id", "embedding"), "coherence")
    folders = written(relational.folders(state["faces"].join(state["photos"].select("photo_id", "num_faces"), "photo_id"), mean.select("person_id", "coherence"), cfg.coherence, cfg.min_person_photos), "folders")
    sizes = faces.groupBy("person_id").agg(F.count_distinct("photo_id").alias("n_photos"))
    counts = photos.rare_and_diffuse(sizes, mean.select("person_id", "coherence"), cfg.min_person_photos, cfg.coherence).withColumn("links", F.lit(folders.count()))
    return folders, relational.report(state["faces"], mean.select("person_id", "coherence"), cfg.coherence), counts


def resolve_library(spark: SparkSession, library: str, root: str, name: str, load: Callable, decode: Callable[[bytes], np.ndarray] | None = None, embedder: str = "default", cfg: ResolveConfig = ResolveConfig(),
                    phase2: bool = False, recluster: bool = False, skip_video_frames: bool = False, exclude: Iterable[tuple[str, str]] = (), save_every: int = SAVE_EVERY) -> Resolved:
    """One run over a library. name, load, decode: the model, as in streaming.model; what it works with (the size of its input, say) is
    for `load` to know. exclude: only takes photos out and derives the views again. recluster: all identities anew from the index, without
    looking for new images. phase2: the photos of three faces and more that phase 1 left."""
    store, exclude = Snapshots(spark, f"{root}/state"), list(exclude)
    failed = spark.createDataFrame([], FAILED)
    if exclude:
        version = store.update(lambda state: excluded(spark, state, library, exclude))
    else:
        if not recluster:
            failed = indexed(spark, library, root, name, load, decode, embedder, skip_video_frames, save_every)
        found = written(_index(spark, root, embedder), "found")

        def decided(state: R.State) -> R.State:
            state = R.guard_model(state, embedder)
            if recluster:
                return R.recluster(R.with_all(state, found, cfg), cfg)
            return R.resolve(state, found, cfg, 2 if phase2 else 1)

        version = store.update(decided)
    return Resolved(version, *views(store.read(version), cfg), failed)
