"""Micro-batch runs: new files are resolved as they come, each exactly once, and a snapshot is published per batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.config import ResolveConfig
from semblance.plans import resolve as R
from semblance.sources import facestore as store_
from semblance.sources.state import Snapshots
from semblance.sources.tables import written

DETECTION = "photo_id string, path string, mtime double, face_index int, embedding array<double>, face_px double, det_score double"


def sweep(spark: SparkSession, source: str, root: str, cfg: ResolveConfig = ResolveConfig(), embedder: str = "default", schema: str = DETECTION, after: Callable[[int], None] | None = None) -> int:
    """Takes all new detection files through phase 1 and phase 2 (and every N batches a recluster), then stops.

    A replayed batch finds its photos finished and changes nothing, so a lost run resumes at the last snapshot. after: called
    with the version of each snapshot once it is published, to send it on."""
    store = Snapshots(spark, f"{root}/state")

    def one(batch: DataFrame, number: int) -> None:
        rows = written(batch.dropDuplicates(["photo_id", "path", "face_index"]), "batch")

        def resolved(state: R.State) -> R.State:
            state = R.resolve(R.resolve(R.guard_model(state, embedder), rows, cfg, 1), rows, cfg, 2)
            return R.recluster(state, cfg) if cfg.recluster_every and (number + 1) % cfg.recluster_every == 0 else state

        version = store.update(resolved)
        if after:
            after(version)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return store.latest()


def cycle(spark: SparkSession, root: str, fetch: Callable[[str], int], detect: Callable[[str], DataFrame], send: Callable[[int], None], remove: Callable[[str], None], cfg: ResolveConfig = ResolveConfig(), embedder: str = "default", once: bool = False) -> int:
    """The whole sweep: fetch a batch of files, detect faces, resolve both phases (recluster every N cycles), send the
    snapshot on, remove the batch; until a fetch brings nothing, or once. The number of cycles that brought something.

    fetch puts files into a folder and gives their number, detect reads the faces of a folder, remove deletes it. A folder is
    removed after its faces are in a published snapshot; a run that dies before fetches into a new one."""
    cycles = 0
    while True:
        folder = f"{root}/incoming/{uuid.uuid4().hex}"
        if not fetch(folder):
            return cycles
        detect(folder).write.mode("append").parquet(f"{root}/detections")
        sweep(spark, f"{root}/detections", root, cfg, embedder, after=send)
        remove(folder)
        cycles += 1
        if once:
            return cycles


def scan(spark: SparkSession, catalog: DataFrame, root: str, extract: Callable[[DataFrame], DataFrame], dim: int | None = None) -> DataFrame:
    """Extracts what the scan log lacks, one planned batch after the other, and returns the log.

    extract: entries to faces (uid, photo_id, face_index, ...); an entry that it gives an `error` for is not logged and comes
    again. Faces are added by their key and entries logged once, so a batch that runs again after a crash repeats nothing."""
    pending = written(catalog.join(store_.scanned_uids(spark, root), "uid", "left_anti"), "pending")
    for (batch,) in pending.select("batch").distinct().orderBy("batch").toLocalIterator():
        out = written(extract(pending.where(F.col("batch") == batch)), "faces")
        out.where("error IS NOT NULL").select("uid", "error").write.mode("append").parquet(f"{root}/dead_letters")
        good = out.where("error IS NULL")
        store_.append(spark, root, good.where("face_index IS NOT NULL").drop("error"), dim)
        store_.mark_scanned(spark, root, good.groupBy("uid").agg(F.first("photo_id").alias("photo_id"), F.count("face_index").cast("int").alias("faces")))
    return store_.scan_log(spark, root)
