"""Relational operators: deduplication, blocks, samples, edges, views, budgets, set operations, state changes.

Every ordering has an explicit last key, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.functions import scalars as S
from semblance.sources.tables import written


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key; rows whose key is null or empty all stay."""
    named = F.col(key).isNotNull() & (F.col(key).cast("string") != "")
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    # only named rows meet in a window: the others never gather in one partition
    kept = df.where(named).withColumn("_n", first).where("_n = 1").drop("_n")
    return kept.unionByName(df.where(~F.coalesce(named, F.lit(False))))


def duplicates(df: DataFrame, content: Column, size: Column, name: Column) -> DataFrame:
    """Groups of equal content: hash, members in order, size, wasted bytes."""
    hashed = df.select(F.sha2(content.cast("binary"), 256).alias("content_hash"), size.alias("size"), name.alias("name"))
    groups = hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min_by("size", "name").alias("size_bytes"), F.sort_array(F.collect_list("name")).alias("files"))
    return groups.where("n > 1").withColumn("wasted_bytes", F.col("size_bytes") * (F.col("n") - 1))


def placed(df: DataFrame, order: list) -> DataFrame:
    """Adds `pos`, the place of each row in the whole order, counted from 0.

    Rows are range-partitioned, sorted and numbered in one stage and written once; a place is the number inside of the
    partition plus the rows of earlier ones. No task sees the whole table, and the numbers are read from what was written, so
    they do not depend on how a later query would cut the ranges. What is broadcast has one row for each partition."""
    local = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(local, "placed").withColumn("_part", F.shiftright("_at", 33)).withColumn("_rank", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")
    return joined.withColumn("pos", F.col("_before") + F.col("_rank")).select(*df.columns, "pos")


def chronological_blocks(df: DataFrame, time: str, tie: str, block: int) -> DataFrame:
    """Adds `pos` (place by time, null first, then by tie) and `block`."""
    return placed(df, [F.col(time).asc_nulls_first(), F.col(tie)]).withColumn("block", F.floor(F.col("pos") / block))


def evenly_spaced(df: DataFrame, key: str, order: list, n: int = 48) -> DataFrame:
    """At most n rows of each key at places int(i * (total / n)), with their sample number."""
    w = Window.partitionBy(key)
    placed = df.withColumn("_pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_total", F.count(F.lit(1)).over(w))
    step = F.col("_total") / F.lit(float(n))
    wanted = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * step).cast("int") == F.col("_pos"))
    all_rows = placed.where(F.col("_total") <= n).withColumn("sample", F.col("_pos"))
    spaced = placed.where(F.col("_total") > n).withColumn("sample", F.explode(wanted))
    return all_rows.unionByName(spaced).drop("_pos", "_total")


def cooccurrence(faces: DataFrame, group: str, person: str) -> DataFrame:
    """Edges a < b of persons that share a group, once for each group."""
    members = faces.where(F.col(person).isNotNull()).select(F.col(group).alias("g"), F.col(person).alias("p")).distinct()
    both = members.alias("x").join(members.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.p") < F.col("y.p")))
    return both.select(F.col("x.p").alias("person_a"), F.col("y.p").alias("person_b"), F.col("x.g").alias("photo_id"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges in order, without self edges and repeats."""
    return edges.where("person_a <> person_b").select(F.least("person_a", "person_b").alias("person_a"), F.greatest("person_a", "person_b").alias("person_b"), "photo_id").distinct()


def summaries(faces: DataFrame, person: str, uid: str, time: str) -> DataFrame:
    """Of each identity: faces, photos, first and last time, months, stable id and an id over its faces' keys."""
    return faces.groupBy(F.col(person).alias("person")).agg(
        F.count(F.lit(1)).alias("n_faces"), F.count_distinct(uid).alias("n_photos"),
        F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), S.stable_id(F.collect_set(F.col(uid).cast("string"))).alias("stable_id"),
    )


def ranked(identities: DataFrame, size: str, tie: str, n: int) -> DataFrame:
    """The n largest with rank and name; top-k without a global sort."""
    top = identities.orderBy(F.col(size).desc(), F.col(tie)).limit(n)
    place = F.row_number().over(Window.orderBy(F.col(size).desc(), F.col(tie)))
    return top.withColumn("rank", place).withColumn("pessoa", S.rank_name(F.col("rank")))


def folders(faces: DataFrame, coherence: DataFrame, limit: float, min_photos: int, by_label: bool = False) -> DataFrame:
    """The folder of each photo from its faces (photo_id, person_id, status, num_faces); coherence: person_id, coherence.

    People stand in the order of their ids; by_label: of their ids with the mark of diffuse ones, which sorts 10_dispersa after 101."""
    photos = faces.where("person_id IS NOT NULL").groupBy("person_id").agg(F.count_distinct("photo_id").alias("n_photos"))
    marks = photos.join(coherence, "person_id", "left").select(
        "person_id", (F.col("n_photos") < min_photos).alias("rare"), (F.coalesce("coherence", F.lit(0.0)) > limit).alias("diffuse"))
    known = faces.join(marks, "person_id", "left")
    key = F.col("person_id").cast("string")
    label = F.concat(key, F.when(F.col("diffuse"), "_dispersa").otherwise("")).alias("label")
    named = F.when(F.col("person_id").isNotNull(), F.struct(*([] if by_label else [key.alias("id")]), label, "rare"))
    view = known.groupBy("photo_id").agg(
        F.sort_array(F.collect_set(named)).alias("people"), F.max("num_faces").alias("num_faces"), F.max(F.col("status") == "deferred").alias("deferred"))
    ids = F.transform("people", lambda p: p["label"])
    n = F.size("people")
    name = (F.when(n == 0, F.when(F.col("deferred"), "aguardando_fase2").otherwise("revisao_manual"))
            .when((n == 1) & (F.col("num_faces") == 1), ids[0]).when(n == 1, F.concat(ids[0], F.lit("_em_grupo"))).otherwise(F.array_join(ids, "_e_")))
    rare = (n > 0) & F.forall("people", lambda p: p["rare"])
    return view.select("photo_id", F.when(rare, F.concat(F.lit("pessoas_raras/"), name)).otherwise(name).alias("folder"))


def report(faces: DataFrame, coherence: DataFrame, limit: float, n: int = 10) -> DataFrame:
    """Largest identities with their share of all assigned faces; ties by id, last first."""
    sizes = faces.where("person_id IS NOT NULL").groupBy("person_id").agg(F.count(F.lit(1)).alias("n_faces"))
    total = sizes.agg(F.sum("n_faces").alias("total"), F.count(F.lit(1)).alias("persons"))
    top = sizes.join(coherence, "person_id", "left").orderBy(F.col("n_faces").desc(), F.col("person_id").desc()).limit(n)
    return top.crossJoin(F.broadcast(total)).select("person_id", "n_faces", "persons", "total", (F.col("n_faces") / F.col("total")).alias("share"), (F.coalesce("coherence", F.lit(0.0)) > limit).alias("diffuse"))


def recurrent(df: DataFrame, key: str, least: int) -> DataFrame:
    """The rows of groups that have so many; smaller groups vanish. Rows without a key are in no group."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join(sizes.select(key), key, "left_semi")


def within_budget(batches: DataFrame, order: str, size: str, count: str, max_bytes: float, target: int) -> DataFrame:
    """Batches that start while the ones before are under both limits. One row a batch, so one window is enough."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent, kept = F.coalesce(F.sum(size).over(before), F.lit(0)), F.coalesce(F.sum(count).over(before), F.lit(0))
    return batches.withColumn("_b", spent).withColumn("_k", kept).where((F.col("_b") < max_bytes) & (F.col("_k") < target)).drop("_b", "_k")


def fixed_chunks(df: DataFrame, order: list, n: int) -> DataFrame:
    """Adds `chunk`, which n rows in order share."""
    return placed(df, order).withColumn("chunk", F.floor(F.col("pos") / n)).drop("pos")


def minus(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def not_in(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """minus with the nulls of SQL's NOT IN: a null key in done leaves no row, and rows without a key stay only if done is empty."""
    sizes = done.agg(F.count(F.lit(1)).alias("_n"), F.count(key).alias("_keys"))
    kept = (F.col("_n") == 0) | (F.col("_n") == F.col("_keys")) & F.col(key).isNotNull()
    return minus(df, done, key).crossJoin(F.broadcast(sizes)).where(kept).select(*df.columns)


def not_indexed(images: DataFrame, detections: DataFrame, scanned: DataFrame) -> DataFrame:
    """images (path, mtime) that need another look: changed since, or found by an index without scores.

    A path without faces is known if it was scanned at this mtime, one with faces if all have it and a score."""
    found = detections.groupBy("path").agg(F.bool_and(F.col("det_score").isNotNull()).alias("_scored"), F.min("mtime").alias("_low"), F.max("mtime").alias("_high"))
    seen = scanned.select("path", F.col("mtime").alias("_scan"))
    both = images.join(found, "path", "left").join(seen, "path", "left")
    known = F.when(F.col("_low").isNull(), F.col("_scan") == F.col("mtime")).otherwise(F.col("_scored") & (F.col("_low") == F.col("mtime")) & (F.col("_high") == F.col("mtime")))
    return both.where(~F.coalesce(known, F.lit(False))).select(*images.columns)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """new over old by key; columns in keep stay as they were where the key was known."""
    if keep:
        before = old.select(key, *(F.col(c).alias(f"_{c}") for c in keep), F.lit(True).alias("_known"))
        joined = new.join(before, key, "left")
        new = joined.select(*(F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in new.columns))
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def exclude_photos(state: dict[str, DataFrame], photos: DataFrame) -> dict[str, DataFrame]:
    """The state without the photos (photo_id, reason): their faces and edges go, and persons that had no other face."""
    gone = photos.select("photo_id").distinct()
    faces = minus(state["faces"], gone, "photo_id")
    left = faces.where("person_id IS NOT NULL").select("person_id").distinct()
    lost = state["faces"].join(gone, "photo_id", "left_semi").select("person_id").distinct().join(left, "person_id", "left_anti")
    edges = minus(state["edges"], gone, "photo_id")
    for side in ("person_a", "person_b"):
        edges = edges.join(lost.select(F.col("person_id").alias(side)), side, "left_anti").select(*state["edges"].columns)
    marked = state["photos"].join(gone.withColumn("_gone", F.lit(True)), "photo_id", "left")
    status = F.when(F.col("_gone"), "excluded").otherwise(F.col("status")).alias("status")
    return state | {
        "faces": faces, "edges": edges, "persons": state["persons"].join(lost, "person_id", "left_anti"),
        "photos": marked.select(*(status if c == "status" else c for c in state["photos"].columns)),
        "excluded": upsert(state["excluded"], photos, "photo_id"),
    }


def merge_persons(faces: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mapping: old, new. Faces move, edges are put in order again and those inside of one person go."""
    moved = faces.join(mapping, F.col("person_id") == F.col("old"), "left")
    moved = moved.withColumn("person_id", F.coalesce("new", "person_id")).select(*faces.columns)
    out = edges
    for side in ("person_a", "person_b"):
        out = out.join(mapping, F.col(side) == F.col("old"), "left").withColumn(side, F.coalesce("new", side)).select(*edges.columns)
    return moved, canonical_edges(out)


def next_ids(groups: DataFrame, order: list, start: int) -> DataFrame:
    """New person ids in order after the sequence number start."""
    return placed(groups, order).withColumn("person_id", S.person_id(F.col("pos") + 1 + start)).drop("pos")


def replace_images(index: DataFrame, scanned: DataFrame, found: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All faces of the images (path, mtime) replaced by those found, and the images stamped as scanned."""
    return minus(index, images, "path").unionByName(found), upsert(scanned, images, "path")


def conflicts(identity: DataFrame, profile: DataFrame, ids: str, profiles: str) -> DataFrame:
    """Photos, for each identity and profile, that both hold and where the identity has an index the profile has not.

    Both tables have photo_id and idx."""
    mine = profile.groupBy(profiles, "photo_id").agg(F.collect_set("idx").alias("_mine"))
    theirs = identity.groupBy(ids, "photo_id").agg(F.collect_set("idx").alias("_theirs"))
    both = theirs.join(mine, "photo_id").where(F.size(F.array_except("_theirs", "_mine")) > 0)
    return both.groupBy(ids, profiles).agg(F.count(F.lit(1)).alias("n_conflicts"))


def album_plan(wanted: DataFrame, have: DataFrame, batch: int) -> DataFrame:
    """uids that the album lacks, in batches; running it again after adding finds what is still missing."""
    return fixed_chunks(minus(wanted, have, "uid"), ["uid"], batch)
