"""Recognition of blocked identities: distances to block profiles, conflicts by shared photos, levels and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.functions import scalars as S
from semblance.functions import vectors as V
from semblance.operators import cluster
from semblance.operators.photos import last_rows
from semblance.operators.relational import conflicts, minus

IGNORE, NO_ALBUM = "ignorar", "sem-album"
#: Thumbnails that a profile keeps.
MAX_THUMBS = 48


def usable(profiles: DataFrame, profile_faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles that have vectors, and those to warn about."""
    have = profile_faces.select("chave").distinct()
    return profiles.join(have, "chave", "left_semi"), profiles.join(have, "chave", "left_anti")


def of_level(profiles: DataFrame, level: str | None) -> DataFrame:
    return profiles if level is None else profiles.where(F.col("nivel") == level)


def distances(identities: DataFrame, profiles: DataFrame, dim: int, block: int = 1024, limit: float | None = None) -> DataFrame:
    """identity, chave, rms, n_conflicts of every identity and profile; with a limit of the pairs within it, and for each identity of the
    nearest profile of each block.

    identities: identity, v, photo_id, idx; profiles: chave, v, photo_id, idx. Both meet as one centroid each, in tiles of
    `block` centroids a side."""
    a = identities.groupBy("identity").agg(V.centroid("v", dim).alias("c"))
    b = profiles.groupBy("chave").agg(V.centroid("v", dim).alias("c"))
    near = cluster.centroid_distances(a, b, "identity", "chave", block, limit)
    shared = conflicts(identities, profiles, "identity", "chave")
    return near.join(shared, ["identity", "chave"], "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0).cast("long")))


def classified(identities: DataFrame, profiles: DataFrame, dim: int, limit: float) -> DataFrame:
    """identity, chave, rms: the nearest profile within the limit without conflicts, else null and the least distance."""
    d = distances(identities, profiles, dim, limit=limit)
    allowed = (F.col("rms") <= limit) & (F.col("n_conflicts") == 0)
    best = d.groupBy("identity").agg(F.min(F.when(allowed, F.struct("rms", "chave"))).alias("m"), F.min("rms").alias("least"))
    return best.select("identity", F.col("m.chave").alias("chave"), F.coalesce("m.rms", "least").alias("rms"))


def checked(identities: DataFrame, profiles: DataFrame, dim: int, threshold: float) -> DataFrame:
    """What is near each profile, with its verdict, in order of distance, name and conflicts."""
    d = distances(identities, profiles, dim, limit=threshold + 0.15).where(F.col("rms") <= threshold + 0.15)
    return d.withColumn("verdict", S.verdict(F.col("rms"), F.col("n_conflicts"), threshold)).orderBy("rms", "identity", "chave", "n_conflicts")


def gate(people: DataFrame, found: DataFrame, levels: DataFrame) -> DataFrame:
    """people (identity, has_vectors, stamp): the level that bars an album, or null. Faces decide where vectors are at
    hand; the stamp of an older ranking decides only where they are not."""
    both = people.join(found.select("identity", "chave"), "identity", "left").join(levels.select("chave", "nivel"), "chave", "left")
    return both.select("identity", F.when(F.col("has_vectors"), F.col("nivel")).otherwise(F.col("stamp")).alias("barred"))


def snapshot(ranking: DataFrame, faces: DataFrame, names: list[str], level: str, reason: str | None = None, custom_name: str | None = None, place: str = "face_index") -> DataFrame:
    """Profiles of ranked people: only faces that the store holds, the first thumbs; people without vectors are skipped.
    Of rows that repeat a key the last by `place` counts."""
    if level not in (IGNORE, NO_ALBUM):
        raise ValueError(f"level {level}")
    if custom_name and len(names) > 1:
        raise ValueError("a custom name is for one person")
    people = ranking.where(F.col("pessoa").isin(*names))
    key = S.item_key(F.col("photo_id"), F.col("face_index"))
    kept = people.select("pessoa", "id", F.posexplode("faces").alias("at", "key")).join(last_rows(faces, key, place).select("key", "thumb"), "key")
    ordered = kept.groupBy("pessoa", "id").agg(F.sort_array(F.collect_list(F.struct("at", "key", "thumb"))).alias("f"))
    return ordered.select(
        F.col("id").alias("chave"), F.lit(custom_name).cast("string").alias("nome"), F.lit(level).alias("nivel"), F.lit(reason).cast("string").alias("motivo"),
        F.struct("pessoa", "id").alias("origem"), F.size("f").alias("rostos"), F.col("f.key").alias("faces"),
        F.slice(F.filter("f.thumb", lambda t: t.isNotNull()), 1, MAX_THUMBS).alias("thumbs"))


def put(profiles: DataFrame, new: DataFrame) -> DataFrame:
    return minus(profiles, new, "chave").unionByName(new)


def removed(profiles: DataFrame, key_or_name: str) -> DataFrame:
    return profiles.where((F.col("chave") != key_or_name) & ~F.coalesce(F.col("nome") == key_or_name, F.lit(False)))


def missing_names(wanted: DataFrame, ranking: DataFrame) -> DataFrame:
    """Requested names that the ranking does not have; a run with any stops."""
    return wanted.join(ranking.select("name").distinct(), "name", "left_anti")
