"""Global ranking: gate, levels 1 to 3, blocklist, top people with their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.config import RankConfig
from semblance.functions import scalars as S
from semblance.operators import blocklist, cluster, relational
from semblance.sources.tables import written


def identities(items: DataFrame, cfg: RankConfig = RankConfig()) -> DataFrame:
    """item, identity of every item that belongs to a recurrent identity.

    items: item, vector, photo, time. Single items of level 1 come back at level 3."""
    first = written(cluster.level1(items, "item", "vector", "photo", "time", cfg.block, cfg.level1), "level1")
    second = written(cluster.level2(items, first, "item", "vector", "photo", cfg.level2), "level2")
    return written(cluster.level3(items, second, "item", "vector", "photo", cfg.level3, cfg.quorum), "level3")


def rank_entities(faces: DataFrame, cfg: RankConfig = RankConfig(), profiles: DataFrame | None = None) -> DataFrame:
    """The most frequent people. faces: item, vector, photo_id, face_index, uid, capture_time, det_score, face_px;
    profiles: chave, nivel, nome, motivo, v, photo_id, idx. People at level ignore leave before the top is cut; a
    block at the other level is only stamped."""
    used = written(faces.where(S.passes_gate(F.col("face_px"), F.col("det_score"), cfg.min_px, cfg.min_score)), "used")
    found = identities(used.select("item", "vector", F.col("photo_id").alias("photo"), F.col("capture_time").alias("time")), cfg)
    full = written(used.join(found, "item"), "ranked")
    people = relational.summaries(full, "identity", "uid", "capture_time").withColumnRenamed("person", "identity")
    keys = full.groupBy("identity").agg(F.sort_array(F.collect_list(S.item_key(F.col("photo_id"), F.col("face_index")))).alias("faces"), F.sort_array(F.collect_set("uid")).alias("uids"))
    people = people.join(keys, "identity").withColumn("id_v2", S.stable_id(F.col("faces")))
    stamp = F.lit(None).cast("struct<nivel: string, perfil: string, nome: string, motivo: string, rms: double>").alias("bloqueio")
    if profiles is None or full.isEmpty():
        people = people.select("*", stamp)
    else:
        dim = len(full.select("vector").first()[0])
        members = full.select("identity", F.col("vector").alias("v"), "photo_id", F.col("face_index").alias("idx"))
        hit = {n: blocklist.classified(members, blocklist.of_level(profiles, n), dim, cfg.blocked).where("chave IS NOT NULL") for n in (blocklist.IGNORE, blocklist.NO_ALBUM)}
        people = people.join(hit[blocklist.IGNORE], "identity", "left_anti")
        about = profiles.select("chave", "nivel", "nome", "motivo").dropDuplicates(["chave"])
        mark = hit[blocklist.NO_ALBUM].join(about, "chave").select("identity", F.struct("nivel", F.col("chave").alias("perfil"), "nome", "motivo", F.round("rms", 3).alias("rms")).alias("bloqueio"))
        people = people.join(mark, "identity", "left")
    return relational.ranked(people, "n_faces", "identity", cfg.top)


def ranking_document(top: DataFrame) -> DataFrame:
    """The people of a ranking as they are stored."""
    date = lambda c: F.col(c).cast("string")
    return top.select("pessoa", F.col("stable_id").alias("id"), F.col("n_faces").alias("rostos"), F.col("n_photos").alias("fotos"), "bloqueio",
                      date("first_seen").alias("primeiro"), date("last_seen").alias("ultimo"), "uids", "faces")


def photos_to_fetch(ranking: DataFrame, name: str, catalog: DataFrame, have: DataFrame, limit: int | None = None) -> DataFrame:
    """Catalog entries of a person that the folder lacks, oldest first (null time first)."""
    uids = ranking.where((F.col("pessoa") == name) | (F.col("id") == name)).select(F.explode("uids").alias("uid")).distinct()
    entries = catalog.join(uids, "uid", "left_semi").join(have.select("name").distinct(), "name", "left_anti")
    ordered = entries.orderBy(F.col("capture_time").asc_nulls_first(), "uid")
    return ordered.limit(limit) if limit else ordered


def contact_sample(full: DataFrame, n: int = 48) -> DataFrame:
    """Up to n faces of each identity, evenly spaced in time."""
    return relational.evenly_spaced(full, "identity", [F.col("capture_time").asc_nulls_first(), F.col("item")], n)
