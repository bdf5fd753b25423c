"""What the engine writes: documents of ranking, blocklist and duplicates, origin markers, albums, and the clean-up of
downloads.

Documents are written as Spark writes JSON: a folder with one document a line in one file, since each is a report of bounded
size. Headers and lists are separate records, so no list passes through the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.config import BatchConfig
from semblance.functions import scalars as S
from semblance.operators import relational
from semblance.plans.rank import ranking_document
from semblance.sources.remote import client
from semblance.sources.tables import read_or_empty, written

PROFILE = "chave string, nome string, nivel string, motivo string, origem struct<pessoa: string, id: string>, rostos int, faces array<string>, thumbs array<string>"
PROFILE_FACES = "chave string, at int, embedding array<float>"
MARKER = "id string, pessoa string, ranking_gerado_em string"
#: Entries of one call to an album.
ALBUM_BATCH = BatchConfig.album_batch


def save_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").json(path)


def save_ranking(top: DataFrame, path: str, in_store: int, used: int, min_score: float, threshold: float, profiles: DataFrame | None = None) -> None:
    """<path>/people: the people in order of rank; <path>/header: when, over what and with which blocklist."""
    spark = top.sparkSession
    ranking_document(top).coalesce(1).sortWithinPartitions("pessoa").write.mode("overwrite").json(f"{path}/people", ignoreNullFields=False)
    head = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("gerado_em"), F.lit(in_store).alias("rostos_no_acervo"), F.lit(used).alias("rostos_usados"),
        F.lit(min_score).alias("min_det_score"), F.lit(threshold).alias("threshold"))
    if profiles is not None:
        listed = profiles.select("chave", "nome", "nivel", "motivo").distinct()
        head = head.crossJoin(listed.agg(F.sort_array(F.collect_list(F.struct("chave", "nome", "nivel", "motivo"))).alias("blocklist")))
    head.coalesce(1).write.mode("overwrite").json(f"{path}/header", ignoreNullFields=False)


def saved_ranking(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """People and header of a saved ranking."""
    person = "pessoa string, id string, rostos long, fotos long, bloqueio struct<nivel: string, perfil: string, nome: string, motivo: string, rms: double>, primeiro string, ultimo string, uids array<string>, faces array<string>"
    return spark.read.schema(person).json(f"{path}/people"), spark.read.json(f"{path}/header")


def save_blocklist(profiles: DataFrame, vectors: DataFrame, root: str) -> None:
    """Writes the whole list. Vectors that belong to no profile are left out, so those of removed profiles go with them."""
    profiles, kept = written(profiles, "profiles"), written(vectors.join(profiles.select("chave"), "chave", "left_semi"), "profile-vectors")
    profiles.coalesce(1).write.mode("overwrite").json(f"{root}/profiles", ignoreNullFields=False)
    kept.select("chave", "at", "embedding").write.mode("overwrite").parquet(f"{root}/vectors")


def blocklist(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles that have vectors, their vectors, and the profiles without any (to warn about); all empty for no list."""
    profiles, vectors = read_or_empty(spark, f"{root}/profiles", PROFILE), read_or_empty(spark, f"{root}/vectors", PROFILE_FACES, "parquet")
    have = vectors.select("chave").distinct()
    return profiles.join(have, "chave", "left_semi"), vectors, profiles.join(have, "chave", "left_anti")


def by_level(profiles: DataFrame, vectors: DataFrame) -> DataFrame:
    """The list as it is shown: level, name, key, vectors, origin and reason, in order."""
    sizes = vectors.groupBy("chave").agg(F.count(F.lit(1)).alias("rostos"))
    return profiles.drop("rostos").join(sizes, "chave").select("nivel", "nome", "chave", "rostos", F.coalesce("origem.pessoa", F.lit("?")).alias("era"), "motivo").orderBy("nivel", "nome", "chave")


def save_duplicates(groups: DataFrame, path: str) -> DataFrame:
    """The report of duplicate files (files, size_bytes, wasted_bytes), most waste first; returns its totals."""
    report = written(groups.select("files", "size_bytes", "wasted_bytes"), "duplicates")
    report.coalesce(1).sortWithinPartitions(F.col("wasted_bytes").desc(), F.col("files")).write.mode("overwrite").json(path)
    return report.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("wasted_bytes"), F.lit(0).cast("long")).alias("wasted_bytes"))


def save_origin(spark: SparkSession, folder: str, person: str, stable_id: str | None, ranked_at: str | None) -> None:
    """Marks whose photos a folder holds; refuses a folder that was marked for another identity."""
    before = read_or_empty(spark, f"{folder}/_origem", MARKER)
    other = before.where(F.col("id").isNotNull() & (F.col("id") != F.lit(stable_id))).first()
    if other:
        raise ValueError(f"the folder holds {other['pessoa']} ({other['id']}), not {person} ({stable_id})")
    spark.createDataFrame([(stable_id, person, ranked_at)], MARKER).coalesce(1).write.mode("overwrite").json(f"{folder}/_origem")


def pruned_downloads(before: DataFrame, after: DataFrame, keep: list[str], delete) -> tuple[int, int]:
    """Deletes the new files (path, name) whose extension is not kept, in tasks, by delete(path); how many stayed and went."""
    new = written(after.join(before.select("name"), "name", "left_anti").withColumn("kept", S.has_extension(F.col("name"), keep)), "new-files")

    def remove(batches):
        for b in batches:
            for p in b["path"]:
                delete(p)
            yield pd.DataFrame({"n": [len(b)]})

    gone = new.where(~F.col("kept")).select("path").mapInPandas(remove, "n long").agg(F.sum("n").alias("n")).first()["n"]
    return new.where("kept").count(), gone or 0


def orphans(files: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Files whose key no record has."""
    return relational.minus(files, known, key)


def fill_album(wanted: DataFrame, album: str, client_name: str, batch: int = ALBUM_BATCH, **options: str) -> DataFrame:
    """Puts the wanted photos (uid) into the album of that name, made where it is missing: one row with added, missing.

    Success of a call is not trusted: the album is read again after the batches, what is missing is sent one by one, and
    it is read once more. What the album already has is not sent."""
    spark = wanted.sparkSession
    c = client(client_name, options)
    found = sorted(a["uid"] for a in c.listing("albums") if _name(a) == album)
    if not found:
        c.create_album(album)
        found = sorted(a["uid"] for a in c.listing("albums") if _name(a) == album)
        if not found:
            raise ValueError(f"the album {album} was made but is not listed")
    uid = found[0]

    def have() -> DataFrame:
        held = [(x.get("uid") or x.get("nodeUid"),) for x in client(client_name, options).listing(f"album-{uid}")]
        return spark.createDataFrame(held, "uid string")

    def send(parts):
        own = client(client_name, options)
        for p in parts:
            errors = []
            for uids in p["uids"]:
                try:
                    own.add_photos(uid, list(uids))
                except Exception as e:
                    errors.append(str(e)[:500])
            yield pd.DataFrame({"errors": [errors]})

    before = written(have(), "album-before")
    pending = relational.album_plan(wanted.select("uid").distinct(), before, batch)
    written(pending.groupBy("chunk").agg(F.sort_array(F.collect_list("uid")).alias("uids")).select("uids").mapInPandas(send, "errors array<string>"), "album-sent")
    left = relational.minus(wanted.select("uid").distinct(), have(), "uid").select(F.array("uid").alias("uids"))
    written(left.mapInPandas(send, "errors array<string>"), "album-resent")
    after = written(have(), "album-after")
    missing = relational.minus(wanted.select("uid").distinct(), after, "uid").agg(F.count(F.lit(1)).alias("missing"))
    added = relational.minus(after, before, "uid").agg(F.count(F.lit(1)).alias("added"))
    return added.crossJoin(missing)


def _name(entry: dict) -> str | None:
    name = entry.get("name")
    return name.get("value") if isinstance(name, dict) else name
