"""Named queries of the sources, sinks and state operators: each goes through its stored form (written, read again) over whole
tables, and has the SQL of what must come back. Stand-ins as in `queries`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.config import RankConfig
from semblance.functions import images
from semblance.functions import scalars as S
from semblance.operators import blocklist, cluster, photos, relational
from semblance.plans import rank, resolve
from semblance.plans.queries import _E, _dist, _faces, _lineitem_faces, _t, query
from semblance.sources import facestore, remote, sinks
from semblance.sources.tables import CATALOG, MANIFEST, STATE, by_name_or_id, read_or_build, read_or_empty, shared_dir, written


def _root(spark) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


# --- listings and catalogs


def _detailed(spark, d) -> DataFrame:
    """documents as entries of the detailed listing: names plain, wrapped or wrapped as failed, times missing for some."""
    k = lambda n: F.col("doc_id") % n
    name = F.concat(F.when(k(11) == 0, "Screenshot_").otherwise("img-"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    wrapped = F.when(k(3) == 0, F.to_json(F.struct(F.lit(True).alias("ok"), name.alias("value")))).when(k(3) == 1, name).otherwise(F.to_json(F.struct(F.lit(False).alias("ok"), name.alias("value"))))
    photo = F.when(k(5) != 0, F.struct(F.when(k(2) == 0, "2024").otherwise("").alias("captureTime"), F.sha2("text", 256).alias("contentHash")))
    entry = F.struct(F.concat(F.lit("u"), "doc_id").alias("uid"), wrapped.alias("name"), F.when(k(7) == 0, "video/mp4").otherwise("image/jpeg").alias("mediaType"), F.when(k(4) != 0, F.col("n_chars")).alias("totalStorageSize"), F.lit("2023").alias("creationTime"), photo.alias("photo"))
    return _t(spark, d, "documents").select(F.to_json(entry).alias("value"))


_CATALOG = """c AS (SELECT 'u' || doc_id AS uid, CASE WHEN doc_id % 11 = 0 THEN 'Screenshot_' ELSE 'img-' END || doc_id || '.jpg' AS name, CASE WHEN doc_id % 7 = 0 THEN 'video/mp4' ELSE 'image/jpeg' END AS media_type,
  (CASE WHEN doc_id % 4 <> 0 THEN n_chars ELSE 0 END)::BIGINT AS size, CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN '2024' ELSE '2023' END AS capture_time, CASE WHEN doc_id % 5 <> 0 THEN sha256(text) END AS content_hash
  FROM documents WHERE doc_id % 3 <> 2)"""


@query(f"WITH {_CATALOG} SELECT * FROM c")
def catalog_scan(spark, d):
    """Detailed listing, catalog, saved as JSON and read again from the cache; the second builder must not run."""
    path = f"{_root(spark)}/catalog"
    read_or_build(spark, path, CATALOG, lambda: remote.catalog(_detailed(spark, d)))
    return read_or_build(spark, path, CATALOG, lambda: spark.createDataFrame([], CATALOG))


@query(f"""WITH {_CATALOG}, p AS (SELECT * FROM c WHERE media_type = 'image/jpeg' AND NOT starts_with(lower(name), 'screenshot')), r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY capture_time NULLS FIRST, uid) AS n FROM p)
SELECT uid, capture_time FROM r WHERE n = 1 OR content_hash IS NULL""")
def catalog_pruned(spark, d):
    return remote.pruned(remote.catalog(_detailed(spark, d))).select("uid", "capture_time")


@query("SELECT o_orderkey::VARCHAR AS uid, o_orderdate::DATE::VARCHAR AS \"captureTime\" FROM orders")
def short_timeline(spark, d):
    entry = F.struct(F.col("o_orderkey").cast("string").alias("nodeUid"), F.col("o_orderdate").cast("date").cast("string").alias("captureTime"), F.array("o_orderstatus").alias("tags"))
    return remote.timeline(_t(spark, d, "orders").select(F.to_json(entry).alias("value"))).select("uid", "captureTime")


@query("""SELECT o_orderkey::VARCHAR AS uid, CASE WHEN o_custkey % 2 = 0 THEN o_orderdate::DATE::VARCHAR ELSE 'old' END AS "captureTime" FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 5 <> 0 OR o_custkey % 2 = 1""")
def manifest_scan(spark, d):
    """The manifest after a download of which a fifth failed, saved as JSON lines and read again."""
    path, o = f"{_root(spark)}/manifest", _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderdate").cast("date").cast("string").alias("captureTime"), F.col("o_custkey") % 2 == 0, "o_orderkey", "o_custkey")
    old = o.where("o_custkey % 2 = 1").select("uid", F.lit("old").alias("captureTime"))
    results = o.where("o_custkey % 2 = 0").select("uid", (F.col("o_orderkey") % 5 != 0).alias("ok"))
    remote.manifest_with(old, results, o).write.json(path)
    return read_or_empty(spark, path, MANIFEST)


@query("""SELECT s_suppkey::VARCHAR AS uid, 'album ' || s_nationkey AS name FROM supplier""")
def album_listing(spark, d):
    name = F.concat(F.lit("album "), F.col("s_nationkey").cast("string"))
    wrapped = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct((F.col("s_suppkey") % 4 == 0).alias("ok"), name.alias("value")))).otherwise(name)
    return remote.albums(_t(spark, d, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("uid"), wrapped.alias("name"))).alias("value")))


@query("""WITH w AS (SELECT DISTINCT c_nationkey AS k FROM customer), a AS (SELECT s_nationkey AS k, min(s_suppkey::VARCHAR) AS uid FROM supplier GROUP BY 1) SELECT 'album ' || k AS name, uid FROM w LEFT JOIN a USING (k)""")
def album_or_new(spark, d):
    wanted = _t(spark, d, "customer").select(F.concat(F.lit("album "), F.col("c_nationkey").cast("string")).alias("name")).distinct()
    return remote.album_or_new(album_listing(spark, d), wanted)


@query("""SELECT (SELECT count(*) FROM orders) AS listed, count(*) FILTER (o_custkey % 3 = 0) AS already, count(*) FILTER (o_custkey % 3 = 1) AS kept, count(*) FILTER (o_custkey % 3 = 2) AS failed FROM orders""")
def download_counters(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), (F.col("o_custkey") % 3).alias("k"))
    return remote.counters(o, o.where("k = 0"), o.where("k <> 0").select("uid", (F.col("k") == 1).alias("ok")))


@query("""WITH f AS (SELECT p_partkey, 'n' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.MP4' ELSE '.jpg' END AS name FROM part), b AS (SELECT p_partkey AS uid, 'n' || p_partkey || '.jpg' AS name FROM part WHERE p_partkey % 2 = 0)
SELECT name, uid, false AS unwanted FROM f JOIN b USING (name) UNION ALL SELECT name, NULL, true FROM f WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0""")
def downloaded_files(spark, d):
    """Files of a download with the entries of their names, and the new ones whose extension is not kept."""
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("n"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, ".MP4").otherwise(".jpg")).alias("name"))
    batch = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("uid"), F.concat(F.lit("n"), "p_partkey", F.lit(".jpg")).alias("name"))
    found, _ = remote.matched_files(p, batch)
    odd = remote.unwanted(p, p.where("p_partkey % 5 = 0"), [".jpg"])
    return found.select("name", "uid", F.lit(False).alias("unwanted")).unionByName(odd.select("name", F.lit(None).cast("long").alias("uid"), F.lit(True).alias("unwanted")))


@query("""SELECT count(*) FILTER (p_partkey % 3 <> 0 AND p_partkey % 5 <> 0) AS kept, count(*) FILTER (p_partkey % 3 = 0 AND p_partkey % 5 <> 0) AS gone FROM part""")
def downloads_pruned(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey"), F.concat(F.lit("n"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, ".MP4").otherwise(".jpg")).alias("name")).withColumn("path", F.col("name"))
    kept, gone = sinks.pruned_downloads(p.where("p_partkey % 5 = 0"), p, [".jpg"], str)  # nothing is on disk: str deletes nothing
    return spark.createDataFrame([(kept, gone)], "kept long, gone long")


# --- the face store


def _stored(spark, d) -> DataFrame:
    f = _faces(spark, d)
    return f.select(F.concat(F.lit("p"), "photo").alias("photo_id"), F.col("idx").alias("face_index"), F.concat(F.lit("u"), "photo").alias("uid"), F.lit(0.9).alias("det_score"), F.col("v").cast("array<float>").alias("embedding"))


@query(f"""WITH {_E} SELECT 'p' || photo AS photo_id, idx AS face_index, 'u' || photo AS uid, round(sqrt(list_dot_product(v, v)), 6) AS norm, (SELECT count(*) FROM e) AS stored FROM e""")
def face_store(spark, d):
    """Half of the faces appended, then all of them twice; metadata and vectors read apart and joined by key."""
    root, f = _root(spark), _stored(spark, d)
    for part in (f.where("face_index < 2"), f, f):
        facestore.append(spark, root, part, 64)
    v = facestore.vectors(spark, root, 64).withColumn("v", F.col("embedding").cast("array<double>"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return facestore.metadata(spark, root).join(v, ["photo_id", "face_index"]).select("photo_id", "face_index", "uid", F.round(norm, 6).alias("norm"), F.lit(facestore.count(spark, root)).cast("long").alias("stored"))


@query("""SELECT o_orderkey::VARCHAR AS uid, coalesce(n, 0)::INT AS faces FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def scan_log(spark, d):
    """Orders as entries and their lines as faces, logged in two runs of which the second repeats the first."""
    root, n = _root(spark), _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = _t(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderkey").cast("string").alias("photo_id"), F.coalesce("n", F.lit(0)).cast("int").alias("faces"))
    facestore.mark_scanned(spark, root, o.where("cast(uid as long) % 2 = 0"))
    facestore.mark_scanned(spark, root, o)
    return facestore.scan_log(spark, root).select("uid", "faces")


@query("SELECT o_orderkey::VARCHAR AS uid FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def scan_pending(spark, d):
    root = _root(spark)
    seen = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("uid"), F.lit("p").alias("photo_id"), F.lit(1).alias("faces"))
    facestore.mark_scanned(spark, root, seen)
    return relational.minus(_t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("uid")), facestore.scanned_uids(spark, root), "uid")


@query(f"WITH {_E} SELECT 'same' AS asked, 'p' || photo AS path, idx AS face_index FROM e")
def index_guarded(spark, d):
    """An index is read for its own model and is empty for another."""
    path = f"{_root(spark)}/index"
    facestore.save_index(_stored(spark, d).select(F.col("photo_id").alias("path"), F.lit(1.0).alias("mtime"), "face_index", "det_score", F.col("embedding").cast("array<double>").alias("embedding")), path, "one")
    read = lambda model, asked: facestore.read_index(spark, path, model).select(F.lit(asked).alias("asked"), "path", "face_index")
    return read("one", "same").unionByName(read("two", "other"))


@query("""WITH f AS (SELECT l_orderkey AS path, l_linenumber, l_partkey, l_suppkey FROM lineitem), c AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT path, count(*) AS n, sum(CASE WHEN path IN (FROM c) THEN 1 ELSE l_linenumber END)::BIGINT AS marks FROM f GROUP BY path""")
def faces_replaced(spark, d):
    li = _t(spark, d, "lineitem")
    index = li.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("mark"))
    changed = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"), F.lit(2.0).alias("mtime")).distinct()
    found = index.join(changed.select("path"), "path", "left_semi").withColumn("mark", F.lit(1).cast("long"))
    new, _ = relational.replace_images(index, changed.limit(0), found, changed)
    return new.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("marks"))


@query(f"WITH {_E} SELECT item, 512::BIGINT AS bytes, round(list_sum(v), 6) AS total FROM e")
def vector_bytes(spark, d):
    both = _faces(spark, d).select("item", images.packed("v").alias("b"))
    return both.select("item", F.octet_length("b").cast("long").alias("bytes"), F.round(F.aggregate(images.unpacked("b"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# --- photos


@query(f"""WITH {_E} SELECT photo AS image, list(idx ORDER BY idx)::VARCHAR AS faces FROM e WHERE (item % 7) * 20 >= 50 GROUP BY photo""")
def faces_by_image(spark, d):
    f = _faces(spark, d).select(F.col("photo").alias("image"), F.col("idx").alias("face_index"), ((F.col("item") % 7) * 20).cast("double").alias("face_px"), F.lit(0.9).alias("det_score"))
    lists = photos.faces_by_image(f, 50, 0.6).select("image", F.col("faces.face_index").alias("f"))
    return lists.select("image", F.concat(F.lit("["), F.array_join(F.col("f").cast("array<string>"), ", "), F.lit("]")).alias("faces"))


@query(f"""WITH {_E}, g AS (SELECT label, min(item) AS first, list(item ORDER BY item)::VARCHAR AS members FROM e GROUP BY label) SELECT row_number() OVER (ORDER BY first) - 1 AS place, label, members FROM g""")
def members_in_order(spark, d):
    m = photos.members_of(_faces(spark, d).withColumn("at", F.col("item")), "label", "item", "at")
    return m.select("place", "label", F.concat(F.lit("["), F.array_join(F.col("members").cast("array<string>"), ", "), F.lit("]")).alias("members"))


@query("""WITH s AS (SELECT l_suppkey AS k, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS persons, count(*) FILTER (n < 560) AS rare, count(*) FILTER (k % 10 = 0) AS diffuse, count(*) FILTER (n < 560 AND k % 10 = 0) AS both FROM s""")
def rare_and_diffuse(spark, d):
    sizes = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("person_id")).agg(F.count_distinct("l_orderkey").alias("n_photos"))
    c = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.when(F.col("s_suppkey") % 10 == 0, 1.2).otherwise(0.1).alias("coherence"))
    return photos.rare_and_diffuse(sizes, c, 560, 0.5)


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'excluded' ELSE 'pending' END AS status FROM orders) SELECT o_orderkey AS photo_id, status, status IN ('phase1_done', 'phase2_done', 'deferred_multi_face', 'reclustered') AS terminal FROM p""")
def photo_status(spark, d):
    o = _t(spark, d, "orders")
    p = photos.with_status(o.select(F.col("o_orderkey").alias("photo_id"), F.lit("pending").alias("status")), o.where("o_custkey % 4 = 0").select(F.col("o_orderkey").alias("photo_id")), "excluded")
    return photos.status_of(p, p).withColumn("terminal", F.col("status").isin(*S.TERMINAL))


@query("""WITH r AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0) SELECT doc_id AS path, CASE WHEN doc_id % 7 <> 0 THEN 'photo' || doc_id WHEN doc_id % 2 = 0 THEN substr(sha256(text), 1, 16) END AS photo_id,
  doc_id % 7 = 0 AND doc_id % 2 = 0 AS hashed, doc_id % 7 = 0 AND doc_id % 2 = 1 AS orphan FROM documents""")
def photo_of_path(spark, d):
    t = _t(spark, d, "documents")
    known = t.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.concat(F.lit("photo"), "doc_id").alias("photo_id"))
    files = t.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("content"))
    return photos.photo_of_path(files, known).select("path", "photo_id", "hashed", "orphan")


@query("""WITH f AS (SELECT l_orderkey AS photo_id, l_suppkey AS path, l_linenumber FROM lineitem), m AS (SELECT photo_id, min(path) AS path FROM f GROUP BY 1) SELECT photo_id, path, count(*) AS n FROM f JOIN m USING (photo_id, path) GROUP BY ALL""")
def first_path_only(spark, d):
    f = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("path"), "l_linenumber")
    return photos.first_path_only(f).groupBy("photo_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id || ':' || (turn % 2) AS key, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id, turn % 2""")
def last_rows(spark, d):
    c = _t(spark, d, "conversations")
    return photos.last_rows(c, S.item_key(F.col("conv_id"), F.col("turn") % 2), "turn").select("key", "role", "turn")


@query("""WITH f AS (SELECT * FROM lineitem WHERE l_orderkey::VARCHAR NOT IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_custkey % 2 = 0)) SELECT l_suppkey AS person_id, count(*) AS n_faces FROM f GROUP BY 1""")
def exclude_by_path(spark, d):
    """Files are excluded by the hash of their content, which is the photo id."""
    digest = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    faces = _t(spark, d, "lineitem").select(digest("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("person_id"))
    files = _t(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("content"))
    state = {"faces": faces, "edges": spark.createDataFrame([], "person_a bigint, person_b bigint, photo_id string"), "persons": faces.select("person_id").distinct(), "photos": faces.select("photo_id", F.lit("done").alias("status")).distinct(), "excluded": spark.createDataFrame([], "photo_id string, reason string")}
    return photos.exclude_paths(state, files, "test")["faces"].groupBy("person_id").agg(F.count(F.lit(1)).alias("n_faces"))


@query("SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 7)")
def orphan_files(spark, d):
    return sinks.orphans(_t(spark, d, "part").select(F.col("p_partkey").alias("key")), _t(spark, d, "lineitem").where("l_returnflag = 'A' AND l_linenumber = 7").select(F.col("l_partkey").alias("key")), "key")


# --- documents


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS m, substr(sha256(array_to_string(list_sort(list_distinct(list(l_orderkey::VARCHAR))), '|')), 1, 12) AS id FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, l_suppkey) AS k FROM s)
SELECT unnest(['pessoa_' || lpad(k::VARCHAR, 2, '0'), id]) AS name, n AS rostos, m AS fotos FROM r WHERE k <= 20""")
def ranking_saved(spark, d):
    """The ranking written as a document, read again and addressed by place and by stable id."""
    top = relational.summaries(_t(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_shipdate")
    empty = F.array().cast("array<string>")
    top = relational.ranked(top, "n_faces", "person", RankConfig().top).select("*", empty.alias("uids"), empty.alias("faces"), F.lit(None).cast("struct<nivel: string, perfil: string, nome: string, motivo: string, rms: double>").alias("bloqueio"))
    path = _root(spark)
    sinks.save_ranking(top, path, 1, 1, 0.7, 1.0)
    return by_name_or_id(sinks.saved_ranking(spark, path)[0]).select("name", "rostos", "fotos")


@query("""WITH p AS (SELECT 'k' || s_suppkey AS chave, CASE WHEN s_suppkey % 2 = 0 THEN 'ignorar' ELSE 'sem-album' END AS nivel, 'n' || s_suppkey AS nome FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT nivel, nome, chave, n AS rostos, '?' AS era FROM p JOIN (SELECT 'k' || l_suppkey AS chave, count(*) AS n FROM lineitem GROUP BY 1) USING (chave)""")
def blocklist_saved(spark, d):
    """Profiles saved with their vectors, some removed and saved again: the vectors of those are gone as well."""
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    p = _t(spark, d, "supplier").select(F.concat(F.lit("k"), k).alias("chave"), F.concat(F.lit("n"), k).alias("nome"), F.when(k % 2 == 0, blocklist.IGNORE).otherwise(blocklist.NO_ALBUM).alias("nivel"), none.alias("motivo"),
                                          F.lit(None).cast("struct<pessoa: string, id: string>").alias("origem"), F.lit(0).alias("rostos"), F.array().cast("array<string>").alias("faces"), F.array().cast("array<string>").alias("thumbs"))
    v = _t(spark, d, "lineitem").select(F.concat(F.lit("k"), "l_suppkey").alias("chave"), F.col("l_linenumber").cast("int").alias("at"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    root = _root(spark)
    sinks.save_blocklist(p, v, root)
    profiles, vectors, _ = sinks.blocklist(spark, root)
    sinks.save_blocklist(profiles.where("cast(substring(chave, 2) as long) % 5 <> 0"), vectors, root)
    profiles, vectors, bare = sinks.blocklist(spark, root)
    return sinks.by_level(profiles, vectors).select("nivel", "nome", "chave", "rostos", "era")


@query("""SELECT 'k' || s_suppkey AS chave, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS nome FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 3 = 0""")
def profiles_changed(spark, d):
    p = _t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("k"), "s_suppkey").alias("chave"), F.lit("old").alias("nome"))
    left = blocklist.removed(p.withColumn("nome", F.when((F.col("s_suppkey") % 4 == 0), "gone").otherwise("old")), "gone")
    return blocklist.put(left, p.where("s_suppkey % 3 = 0").withColumn("nome", F.lit("new"))).select("chave", "nome")


@query("""WITH w AS (SELECT DISTINCT 'pessoa_' || lpad(l_linenumber::VARCHAR, 2, '0') AS name FROM lineitem UNION SELECT 'Ana') SELECT name FROM w WHERE name LIKE 'pessoa\\_%' ESCAPE '\\' AND name NOT IN ('pessoa_01', 'pessoa_02')""")
def names_missing(spark, d):
    wanted = _t(spark, d, "lineitem").select(S.rank_name(F.col("l_linenumber")).alias("name")).distinct().unionByName(spark.createDataFrame([("Ana",)], "name string"))
    return blocklist.missing_names(photos.ranked_names(wanted), spark.createDataFrame([("pessoa_01",), ("pessoa_02",)], "name string"))


@query("""WITH g AS (SELECT count(*) AS n, min_by(n_chars, doc_id) AS size FROM documents GROUP BY text HAVING count(*) > 1) SELECT count(*) AS groups, sum(size * (n - 1))::BIGINT AS wasted_bytes FROM g""")
def duplicates_saved(spark, d):
    g = relational.duplicates(_t(spark, d, "documents"), F.col("text"), F.col("n_chars"), F.col("doc_id"))
    return sinks.save_duplicates(g.withColumn("files", F.col("files").cast("array<string>")), f"{_root(spark)}/duplicates")


@query("""SELECT o_orderkey AS uid, o_orderdate::DATE AS capture_time FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7) AND o_custkey % 3 <> 0""")
def photos_to_fetch(spark, d):
    """What a folder lacks of one person's photos."""
    uids = _t(spark, d, "lineitem").where("l_suppkey = 7").agg(F.collect_set("l_orderkey").alias("uids"))
    ranking = uids.select(F.lit("pessoa_01").alias("pessoa"), F.lit("x").alias("id"), "uids")
    c = _t(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderkey").alias("name"), F.col("o_orderdate").cast("date").alias("capture_time"), "o_custkey")
    return rank.photos_to_fetch(ranking, "pessoa_01", c, c.where("o_custkey % 3 = 0")).select("uid", "capture_time")


# --- state


def _state(spark, d) -> dict[str, DataFrame]:
    """Lines as faces in the state's own columns."""
    f = _lineitem_faces(spark, d).select(F.expr("uuid()").alias("face_id"), F.col("photo_id").cast("string").alias("photo_id"), F.lit(0).alias("face_index"), F.lit(None).cast("array<double>").alias("embedding"), S.person_id(F.col("person_id")).alias("person_id"), F.lit(None).cast("double").alias("confidence"), "status")
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("photo_id"), F.lit("p").alias("path"), F.lit(1.0).alias("mtime"), F.lit(1).alias("num_faces"), F.when(F.col("o_custkey") % 5 == 0, "excluded").otherwise("phase1_done").alias("status"))
    empty = {n: spark.createDataFrame([], s) for n, s in STATE.items()}
    meta = spark.createDataFrame([("embedder", "one"), ("person_seq", "9")], "key string, value string")
    return empty | {"faces": f.withColumn("person_id", F.when(F.col("status") == "assigned", F.col("person_id"))), "photos": o, "meta": meta}


@query("""SELECT CASE WHEN o_custkey % 5 = 0 THEN 'excluded' ELSE 'pending' END AS status, count(*) AS n, 0::BIGINT AS faces, 'two' AS embedder FROM orders GROUP BY 1""")
def model_guard(spark, d):
    """Another model drops all identities and puts photos back to pending; exclusions stay."""
    s = resolve.guard_model(_state(spark, d), "two")
    name = s["meta"].where("key = 'embedder'").first()["value"]
    return s["photos"].groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("faces", F.lit(s["faces"].count()).cast("long")).withColumn("embedder", F.lit(name))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS p FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linenumber = 1)), n AS (SELECT g, 'person_' || CASE WHEN p < 1000 THEN lpad(p::VARCHAR, 3, '0') ELSE p::VARCHAR END AS p FROM m)
SELECT x.p AS person_a, y.p AS person_b, count(*) AS n_photos, (SELECT count(DISTINCT p) FROM n) AS persons FROM n x JOIN n y ON x.g = y.g AND x.p < y.p GROUP BY ALL""")
def edges_rebuilt(spark, d):
    s = resolve.with_views(_state(spark, d))
    n = s["persons"].count()
    return s["edges"].groupBy("person_a", "person_b").agg(F.count(F.lit(1)).alias("n_photos")).withColumn("persons", F.lit(n).cast("long"))


# --- clustering in parts that SQL can state


@query("WITH b AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 200 AS block FROM embeddings) SELECT block, count(*) AS n FROM b GROUP BY block")
def level1_sizes(spark, d):
    """Rows of each block that level 1 gives back with their places."""
    f = _faces(spark, d).select("item", F.col("v").alias("vector"), "photo", F.lit(None).cast("timestamp").alias("time"))
    found = cluster.level1(f, "item", "vector", "photo", "time", 200, 1.15)
    return found.groupBy(F.floor(F.col("pos") / 200).alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_E}, b AS (SELECT item, v, label, item // 2 AS photo FROM e WHERE item % 2 = 0), l AS (SELECT item, v, item // 2 AS photo FROM e WHERE item % 2 = 1),
p AS (SELECT l.item, b.label, {_dist('l.v', 'b.v')} AS d FROM l, b), r AS (SELECT *, row_number() OVER (PARTITION BY item, label ORDER BY d) AS n FROM p), s AS (SELECT item, label, avg(d) AS score FROM r WHERE n <= 3 GROUP BY ALL),
k AS (SELECT s.item, s.label, s.score FROM s JOIN l ON s.item = l.item WHERE NOT EXISTS (FROM b WHERE b.photo = l.photo AND b.label = s.label)), m AS (SELECT item, arg_min(label, score) AS label, min(score) AS score FROM k GROUP BY item)
SELECT item, label AS identity FROM m WHERE score <= 1.25 UNION ALL SELECT item, label FROM b""")
def loose_assigned(spark, d):
    """Even items are members of their label, odd ones loose; two neighbours share a photo, so a loose item may not go where its neighbour is."""
    f = _faces(spark, d).select("item", F.col("v").alias("vector"), F.expr("item div 2").alias("photo"), "label")
    members = f.where("item % 2 = 0").select("item", F.col("label").cast("long").alias("identity"))
    return cluster.level3(f, members, "item", "vector", "photo", 1.25, 3)


@query(f"""WITH RECURSIVE {_E}, p AS MATERIALIZED (SELECT x.item AS a, y.item AS b FROM e x JOIN e y ON x.item <> y.item WHERE {_dist('x.v', 'y.v')} <= 1.10), r AS (SELECT a AS item, a AS reach FROM p UNION SELECT r.item, p.b FROM r JOIN p ON r.reach = p.a)
SELECT item, min(reach) AS component FROM r GROUP BY item""")
def components_of_pairs(spark, d):
    return cluster.components(cluster.links_within(_faces(spark, d), "item", "v", 1.10, slack=0))


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, source, n_chars FROM documents), f AS (SELECT k, doc_id, 0::BIGINT AS batch, n_chars::BIGINT AS used, [source] AS seen FROM o WHERE k = 1 UNION ALL
SELECT o.k, o.doc_id, CASE WHEN list_contains(seen, source) OR used + n_chars > 60000 OR len(seen) >= 250 THEN batch + 1 ELSE batch END, CASE WHEN list_contains(seen, source) OR used + n_chars > 60000 OR len(seen) >= 250 THEN n_chars ELSE used + n_chars END,
  CASE WHEN list_contains(seen, source) OR used + n_chars > 60000 OR len(seen) >= 250 THEN [source] ELSE list_append(seen, source) END FROM f JOIN o ON o.k = f.k + 1) SELECT doc_id, batch FROM f""")
def batches_planned(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return cluster.planned_batches(docs, ["doc_id"], "source", "n_chars", 60_000, 250).select("doc_id", "batch")


@query("SELECT l_suppkey AS person, 'done' AS pruned FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) WHERE n >= 2")
def recurrent_only(spark, d):
    """Groups below the least size vanish, as in the second level of the ranking."""
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("person"))
    return relational.recurrent(rows, "person", 2).select("person", F.lit("done").alias("pruned")).distinct()
