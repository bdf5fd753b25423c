"""Named queries over the test tables, and the SQL that gives the same rows where SQL can express them.

Stand-ins: an order is a photo and a supplier a person; an embedding is a face, its photo is vec_id div 4 and its
person the label; documents are files; events are the time-ordered stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.config import RankConfig, ResolveConfig
from semblance.functions import scalars as S
from semblance.functions import vectors as V
from semblance.operators import blocklist, cluster, relational
from semblance.plans import rank, resolve
from semblance.sources.tables import STATE, shared_dir
from semblance.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DIM = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _faces(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as faces: item, v (double), label, photo."""
    e = _t(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("item"), V.doubles("embedding").alias("v"), "label", F.expr("vec_id div 4").alias("photo"), (F.col("vec_id") % 4).cast("int").alias("idx"))


_E = "e AS (SELECT vec_id AS item, embedding::DOUBLE[] AS v, label, vec_id // 4 AS photo, (vec_id % 4)::INT AS idx FROM embeddings)"
_DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def _dist(a: str, b: str) -> str:
    return _DIST.format(a=a, b=b)


# --- deduplication, ranking, blocks, samples


@query("""SELECT sha256(text) AS content_hash, count(*) AS n, min_by(n_chars, doc_id) AS size_bytes, min_by(n_chars, doc_id) * (count(*) - 1) AS wasted_bytes,
  string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS files FROM documents GROUP BY text HAVING count(*) > 1""")
def dup_report(spark, d):
    g = relational.duplicates(_t(spark, d, "documents"), F.col("text"), F.col("n_chars"), F.col("doc_id"))
    return g.withColumn("files", F.array_join(F.col("files").cast("array<string>"), ",")).orderBy(F.col("wasted_bytes").desc(), "content_hash")


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 OR coalesce(text, '') = ''")
def dedupe_keep_first(spark, d):
    return relational.keep_first(_t(spark, d, "documents"), "text", ["doc_id"]).select("doc_id", "source", "n_chars")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS p FROM lineitem)
SELECT x.p AS person_a, y.p AS person_b, x.g AS photo_id FROM m x JOIN m y ON x.g = y.g AND x.p < y.p""")
def cooccurrence(spark, d):
    return relational.cooccurrence(_t(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


_SUMMARY = """s AS (SELECT l_suppkey AS person, count(*) AS n_faces, count(DISTINCT l_orderkey) AS n_photos, min(l_shipdate)::DATE AS first_seen, max(l_shipdate)::DATE AS last_seen,
  substr(sha256(array_to_string(list_sort(list_distinct(list(l_orderkey::VARCHAR))), '|')), 1, 12) AS stable_id FROM lineitem GROUP BY l_suppkey)"""


@query(f"""WITH {_SUMMARY}, r AS (SELECT *, row_number() OVER (ORDER BY n_faces DESC, person) AS rank FROM s)
SELECT person, n_faces, n_photos, first_seen, last_seen, stable_id, rank, 'pessoa_' || lpad(rank::VARCHAR, 2, '0') AS pessoa FROM r WHERE rank <= 20""")
def rank_top(spark, d):
    s = relational.summaries(_t(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_shipdate")
    s = s.withColumns({c: F.col(c).cast("date") for c in ("first_seen", "last_seen")})
    return relational.ranked(s, "n_faces", "person", RankConfig().top).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT event_id, (row_number() OVER (ORDER BY ts NULLS FIRST, event_id) - 1) AS pos, (row_number() OVER (ORDER BY ts NULLS FIRST, event_id) - 1) // 4000 AS block FROM events""")
def chron_blocks(spark, d):
    return relational.chronological_blocks(_t(spark, d, "events"), "ts", "event_id", 4000).select("event_id", F.col("pos").cast("long"), F.col("block").cast("long"))


@query("""WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS total FROM events),
s AS (SELECT user_id, event_id, pos AS sample FROM p WHERE total <= 48
UNION ALL SELECT user_id, event_id, i AS sample FROM p, range(48) r(i) WHERE total > 48 AND floor(i * (total / 48.0::DOUBLE))::BIGINT = pos)
SELECT user_id, event_id, sample FROM s""")
def temporal_sample(spark, d):
    return relational.evenly_spaced(_t(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("sample").cast("long"))


@query("SELECT label AS person, count(*) AS n_faces, ((count(*) - 1) // 50 + 1)::BIGINT AS n_chunks FROM embeddings GROUP BY label")
def group_sizes(spark, d):
    return _faces(spark, d).groupBy(F.col("label").alias("person")).agg(F.count(F.lit(1)).alias("n_faces")).withColumn("n_chunks", F.ceil(F.col("n_faces") / 50))


# --- vectors


@query(f"""WITH {_E} SELECT x.label, count(*) AS n_pairs, round(avg({_dist('x.v', 'y.v')}), 6) AS coherence FROM e x JOIN e y ON x.label = y.label AND x.item < y.item GROUP BY x.label""")
def coherence(spark, d):
    c = cluster.coherence(_faces(spark, d), "label", "item", "v")
    return c.select("label", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"), F.round("coherence", 6).alias("coherence"))


@query(f"""WITH {_E} SELECT x.label AS person_a, y.label AS person_b, round(avg({_dist('x.v', 'y.v')}), 6) AS distance FROM e x JOIN e y ON x.label < y.label GROUP BY x.label, y.label""")
def linkage(spark, d):
    return cluster.linkage(_faces(spark, d), "label", "v", "item").withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_E}, p AS (SELECT x.item, y.label AS person, {_dist('x.v', 'y.v')} AS d FROM e x JOIN e y ON x.item <> y.item),
r AS (SELECT *, row_number() OVER (PARTITION BY item, person ORDER BY d) AS rn FROM p), s AS (SELECT item, person, avg(d) AS score FROM r WHERE rn <= 3 GROUP BY item, person)
SELECT item, arg_min(person, score) AS person, round(min(score), 6) AS score FROM s GROUP BY item""")
def quorum_best(spark, d):
    f = _faces(spark, d)
    best = cluster.quorum_best(f.select("item", "v"), f.select("item", F.col("label").alias("person"), "v"), 3)
    return best.withColumn("score", F.round("score", 6))


@query(f"""WITH {_E} SELECT x.item AS a, y.item AS b, round({_dist('x.v', 'y.v')}, 6) AS distance FROM e x JOIN e y ON x.item < y.item WHERE {_dist('x.v', 'y.v')} <= 1.15""")
def pairs_within(spark, d):
    return cluster.pairs_within(_faces(spark, d), "item", "v", 1.15).withColumn("distance", F.round("distance", 6))


_CENTROID = "c AS (SELECT {k} AS k, list(m ORDER BY i) AS c FROM (SELECT {k}, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY {k}, i) GROUP BY {k})"


@query(f"""WITH {_E}, {_CENTROID.format(k='label')} SELECT x.k AS person_a, y.k AS person_b, round(sqrt(greatest(2 - 2 * list_dot_product(x.c, y.c), 0)), 6) AS rms FROM c x JOIN c y ON x.k < y.k""")
def rms_between(spark, d):
    return cluster.rms_between(_faces(spark, d), "label", "v", DIM).withColumn("rms", F.round("rms", 6))


@query(f"""WITH {_E} SELECT item, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, v) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(v, v))), 6) AS unit_dot FROM e""")
def vector_norms(spark, d):
    f = _faces(spark, d)
    return f.select("item", F.round(V.norm("v"), 6).alias("norm"), F.round(V.dot("v", V.normalised("v")) / V.norm("v"), 6).alias("unit_dot"))


@query(f"""WITH {_E}, m AS (SELECT x.label, sum({_dist('x.v', 'y.v')}) AS s FROM e x JOIN e y ON x.label = y.label AND x.item < y.item GROUP BY x.label), n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
t AS (SELECT x.item, y.label, sum({_dist('x.v', 'y.v')}) AS t FROM e x JOIN e y ON x.label <> y.label GROUP BY x.item, y.label)
SELECT item, label, round((s + t) / (n * (n + 1) / 2.0), 6) AS coherence FROM t JOIN m USING (label) JOIN n USING (label)""")
def coherence_after_adding(spark, d):
    f = _faces(spark, d)
    c = cluster.coherence(f, "label", "item", "v").withColumn("s", F.col("coherence") * F.col("n") * (F.col("n") - 1) / 2)
    t = cluster.sums_to_others(f, "item", "label", "v").withColumnRenamed("person", "label")
    return t.join(c, "label").select("item", "label", F.round(V.coherence_with_one_more(F.col("s"), F.col("n"), F.col("t")), 6).alias("coherence"))


# --- filters and scalar functions


@query("SELECT event_id, user_id, value FROM events WHERE coalesce(value, 0) >= 50 AND length(event_type) >= 4")
def quality_gate(spark, d):
    e = _t(spark, d, "events")
    return e.where(S.passes_gate(F.col("value"), F.length("event_type").cast("double"), 50, 4)).select("event_id", "user_id", "value")


@query(r"""WITH f AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/heic' WHEN 2 THEN 'image/png' END AS media_type,
  (CASE doc_id % 5 WHEN 0 THEN 'Screenshot_' WHEN 1 THEN 'SCREENSHOT' ELSE 'img-' END) || source || (CASE doc_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' ELSE '.heic' END) AS name FROM documents)
SELECT doc_id, name, coalesce(media_type IN ('image/jpeg', 'image/heic', 'image/heif'), false) AND NOT starts_with(lower(name), 'screenshot') AS camera, regexp_matches(name, '(?i)^screenshot_') AS screenshot,
  lower(regexp_extract(name, '\.([^./]+)$', 1)) AS extension, lower(regexp_extract(name, '\.([^./]+)$', 1)) IN ('jpg', 'heic') AS wanted FROM f""")
def media_filter(spark, d):
    k = lambda n: F.col("doc_id") % n
    media = F.when(k(4) == 0, "image/jpeg").when(k(4) == 1, "image/heic").when(k(4) == 2, "image/png")
    name = F.concat(F.when(k(5) == 0, "Screenshot_").when(k(5) == 1, "SCREENSHOT").otherwise("img-"), F.col("source"), F.when(k(3) == 0, ".JPG").when(k(3) == 1, ".mp4").otherwise(".heic"))
    f = _t(spark, d, "documents").select("doc_id", media.alias("media_type"), name.alias("name"))
    n = F.col("name")
    return f.select("doc_id", "name", S.is_camera_photo(F.col("media_type"), n).alias("camera"), S.is_screenshot(n).alias("screenshot"), S.extension(n).alias("extension"), S.has_extension(n, [".JPG", "heic"]).alias("wanted"))


@query("""WITH o AS (SELECT o_orderkey, (o_totalprice * o_totalprice)::DOUBLE AS b FROM orders)
SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576)
  WHEN b < 1099511627776 THEN printf('%.1f GB', b / 1073741824) ELSE printf('%.1f TB', b / 1099511627776) END AS size FROM o""")
def human_size(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", S.human_size((F.col("o_totalprice") * F.col("o_totalprice")).cast("double")).alias("size"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, l_orderkey || ':' || l_linenumber AS key, l_orderkey::VARCHAR AS key_group, l_linenumber::INT AS key_index,
  'person_' || lpad(l_linenumber::VARCHAR, 3, '0') AS person, substr(min(l_shipdate)::DATE::VARCHAR, 1, 7) AS month FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def scalar_misc(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("t"))
    key = S.item_key(F.col("l_orderkey"), F.col("l_linenumber"))
    return g.select("l_orderkey", "l_linenumber", "n", key.alias("key"), S.key_group(key).alias("key_group"), S.key_index(key).alias("key_index"),
                    S.person_id(F.col("l_linenumber")).alias("person"), F.date_format("t", "yyyy-MM").alias("month"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
j AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN '{"ok":true,"value":"' || event_type || '"}' WHEN event_id % 3 = 1 THEN '{"ok":false,"value":"x"}' ELSE event_type END AS name FROM e)
SELECT event_id, k::BIGINT AS k, CASE WHEN event_id % 3 = 1 THEN NULL ELSE event_type END AS name, CASE WHEN event_id % 3 = 1 THEN 'x' ELSE event_type END AS value,
  coalesce(CASE WHEN event_id % 3 = 1 THEN NULL ELSE event_type END, user_id::VARCHAR) AS filled FROM j""")
def json_unwrap(spark, d):
    e = _t(spark, d, "events")
    wrap = lambda ok, v: F.to_json(F.struct(F.lit(ok).alias("ok"), v.alias("value")))
    name = F.when(F.col("event_id") % 3 == 0, wrap(True, F.col("event_type"))).when(F.col("event_id") % 3 == 1, wrap(False, F.lit("x"))).otherwise(F.col("event_type"))
    k = S.looked_up(F.from_json("props", "map<string,bigint>"), F.lit("k"), F.lit(None).cast("long"))
    return e.withColumn("j", name).select("event_id", k.alias("k"), S.unwrapped(F.col("j")).alias("name"), S.unwrapped_value(F.col("j")).alias("value"), S.filled(S.unwrapped(F.col("j")), F.col("user_id").cast("string")).alias("filled"))


@query("""WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::DOUBLE AS x1, (l_quantity * 2)::DOUBLE AS y1, (l_quantity * 3)::DOUBLE AS x2, (l_quantity * 5)::DOUBLE AS y2 FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least(x2 - x1, y2 - y1) AS face_px, greatest(0, trunc(x1 - (y2 - y1) * 0.3)::INT) AS bx1, greatest(0, trunc(y1 - (y2 - y1) * 0.3)::INT) AS by1,
  least(120, trunc(x2 + (y2 - y1) * 0.3)::INT) AS bx2, least(160, trunc(y2 + (y2 - y1) * 0.3)::INT) AS by2, abs(x2 / y2 - 16.0 / 9) <= 0.02 AS wide FROM b""")
def box_geometry(spark, d):
    q = F.col("l_quantity").cast("double")
    li = _t(spark, d, "lineitem").withColumn("b", F.array(q, q * 2, q * 3, q * 5))
    p = S.padded_box(F.col("b"), F.lit(120), F.lit(160))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.face_px(F.col("b")).alias("face_px"), *(p[i].alias(n) for i, n in enumerate(("bx1", "by1", "bx2", "by2"))), S.is_wide_frame(F.col("b")[2], F.col("b")[3]).alias("wide"))


# --- joins


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_pending(spark, d):
    done = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.not_in(_t(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query("""SELECT o_orderkey AS uid, o_orderdate::DATE AS day FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY day NULLS FIRST, uid LIMIT 100""")
def semi_fetch(spark, d):
    person = _t(spark, d, "customer").where("c_nationkey = 3").select("c_custkey")
    have = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    o = _t(spark, d, "orders").join(person, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return relational.minus(o, have, "o_orderkey").select(F.col("o_orderkey").alias("uid"), F.col("o_orderdate").cast("date").alias("day")).orderBy(F.col("day").asc_nulls_first(), "uid").limit(100)


@query("""WITH n AS (SELECT s.s_suppkey AS uid, o.o_orderkey AS entry FROM supplier s LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o ON s.s_suppkey = o.o_custkey)
SELECT count(*) AS wanted, count(entry) AS found, count(*) - count(entry) AS unmatched FROM n""")
def unmatched_counts(spark, d):
    have = _t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("entry"))
    both = _t(spark, d, "supplier").join(have, F.col("s_suppkey") == F.col("o_custkey"), "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("entry").alias("found"), F.sum(F.col("entry").isNull().cast("long")).alias("unmatched"))


@query("""WITH k AS (SELECT conv_id, turn, max(role) AS role FROM conversations GROUP BY conv_id, turn), w AS (SELECT conv_id, unnest([0, 1, 9]) AS turn FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT w.conv_id || ':' || w.turn AS key, k.role FROM w JOIN k ON w.conv_id = k.conv_id AND w.turn = k.turn""")
def keys_in_store(spark, d):
    c = _t(spark, d, "conversations")
    store = c.groupBy("conv_id", "turn").agg(F.max("role").alias("role")).select(S.item_key(F.col("conv_id"), F.col("turn")).alias("key"), "role")
    wanted = c.select("conv_id").distinct().select(F.explode(F.array(*(S.item_key(F.col("conv_id"), F.lit(i)) for i in (0, 1, 9)))).alias("key"))
    return wanted.join(store, "key")


@query("""WITH r AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0), known AS (SELECT text, min(doc_id) AS photo FROM r WHERE doc_id % 2 = 0 GROUP BY text), f AS (SELECT doc_id AS path, text FROM documents)
SELECT path, coalesce(photo::VARCHAR, substr(sha256(f.text), 1, 16)) AS photo_id, photo IS NULL AS hashed FROM f LEFT JOIN known USING (text)""")
def known_or_hashed(spark, d):
    t = _t(spark, d, "documents").select("doc_id", "text")
    known = t.where("doc_id % 7 <> 0 AND doc_id % 2 = 0").groupBy("text").agg(F.min("doc_id").alias("photo"))
    both = t.join(known, "text", "left")
    return both.select(F.col("doc_id").alias("path"), F.coalesce(F.col("photo").cast("string"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16)).alias("photo_id"), F.col("photo").isNull().alias("hashed"))


@query("""WITH w AS (SELECT DISTINCT l_suppkey AS uid FROM lineitem WHERE l_returnflag = 'A'), m AS (SELECT uid FROM w WHERE uid NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5))
SELECT uid, (row_number() OVER (ORDER BY uid) - 1) // 50 AS chunk FROM m""")
def album_plan(spark, d):
    wanted = _t(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("uid")).distinct()
    have = _t(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("uid"))
    return relational.album_plan(wanted, have, 50).select("uid", F.col("chunk").cast("long"))


@query("""WITH i AS (SELECT o_orderkey AS path, (o_custkey % 3)::DOUBLE AS mtime FROM orders), f AS (SELECT l_orderkey AS path, bool_and(l_tax IS NOT NULL) AS scored, min((l_linenumber % 3)::DOUBLE) AS low, max((l_linenumber % 3)::DOUBLE) AS high FROM lineitem WHERE l_linenumber < 2 GROUP BY l_orderkey),
s AS (SELECT DISTINCT l_orderkey AS path, 1::DOUBLE AS scan FROM lineitem)
SELECT path, mtime FROM i LEFT JOIN f USING (path) LEFT JOIN s USING (path) WHERE NOT coalesce(CASE WHEN low IS NULL THEN scan = mtime ELSE scored AND low = mtime AND high = mtime END, false)""")
def not_indexed(spark, d):
    li = _t(spark, d, "lineitem")
    images = _t(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 3).cast("double").alias("mtime"))
    found = li.where("l_linenumber < 2").select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") % 3).cast("double").alias("mtime"), F.col("l_tax").alias("det_score"))
    scanned = li.select(F.col("l_orderkey").alias("path"), F.lit(1.0).alias("mtime")).distinct()
    return relational.not_indexed(images, found, scanned)


# --- blocklist

_PROFILES = "p AS (SELECT 'p' || label AS chave, v, photo, CASE WHEN label = 0 THEN idx ELSE (idx + 1) % 4 END AS idx FROM e WHERE label < 3 AND item % 2 = 0)"
_CONFLICTS = """i AS (SELECT label AS identity, photo, list_sort(list_distinct(list(idx))) AS a FROM e GROUP BY label, photo), q AS (SELECT chave, photo, list_distinct(list(idx)) AS b FROM p GROUP BY chave, photo),
k AS (SELECT identity, chave, count(*) AS n_conflicts FROM i JOIN q USING (photo) WHERE len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 GROUP BY identity, chave)"""


def _profiles(spark, d) -> tuple[DataFrame, DataFrame]:
    f = _faces(spark, d)
    idx = F.when(F.col("label") == 0, F.col("idx")).otherwise((F.col("idx") + 1) % 4)
    own = f.where("label < 3 AND item % 2 = 0").select(F.concat(F.lit("p"), F.col("label")).alias("chave"), "v", F.col("photo").alias("photo_id"), idx.alias("idx"))
    return f.select(F.col("label").alias("identity"), "v", F.col("photo").alias("photo_id"), "idx"), own


@query(f"WITH {_E}, {_PROFILES}, {_CONFLICTS} SELECT identity, chave, n_conflicts FROM k")
def conflicts(spark, d):
    return relational.conflicts(*_profiles(spark, d), "identity", "chave")


_NEAR = f"""{_CENTROID.format(k='label')}, pc AS (SELECT chave, list(m ORDER BY i) AS c FROM (SELECT chave, i, avg(v[i]) AS m FROM p, range(1, 65) r(i) GROUP BY chave, i) GROUP BY chave),
n AS (SELECT c.k AS identity, pc.chave, sqrt(greatest(2 - 2 * list_dot_product(c.c, pc.c), 0)) AS rms FROM c, pc),
z AS (SELECT identity, chave, rms, coalesce(n_conflicts, 0) AS n_conflicts FROM n LEFT JOIN k USING (identity, chave))"""


@query(f"""WITH {_E}, {_PROFILES}, {_CONFLICTS}, {_NEAR}, a AS (SELECT identity, arg_min(chave, rms) FILTER (rms <= 1.395 AND n_conflicts = 0) AS chave, min(rms) FILTER (rms <= 1.395 AND n_conflicts = 0) AS best, min(rms) AS least FROM z GROUP BY identity)
SELECT identity, chave, round(coalesce(best, least), 6) AS rms FROM a""")
def profile_classify(spark, d):
    return blocklist.classified(*_profiles(spark, d), DIM, 1.395).withColumn("rms", F.round("rms", 6))


@query(f"""WITH {_E}, {_PROFILES}, {_CONFLICTS}, {_NEAR} SELECT identity, chave, round(rms, 6) AS rms, n_conflicts,
  CASE WHEN rms <= 1.395 AND n_conflicts = 0 THEN 'blocked' WHEN rms <= 1.395 THEN 'near, shares photos' ELSE 'near' END AS verdict FROM z WHERE rms <= 1.395 + 0.15""")
def profile_check(spark, d):
    return blocklist.checked(*_profiles(spark, d), DIM, 1.395).withColumn("rms", F.round("rms", 6))


@query("""SELECT s_suppkey AS identity, CASE WHEN s_suppkey % 2 = 0 THEN CASE s_suppkey % 6 WHEN 0 THEN 'ignorar' WHEN 2 THEN 'sem-album' END ELSE CASE WHEN s_suppkey % 5 = 0 THEN 'sem-album' END END AS barred FROM supplier""")
def album_gate(spark, d):
    k = F.col("s_suppkey")
    people = _t(spark, d, "supplier").select(k.alias("identity"), (k % 2 == 0).alias("has_vectors"), F.when(k % 5 == 0, "sem-album").alias("stamp"))
    found = people.select("identity", F.when(F.col("identity") % 6 == 0, "p0").when(F.col("identity") % 6 == 2, "p2").alias("chave"))
    levels = spark.createDataFrame([("p0", "ignorar"), ("p2", "sem-album")], "chave string, nivel string")
    return blocklist.gate(people, found, levels)


# --- views, reports, budgets, sets, state


_PEOPLE = "f AS (SELECT l_orderkey AS photo_id, l_suppkey AS person_id, l_linenumber FROM lineitem)"


def _lineitem_faces(spark, d) -> DataFrame:
    """Lines as faces: the person is the supplier, but lines with returnflag N and number 1 are not assigned."""
    li = _t(spark, d, "lineitem")
    loose = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 1)
    n = li.groupBy(F.col("l_orderkey").alias("photo_id")).agg(F.count(F.lit(1)).alias("num_faces"))
    f = li.select(F.col("l_orderkey").alias("photo_id"), F.when(~loose, F.col("l_suppkey")).alias("person_id"),
                  F.when(loose, F.when(F.col("l_suppkey") % 2 == 0, "deferred").otherwise("uncertain")).otherwise("assigned").alias("status"))
    return f.join(n, "photo_id")


@query("""WITH f AS (SELECT l_orderkey AS photo_id, CASE WHEN NOT (l_returnflag = 'N' AND l_linenumber = 1) THEN l_suppkey END AS person_id, l_returnflag = 'N' AND l_linenumber = 1 AND l_suppkey % 2 = 0 AS deferred,
  count(*) OVER (PARTITION BY l_orderkey) AS num_faces FROM lineitem), r AS (SELECT person_id, count(DISTINCT photo_id) < 560 AS rare FROM f WHERE person_id IS NOT NULL GROUP BY person_id),
g AS (SELECT photo_id, max(num_faces) AS num_faces, bool_or(deferred) AS deferred, list_sort(list_distinct(list(f.person_id::VARCHAR || CASE WHEN f.person_id % 10 = 0 THEN '_dispersa' ELSE '' END) FILTER (f.person_id IS NOT NULL))) AS ids,
  bool_and(rare) FILTER (f.person_id IS NOT NULL) AS rare FROM f LEFT JOIN r ON f.person_id = r.person_id GROUP BY photo_id)
SELECT photo_id, CASE WHEN coalesce(rare, false) THEN 'pessoas_raras/' ELSE '' END || CASE WHEN coalesce(len(ids), 0) = 0 THEN CASE WHEN deferred THEN 'aguardando_fase2' ELSE 'revisao_manual' END
  WHEN len(ids) = 1 AND num_faces = 1 THEN ids[1] WHEN len(ids) = 1 THEN ids[1] || '_em_grupo' ELSE array_to_string(ids, '_e_') END AS folder FROM g""")
def folder_view(spark, d):
    f = _lineitem_faces(spark, d)
    c = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.when(F.col("s_suppkey") % 10 == 0, 1.2).otherwise(0.1).alias("coherence"))
    return relational.folders(f, c, 0.5, 560, by_label=True)


@query("""WITH s AS (SELECT l_suppkey AS person_id, count(*) AS n_faces FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linenumber = 1) GROUP BY l_suppkey)
SELECT person_id, n_faces, (SELECT count(*) FROM s) AS persons, (SELECT sum(n_faces) FROM s)::BIGINT AS total, round(n_faces / (SELECT sum(n_faces) FROM s), 9) AS share, person_id % 10 = 0 AS diffuse FROM s ORDER BY n_faces DESC, person_id DESC LIMIT 10""")
def run_report(spark, d):
    c = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.when(F.col("s_suppkey") % 10 == 0, 1.2).otherwise(0.1).alias("coherence"))
    return relational.report(_lineitem_faces(spark, d), c, 1.10).withColumn("share", F.round("share", 9))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice::DOUBLE AS size, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 250 AS chunk FROM orders), b AS (SELECT chunk, sum(size) AS bytes, count(*) AS n FROM o GROUP BY chunk),
c AS (SELECT *, coalesce(sum(bytes) OVER w, 0) AS spent, coalesce(sum(n) OVER w, 0) AS kept FROM b WINDOW w AS (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT chunk, round(bytes, 2) AS bytes, n FROM c WHERE spent < 500000000 AND kept < 5000""")
def running_budget(spark, d):
    o = relational.fixed_chunks(_t(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 250)
    b = o.groupBy("chunk").agg(F.sum(F.col("o_totalprice").cast("double")).alias("bytes"), F.count(F.lit(1)).alias("n"))
    return relational.within_budget(b, "chunk", "bytes", "n", 500_000_000, 5000).select(F.col("chunk").cast("long"), F.round("bytes", 2).alias("bytes"), "n")


@query("""WITH a AS (SELECT l_suppkey AS s, list_sort(list_distinct(list(l_linenumber::BIGINT))) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey AS s, list_sort(list_distinct(list(l_linenumber::BIGINT + 2))) AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s, len(list_intersect(x, y)) > 0 AS overlaps, len(list_distinct(list_concat(x, y)))::BIGINT AS n_union, len(list_filter(x, lambda i: NOT list_contains(y, i)))::BIGINT AS n_minus, len(list_intersect(x, y))::BIGINT AS n_both FROM a JOIN b USING (s)""")
def setops(spark, d):
    li = _t(spark, d, "lineitem")
    a = li.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("s")).agg(F.collect_set(F.col("l_linenumber").cast("long")).alias("x"))
    b = li.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s")).agg(F.collect_set(F.col("l_linenumber").cast("long") + 2).alias("y"))
    size = lambda c: F.size(c).cast("long")
    return a.join(b, "s").select("s", F.arrays_overlap("x", "y").alias("overlaps"), size(F.array_union("x", "y")).alias("n_union"), size(F.array_except("x", "y")).alias("n_minus"), size(F.array_intersect("x", "y")).alias("n_both"))


@query("""SELECT c_custkey AS k, 'both' AS part FROM customer INTERSECT SELECT o_custkey, 'both' FROM orders UNION ALL (SELECT c_custkey, 'before' FROM customer EXCEPT SELECT o_custkey, 'before' FROM orders)""")
def before_after(spark, d):
    c, o = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")), _t(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return c.intersect(o).withColumn("part", F.lit("both")).unionAll(c.subtract(o).withColumn("part", F.lit("before")))


@query("""WITH g AS (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0), f AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM g))
SELECT l_suppkey AS person_id, count(*) AS n_faces FROM f GROUP BY l_suppkey""")
def exclude_group(spark, d):
    faces = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("person_id"))
    gone = _t(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("photo_id"), F.lit("test").alias("reason"))
    empty = spark.createDataFrame([], "photo_id bigint, reason string")
    state = {"faces": faces, "edges": relational.cooccurrence(faces, "photo_id", "person_id"), "persons": faces.select("person_id").distinct(), "photos": faces.select("photo_id", F.lit("done").alias("status")).distinct(), "excluded": empty}
    out = relational.exclude_photos(state, gone)
    return out["faces"].join(out["persons"], "person_id").groupBy("person_id").agg(F.count(F.lit(1)).alias("n_faces"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS g, (l_suppkey - l_suppkey % 10) AS p FROM lineitem)
SELECT x.p AS person_a, y.p AS person_b, x.g AS photo_id FROM m x JOIN m y ON x.g = y.g AND x.p < y.p""")
def merge_map(spark, d):
    faces = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("person_id"))
    mapping = faces.select(F.col("person_id").alias("old"), (F.col("person_id") - F.col("person_id") % 10).alias("new")).distinct().where("old <> new")
    return relational.merge_persons(faces, relational.cooccurrence(faces, "photo_id", "person_id"), mapping)[1]


@query("""SELECT o_orderkey AS photo_id, CASE WHEN o_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS status, (CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE 0 END)::BIGINT AS vector FROM orders WHERE o_orderkey % 2 = 0 OR o_custkey % 3 = 0""".replace("CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE 0 END", "CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_custkey END"))
def upsert_latest(spark, d):
    o = _t(spark, d, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("photo_id"), F.lit("old").alias("status"), F.lit(0).cast("long").alias("vector"))
    new = o.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("photo_id"), F.lit("new").alias("status"), F.col("o_custkey").cast("long").alias("vector"))
    return relational.upsert(old, new, "photo_id", keep=["vector"])


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, l_suppkey) + 7 AS k FROM g)
SELECT l_suppkey, n, 'person_' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS person_id FROM r""")
def new_person_ids(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return relational.next_ids(g, [F.col("n").desc(), F.col("l_suppkey")], 7)


@query("SELECT o_orderstatus AS status, count(*) AS n, sum(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS kept, round(sum(o_totalprice) / 1e6, 6) AS mb FROM orders GROUP BY o_orderstatus")
def run_counters(spark, d):
    o = _t(spark, d, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("o_custkey") % 2 == 0).cast("long")).alias("kept"), F.round(F.sum("o_totalprice") / 1e6, 6).alias("mb"))


# --- linkage; where there is no SQL, tests hold the kernels against brute force


def _linked(rows: str, start: str, mean: str, t: float, tag: str = "") -> str:
    """CTEs that merge the closest two clusters of `rows` (item, v, photo, block) in each step, from the labels `start` (item, c) on."""
    ends = f"JOIN (SELECT unnest(m.items) AS item, unnest(m.label) AS c) x ON x.item = p.a JOIN (SELECT unnest(m.items) AS item, unnest(m.label) AS c) y ON y.item = p.b"
    return f"""p{tag} AS MATERIALIZED (SELECT x.item AS a, y.item AS b, {_dist('x.v', 'y.v')} AS d, x.photo = y.photo AS barred FROM {rows} x JOIN {rows} y ON x.item < y.item AND x.block = y.block),
m{tag} AS (SELECT 0 AS step, (SELECT list(item ORDER BY item) FROM {start}) AS items, (SELECT list(c ORDER BY item) FROM {start}) AS label, true AS more
  UNION ALL SELECT step + 1, items, CASE WHEN best IS NULL THEN label ELSE list_transform(label, lambda x: CASE WHEN x = best.hi THEN best.lo ELSE x END) END, best IS NOT NULL
  FROM (SELECT m.step, m.items, m.label, (SELECT struct_pack(lo := lo, hi := hi) FROM (SELECT least(x.c, y.c) AS lo, greatest(x.c, y.c) AS hi, {mean} AS cost FROM p{tag} p {ends}
    WHERE x.c <> y.c GROUP BY 1, 2 HAVING NOT bool_or(p.barred) AND {mean} <= {t}) ORDER BY cost, lo, hi LIMIT 1) AS best FROM m{tag} m WHERE m.more)),
o{tag} AS (SELECT unnest(items) AS item, unnest(label) AS representative FROM (SELECT * FROM m{tag} ORDER BY step DESC LIMIT 1))"""


_BLOCKS = f"WITH RECURSIVE {_E}, k AS (SELECT *, (row_number() OVER (ORDER BY item) - 1) // 200 AS block, item AS c FROM e), {_linked('k', 'k', 'avg(p.d)', 1.15)}"


@query(f"""WITH RECURSIVE {_E}, p AS MATERIALIZED (SELECT x.item AS a, y.item AS b FROM e x JOIN e y ON x.item <> y.item WHERE {_dist('x.v', 'y.v')} <= 1.10), r AS (SELECT a AS item, a AS reach FROM p UNION SELECT r.item, p.b FROM r JOIN p ON r.reach = p.a)
SELECT item, min(reach) AS component FROM r GROUP BY item""")
def cluster_components(spark, d):
    return cluster.components(cluster.links_within(_faces(spark, d), "item", "v", 1.10, slack=0))


@query(f"WITH RECURSIVE {_E}, k AS (SELECT *, 0 AS block, item AS c FROM e), {_linked('k', 'k', 'avg(p.d)', 1.15)} SELECT item, representative FROM o")
def constrained_clusters(spark, d):
    return cluster.constrained_clusters(_faces(spark, d), "item", "v", "photo", 1.15)


def _timed(spark, d) -> DataFrame:
    return _faces(spark, d).select("item", F.col("v").alias("vector"), "photo", F.lit(None).cast("timestamp").alias("time"))


@query(f"{_BLOCKS} SELECT item, representative FROM o")
def level1(spark, d):
    return cluster.level1(_timed(spark, d), "item", "vector", "photo", "time", 200, 1.15).select("item", "representative")


@query(f"""{_BLOCKS}, s AS MATERIALIZED (SELECT item, representative AS c FROM o WHERE representative IN (SELECT representative FROM o GROUP BY 1 HAVING count(*) > 1)),
w AS MATERIALIZED (SELECT e.item, v, photo, 0 AS block FROM e JOIN s USING (item)), {_linked('w', 's', 'sqrt(avg(p.d * p.d))', 1.25, '2')} SELECT item, representative AS identity FROM o2""")
def level2(spark, d):
    f = _timed(spark, d)
    return cluster.level2(f, cluster.level1(f, "item", "vector", "photo", "time", 200, 1.15), "item", "vector", "photo", 1.25)


@query()
def level3(spark, d):
    return rank.identities(_timed(spark, d), RankConfig(block=200, level1=1.15, level2=1.25, level3=1.2))


@query()
def rank_entities(spark, d):
    f = _faces(spark, d)
    faces = f.select("item", F.col("v").alias("vector"), F.col("photo").alias("photo_id"), F.col("idx").alias("face_index"), F.concat(F.lit("u"), F.col("photo")).alias("uid"),
                     F.lit(None).cast("timestamp").alias("capture_time"), F.lit(0.9).alias("det_score"), F.lit(80.0).alias("face_px"))
    top = rank.rank_entities(faces, RankConfig(block=200, level1=1.15, level2=1.25, level3=1.2))
    return top.select("rank", "pessoa", "identity", "n_faces", "n_photos", "stable_id", "id_v2")


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, source, n_chars FROM documents), f AS (SELECT k, doc_id, source, n_chars, 0::BIGINT AS batch, n_chars::BIGINT AS used, [source] AS seen FROM o WHERE k = 1 UNION ALL
SELECT o.k, o.doc_id, o.source, o.n_chars, CASE WHEN list_contains(seen, o.source) OR used + o.n_chars > 60000 OR len(seen) >= 250 THEN batch + 1 ELSE batch END, CASE WHEN list_contains(seen, o.source) OR used + o.n_chars > 60000 OR len(seen) >= 250 THEN o.n_chars ELSE used + o.n_chars END,
  CASE WHEN list_contains(seen, o.source) OR used + o.n_chars > 60000 OR len(seen) >= 250 THEN [o.source] ELSE list_append(seen, o.source) END FROM f JOIN o ON o.k = f.k + 1) SELECT doc_id, source, n_chars, batch FROM f""")
def plan_batches(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return cluster.planned_batches(docs, ["doc_id"], "source", "n_chars", 60_000, 250)


def _detections(spark, d) -> DataFrame:
    """Every face; every fifth photo is two of two faces, so that not all photos are crowded."""
    half = F.when((F.col("photo") % 5 == 0) & (F.col("idx") >= 2), "b").otherwise("")
    return _faces(spark, d).select(F.concat(F.lit("ph"), F.col("photo"), half).alias("photo_id"), F.concat(F.format_string("/lib/%06d", "photo"), half, F.lit(".jpg")).alias("path"), F.lit(1.0).alias("mtime"), F.col("idx").alias("face_index"),
                                   F.col("v").alias("embedding"), F.lit(80.0).alias("face_px"), F.lit(0.9).alias("det_score"))


_LOOSE = ResolveConfig(match=1.15, uncertain=1.25, coherence=1.2)


@query()
def incremental(spark, d):
    state = {n: spark.createDataFrame([], s) for n, s in STATE.items()}
    state = resolve.resolve(state, _detections(spark, d), _LOOSE, 1)
    state = resolve.resolve(state, _detections(spark, d), _LOOSE, 2)
    return state["faces"].select("face_id", "person_id", F.round("confidence", 6).alias("confidence"), "status")


@query()
def reclustered(spark, d):
    state = {n: spark.createDataFrame([], s) for n, s in STATE.items()}
    state = resolve.recluster(resolve.resolve(state, _detections(spark, d), _LOOSE, 1), _LOOSE)
    return state["faces"].select("face_id", "person_id", "status")


@query()
def stream_sweep(spark, d):
    import uuid

    root = f"{shared_dir(spark)}/sweep-{uuid.uuid4().hex}"
    _detections(spark, d).repartition(2, "photo_id").write.parquet(f"{root}/in")
    ingest.sweep(spark, f"{root}/in", root, _LOOSE)
    from semblance.sources.state import Snapshots

    return Snapshots(spark, f"{root}/state").read()["faces"].select("face_id", "person_id", "status")


#: The names under which these two ran over whole tables before their SQL did.
for _old, _name in (("coherence_after_adding_all", "coherence_after_adding"), ("exclude_group_all", "exclude_group")):
    QUERIES[_old], ORACLE_SQL[_old] = QUERIES[_name], ORACLE_SQL[_name]
