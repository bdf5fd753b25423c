"""Incremental identity resolution: state in, state out.

Later decisions read earlier ones, but only through faces that are near each other. Faces and identities fall into components
of the graph of pairs within the widest limit; a decision, a rediscovery, a split or a merge never looks beyond one. So each
component is resolved in path order by itself, side by side with the others. New identities are numbered over all components in
the order in which one run over everything would make them.

Components are part of the state: a disjoint-set table of faces and their roots. A batch links its new faces with all faces (never
old ones with each other), and the links join roots. Only components that the batch reaches are resolved, and those that the run
before changed; a component where a run without new faces changed nothing is settled until something in it changes. A face that has
left may leave its component larger than it need be, which changes no decision.
Merging follows with the final names, again by component. The one figure that looks further, the distance of a face of phase 2
that is near nobody, comes from quorum tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.config import BatchConfig, ResolveConfig
from semblance.functions import scalars as S
from semblance.operators import cluster, kernels, relational
from semblance.operators.cluster import coherence, constrained_clusters
from semblance.operators.photos import first_path_only
from semblance.sources.tables import FACE, written

State = dict[str, DataFrame]
COLUMNS = [c.split()[0] for c in FACE.split(", ")]
#: What a kernel gives back: rows of faces (made is null), and for each new identity a row with the key of its making.
_BORN = "stage int, root_new int, root_stage int, root_at string, root_index int, at string, index int"
_OUT = f"component string, {FACE}, decided string, made string, {_BORN}"
_PLAIN = (None,) * 8
#: Faces that a task resolves, about; a component is never cut.
BUCKET = 5000
#: Photos whose distances to everyone are computed at once.
AHEAD = 32


def graph_of(known: pd.DataFrame, quorum: int, prefix: str) -> kernels.Graph:
    g = kernels.Graph(quorum, 0, prefix)
    for name, own in known.sort_values(["person_id", "face_id"]).groupby("person_id", sort=True):
        g.people[name] = kernels.Person.of(own["face_id"].tolist(), [np.asarray(v, dtype=float) for v in own["embedding"]])
    return g


def decided(faces: pd.DataFrame, known: pd.DataFrame, cfg: ResolveConfig, phase: int, prefix: str) -> tuple[list[dict], list[tuple]]:
    """Decisions on the new faces of a component (phase 1) or its deferred ones (phase 2), rediscovery and splits: all
    rows of the component, and for each identity made its name and the key of its making."""
    g = graph_of(known[known["status"] == "assigned"], cfg.quorum, prefix)
    rows = {r["face_id"]: r | {"decided": None} for r in known.to_dict("records")}
    born: dict[str, tuple] = {}
    photos = sorted(faces.groupby("photo_id"), key=lambda x: (x[1]["path"].iloc[0], x[0]))
    for at in range(0, len(photos), AHEAD):
        some = [(photo, own.sort_values("face_index").to_dict("records")) for photo, own in photos[at : at + AHEAD]]
        g.ahead(np.array([r["embedding"] for _, own in some for r in own], dtype=float))
        for photo, own in some:
            used = set()
            for r in own:
                v, before = np.asarray(r["embedding"], dtype=float), g.sequence
                d = g.decide(r["face_id"], v, cfg.match, cfg.uncertain, cfg.coherence, phase == 1, used)
                if d.person:
                    used.add(d.person)
                if g.sequence > before:
                    born[d.person] = (0, f"{r['path']}\0{photo}", r["face_index"])
                rows[r["face_id"]] = {"face_id": r["face_id"], "photo_id": photo, "face_index": r["face_index"], "embedding": v, "person_id": d.person, "confidence": d.confidence, "status": d.status, "decided": d.person}
    if phase == 1:
        loose = [r for _, r in sorted(rows.items()) if r["status"] == "uncertain" and r["person_id"] is None]
        found = g.rediscover([r["face_id"] for r in loose], [r["photo_id"] for r in loose], [np.asarray(r["embedding"], dtype=float) for r in loose], cfg.match, cfg.coherence)
        for key, name in sorted(found.items()):
            born.setdefault(name, (1, key, 0))
            rows[key] = rows[key] | {"person_id": name, "status": "assigned"}
    for key, name in g.split(cfg.coherence, cfg.match).items():
        rows[key] = rows[key] | {"person_id": name}
    made = [(name, stage, 0, 0, "", 0, at, index) for name, (stage, at, index) in born.items()]
    for i, (name, root) in enumerate(g.splits):
        own = (1, *born[root]) if root in born else (0, 0, root, 0)
        made.append((name, 2, *own, "", i))
    return list(rows.values()), made


def merged(faces: pd.DataFrame, cfg: ResolveConfig) -> dict[str, str]:
    """old: new person of the identities of a component that are merged."""
    out = graph_of(faces, cfg.quorum, "person_").reconcile(cfg.match, cfg.coherence, cfg.enforce_exclusion)
    last = lambda n: last(out[n]) if n in out else n
    return {old: last(old) for old in out}


#: Rows of names that are broadcast at once, about 60 bytes each; more are joined by a shuffle.
SMALL = 200_000


def _components(now: DataFrame, old: DataFrame, roots: DataFrame, cfg: ResolveConfig) -> DataFrame:
    """face_id, component, dirty of the new and the old faces (face_id, embedding, person_id, status), written. dirty: the component has
    a new face, has lost one, was changed since it was last resolved, or was not settled then."""
    before = roots.select("face_id", F.col("root").alias("_root"), F.col("settled").alias("_settled"), F.col("person_id").alias("_person"), F.col("status").alias("_status"))
    same = F.col("person_id").eqNullSafe(F.col("_person")) & F.col("status").eqNullSafe(F.col("_status"))
    held = old.select("face_id", "person_id", "status").join(before, "face_id", "left")
    held = held.select("face_id", "person_id", F.coalesce("_root", "face_id").alias("root"), F.when(F.col("_root").isNull(), 1).otherwise(2).alias("kind"), (~F.coalesce(F.col("_settled") & same, F.lit(False))).alias("dirty"))
    fresh = now.select("face_id", F.lit(None).cast("string").alias("person_id"), F.col("face_id").alias("root"), F.lit(0).alias("kind"), F.lit(True).alias("dirty"))
    rows = written(held.unionByName(fresh), "rows")
    # kinds: new faces, old ones that have no root yet, old ones that have
    n = dict(rows.groupBy("kind").count().collect())
    new, rooted = now.select("face_id", "embedding"), old.select("face_id", "embedding")
    if n.get(1):
        without = rows.where("kind = 1").select("face_id")
        without = F.broadcast(without) if n[1] <= SMALL else without
        new, rooted = new.unionByName(rooted.join(without, "face_id", "left_semi")), rooted.join(without, "face_id", "left_anti")
    people = rows.where("person_id IS NOT NULL").select("person_id", "root").distinct()
    first = people.groupBy("person_id").agg(F.min("root").alias("b"), F.max("root").alias("_last")).where("b <> _last")
    # the faces of one identity are together
    pairs = people.join(first, "person_id").where("root <> b").select(F.col("root").alias("a"), "b")
    if n.get(0) or n.get(1):
        new, limit = written(new, "new"), max(cfg.match, cfg.uncertain)
        links = cluster.links_within(new, "face_id", "embedding", limit)
        if n.get(2):
            links = links.unionByName(cluster.links_between(new, rooted, "face_id", "embedding", limit))
        root = lambda side: rows.select(F.col("face_id").alias(side), F.col("root").alias(f"_{side}"))
        pairs = pairs.unionByName(links.join(root("a"), "a").join(root("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    gone = roots.join(rows.select("face_id"), "face_id", "left_anti").select("root").distinct().withColumn("_lost", F.lit(True))
    joined = cluster.components(pairs.where("a <> b")).select(F.col("item").alias("root"), "component")
    named = rows.join(joined, "root", "left").join(gone, "root", "left").select("face_id", F.coalesce("component", "root").alias("component"), (F.col("dirty") | F.coalesce("_lost", F.lit(False))).alias("dirty"))
    dirty = named.groupBy("component").agg(F.bool_or("dirty").alias("dirty"))
    return written(named.drop("dirty").join(dirty, "component").select("face_id", "component", "dirty"), "components")


def sequence_of(state: State) -> int:
    row = state["meta"].where("key = 'person_seq'").first()
    return int(row["value"]) if row else 0


def guard_model(state: State, embedder: str) -> State:
    """Identities of another model are dropped (photos go back to pending, exclusions stay); the model is recorded."""
    spark = state["meta"].sparkSession
    row = state["meta"].where("key = 'embedder'").first()
    stamp = spark.createDataFrame([("embedder", embedder)], "key string, value string")
    if row and row["value"] != embedder and not state["faces"].isEmpty():
        state = reset(state)
    return state | {"meta": relational.upsert(state["meta"], stamp, "key")}


def reset(state: State) -> State:
    pending = F.when(F.col("status") == "excluded", F.col("status")).otherwise("pending").alias("status")
    return state | {n: state[n].limit(0) for n in ("faces", "edges", "persons", "roots")} | {
        "photos": state["photos"].select(*(pending if c == "status" else c for c in state["photos"].columns)),
        "meta": state["meta"].where("key <> 'person_seq'")}


def resolve(state: State, found: DataFrame, cfg: ResolveConfig = ResolveConfig(), phase: int = 1) -> State:
    """found: photo_id, path, mtime, face_index, embedding, face_px, det_score of detected faces.

    Phase 1 takes photos that are neither finished nor excluded, phase 2 those that were deferred."""
    spark = found.sparkSession
    gated = found.where(S.passes_gate(F.col("face_px"), F.col("det_score"), cfg.min_px, cfg.min_score))
    gated = first_path_only(gated).dropDuplicates(["photo_id", "face_index"]).withColumn("face_id", S.item_key(F.col("photo_id"), F.col("face_index")))
    open_ = gated.join(state["excluded"].select("photo_id"), "photo_id", "left_anti")
    status = state["photos"].select("photo_id", "status")
    if phase == 1:
        todo = open_.join(status.where(F.col("status").isin(*S.TERMINAL)), "photo_id", "left_anti")
    else:
        todo = open_.join(status.where("status = 'deferred_multi_face'"), "photo_id", "left_semi")
    todo = written(todo.select("photo_id", "path", "mtime", "face_index", "face_id", F.col("embedding").cast("array<double>")), "todo")
    todo = relational.placed(todo, ["path", "photo_id", "face_index"])
    sequence = sequence_of(state)
    sizes = todo.groupBy("photo_id").agg(F.count(F.lit(1)).alias("n"))
    # photos of many faces wait for phase 2
    now = todo.join(sizes.where("n < 3").select("photo_id"), "photo_id", "left_semi") if phase == 1 else todo
    waiting = todo.join(now.select("face_id"), "face_id", "left_anti")
    known = state["faces"].select(*COLUMNS)
    replaced = known.join(todo.select("face_id"), "face_id", "left_anti")
    active = F.col("status").isin("assigned", "uncertain")
    old = replaced.where(active)
    parts = _components(now, old, state["roots"], cfg)
    some = parts.where("dirty").select("face_id", "component")
    n = some.count()
    some = F.broadcast(some) if n <= SMALL else some
    buckets = max(1, -(-n // BUCKET))

    def dealt(df: DataFrame) -> DataFrame:
        full = df.join(some, "face_id").withColumn("_bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
        return full.toDF(*full.columns)  # columns of its own: both sides of the cogroup come from `some`

    def kernel(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        out = []
        olds = dict(list(old.groupby("component")))
        news = dict(list(new.groupby("component")))
        for c in sorted(olds.keys() | news.keys()):
            rows, made = decided(news.get(c, new.iloc[:0]), olds.get(c, old.iloc[:0])[COLUMNS], cfg, phase, f"~{c}~")
            out += [(c, *(r[k] for k in COLUMNS), r["decided"], *_PLAIN) for r in rows]
            out += [(c, *(None for _ in COLUMNS), None, *m) for m in made]
        return pd.DataFrame(out, columns=[x.split()[0] for x in _OUT.split(", ")]).astype({k: "Int32" for k in ("face_index", "stage", "root_new", "root_stage", "root_index", "index")})

    both = dealt(now).groupBy("_bucket").cogroup(dealt(old).groupBy("_bucket"))
    out = written(both.applyInPandas(kernel, _OUT), "decided")
    born = relational.placed(out.where("made IS NOT NULL").select("component", "made", *[c.split()[0] for c in _BORN.split(", ")]),
                             ["stage", *(F.col(c).desc() for c in ("root_new", "root_stage", "root_at", "root_index")), "at", "index"])
    names = born.select(F.col("made").alias("person_id"), S.person_id(F.col("pos") + 1 + sequence).alias("_name"))
    faces = out.where("made IS NULL").join(names, "person_id", "left").withColumn("person_id", F.coalesce("_name", "person_id")).drop("_name")
    if phase == 2:
        faces = _far_confidence(written(faces.select("component", *COLUMNS, "decided"), "named"), replaced, now, cfg)
    faces = written(faces.select("component", *COLUMNS), "resolved")

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        found = {}
        for _, own in p.groupby("component"):
            if own["person_id"].nunique() > 1:
                found |= merged(own, cfg)
        return pd.DataFrame({"person_id": list(found), "_to": list(found.values())}, dtype=object)

    held = faces.where("person_id IS NOT NULL AND status = 'assigned'").withColumn("_bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    to = held.groupBy("_bucket").applyInPandas(merge, "person_id string, _to string")
    faces = faces.join(to, "person_id", "left").withColumn("person_id", F.coalesce("_to", "person_id"))
    blank = {"person_id": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "status": F.lit("deferred")}
    later = waiting.select(*(blank[c].alias(c) if c in blank else F.col(c) for c in COLUMNS))
    faces = written(faces.select("component", *COLUMNS), "resolved-faces")
    roots = _rooted(faces, old, now, born, parts, state["roots"], phase)
    rest = old.join(some, "face_id", "left_anti")
    faces = written(faces.select(*COLUMNS).unionByName(rest).unionByName(later).unionByName(replaced.where(~F.coalesce(active, F.lit(False)))), "faces")
    last = sequence + names.count()
    counts = todo.groupBy("photo_id").agg(F.min("path").alias("path"), F.max("mtime").alias("mtime"), F.count(F.lit(1)).cast("int").alias("num_faces"))
    done = F.when(F.lit(phase) == 2, "phase2_done").when(F.col("num_faces") >= 3, "deferred_multi_face").otherwise("phase1_done")
    meta = spark.createDataFrame([("person_seq", str(last))], "key string, value string")
    return with_views(state | {
        "faces": faces, "photos": relational.upsert(state["photos"], counts.withColumn("status", done), "photo_id"),
        "meta": relational.upsert(state["meta"], meta, "key"), "roots": roots})


def _rooted(faces: DataFrame, old: DataFrame, now: DataFrame, born: DataFrame, parts: DataFrame, before: DataFrame, phase: int) -> DataFrame:
    """The disjoint sets after a run. faces: those of the components that were resolved. A component is settled if a run of phase 1
    brought it no new face, made no identity in it and left every face as it was."""
    was = old.select("face_id", F.col("person_id").alias("_p"), F.col("status").alias("_s"), F.lit(True).alias("_known"))
    moved = ~(F.col("person_id").eqNullSafe(F.col("_p")) & F.col("status").eqNullSafe(F.col("_s")) & F.coalesce("_known", F.lit(False)))
    rows = faces.select("face_id", "component", "person_id", "status").join(was, "face_id", "left").withColumn("_moved", moved)
    busy = rows.where("_moved").select("component").unionByName(now.select("face_id").join(parts, "face_id").select("component")).unionByName(born.select("component")).distinct().withColumn("_busy", F.lit(True))
    quiet = F.col("_busy").isNull() & F.lit(phase == 1)
    fresh = rows.join(busy, "component", "left").select("face_id", F.col("component").alias("root"), quiet.alias("settled"), "person_id", "status")
    kept = before.join(parts.where("NOT dirty"), "face_id").select("face_id", F.col("component").alias("root"), "settled", "person_id", "status")
    return written(fresh.unionByName(kept), "roots")


def _far_confidence(faces: DataFrame, old: DataFrame, now: DataFrame, cfg: ResolveConfig) -> DataFrame:
    """faces with the confidence of those that stayed uncertain far from all: the nearest identity at their place in the run
    may be in another component."""
    place = now.select("face_id", "pos")
    new = faces.join(place, "face_id")
    far = new.where((F.col("status") == "uncertain") & F.col("decided").isNull() & (F.coalesce("confidence", F.lit(float("inf"))) > cfg.uncertain))
    crowd = now.groupBy("photo_id").agg(F.count(F.lit(1)).alias("keep"))
    items = written(far.join(crowd, "photo_id").select(F.col("face_id").alias("item"), F.col("embedding").alias("v"), F.col("photo_id").alias("photo"), "keep", "pos"), "far")
    if items.isEmpty():
        return faces
    bank = lambda df, person, photo, pos: df.select(F.col("face_id").alias("item"), person.alias("person"), F.col("embedding").alias("v"), photo.alias("photo"), pos.alias("pos"))
    before = bank(old.where("status = 'assigned' AND person_id IS NOT NULL"), F.col("person_id"), F.lit(None).cast("string"), F.lit(-1).cast("long"))
    during = bank(new.where("decided IS NOT NULL"), F.col("decided"), F.col("photo_id"), F.col("pos"))
    banks = written(before.unionByName(during), "far-banks")
    found = cluster.quorum_candidates(items, banks, cfg.quorum, ordered=True).join(items.select("item", "photo", "pos"), "item")
    # a large identity's pieces do not know all its photos
    barred = banks.where("photo IS NOT NULL").groupBy("photo", "person").agg(F.min("pos").alias("_since"))
    free = found.join(barred, ["photo", "person"], "left").where(F.col("_since").isNull() | (F.col("_since") >= F.col("pos")))
    least = free.groupBy(F.col("item").alias("face_id")).agg(F.min("score").alias("_far"))
    return faces.join(least, "face_id", "left").withColumn("confidence", F.coalesce("_far", "confidence")).drop("_far")


def with_views(state: State) -> State:
    """Persons and edges follow from the faces."""
    faces = state["faces"].where("person_id IS NOT NULL AND status = 'assigned'")
    fresh = faces.select("person_id").distinct().join(state["persons"].select("person_id"), "person_id", "left_anti").withColumn("created_at", F.current_timestamp())
    kept = state["persons"].join(faces.select("person_id").distinct(), "person_id", "left_semi")
    return state | {"persons": kept.unionByName(fresh), "edges": relational.cooccurrence(faces, "photo_id", "person_id")}


def with_all(state: State, found: DataFrame, cfg: ResolveConfig = ResolveConfig()) -> State:
    """The state with a face for everything found that passes the gate, also where no run has decided on it: what a recluster takes."""
    gated = first_path_only(found.where(S.passes_gate(F.col("face_px"), F.col("det_score"), cfg.min_px, cfg.min_score))).dropDuplicates(["photo_id", "face_index"])
    named = gated.withColumn("face_id", S.item_key(F.col("photo_id"), F.col("face_index"))).join(state["excluded"].select("photo_id"), "photo_id", "left_anti")
    named = written(named.select("face_id", "photo_id", "path", "mtime", "face_index", F.col("embedding").cast("array<double>").alias("embedding")), "every-face")
    new = named.join(state["faces"].select("face_id"), "face_id", "left_anti")
    faces = new.select("face_id", "photo_id", "face_index", "embedding", F.lit(None).cast("string").alias("person_id"), F.lit(None).cast("double").alias("confidence"), F.lit("deferred").alias("status"))
    counts = named.groupBy("photo_id").agg(F.min("path").alias("path"), F.max("mtime").alias("mtime"), F.count(F.lit(1)).cast("int").alias("num_faces"), F.lit("pending").alias("status"))
    return state | {"faces": state["faces"].unionByName(faces), "photos": state["photos"].unionByName(counts.join(state["photos"].select("photo_id"), "photo_id", "left_anti"))}


def recluster(state: State, cfg: ResolveConfig = ResolveConfig(), limit: int = BatchConfig.max_kernel_items) -> State:
    """All identities anew by constrained average linkage over all faces that no excluded photo holds, then the incoherent
    ones split. person_001 is the largest."""
    spark = state["meta"].sparkSession
    faces = written(state["faces"].join(state["excluded"].select("photo_id"), "photo_id", "left_anti"), "all-faces")
    groups = constrained_clusters(faces.select("face_id", "embedding", "photo_id"), "face_id", "embedding", "photo_id", cfg.match, limit)
    sizes = groups.groupBy("representative").agg(F.count(F.lit(1)).alias("n"))
    named = relational.next_ids(sizes, [F.col("n").desc(), F.col("representative")], 0).select("representative", F.col("person_id").alias("_p"))
    full = faces.join(groups.withColumnRenamed("item", "face_id"), "face_id").join(named, "representative")
    full = written(full.select("face_id", "photo_id", "face_index", "embedding", F.col("_p").alias("person_id"), F.lit(None).cast("double").alias("confidence"), F.lit("assigned").alias("status")), "reclustered")
    bad = coherence(full, "person_id", "face_id", "embedding").where(F.col("coherence") > cfg.coherence).select("person_id")
    sequence = named.count()

    def apart(p: pd.DataFrame) -> pd.DataFrame:
        g = kernels.Graph(cfg.quorum, 0)
        own = p.sort_values("face_id")
        g.people["keep"] = kernels.Person.of(own["face_id"].tolist(), [np.asarray(v, dtype=float) for v in own["embedding"]])
        moved = g.split(cfg.coherence, cfg.match)
        return pd.DataFrame({"face_id": own["face_id"], "base": own["person_id"], "part": [moved.get(k) for k in own["face_id"]]})

    split = written(full.join(bad, "person_id", "left_semi").groupBy("person_id").applyInPandas(apart, "face_id string, base string, part string").where("part IS NOT NULL"), "split")
    new = relational.next_ids(split.select("base", "part").distinct(), ["base", "part"], sequence).withColumnRenamed("person_id", "_new")
    moved = split.join(new, ["base", "part"]).select("face_id", "_new")
    out = full.join(moved, "face_id", "left").withColumn("person_id", F.coalesce("_new", "person_id")).select(*full.columns)
    last = sequence + new.count()
    counts = full.groupBy("photo_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    photos = state["photos"].join(counts, "photo_id", "left").select("photo_id", "path", "mtime", F.coalesce("n", "num_faces").alias("num_faces"), F.when(F.col("n").isNotNull(), "reclustered").otherwise(F.col("status")).alias("status"))
    meta = spark.createDataFrame([("person_seq", str(last))], "key string, value string")
    return with_views(state | {"faces": out, "photos": photos, "persons": state["persons"].limit(0), "meta": relational.upsert(state["meta"], meta, "key"), "roots": state["roots"].limit(0)})


def folder_view(state: State, limit: float = 0.5, min_photos: int = 3) -> DataFrame:
    coherent = coherence(state["faces"].where("person_id IS NOT NULL"), "person_id", "face_id", "embedding")
    faces = state["faces"].join(state["photos"].select("photo_id", "num_faces"), "photo_id")
    return relational.folders(faces, coherent, limit, min_photos)
