"""The pipeline's stages against plain forms of their decisions."""

import random

import corpus_pipeline as P
from semblance.llm import neardup, quality, toxicity
from test_neardup import edited, slow_classes

BAD = ("idiot", "moron")


def table(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tu") for b in ("den", "lam", "rot", "sil") for c in ("a", "e", "or", "un")]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randint(60, 120))]
        toxic = i % 5 == 0
        if i % 7 == 0:
            w = w[:30]  # too short
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    for i in range(400, 420):  # near copies
        rows.append((i, " ".join(edited(rng, rows[i - 399][1].split(), 1)), "en", "s9", 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (502, rows[1][1], "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = table(spark, tmp_path)
    d = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality_rules", "near_dedup", "mixing", "packing"]
    stage = dict(P.STAGES)
    clean = stage["toxicity"](spark, docs, d).cache()
    toxic = {i for i, t in texts.items() if t and set(t.split()) & set(BAD)}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == set(texts) - toxic
    good = stage["quality_rules"](spark, clean, d).cache()
    short = {i for i, t in texts.items() if len((t or "").split()) < 50}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == set(texts) - toxic - short
    one = stage["near_dedup"](spark, good, d).cache()
    left = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == set(slow_classes(left).values())
    mixed = stage["mixing"](spark, one, d).cache()
    assert mixed.columns == columns
    total = sum(len(r["text"].split()) for r in one.collect())
    assert abs(sum(len(r["text"].split()) for r in mixed.collect()) - 1.5 * total) < 4 * 130
    packed = stage["packing"](spark, mixed, d).collect()
    assert len(packed) == mixed.count()
    assert P.run(spark, d).count() == len(packed)
    assert quality.CURRENT in quality.POLICIES and toxicity.THRESHOLD == 0.7 and neardup.SIMILARITY == 0.8
