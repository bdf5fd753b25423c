from collections import Counter

from pyspark.sql import functions as F

from semblance.llm import quality as Q

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def slow(text):
    text = text or ""
    w = split(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    at = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text), len(lines), len(lines) - len(set(lines)), len(at), sum(c.isupper() for c in text), text.count("!")


def test_measurements_and_bits(spark, docs, odd):
    texts = ["a b c a b c a b", "x x x x", "A B\nA B\n \nc!", "# * | ok", "q w e r q w e z"]
    df = docs(*enumerate(texts, 100)).unionByName(odd)
    for r in Q.ledger(Q.measure(df)).collect():
        got = tuple(r[c] for c in Q.MEASUREMENTS)
        want = dict(zip(("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims"), slow(r["text"]), strict=True))
        assert got == tuple(want[c] for c in Q.MEASUREMENTS), r["text"][:50]
        assert (r["bits"] & 1 == 1) == (r["n_words"] < 50)


def test_policies_and_ablations(spark, docs):
    good = " ".join(f"word{i}" for i in range(60))
    df = docs((1, good), (2, "too short"), (3, good + " " + "#" * 300), (4, "! " * 80))
    entries = Q.ledger(Q.measure(df)).cache()
    assert [r["doc_id"] for r in entries.where(Q.passes()).collect()] == [1]
    assert sorted(r["doc_id"] for r in entries.where(Q.passes("v1")).collect()) == [1, 3]
    by = {r["rule"]: r for r in Q.ablations(entries).collect()}
    assert by["few_words"]["n_failed"] == 1 and by["few_words"]["n_failed_alone"] == 1 and by["few_words"]["n_kept_without"] == 2
    assert by["repeats"]["n_failed"] == 1 and by["repeats"]["n_failed_alone"] == 0
    assert set(by) == set(Q.RULES)
    assert [r["doc_id"] for r in Q.keep(df).collect()] == [1] and Q.keep(df).columns == df.columns


def test_empty_and_clashing(spark, docs):
    df = docs((1, "a b"))
    assert Q.keep(df.limit(0)).count() == 0
    clash = df.withColumn("n_words", F.lit("x")).withColumn("bits", F.lit(9))
    assert Q.ledger(Q.measure(clash)).first()["n_words"] == 2
