import pytest

from semblance.llm import mixing as M


def slow_targets(sizes, share=M.SHARE, cap=M.MAX_EPOCHS):
    """Reshares the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, w = budget - sum(fixed.values()), sum(weight[s] for s in free)
        target = {s: rest * weight[s] / w for s in free}
        above = [s for s in free if target[s] >= cap * sizes[s]]
        if not above:
            return target | fixed
        fixed |= {s: cap * sizes[s] for s in above}


def test_targets_and_taken(spark, docs):
    rows = [(i, "w " * (1 + i * 7 % 40), s) for i, s in enumerate(["a"] * 300 + ["b"] * 20 + ["c"] * 60 + [None] * 40 + ["\u00e9"] * 30)]
    got = M.mix(docs(*rows)).collect()
    assert len(got) == len(rows)
    size, taken, target = {}, {}, {}
    for r in got:
        s = r["source"]
        size[s], taken[s], target[s] = size.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
        assert r["taken"] <= 2 * r["size"]
    want = slow_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 40
    again = {(r["doc_id"], r["taken"]) for r in M.mix(docs(*rows[::-1])).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_odd_rows(spark, docs, odd):
    got = M.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert M.mix(odd.limit(0)).count() == 0
    assert M.repeated(docs((1, "a b c", "x"), (2, "d e f", "y"))).columns == odd.columns
    assert {r["target"] for r in M.mix(docs((1, "", "x"))).collect()} == {0.0}


def test_repeated_takes_rows_without_an_id_and_with_equal_ids(spark, docs):
    rows = [(None, f"n{i} w w", "x") for i in range(30)] + [(5, f"r{i} " + "w " * i, "x") for i in range(30)] + [(i + 10, "v w", "y") for i in range(20)]
    df = docs(*rows)
    plan, out = M.mix(df).collect(), M.repeated(df).collect()
    count = lambda keep, rows_: sum(r.asDict().get("repeats", 1) for r in rows_ if keep(r["doc_id"]))
    for keep in (lambda i: i is None, lambda i: i == 5, lambda i: i is not None and i >= 10):
        assert count(keep, plan) == count(keep, out) > 0
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in plan)
