"""Collocations against a count of every phrase in plain Python, and the perfect hash alone."""

import re
from collections import Counter

import numpy as np
import pytest

from semblance.llm import collocation
from semblance.llm.collocation import PerfectHash


def brute(rows, least, longest=5, top=2000, share=100):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    candidates = {key: a for key, a in f.items() if len(key[1]) >= 2 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(la == lang and len(q) > len(p) and inside(q) and 100 * c >= share * a for (la, q), c in candidates.items()):
            continue
        score, _, x, y = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), x, y, n[lang]))
    ranked, place = [], Counter()
    for lang, s, a, p, x, y, total in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p.decode(), -a, x, y, total, -s))
    return ranked


def texts():
    rng = np.random.default_rng(5)
    words = ["The", "the", "of", "naïve", "\x01odd", "a\x00b", " wide", "x-y", "I", "ÄRGER", "z"]
    rows = [(" ".join(rng.choice(words, int(rng.integers(0, 60)), p=[0.3, 0.1, 0.2] + [0.05] * 8)) + str(rng.choice(["", ".", "!?", "\n"])), str(rng.choice(["en", "de", "und"]))) for _ in range(80)]
    rows += [("new york city hall opens. New York\tcity, hall  opens; new york\x0bcity hall opens", "en")] * 7
    rows += [(None, "en"), ("", None), (" \t ", "en"), ("no lang here no lang here", None), ("no lang here", "und"), ("a.b.c", ""), ("of the " * 3000, None)]
    return rows


@pytest.mark.parametrize("least,per_pass,share", [(3, 1 << 31, 100), (3, 700, 100), (9, 1 << 31, 80)])
def test_equals_brute_force(spark, least, per_pass, share):
    rows = texts()
    df = spark.createDataFrame([(i, t, la, 1, 2) for i, (t, la) in enumerate(rows)], "doc_id long, text string, lang string, n long, words long").repartition(5)
    got = [tuple(r) for r in collocation.collocations(df, least, per_pass=per_pass, share=share).collect()]
    want = brute(rows, least, share=share)
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_limit_keeps_the_best_with_ties(spark):
    rows = [(f"p{i} q{i}. " * 3, "en") for i in range(30)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = [tuple(r) for r in collocation.collocations(df, 3, top=7).collect()]
    assert sorted(got) == sorted(brute(rows, 3, top=7)) and len(got) == 7


def test_nothing_frequent(spark):
    for rows in ([], [("one two three", "en")], [("one. " * 50, "en")]):
        assert collocation.collocations(spark.createDataFrame(rows, "text string, lang string"), 4).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000, 200_000])
def test_perfect_hash_is_minimal_and_tells_strangers(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    h = PerfectHash(keys)
    assert sorted(h.lookup(keys).tolist()) == list(range(len(keys)))
    assert (h.keys[h.lookup(keys)] == keys).all()
    strangers = np.setdiff1d(np.random.default_rng(n + 1).integers(0, 1 << 63, 10_000, dtype=np.uint64), keys)
    assert (h.lookup(strangers) == -1).all()
