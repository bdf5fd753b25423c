"""Conversation repair against a recursion over all edits in plain Python."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from semblance.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost long, copy int"


def cheapest(signature):
    """Least cost and ASCII-least edits, from the end to the beginning, with whole strings and any number of insertions."""
    after = lambda state: "a" if state == "u" else "u"
    later = None
    for i in range(len(signature), -1, -1):
        best = {}
        for state in ("", "s", "u", "a"):
            options = [(0, "")] if i == len(signature) and state in ("", "a") else []
            if i < len(signature):
                x, go = signature[i], lambda cost, letter, to: (later[to][0] + cost, letter + later[to][1])
                options.append(go(3, "D", state))
                if x != "x":
                    who, cut = x.lower(), x.isupper()
                    if who == "s" and state == "" or who == "u" and state != "u" or who == "a" and state == "u":
                        options.append(go(cut, "K", who))
                    options.append(go(2 + cut, "R", after(state)))
            best[state] = min(options, default=(1 << 40, ""))
        for _ in range(4):
            best = {s: min(v, (best[after(s)][0] + 2, "I" + best[after(s)][1])) for s, v in best.items()}
        later = best
    return later[""]


def brute(rows, damage=True):
    by, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        role = "user" if k == 4 else role
        by[conv] += [(turn, role, text)] * (2 if k == 3 else 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, counts, signature = set(), Counter(), ""
        for _, role, text in own:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            counts[fault] += 1
            seen.add((role, text))
            who = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in ("blank", "duplicate") else who.upper() if fault else who
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest(signature)
        made, at, last = [], 0, ""
        for e in audit:
            row = None
            if e != "I":
                row, at = own[at], at + 1
            if e == "D":
                continue
            if e == "K":
                made.append((row[1], row[2]))
            else:
                made.append(("assistant" if last == "u" else "user", row[2] if row else ""))
            last = made[-1][0][:1]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def test_walk_equals_the_recursion_and_shares_prefixes():
    signatures = sorted("".join(p) for n in range(5) for p in itertools.product("suaoUx", repeat=n))
    rng = np.random.default_rng(3)
    signatures = sorted({*signatures, *("".join(rng.choice(list("suaoSUAOx"), int(rng.integers(5, 12)))) for _ in range(300))})
    walk = C.Walk()
    for s in signatures:
        walk.go(s)
        assert walk.answer() == cheapest(s), s
    assert walk.computed == len({s[:i] for s in signatures for i in range(1, len(s) + 1)})


def test_a_very_long_conversation_is_walked_in_little_memory():
    walk = C.Walk()
    walk.go("ua" * 50_000)
    assert walk.answer() == (0, "K" * 100_000)
    walk.go("ua" * 49_999 + "u")
    assert walk.computed == 100_000 and walk.answer() == (2, "K" * 99_999 + "I")


def table():
    rng = np.random.default_rng(11)
    said = ["Hello there.", "What?", "no end", "", " \t\n", "naïve \U0001f600!", "a.b.c", "...", "x \x0b"]
    roles = ["user", "assistant", "system", "tool", "", "usher", None]
    rows = []
    for conv in range(120):
        turns = rng.integers(0, 9, int(rng.integers(0, 12)))
        rows += [(conv, int(t) if rng.random() > 0.1 else None, str(r) if (r := rng.choice(roles, p=[0.4, 0.3, 0.1, 0.05, 0.05, 0.05, 0.05])) is not None else None, str(rng.choice(said)) if rng.random() > 0.05 else None) for t in turns]
    rows += [(500, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(400)]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Hi."), ((1 << 53) + 1, 2, "assistant", "Yes!"), (600, None, None, None), (600, None, None, None), (-(1 << 62), 1 << 60, "user", "far."), (-(1 << 62), 3, "user", "far.")]
    rows += [(701, 1, "user", "word " * 40_000 + "."), (701, 2, "assistant", "Ok.")]
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.")]


@pytest.mark.parametrize("damage", [True, False])
def test_report_equals_brute_force(spark, damage):
    rows = table()
    df = spark.createDataFrame([(*r, "clash", 1, 7) for r in rows], SCHEMA).repartition(4)
    got = C.report((C.damaged if damage else C.untouched)(df)).collect()
    want = brute(rows, damage)
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def test_repaired_rows_give_the_digest(spark):
    df = spark.createDataFrame([(*r, "clash", 1, 7) for r in table()], SCHEMA)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in C.report(C.damaged(df)).collect()}
    said = defaultdict(list)
    for r in sorted(C.repaired(C.damaged(df)).collect(), key=lambda r: r["place"]):
        said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(said[c]).encode()).hexdigest() == d for c, d in digests.items())


def test_empty_table(spark):
    assert C.report(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
