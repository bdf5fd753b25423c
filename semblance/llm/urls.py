"""URL filters by a Bloom filter cascade: exact membership of listed keys, without joins.

A rule is `host + path prefix`; the keys of a url are all its host suffixes joined to its path's prefixes of
the lengths that rules have. The key universe is the set of distinct keys of the whole corpus. Level 1 of the
cascade holds the listed keys that occur in no other level's complement, level 2 the universe's false positives
of level 1, level 3 the listed keys that level 2 wrongly passes, and so on by turns until a level has none.
For a key of the universe, the first level that rejects it tells whether it is listed, without error.

Level 1 is sized from the counts of listed and other keys so that false positives number about as many as the
listed keys; later levels have a false positive rate of one half. The whole cascade takes a few bytes a listed
key, however large the corpus is. Its size is checked against MAX_BYTES; longer lists are matched by a join on
the keys instead.

Defined cases: a null url, or one without `://`, has an empty host and path and no keys; repeated rows are judged
one by one; an empty list lists nothing; keys compare by code point.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict); the rules of the production query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Verdict for urls that no listed key fits.
DEFAULT = "allow"
MAX_BYTES = 64 << 20


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path (columns of these names are replaced)."""
    has = F.coalesce(F.col(url).contains("://"), F.lit(False))
    rest = F.when(has, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    df = df.drop("host", "path").withColumn("_rest", F.regexp_extract(rest, r"(?s)^([^?#]*)", 1))
    df = df.withColumn("_host", F.substring_index("_rest", "/", 1))
    path = F.expr("substring(_rest, length(_host) + 1)")
    return df.withColumns({"host": F.translate("_host", UPPER, LOWER), "path": path}).drop("_rest", "_host")


def keys(lengths: list[int]) -> Column:
    """Distinct keys of a row's host and path, longest host first; paths shorter than a length give none."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda p: p.isNotNull())
    both = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(both))


def _hashes(key: Column) -> Column:
    return F.array(F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key))


class Bloom:
    def __init__(self, n: int, rate: float):
        self.bits = max(64, math.ceil(-max(n, 1) * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(-math.log2(rate)))
        self.words = np.zeros((self.bits + 7) // 8, dtype=np.uint8)

    def _at(self, h: np.ndarray, salt: int) -> np.ndarray:
        """h: n x 2 unsigned 64-bit hashes; gives n x k bit positions."""
        with np.errstate(over="ignore"):
            one = h[:, 0] ^ (np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15))
            one = (one ^ (one >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            step = (h[:, 1] + np.uint64(salt) * np.uint64(0x94D049BB133111EB)) | np.uint64(1)
            at = one[:, None] + np.arange(self.k, dtype=np.uint64)[None, :] * step[:, None]
            return ((at ^ (at >> np.uint64(29))) % np.uint64(self.bits)).astype(np.int64)

    def add(self, h: np.ndarray, salt: int) -> None:
        at = self._at(h, salt).ravel()
        np.bitwise_or.at(self.words, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, h: np.ndarray, salt: int) -> np.ndarray:
        at = self._at(h, salt)
        return ((self.words[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


class Cascade:
    """levels[0] holds listed keys, levels[1] others, and so on by turns."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def listed(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h))
        for i, level in enumerate(self.levels):
            hit = level.has(h[open_], i) if len(open_) else np.zeros(0, bool)
            out[open_[~hit]] = i % 2 == 1
            open_ = open_[hit]
        return out

    def size(self) -> int:
        return sum(level.words.nbytes for level in self.levels)


def build(listed: np.ndarray, false_positives, n_others: int) -> Cascade:
    """listed: n x 2 hashes. false_positives(level): hashes of the other keys that pass the first level."""
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * max(1, len(listed)) / max(1, n_others)))
    first = Bloom(len(listed), rate)
    first.add(listed, 0)
    levels, inside, outside = [first], listed, false_positives(first)
    while len(outside):
        level = Bloom(len(outside), 0.5)
        level.add(outside, len(levels))
        passed = inside[level.has(inside, len(levels))]
        levels.append(level)
        inside, outside = outside, passed
    return Cascade(levels)


def _matrix(df: pd.DataFrame) -> np.ndarray:
    return np.stack([df["h1"].to_numpy(np.int64), df["h2"].to_numpy(np.int64)], axis=1).view(np.uint64)


def cascade(universe: DataFrame, rules: list[str]) -> Cascade:
    """The cascade of the rules over a universe of distinct keys (h1, h2). What reaches the driver is the rules
    and about as many false positives of the first level."""
    spark = universe.sparkSession
    local = spark.createDataFrame([(r,) for r in rules] or [("",)], "key string").select(*(_hashes(F.col("key"))[i].alias(f"h{i + 1}") for i in range(2)))
    listed = _matrix(local.toPandas())[: len(rules)]
    n = universe.count()

    def false_positives(level: Bloom) -> np.ndarray:
        known = {tuple(x) for x in listed.tolist()}

        def passing(parts):
            for p in parts:
                h = _matrix(p)
                hit = level.has(h, 0) & np.array([tuple(x) not in known for x in h.tolist()], dtype=bool) if len(h) else np.zeros(0, bool)
                yield p[hit]

        return _matrix(universe.mapInPandas(passing, "h1 long, h2 long").toPandas())

    return build(listed, false_positives, max(0, n - len(rules)))


def joined(rows: DataFrame, verdicts: dict[str, str], default: str) -> DataFrame:
    """The same by a join of the keys of each distinct (host, path) with the rules, for lists of any length."""
    listed = rows.sparkSession.createDataFrame(list(verdicts.items()), "_rule string, _verdict string")
    each = rows.select("host", "path", "_keys").dropDuplicates(["host", "path"]).select("host", "path", F.explode("_keys").alias("_rule")).join(listed, "_rule")
    best = each.groupBy("host", "path").agg(F.max(F.struct(F.length("_rule").alias("n"), "_rule", "_verdict")).alias("_best"))
    out = rows.join(best, ["host", "path"], "left").select(*rows.columns, "_best").drop("_keys")
    return out.withColumns({"rule": F.col("_best._rule"), "verdict": F.coalesce("_best._verdict", F.lit(default))}).drop("_best")


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages with a url column: adds host, path, rule (the longest that fits) and verdict."""
    spark = pages.sparkSession
    verdicts = dict(rules)
    lengths = sorted({len(r) - r.index("/") for r in verdicts})
    rows = with_host_path(pages.drop("rule", "verdict")).withColumn("_keys", keys(lengths))
    if not rules:
        return rows.drop("_keys").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    distinct = rows.select(F.explode("_keys").alias("k")).distinct()
    universe = written(distinct.select(*(_hashes(F.col("k"))[i].alias(f"h{i + 1}") for i in range(2))), "url-keys")
    built = cascade(universe, list(verdicts))
    if built.size() > max_bytes:
        return joined(rows, verdicts, default)
    shared = spark.sparkContext.broadcast(built)

    @F.pandas_udf("array<boolean>")
    def member(h: pd.Series) -> pd.Series:
        counts = h.map(len).to_numpy()
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in h]) if counts.sum() else np.zeros(0, np.int64)
        found = shared.value.listed(flat.reshape(-1, 2).view(np.uint64))
        ends = np.cumsum(counts // 2)
        return pd.Series([found[e - c // 2 : e] for e, c in zip(ends, counts, strict=True)])

    rows = rows.withColumn("_listed", member(F.flatten(F.transform("_keys", _hashes))))
    hits = F.transform(F.filter(F.arrays_zip("_keys", "_listed"), lambda x: x["_listed"]), lambda x: F.struct(F.length(x["_keys"]).alias("n"), x["_keys"].alias("k")))
    rule = F.array_max(hits)["k"]
    named = F.create_map(*(F.lit(x) for r in rules for x in r))
    return (rows.withColumn("rule", rule).drop("_keys", "_listed")
            .withColumn("verdict", F.coalesce(F.element_at(named, F.col("rule")), F.lit(default))))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_FITS = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, '{r[: r.index('/')]}' AS h, '{r[r.index('/') :]}' AS p, '{v}' AS verdict" for r, v in RULES)

OP8_SQL = f"""
WITH r AS ({_FITS}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1, 's') ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
             substr(rest, length(regexp_extract(rest, '^([^/]*)', 1, 's')) + 1) AS path FROM u),
n AS (SELECT row_number() OVER () AS i, * FROM v),
f AS (SELECT i, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM n JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM n LEFT JOIN f USING (i)
"""
