"""Rule bitmask ledger: every rule is evaluated once, policies and ablations read only the stored bits.

`measure` adds the measurements, `ledger` the failure bits (bit i set: rule i failed). A policy is a
version name and a mask of the rules that it enforces, so a verdict is one bitwise AND, a new policy
needs no second look at the texts, and an ablation is an aggregation over at most 2^rules bit values.

Defined cases: a null or empty text has no words, all measurements are 0 and it fails `few_words`;
ratios are compared as products, so nothing is divided by 0; repeated rows are judged one by one;
columns of the input that clash with the added names are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import SPACES, table, word_chars, words

SYMBOLS = "#*$%&|<>"

#: name: SQL condition on the measurements that makes the rule fail. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "20 * n_symbols > word_chars",
    "copied_lines": "2 * n_dup_lines > n_lines",
    "shouting": "2 * n_upper > word_chars",
    "exclaims": "2 * n_exclaims > n_words",
    "word_length": "n_words > 0 AND (2 * word_chars < 5 * n_words OR word_chars > 12 * n_words)",
}


def mask(*names: str) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


#: Versions of the policy; v1 holds the two base rules alone.
POLICIES: dict[str, int] = {"v1": mask("few_words", "repeats"), "v2": mask(*RULES)}
CURRENT = "v2"
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims")


def _occurrences(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeated(sorted_windows: Column) -> Column:
    """Positions of the windows that have an equal neighbour in the sorted list, in text order."""
    n = F.size(sorted_windows)
    at = lambda i: F.get(sorted_windows, i).getField("h")
    same = F.filter(
        sorted_windows,
        lambda x, i: (F.coalesce(at(i - 1) == x.getField("h"), F.lit(False)))
        | ((i < n - 1) & F.coalesce(at(i + 1) == x.getField("h"), F.lit(False))),
    )
    return F.sort_array(F.transform(same, lambda x: x.getField("p")))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measurements of its text column. All work stays inside the row, so nothing is shuffled.

    Windows of three words are compared by their 64-bit hash within one text."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in df.columns if c == text or c not in MEASUREMENTS]
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = df.select(*kept, words(t).alias("_w"), lines.alias("_lines"))
    n = F.size("_w")
    word = lambda i: F.get(F.col("_w"), i)
    windows = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("p")),
    )
    df = df.withColumn("_sorted", F.sort_array(windows)).withColumn("_at", _repeated(F.col("_sorted")))
    covered = F.when(F.size("_at") == 0, 0).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("_at") - 1, F.lit(1))), F.lit(3),
                    lambda acc, i: acc + F.coalesce(F.least(F.lit(3), F.get(F.col("_at"), i) - F.get(F.col("_at"), i - 1)), F.lit(0)))
    )
    return df.select(
        *kept,
        n.cast("long").alias("n_words"),
        word_chars(t).cast("long").alias("word_chars"),
        _occurrences(t, SYMBOLS).alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        _uppers(t).alias("n_upper"),
        _occurrences(t, "!").alias("n_exclaims"),
    )


def _uppers(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long")


def ledger(measured: DataFrame) -> DataFrame:
    """Adds `bits`: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, failing in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.drop("bits").withColumn("bits", bits)


def passes(policy: str = CURRENT) -> Column:
    return F.col("bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail it alone, and rows kept without it."""
    counts = entries.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                      for i, n in enumerate(RULES) if POLICIES[policy] >> i & 1))
    enforced = F.col("bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long"))
    each = counts.select("n", enforced.alias("failed"), F.explode(rules).alias("r")).select("n", "failed", "r.*")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.coalesce(F.sum(F.when((F.col("failed") == 0) | (F.col("failed") == F.col("bit")), F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def keep(df: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of df that the policy accepts, with the columns of df.

    The row number is a fence: the optimiser must not move the filter below the measurements, or it would put their
    whole expressions into it, to be evaluated again for every use."""
    fence = ledger(measure(df, text)).withColumn("_row", F.monotonically_increasing_id())
    return fence.where(passes(policy) & (F.col("_row") >= 0)).select(*df.columns)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    entries = ledger(measure(docs))
    base = F.col("bits").bitwiseAND(F.lit(POLICIES["v1"]).cast("long")) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          base.alias("base_failed"), passes().alias("kept"), "bits", "n_lines", "n_upper", "n_exclaims")


_BITS_SQL = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))

OP2_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
tri AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i,
               unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(3) r(k) WHERE c > 1 GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclaims
  FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, ({_BITS_SQL})::BIGINT AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (bits & {POLICIES["v1"]}) <> 0 AS base_failed, (bits & {POLICIES[CURRENT]}) = 0 AS kept,
       bits, n_lines, n_upper, n_exclaims
FROM b
"""
