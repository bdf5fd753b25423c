"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source is clamped at `max_epochs` times its own size; the weight that this frees goes to the others
in proportion, until no source is above its cap. That is the level L with sum(min(cap, L * weight)) = budget,
which sorted ratios and running sums give without iteration. A source then repeats each document
floor(target / size) times and once more for the documents that come first in a seeded order, up to the
rest of its target: the taken words miss the target by less than one document.

Only per-source and per-(source, slice) sums are gathered; the seeded order is cut into SLICES slices by the
first hex digits of a hash, and rows are sorted only inside the one slice of a source that holds the cut.

Defined cases: a null text has size 0; a null source is a source of its own, last in the order; repeated rows
are separate documents (equal ids tie, any of them may be taken); an empty table gives an empty result; a
source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.common import table, words, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Hex digits of the slice: 16^3 slices a source.
DIGITS = 3


def waterfill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources: one row per source with `weight` and `source_size`; adds `target`.

    The window has one partition, of one row a source: sources are summed before."""
    s = sources.withColumn("_cap", F.lit(max_epochs) * F.col("source_size"))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    upto = every.orderBy("_ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s = (s.withColumn("_budget", F.lit(share) * F.sum("source_size").over(every))
         .withColumn("_caps", F.sum("_cap").over(upto)).withColumn("_used", F.sum("weight").over(upto))
         .withColumn("_all", F.sum("weight").over(every)))
    # if the sources up to here are clamped, the others stand at this level
    level = F.when(F.col("_all") > F.col("_used"), (F.col("_budget") - F.col("_caps")) / (F.col("_all") - F.col("_used")))
    s = s.withColumn("_clamped", F.coalesce(level >= F.col("_ratio"), F.col("_budget") >= F.col("_caps")))
    clamped = F.sum(F.when(F.col("_clamped"), F.col("_cap")).otherwise(0.0)).over(every)
    weights = F.sum(F.when(F.col("_clamped"), 0).otherwise(F.col("weight"))).over(every)
    free = F.col("weight") * (F.col("_budget") - clamped) / F.when(weights > 0, weights)
    target = F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.least(free, F.col("_cap")))
    return s.withColumn("target", target.cast("double")).drop("_cap", "_ratio", "_budget", "_caps", "_used", "_all", "_clamped")


def weigh(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Adds `weight`: the given weights repeat over the sources by code point, null last."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1))


def _order(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, source): doc_id, size, source, source_size, target, repeats, taken, and the columns to carry."""
    sized = written(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
                                _order(F.col("doc_id")).alias("ord"), *carry), "mix-sizes")
    slice_ = F.substring("ord", 1, DIGITS)
    sums = sized.groupBy("source", slice_.alias("slice")).agg(F.sum("size").alias("bytes"))
    sums = written(sums, "mix-slices")
    plan = waterfill(weigh(sums.groupBy("source").agg(F.sum("bytes").alias("source_size")), weights), share, max_epochs)
    ratio = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    plan = plan.withColumn("whole", F.coalesce(F.floor(ratio), F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # the slice in which the running sum of a source reaches its rest
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    marks = sums.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    p = plan.withColumnRenamed("source", "_s")
    marks = marks.join(p, F.col("source").eqNullSafe(F.col("_s")))
    cut = (marks.where(F.col("before") <= F.col("rest")).groupBy("_s", "source_size", "target", "whole", "rest")
           .agg(F.max("slice").alias("cut"), F.max("before").alias("cut_before")))
    cut = written(cut, "mix-plan")
    rows = sized.join(cut, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    clear = rows.where(slice_ != F.col("cut")).withColumn("more", (slice_ < F.col("cut")).cast("long"))
    # inside the cut slice: take in seeded order while the words taken do not pass the rest
    run = Window.partitionBy("source").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where(slice_ == F.col("cut")).withColumn("_run", F.sum("size").over(run))
    edge = edge.withColumn("more", (F.col("cut_before") + F.col("_run") <= F.col("rest")).cast("long")).drop("_run")
    out = clear.unionByName(edge)
    repeats = F.least(F.col("whole") + F.col("more"), F.lit(int(max_epochs)).cast("long"))
    return out.select("doc_id", "size", "source", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"), *carry)


def repeated(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, with the columns of docs. Rows travel with their own count: ids
    may be null or repeated."""
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row"))
    taken = mix(rows, carry=("_row",)).where("repeats > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("_row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


#: The same definition over whole sources: sizes, targets by sorted ratios, and the seeded order as a running sum.
OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS ord,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_value{WEIGHTS}[((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight,
      {MAX_EPOCHS} * source_size AS cap, {SHARE} * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, sum(cap) OVER r AS caps, sum(weight) OVER () - sum(weight) OVER r AS others FROM w
      WINDOW r AS (ORDER BY cap / weight RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN others > 0 THEN (budget - caps) / others >= cap / weight ELSE budget >= caps END AS clamped FROM l),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE least(cap, weight * (budget - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ())
        / sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER ()) END::DOUBLE AS target FROM c),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
o AS (SELECT doc_id, size, d.source, source_size, target, whole,
        sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) <= target - whole * source_size AS more
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
p AS (SELECT *, least(whole + CASE WHEN more THEN 1 ELSE 0 END, {int(MAX_EPOCHS)})::BIGINT AS repeats FROM o)
SELECT doc_id, size, source_size, target, (repeats * size)::BIGINT AS taken, source, repeats FROM p
"""
