"""Sharding by histogram sort: exact byte counts below candidate keys, refined until splitters meet a tolerance.

A row's 64-bit key has a hash of its text above SPLIT_BITS bits of a hash of its id, so equal texts stand side
by side. Each round counts, exactly and over all rows, the bytes below evenly spaced probes inside every interval that still
holds a splitter, and keeps the interval around each target. Probes stand at edges of groups, until an interval is one
group: then the splitter is the nearer of its edges, unless the group is larger than a shard. Only such a group is cut, by
probes inside its low bits. Rounds end when every splitter is within the tolerance or at the edge next to its target. Then
rows are exchanged once, by cells: the shards cut again at row-count splitters found in the same way (these may cut groups,
since they only say which task ranks a row), so that no task holds a whole shard. The slot of a row is its rank inside its
cell plus the rows of the shard's earlier cells.

What reaches the driver each round is one sum for each probe interval, a number set by the parameters alone.

Defined cases: a null text has no bytes and size 1; an empty table gives an empty result; rows with equal keys
(repeated rows) stay in one shard; a null doc_id is hashed like a value; a row larger than a shard makes that shard as
large as it must be; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.common import table, written

SHARDS = 16
#: Allowed distance of a splitter from its target, as a share of a shard.
TOLERANCE = 0.01
#: Probes inside an interval and round.
PROBES = 64
#: Low bits of the key that split a group of equal texts.
SPLIT_BITS = 20
#: Rows of a cell, about, and least number of cells. From SMALL_CELLS on, cells grow up to LARGE_CELL_ROWS, which Spark
#: sorts with spilling, before there are more of them.
CELL_ROWS, MIN_CELLS, SMALL_CELLS, LARGE_CELL_ROWS = 20_000, 64, 8192, 1_000_000

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    low = F.xxhash64(F.lit("cut"), "doc_id").bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
    high = F.xxhash64(text).bitwiseAND(F.lit(-1 << SPLIT_BITS))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), high.bitwiseOR(low).alias("key"))


def _counts(rows: DataFrame, weight: str, probes: list[int]) -> list[int]:
    """Sums of the weight of rows with a key below each probe (sorted)."""
    edges = np.array(probes, dtype=np.int64)

    def count(parts):
        sums = np.zeros(len(edges) + 1, dtype=np.int64)
        for p in parts:
            np.add.at(sums, np.searchsorted(edges, p["key"].to_numpy(), side="right"), p["w"].to_numpy())
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"at": at, "w": sums[at]})

    got = rows.select("key", F.expr(weight).alias("w")).mapInPandas(count, "at long, w long").groupBy("at").agg(F.sum("w").alias("w")).collect()
    sums = np.zeros(len(edges) + 1, dtype=np.int64)
    for r in got:
        sums[r["at"]] = r["w"]
    return np.cumsum(sums)[:-1].tolist()


def _grid(low: int, high: int, n: int, inside: bool) -> set[int]:
    """About n probes inside (low, high); at edges of groups, unless they may stand inside."""
    step = (high - low) / (n + 1)
    found = {low + round(i * step) for i in range(1, n + 1)}
    if not inside:
        found = {p >> SPLIT_BITS << SPLIT_BITS for p in found} | {p << SPLIT_BITS for p in ((low >> SPLIT_BITS) + 1, (high - 1) >> SPLIT_BITS)}
    return {p for p in found if low < p < high}


def splitters(rows: DataFrame, weight: str, parts: int, tolerance: float = TOLERANCE, probes: int = PROBES, whole: bool = True) -> list[int]:
    """parts - 1 sorted keys; part i holds the keys from splitter i - 1 up to, without, splitter i. whole: groups that are
    not heavier than a part are not cut."""
    total = rows.agg(F.sum(F.expr(weight)).alias("w")).first()["w"] or 0
    goals = [total * i / parts for i in range(1, parts)]
    known = {LOW: 0, HIGH: total}  # weight below a key; no key is above HIGH, and one equal to it belongs to the last part
    slack = tolerance * total / parts

    def around(goal: float) -> tuple[int, int]:
        """The last probe at or below the goal and the first above it."""
        i = bisect.bisect_right(below, goal) - 1
        return order[i], order[min(i + 1, len(order) - 1)]

    def asked(goal: float) -> set[int]:
        a, b = around(goal)
        one = (b - 1) >> SPLIT_BITS == a >> SPLIT_BITS  # an interval inside of one group
        if b - a <= 1 or min(abs(known[a] - goal), abs(known[b] - goal)) <= slack:
            return set()
        edges = all(x == HIGH or x % (1 << SPLIT_BITS) == 0 for x in (a, b))
        if whole and one and edges and known[b] - known[a] <= total / parts:
            return set()
        return _grid(a, b, probes, not whole or one)

    while True:
        order = sorted(known)
        below = [known[k] for k in order]
        wanted = set().union(*map(asked, goals)) - known.keys() if goals else set()
        if not wanted:
            break
        new = sorted(wanted)
        known |= dict(zip(new, _counts(rows, weight, new), strict=True))
    found = []
    for goal in goals:
        a, b = around(goal)
        found.append(a if goal - known[a] <= known[b] - goal else b)
    return found


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = written(keyed(docs), "shard-keys")
    main = splitters(rows, "size", shards)
    n = rows.count()
    cells = max(MIN_CELLS, min(SMALL_CELLS, n // CELL_ROWS), n // LARGE_CELL_ROWS)
    edges = sorted({*main, *splitters(rows, "1", cells, tolerance=0.2, whole=False)})
    cuts = spark.sparkContext.broadcast(np.array(edges, dtype=np.int64))

    @F.pandas_udf("int")
    def cell_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, key.to_numpy(), side="right").astype(np.int32))

    of_cell = [bisect.bisect_right(main, LOW if i == 0 else edges[i - 1]) for i in range(len(edges) + 1)]
    celled = rows.withColumn("cell", cell_of("key"))
    counts = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = {}, []
    for i, s in enumerate(of_cell):
        offsets.append(before.get(s, 0))
        before[s] = before.get(s, 0) + counts.get(i, 0)
    known = spark.createDataFrame(list(zip(range(len(of_cell)), of_cell, offsets, strict=True)), "cell int, shard int, before long")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("key", "doc_id"))
    return (celled.withColumn("_place", place).join(F.broadcast(known), "cell")
            .select("doc_id", "size", "text_crc32", "key", "shard", (F.col("before") + F.col("_place") - 1).alias("slot")))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
