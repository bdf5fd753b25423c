"""Near-duplicate detection by DartMinHash: signatures from hashed darts, then a banded join.

Each element of a weighted set owns, on the weight axis, the regions [0, 1), [1, 2), [2, 4) and so on up to its weight.
Darts arrive in every region along a rank axis as a Poisson process whose times, weights and coordinates are
hashes of (element, region, number), so equal elements throw equal darts in all documents. A document keeps the
darts below a rank that lets about k ln k + 2 k of them through (twice as many again while a coordinate is
empty) and of each coordinate the earliest: k values, equal at a coordinate with the probability of the weighted
Jaccard similarity, from one pass over the sparse elements instead of k.

Documents are sets of their five-word shingles (one shingle for shorter texts), weight 1. Equal word sequences are
one node. Nodes that share a band (4 of 80 values) are candidates. First each meets one leader of its bucket: the least
node or, in buckets over SMALL, the node closest to the bucket's consensus signature, which in a group of copies is the
text that they were made from. Then, in buckets where unlinked classes still meet, all pairs across those classes are looked at,
in blocks of BLOCK members, inside the worker. Two bounds that never lose a link sort most pairs out there: the shingles
that each side shares with any other candidate at all, and the symmetric difference of the sets, which is no less than that of
their bitmaps. A first round sends on only pairs that would join classes not yet joined in their block, best first; a second
one, after these are merged, all pairs that are left. A member of a bucket's largest class meets the members of the other
classes only. All pairs are checked by the exact Jaccard similarity of the shingle sets
(64-bit hashes). Classes are connected components, by least labels and pointer jumping over written tables.
Buckets, partners and classes have no cap.

A pair of similarity 0.8 shares no band with probability 3e-5.

Rows and nodes are known by a 64-bit hash of doc_id and text, not by doc_id, which may be null or repeated; a node has
the least of its rows.

Defined cases: null, empty and wordless texts are classes of their own; ties take the least doc_id; repeated rows
share a class; rows with one doc_id and different texts are matched apart; rows without a doc_id are matched like others,
and a class without any doc_id has a null class_id and still keeps one row; an empty table gives an empty result; only
doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from semblance.llm.common import table, written
from semblance.operators import cluster

SHINGLE = 5
SIMILARITY = 0.8
K, ROWS = 80, 4
EST_MIN = 0.6
BLOCK = 512
#: Buckets up to this size are led by their least node; members of a larger one that vote on its consensus.
SMALL, VOTERS = 16, 64
#: Members of a large bucket that one task compares with its consensus.
DEALT = 1024
#: Bits of the sieve that spares most texts the exchange by row: a fixed size, whatever the corpus.
SIEVE_BITS = 1 << 22
#: Words of a batch that are hashed together.
CHUNK = 500_000

#: A value of a signature.
VALUE = np.dtype("<u2")

U = np.uint64
GOLD, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * MIX1
        x = (x ^ (x >> U(27))) * MIX2
        return x ^ (x >> U(31))


def shingles(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the n-word windows, of all words together if there are fewer; none for no words."""
    if not words:
        return np.zeros(0, dtype=U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U, count=len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, dtype=U)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mixed(out * GOLD + h[i : i + len(out)])
    return out


def dart_signatures(elements: np.ndarray, owner: np.ndarray, n_sets: int, k: int = K, weights: np.ndarray | None = None) -> np.ndarray:
    """n_sets x k 16-bit values, the low bits of the earliest darts: two that differ look equal once in 65536. elements: hashes; owner: the set of each, rising; weights: over 0, 1 if left out.
    A repeated element throws the same darts again, so it counts once, with its largest weight."""
    earliest = np.full(n_sets * k, np.iinfo(np.uint64).max, dtype=U)
    mass = np.bincount(owner, weights=weights, minlength=n_sets)
    reach = (k * np.log(k) + 2 * k) / np.maximum(mass, 1e-300)
    todo = np.flatnonzero(mass > 0)
    while len(todo):
        chosen = np.zeros(n_sets, dtype=bool)
        chosen[todo] = True
        use = chosen[owner]
        base_e, base_o, base_w = elements[use], owner[use], None if weights is None else weights[use]
        region, low, width = 0, 0.0, 1.0
        while len(base_e):
            e, o, w = base_e, base_o, base_w
            time, number = np.zeros(len(e)), 0
            while len(e):
                number += 1
                with np.errstate(over="ignore"):
                    h = mixed(e + U(number * 64 + region) * GOLD)
                time = time - np.log((h >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width
                alive = time < reach[o]
                e, o, time, h = e[alive], o[alive], time[alive], h[alive]
                dart = mixed(h + GOLD)
                hit = slice(None)
                if w is not None:
                    w = w[alive]
                    hit = low + width * (mixed(dart + MIX1) >> U(11)).astype(np.float64) * 2.0**-53 < w
                d, t, who = dart[hit], time[hit], o[hit]
                rank = t.astype(np.float32).view(np.uint32).astype(U) << U(32)
                np.minimum.at(earliest, who * k + ((d >> U(32)) % U(k)).astype(np.int64), rank | (d & U(0xFFFFFFFF)))
            if base_w is None:
                break
            low, width, region = low + width, max(1.0, low + width), region + 1
            more = base_w > low
            base_e, base_o, base_w = base_e[more], base_o[more], base_w[more]
        todo = todo[(earliest.reshape(n_sets, k)[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        reach[todo] *= 2
    return (earliest & U(0xFFFF)).astype(VALUE).reshape(n_sets, k)


def bands() -> Column:
    """One 64-bit key for each band of a signature: a hash of its values and its number."""
    size = ROWS * VALUE.itemsize
    return F.array(*(F.xxhash64(F.substring("sig", 1 + i * size, size), F.lit(i)) for i in range(K // ROWS)))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def bare() -> Column:
    """Whether a row has no word."""
    return ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `row`, the key of a row: null ids are passed over by the hash, so such rows are known by their text."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


SIGNED = "row long, doc_id long, known boolean, k1 long, k2 long, sig binary"


def signed(docs: DataFrame) -> DataFrame:
    """Text key (of the word sequence) and signature of every row with words."""

    def sign(batches):
        for b in batches:
            ids, keys, parts, size = [], [], [], 0
            for text, *own in zip(b["text"], b["row"], b["doc_id"], b["known"], strict=True):
                words = _words(text)
                if not words:
                    continue
                ids.append(own)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                parts.append(shingles(words))
                size += len(words)
                if size > CHUNK:
                    yield _signed(ids, keys, parts)
                    ids, keys, parts, size = [], [], [], 0
            if ids:
                yield _signed(ids, keys, parts)

    # a column with nulls would reach pandas as floats, which round large ids
    rows = keyed(docs).select("row", F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    signs = rows.mapInPandas(sign, SIGNED)
    return signs.withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")


def _signed(ids: list, keys: list[bytes], parts: list[np.ndarray]) -> pd.DataFrame:
    sig = dart_signatures(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), len(parts))
    both = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
    own = dict(zip(("row", "doc_id", "known"), zip(*ids, strict=True), strict=True))
    return pd.DataFrame(own | {"k1": both[:, 0], "k2": both[:, 1], "sig": [s.tobytes() for s in sig]})


def _similar(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Share of equal signature values."""
    x, y = (np.frombuffer(b"".join(s), dtype=VALUE).reshape(len(s), -1) for s in (a, b))
    return (x == y).mean(axis=1) if len(a) else np.zeros(0)


@F.pandas_udf(DoubleType())
def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_similar(a, b))


@F.pandas_udf(DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both))
    return pd.Series(out, dtype=float)


def sieved(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most rows whose `row` is not in ids: a one-hash filter of SIEVE_BITS bits, joined as a table of words.
    It never loses a row of ids; past its capacity it only lets more through."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS))
    bit = lambda h: F.expr(f"shiftleft(1L, cast({h} % 32 as int))")
    held = ids.select(at(F.col("row")).alias("_h")).select(F.floor(F.col("_h") / 32).alias("_word"), bit("_h").alias("_bit"))
    table_ = held.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    rows = docs.withColumn("_h", at(F.col("row"))).withColumn("_word", F.floor(F.col("_h") / 32))
    return rows.join(F.broadcast(table_), "_word").where(F.col("_bits").bitwiseAND(bit("_h")) != 0).select(*docs.columns)


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, grams: the sorted distinct shingle hashes of the text of each node."""

    def grams(batches):
        for b in batches:
            yield pd.DataFrame({"node": b["row"], "grams": [np.unique(shingles(_words(t))).view(np.int64) for t in b["text"]]})

    ids = nodes.select(F.col("node").alias("row"))
    # an inner join: a semi join would be moved below the sieve
    texts = sieved(keyed(docs), ids).join(ids.distinct(), "row").dropDuplicates(["row"])
    return texts.mapInPandas(grams, "node long, grams array<long>")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the similarity, by their exact sets."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    return written(both.where(jaccard("ga", "gb") >= SIMILARITY).select("a", "b"), "near-links")


def shared_sizes(sets: DataFrame) -> DataFrame:
    """node, size, shared: its shingles, and those of them that any other node of the table has."""
    each = sets.select("node", F.explode("grams").alias("g"))
    alone = each.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    size = F.size("grams").cast("long")
    return sets.join(own, "node", "left").select("node", size.alias("size"), (size - F.coalesce("own", F.lit(0))).alias("shared"))


def pieces_of(n: str) -> Column:
    return F.ceil(F.col(n) / DEALT)


def central_nodes(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """key, piece, central: of each large bucket the node whose signature is closest to the bucket's most frequent values,
    for each piece that the bucket is dealt into.
    VOTERS members set the consensus; every member is compared with it."""
    rows = members.where(F.col("n") > SMALL).select("key", "node", "n").join(sigs, "node")
    rows = written(rows, "near-large")
    pieces = pieces_of("n")
    vote = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
    voters = rows.withColumn("_v", vote).where(F.col("_v") <= VOTERS)

    def consensus(p: pd.DataFrame) -> pd.DataFrame:
        m = np.sort(np.frombuffer(b"".join(p["sig"]), dtype=VALUE).reshape(len(p), -1), axis=0)
        run = np.ones(m.shape, dtype=np.int64)  # length of the run of equal values that ends here
        for i in range(1, len(m)):
            run[i] = np.where(m[i] == m[i - 1], run[i - 1] + 1, 1)
        best = m[run.argmax(axis=0), np.arange(m.shape[1])]
        return pd.DataFrame({"key": [p["key"].iloc[0]], "consensus": [best.tobytes()]})

    agreed = voters.groupBy("key").applyInPandas(consensus, "key long, consensus binary")
    # a large bucket is dealt over several pieces, each of which meets the consensus
    each = agreed.join(voters.groupBy("key").agg(F.max(pieces).alias("pieces")), "key").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("node"), pieces)).join(each.drop("pieces"), ["key", "piece"])
    scored = dealt.select("key", "piece", "node", estimate("sig", "consensus").alias("agree"))
    best = F.max_by(F.struct("agree", "node"), F.struct("agree", -F.col("node"))).alias("m")
    found = scored.groupBy("key", "piece").agg(best).select("key", "m.*").groupBy("key").agg(F.max_by("node", F.struct("agree", -F.col("node"))).alias("central"))
    return each.select("key", "piece").join(found, "key")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of the connected component, for every node of a link (a, b)."""
    return cluster.components(links).select(F.col("item").alias("node"), F.col("component").alias("label"))


@F.pandas_udf(BinaryType())
def bitmap(grams: pd.Series) -> pd.Series:
    """A bit for each shingle hash, modulo the bits of a power of two of 64 to 8192 bytes, no fewer than there are shingles."""
    out = []
    for g in grams:
        n = 64
        while n < min(len(g), 8192):
            n *= 2
        bits = np.zeros(8 * n, dtype=np.uint8)
        bits[g.view(U) % U(8 * n)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return pd.Series(out)


def _across(forest: bool):
    """Pairs across classes that may be similar, in runs of rows with equal (key, cell), sorted by these."""

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            code = (b["key"].ne(b["key"].shift()) | b["cell"].ne(b["cell"].shift())).cumsum().to_numpy()
            cut = int(np.searchsorted(code, code[-1]))  # the last run may go on
            held = b.iloc[cut:].reset_index(drop=True)
            if cut:
                yield _pairs(b.iloc[:cut], code[:cut], forest)
        if held is not None and len(held):
            yield _pairs(held, np.zeros(len(held), dtype=int), forest)

    return across


def _folded(maps: list[bytes], n: int) -> np.ndarray:
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, dtype=np.uint8).reshape(-1, n), axis=0) for m in maps])


def _run_pairs(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the pairs of one run that may be similar, and the bound of their similarity."""
    label, block, size, shared = (own[c].to_numpy(np.int64) for c in ("label", "block", "size", "shared"))
    i, j = divmod(int(own["cell"].iloc[0]), int(own["blocks"].iloc[0]))
    first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
    length = own["map"].map(len).to_numpy()
    maps = {n: _folded([m if len(m) >= n else m * (n // len(m)) for m in own["map"]], n) for n in np.unique(length).tolist()}
    out = []
    for at in range(0, len(first), 64):
        f = first[at : at + 64]
        most = np.minimum(shared[f][:, None], shared[second][None, :])
        may = (label[f][:, None] != label[second][None, :]) & (most >= SIMILARITY * (size[f][:, None] + size[second][None, :] - most))
        x, y = np.nonzero(may)
        x, y = f[x], second[y]
        width = np.minimum(length[x], length[y])
        for n in np.unique(width).tolist():
            p, q, m = x[width == n], y[width == n], maps[n]
            step = max(1, (16 << 20) // n)
            for k in range(0, len(p), step):
                a, b = p[k : k + step], q[k : k + step]
                differ = np.bitwise_count(m[a] ^ m[b]).sum(axis=1, dtype=np.int64)
                both = size[a] + size[b]
                bound = (both - differ) / (both + differ)
                near = bound >= SIMILARITY
                out.append((a[near], b[near], bound[near]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, dtype=float if k == 2 else int) for k in range(3))


def _pairs(b: pd.DataFrame, code: np.ndarray, forest: bool) -> pd.DataFrame:
    found = [np.zeros((0, 2), dtype=np.int64)]
    ends = np.flatnonzero(np.diff(code, append=code[-1] + 1)) + 1
    for s, e in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        own = b.iloc[s:e]
        x, y, bound = _run_pairs(own)
        node, label = own["node"].to_numpy(np.int64), own["label"].to_numpy(np.int64)
        if forest and len(x):
            root = {v: v for v in label.tolist()}

            def top(v: int, root=root) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            kept = []
            for k in np.argsort(-bound, kind="stable").tolist():
                p, q = top(int(label[x[k]])), top(int(label[y[k]]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    kept.append(k)
            x, y = x[kept], y[kept]
        found.append(np.stack([np.maximum(node[x], node[y]), np.minimum(node[x], node[y])], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def across_classes(members: DataFrame, labels: DataFrame, sets: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of nodes of one bucket in different classes that the bounds let through."""
    now = members.select("key", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    now = written(now, "near-meeting")
    # classes of each bucket in which several meet: the largest one, and the members of the others, which are all that can be
    # news to each other or to it
    sizes = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    meeting = sizes.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.max("m").alias("m"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    blocks_of = lambda c: F.ceil(c / BLOCK).cast("long")
    meeting = meeting.select("key", "largest", blocks_of(F.col("n") - F.col("m")).alias("few"), blocks_of(F.col("m")).alias("many"))
    rows = written(now.select("key", "node", "label").join(meeting, "key").withColumn("major", F.col("label") == F.col("largest")).withColumn("blocks", F.col("few") + F.col("many")), "near-mixed")
    inside = sets.join(rows.select("node").distinct(), "node", "left_semi")
    about = inside.select("node", bitmap("grams").alias("map")).join(shared_sizes(inside), "node")
    # a node that shares too little with all others has no link
    about = written(about.where(F.col("shared") >= SIMILARITY * F.col("size")), "near-open")
    # blocks of the others come first; cell i * blocks + j holds the blocks i and j >= i, of which i is one of the others
    block = F.when(F.col("major"), F.col("few") + F.pmod(F.xxhash64("node", "key"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node", "key"), F.col("few")))
    rows = rows.withColumn("block", block)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cells = F.when(F.col("major"), F.transform(upto(F.col("few")), lambda o: o * F.col("blocks") + F.col("block"))).otherwise(
        F.transform(upto(F.col("blocks")), lambda o: F.least("block", o) * F.col("blocks") + F.greatest("block", o)))
    celled = rows.join(about, "node").withColumn("cell", F.explode(cells)).select("key", "cell", "node", "label", "block", "blocks", "size", "shared", "map")
    celled = celled.repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    return written(celled.mapInPandas(_across(forest), "a long, b long").distinct(), "near-pairs")


def _labelled(docs: DataFrame) -> DataFrame:
    """row, doc_id, label (the class) of every row with words, for docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = written(signed(docs), "near-signed")
    nodes = written(rows.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.first("sig").alias("sig")), "near-nodes")
    banded = nodes.select("node", F.explode(bands()).alias("key"))
    full = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    full = written(full, "near-buckets")
    members = written(banded.join(full, "key").select("key", "node", "leader", "n"), "near-members")
    sigs = nodes.select("node", "sig")
    sets = written(shingle_sets(docs, members.select("node").distinct()), "near-sets")
    dealt = members.withColumn("piece", F.pmod(F.xxhash64("node"), pieces_of("n")))
    led = dealt.join(central_nodes(members, sigs), ["key", "piece"], "left").select("node", F.coalesce("central", "leader").alias("leader"))
    stars = led.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    left = stars.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    both = left.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    likely = written(both.where(estimate("sa", "sb") >= EST_MIN).select("a", "b"), "near-pairs")
    links = verified(sets, likely)
    labels = components(links)
    for forest in (True, False):
        pairs = across_classes(members, labels, sets, forest)
        if pairs.isEmpty():
            break
        links = written(links.union(verified(sets, pairs)), "near-links")
        labels = components(links)
    of_text = nodes.select("k1", "k2", "node").join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("label"))
    return written(rows.select("row", "doc_id", "k1", "k2").join(of_text, ["k1", "k2"]).select("row", "doc_id", "label"), "near-labelled")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows = _labelled(docs)
    least = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("_n"))
    # a class of one row needs no join
    many = least.where("_n > 1").select("label", "class_id", F.lit(True).alias("_many"))
    of_row = rows.join(many, "label", "left").select("doc_id", F.when(F.col("_many"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    # rows without words, and every row once
    return of_row.unionByName(docs.where(bare()).select("doc_id", F.col("doc_id").alias("class_id")))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, that of the least doc_id, with the columns of docs. Rows without words are classes
    of their own; of those that repeat a doc_id and text, one stays."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    own = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = _labelled(docs.select("doc_id", "text")).groupBy("label").agg(F.min(rank).alias("m")).select(F.col("m.row").alias(name)).distinct()
    worded = own.where(~bare()).join(kept, name, "left_semi").dropDuplicates([name])
    wordless = own.where(bare())
    named = wordless.where(F.col("doc_id").isNotNull()).dropDuplicates([name])
    return worded.unionByName(named).unionByName(wordless.where(F.col("doc_id").isNull())).select(*docs.columns)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
