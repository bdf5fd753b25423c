"""LM scoring by a Katz backoff bigram model with Good-Turing discounts and exactly normalised backoff weights.

The counts are partitioned by a hash of the token; no task and no driver ever holds a whole table. Documents send
each partition packed arrays of (history, token, document); a partition then knows all occurrences of its tokens.
One pass over the exchanged arrays counts counts of counts (which set the discounts), a second adds up for each
document what its tokens are worth, and sends on (a) for each history the discounted mass and the lower-order mass of
its seen continuations and (b) the tokens whose bigram was never seen. In the partition of the history these meet its
count, give its backoff weight and close the recursion. The exchange is one RDD, so the second pass reads the
shuffle files of the first; a lost executor's part is made again from the documents.

The model. Order 1: P(w) = d(c) c / N for training tokens, the rest of the mass to one unknown token. Order 2: P(w | v) =
d(c) c(v, w) / den(v) if the bigram was seen, else alpha(v) P(w), where alpha(v) is what the seen ones leave over what
their order-1 probabilities leave, so each distribution sums to 1. d is Katz's Good-Turing discount up to K counts
(half a count where the counts of counts give none in (0, 1)). den(v) = c(v), plus 1 above K counts: otherwise
a history whose continuations were all seen over K times would leave no mass. A text starts from a start mark and
ends with an end token.

A partition's sums for a document travel in double precision.

Tokens so frequent that one would fill a partition are dealt by (history, token) over all of them, and their counts are summed
across partitions. Which ones is read from a sample of documents; that list decides where tokens are counted,
not what is counted.

Defined cases: null and empty texts have the end token alone; repeated rows are separate documents; without
training documents every token is unknown and has probability 1; an empty table gives an empty result; a null
doc_id counts as the text of a null, in training; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import RDD, Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import table, words
from semblance.llm.neardup import GOLD, U, mixed

#: Counts up to this one are discounted.
K = 5
#: Text bytes of a partition and tokens of a chunk, about.
PARTITION_BYTES = 20 << 20
CHUNK_TOKENS = 600_000
MIN_PARTITIONS = 12
#: One in so many documents is looked at for frequent tokens.
SAMPLE = 32

START, END = (U(xxhash.xxh3_64_intdigest(x)) for x in (b"start \n", b"end \n"))


@dataclass(frozen=True)
class Route:
    parts: int
    hot: np.ndarray

    def of_word(self, w: np.ndarray) -> np.ndarray:
        return (mixed(w) % U(self.parts)).astype(np.int64)

    def is_hot(self, w: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, w), max(0, len(self.hot) - 1))
        return self.hot[at] == w if len(self.hot) else np.zeros(len(w), dtype=bool)

    def of_pair(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            both = (mixed(w * GOLD + v) % U(self.parts)).astype(np.int64)
        return np.where(self.is_hot(w), both, self.of_word(w))


@dataclass(frozen=True)
class Model:
    """Global figures: training tokens, distinct ones, documents, discounts by count, and hot tokens' counts."""

    tokens: int
    distinct: int
    documents: int
    uni: np.ndarray
    bi: np.ndarray
    hot: np.ndarray
    hot_counts: np.ndarray
    unknown: float

    def p_uni(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _discounted(self.uni, c) / max(1, self.tokens), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def _discounted(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return c * np.where(c <= K, d[np.minimum(c, K)], 1.0)


def denominator(c: np.ndarray) -> np.ndarray:
    return c + (c > K)


def discounts(coc: list[int]) -> np.ndarray:
    """Katz's discount of each count 0 to K, from the numbers of things seen r times (index r, to K + 1)."""
    d = np.ones(K + 1)
    for r in range(1, K + 1):
        value = math.nan
        if coc[1] and coc[r] and coc[K + 1]:
            common = (K + 1) * coc[K + 1] / coc[1]
            if common != 1:
                value = ((r + 1) * coc[r + 1] / (r * coc[r]) - common) / (1 - common)
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def _give_back() -> None:
    """Returns freed memory to the system where the C library can, so that workers that live on do not keep their peak."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays, whole numbers in as few bytes as they need, byte plane by byte plane, compressed. `names` are sorted and
    stored as differences."""
    parts = []
    for name, a in arrays.items():
        if name == "names" and len(a):
            a = np.diff(a, prepend=U(0))
        if a.dtype == np.int64:
            most = int(a.max()) if len(a) else 0
            a = a.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 1 << 32 else np.int64)
        data = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        parts.append(f"{name} {a.dtype.str} {len(data)}\n".encode() + data)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, {}
    while at < len(data):
        end = data.index(b"\n", at)
        name, kind, size = data[at:end].decode().split()
        planes = np.frombuffer(data, dtype=np.uint8, count=int(size), offset=end + 1).reshape(np.dtype(kind).itemsize, -1)
        a = np.ascontiguousarray(planes.T).view(kind).ravel()
        if name == "names":
            a = np.cumsum(a, dtype=U)
        out[name] = a.astype(np.int64) if a.dtype.kind == "u" and a.dtype.itemsize < 8 else a
        at = end + 1 + int(size)
    return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _chunks(batches: Iterator[pd.DataFrame], route: Route) -> Iterator[pd.DataFrame]:
    """Rows (part, chunk, blob): what a chunk of documents sends to each partition, and its own documents."""
    number = 0
    ids: list = []
    texts: list[list[bytes]] = []
    size = 0

    def flush() -> pd.DataFrame:
        nonlocal number, ids, texts, size
        chunk = TaskContext.get().partitionId() << 32 | number
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        w = np.empty(int(lengths.sum()), dtype=U)
        ends = np.cumsum(lengths) - 1
        is_word = np.ones(len(w), dtype=bool)
        is_word[ends] = False
        w[is_word] = np.fromiter((xxhash.xxh3_64_intdigest(x) for t in texts for x in t), dtype=U, count=int(is_word.sum()))
        w[ends] = END
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[ends - lengths + 1] = START
        doc = np.repeat(np.arange(len(texts)), lengths)
        out = np.array([held_out(i) for i in ids])
        known = np.array([i is not None for i in ids])
        header = _pack(ids=np.array([i or 0 for i in ids], dtype=np.int64).view(U), known=known.astype(np.int64), n=lengths, out=out.astype(np.int64))
        rows = [(chunk % route.parts, chunk, b"h" + header)]
        part = route.of_pair(v, w)
        order = np.lexsort((v, w, part))
        v, w, doc, part = v[order], w[order], doc[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            names, at = np.unique(np.concatenate([v[a:b], w[a:b]]), return_inverse=True)
            own = doc[a:b]
            rows.append((int(part[a]), chunk, b"t" + _pack(names=names, v=at[: b - a], w=at[b - a :], doc=own, out=out[own].astype(np.int64))))
        number, ids, texts, size = number + 1, [], [], 0
        del v, w, doc, part, order
        _give_back()
        return pd.DataFrame(rows, columns=["part", "chunk", "blob"])

    for b in batches:
        for doc_id, known, text in zip(b["doc_id"].tolist(), b["known"], b["text"], strict=True):
            found = (text or "").encode("utf-8", "surrogatepass").lower().split()
            ids.append(doc_id if known else None)
            texts.append(found)
            size += len(found) + 1
            if size >= CHUNK_TOKENS:
                yield flush()
    if ids:
        yield flush()


def frequent(docs: DataFrame, parts: int) -> np.ndarray:
    """Sorted hashes of tokens that hold over 1 / (8 parts) of the sampled tokens; at most 8 parts of them."""
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(SAMPLE)) == 0)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = some.select(F.explode(words(lower)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = some.select(F.sum(F.size(words(F.col("text")))).alias("n")).first()["n"] or 0
    found = counts.where(F.col("n") * 8 * parts > total).select("w").collect()
    return np.sort(np.array([END, *(xxhash.xxh3_64_intdigest(r["w"].encode("utf-8", "surrogatepass")) for r in found)], dtype=U))


class Tokens:
    """All occurrences of a partition's tokens, grouped by token and then history.

    An occurrence is kept as four small numbers: its place among the tokens and among the pairs, its document (counted
    over all chunks) and whether that is for training."""

    def __init__(self, blobs: list[tuple[int, bytes]]):
        self.headers = [(c, b) for c, b in blobs if b[:1] == b"h"]
        parts = [(c, _unpack(b[1:])) for c, b in blobs if b[:1] == b"t"]
        self.chunks = [c for c, _ in parts]
        # documents of chunk i count from base[i] on
        self.base = np.cumsum([0, *(int(p["doc"].max()) + 1 for _, p in parts)])
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, dtype=kind)
        names = np.unique(join([p["names"] for _, p in parts], U))
        codes = [np.searchsorted(names, p["names"]).astype(np.int32) for _, p in parts]
        v = join([c[p["v"]] for c, (_, p) in zip(codes, parts, strict=True)], np.int32)
        w = join([c[p["w"]] for c, (_, p) in zip(codes, parts, strict=True)], np.int32)
        self.doc = join([(p["doc"] + b).astype(np.int32) for b, (_, p) in zip(self.base, parts, strict=False)], np.int32)
        self.train = join([p["out"] == 0 for _, p in parts], bool)
        del parts, codes
        order = np.lexsort((v, w)).astype(np.int32)
        v, w, self.doc, self.train = v[order], w[order], self.doc[order], self.train[order]
        del order
        new_w = np.diff(w, prepend=np.int32(-1)) != 0
        new_pair = new_w | (np.diff(v, prepend=np.int32(-1)) != 0)
        self.of_w, self.of_pair = (np.cumsum(x, dtype=np.int32) - np.int32(1) for x in (new_w, new_pair))
        self.words = names[w[new_w]]
        self.pair_v, self.pair_w = names[v[new_pair]], self.of_w[new_pair]
        del v, w, names
        _give_back()
        self.word_counts = np.bincount(self.of_w[self.train], minlength=len(self.words))
        self.pair_counts = np.bincount(self.of_pair[self.train], minlength=len(self.pair_v))


def _coc(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2]


def _count(blobs: Iterator[tuple[int, tuple[int, bytes]]], route: Route) -> Iterator[tuple[str, list]]:
    """("all", counts of counts and totals) of a partition's own tokens, and partial counts of the hot ones."""
    rows = [x for _, x in blobs]
    if not rows:
        return
    t = Tokens(rows)
    hot = route.is_hot(t.words)
    own = t.word_counts[~hot]
    documents = sum(int((_unpack(b[1:])["out"] == 0).sum()) for _, b in t.headers)
    yield "all", [*_coc(own).tolist(), *_coc(t.pair_counts).tolist(), int(t.word_counts.sum()), int((own > 0).sum()), documents]
    for w, c in zip(t.words[hot].tolist(), t.word_counts[hot].tolist(), strict=True):
        yield f"{w}", [c]


def _add(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def fit(exchanged: RDD, route: Broadcast[Route]) -> Model:
    found = dict(exchanged.mapPartitions(lambda x: _count(x, route.value)).reduceByKey(_add).collect())
    sums = found.pop("all", [0] * (2 * (K + 2) + 3))
    hot = np.array(sorted(map(int, found)), dtype=U)
    counts = np.array([found[str(w)][0] for w in hot.tolist()], dtype=np.int64)
    uni = np.array(sums[: K + 2]) + _coc(counts)
    tokens, distinct, documents = sums[-3], sums[-2] + int((counts > 0).sum()), sums[-1]
    d = discounts(uni.tolist())
    # what the discounts take from order 1 is the unknown token's
    lost = float(sum((1 - d[r]) * r * uni[r] for r in range(1, K + 1)))
    if tokens and lost <= 0:
        lost = 0.5  # every token was seen over K times: as if an unknown one had been seen half a time
    return Model(tokens, distinct, documents, d, discounts(sums[K + 2 : 2 * (K + 2)]), hot, counts, lost / tokens if tokens else 1.0)


def _by_chunk(chunks: list[int], base: np.ndarray, doc: np.ndarray, values: dict[str, np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(chunk, blob) of the sums for each document that has any; doc: which documents the values are of, counted over all chunks."""
    cuts = np.searchsorted(doc, base)
    for i, c in enumerate(chunks):
        own = slice(cuts[i], cuts[i + 1])
        if cuts[i] < cuts[i + 1]:
            yield c, b"s" + _pack(doc=(doc[own] - base[i]).astype(np.int64), **{n: x[own] for n, x in values.items()})


def _worth(blobs: Iterator[tuple[int, tuple[int, bytes]]], route: Route, model: Model) -> Iterator[tuple[int, tuple[int, bytes]]]:
    """Sums for each document, and what the partitions of the histories need."""
    rows = [x for _, x in blobs]
    if not rows:
        return
    t = Tokens(rows)
    for c, b in t.headers:
        yield c % route.parts, (c, b)
    hot = route.is_hot(t.words)
    counts = t.word_counts.copy()
    if len(model.hot):
        at = np.minimum(np.searchsorted(model.hot, t.words), len(model.hot) - 1)
        counts = np.where(hot & (model.hot[at] == t.words), model.hot_counts[at], counts)
    p_uni, seen = model.p_uni(counts), t.pair_counts > 0
    inside = np.where(seen, np.log10(np.maximum(_discounted(model.bi, t.pair_counts), 1e-300)), np.log10(p_uni)[t.pair_w])
    # as the history of the next token, where there is one
    as_history = np.where((counts > 0) & (t.words != END), -np.log10(np.maximum(denominator(counts), 1)), 0.0)
    n_docs = int(t.base[-1])
    sums = lambda x: np.bincount(t.doc, weights=x, minlength=n_docs)
    has = np.flatnonzero(np.bincount(t.doc, minlength=n_docs))
    values = {"base": sums(model.base(counts)[t.of_w])[has], "known": sums((counts > 0)[t.of_w])[has].astype(np.int64), "score": (sums(inside[t.of_pair]) + sums(as_history[t.of_w]))[has]}
    for c, b in _by_chunk(t.chunks, t.base, has, values):
        yield c % route.parts, (c, b)
    # counts of own tokens for their own partition
    own = ~hot & (counts > 0)
    target = route.of_word(t.words)
    for q in np.unique(target[own]):
        at = own & (target == q)
        yield int(q), (-1, b"c" + _pack(w=t.words[at], n=counts[at]))
    # masses of seen continuations by history
    order = np.argsort(t.pair_v[seen], kind="stable")
    v = t.pair_v[seen][order]
    if len(v):
        first = np.flatnonzero(np.diff(v, prepend=~v[:1]) != 0)
        taken = np.add.reduceat(_discounted(model.bi, t.pair_counts[seen][order]), first)
        lower = np.add.reduceat(p_uni[t.pair_w[seen][order]], first)
        yield from _routed(route, v[first], b"m", taken=taken, lower=lower)
    unseen = np.flatnonzero(~seen[t.of_pair])
    if len(unseen):
        doc = t.doc[unseen].astype(np.int64)
        at = np.searchsorted(t.base, doc, side="right") - 1
        yield from _routed(route, t.pair_v[t.of_pair[unseen]], b"r", chunk=np.array(t.chunks, dtype=np.int64)[at].view(U), doc=doc - t.base[at])


def _routed(route: Route, w: np.ndarray, kind: bytes, **arrays: np.ndarray) -> Iterator[tuple[int, tuple[int, bytes]]]:
    part = route.of_word(w)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[a:b]
        yield int(part[own[0]]), (-1, kind + _pack(w=w[own], **{n: x[own] for n, x in arrays.items()}))


def _table(blobs: list[dict[str, np.ndarray]], *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct words and the sums of the named arrays."""
    if not blobs:
        return np.zeros(0, dtype=U), [np.zeros(0) for _ in names]
    w, at = np.unique(np.concatenate([b["w"] for b in blobs]), return_inverse=True)
    return w, [np.bincount(at, weights=np.concatenate([b[n] for b in blobs]), minlength=len(w)) for n in names]


def _lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), default)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)


def _back_off(blobs: Iterator[tuple[int, tuple[int, bytes]]], model: Model) -> Iterator[tuple[int, bytes]]:
    """(chunk, blob): passes the documents' sums on, and adds what unseen bigrams get from their histories."""
    kinds: dict[bytes, list[dict[str, np.ndarray]]] = defaultdict(list)
    for _, (chunk, blob) in blobs:
        if blob[:1] in b"hs":
            yield chunk, blob
        else:
            kinds[blob[:1]].append(_unpack(blob[1:]))
    asked = kinds.pop(b"r", [])
    if not asked:
        return
    w, (taken, lower) = _table(kinds.pop(b"m", []), "taken", "lower")
    known, (n,) = _table(kinds.pop(b"c", []), "n")
    count = _lookup(known, n, w, 0.0)
    if len(model.hot):
        count = np.where(count > 0, count, _lookup(model.hot, model.hot_counts.astype(float), w, 0.0))
    count = np.where(w == START, float(model.documents), count)
    den = denominator(np.maximum(count, 1))
    alpha = (1 - taken / den) / np.maximum(1 - lower, 1e-300)
    v = np.concatenate([a["w"] for a in asked])
    chunk = np.concatenate([a["chunk"] for a in asked]).view(np.int64)
    doc = np.concatenate([a["doc"] for a in asked])
    # the denominator was taken off for every history
    value = _lookup(w, np.log10(np.maximum(alpha, 1e-300)) + np.log10(den), v, 0.0)
    chunks, rank = np.unique(chunk, return_inverse=True)
    wide = int(doc.max()) + 1
    has, at = np.unique(rank * wide + doc, return_inverse=True)
    yield from _by_chunk(chunks.tolist(), np.arange(len(chunks) + 1) * wide, has, {"score": np.bincount(at, weights=value)})


def _finish(blobs: Iterator[tuple[int, bytes]], model: Model) -> Iterator[tuple]:
    by: dict[int, list[bytes]] = defaultdict(list)
    for chunk, blob in blobs:
        by[chunk].append(blob)
    start = math.log10(max(1, denominator(np.int64(model.documents)))) if model.documents else 0.0
    for parts in by.values():
        head = next(_unpack(b[1:]) for b in parts if b[:1] == b"h")
        n = len(head["n"])
        sums = {k: np.zeros(n) for k in ("base", "known", "score")}
        for b in parts:
            if b[:1] == b"s":
                got = _unpack(b[1:])
                for k in sums.keys() & got.keys():
                    sums[k][got["doc"]] += got[k]
        ids = head["ids"].view(np.int64)
        for i in range(n):
            yield (int(ids[i]) if head["known"][i] else None, bool(head["out"][i]), int(head["n"][i]), int(sums["known"][i]), model.tokens, float(sums["base"][i]), float(sums["score"][i] - start))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Scores of every row of docs (doc_id, text) under the model of its training rows."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(MIN_PARTITIONS, -(-size // partition_bytes))
    route = spark.sparkContext.broadcast(Route(parts, frequent(docs, parts)))
    # pandas would make floats of ids among which is a null
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    rows = named.mapInPandas(lambda b: _chunks(b, route.value), "part int, chunk long, blob binary").rdd
    exchanged = rows.map(lambda r: (r[0], (r[1], bytes(r[2])))).partitionBy(parts)
    model = fit(exchanged, route)
    shared = spark.sparkContext.broadcast(model)
    met = exchanged.mapPartitions(lambda x: _worth(x, route.value, shared.value)).partitionBy(parts)
    sums = met.mapPartitions(lambda x: _back_off(x, shared.value)).partitionBy(parts)
    return spark.createDataFrame(sums.mapPartitions(lambda x: _finish(x, shared.value)), SCORES)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
