"""Phrase collocation mining: phrases of 2 to `longest` words that occur `least` times or more, with the score of their weakest cut.

Level by level, as Apriori does: a phrase can be frequent only if the phrase without its last word and the one without its first
are, so its key is the pair of their slots, two numbers of 32 bits. Keys are exact, not hashes of words. A level takes three readings
of the encoded texts, and in each a task adds up numpy arrays over all its texts before it sends anything:
1. The occurrences of keys are counted in hashed buckets, eight or fewer to a bucket on average (the number of buckets follows the
   occurrences). A key whose bucket stays under `least` cannot be frequent; what the buckets leave is a bit for each.
2. The distinct keys in full buckets are the candidates: all frequent phrases, and a few others. They get a minimal perfect hash that
   stores the key of each slot, so that any other key is told from the candidates.
3. Tasks count candidates by slot (bincount); the arrays are cut into ranges and added up in a tree of two steps.
Candidates that reach `least` get a hash of their own, for the next level and for the cuts: the parts of a phrase are found by
following the slots of its key, so the counts of a cut are read by slot.

Texts are encoded once: words are numbered if they are frequent; anything else, and every end of a piece, is a gap.

What is collected and broadcast: words and phrases that occur `least` times, which by that are at most one for `least` words of the
corpus (with 100: 0.16 bytes a word at a level); bits and candidates of at most PASS occurrences, beyond which the keys of a level are
taken in several passes by hash, each with bits and a hash of its own.

Containment is looked at one word up only: the longer phrase's frequency is at most that of any phrase between, so a phrase is inside
a longer one of the given share if and only if it is inside one that is one word longer.

Defined cases: a null text has no words; a null lang counts as `und`, and with a lang of that name as one; repeated rows count as
often as they stand there; ties are decided by frequency and then by the bytes of the phrase; an empty table, or one without a
frequent phrase, gives an empty result; only text and lang are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.common import runs, table, written
from semblance.llm.neardup import GOLD, U, mixed

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
#: Bytes of text that are encoded at a time.
CHUNK_BYTES = 8 << 20
#: Occurrences of keys that share one pass, and those for each bucket.
PASS, PER_BUCKET = 1 << 31, 8
#: Buckets, and slots, of a range that is added up by itself.
BUCKETS, SLOTS = 1 << 20, 1 << 16
#: First sums of the tree for each range.
BRANCHES = 32
#: Phrases that a task scores.
SCORED = 200_000

#: Bytes that end a piece, and bytes that separate words inside of one.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, dtype=np.uint8)
KIND[list(ENDS)], KIND[list(BLANKS)] = 2, 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys that keeps the key of each slot.

    Keys go to a bit array twice their number; those alone on their bit are done, the others go to the next array. A slot is the
    number of bits set before the key's own."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base, left = 0, keys.astype(U)
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = self._place(left, len(self.levels), size)
            hits = np.bincount(at, minlength=size)
            bits = np.packbits(hits == 1, bitorder="little").view("<u8")
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((bits, base + np.cumsum(ones) - ones))
            base += int(ones.sum())
            left = left[hits[at] > 1]
        self.keys = np.zeros(len(keys), dtype=U)
        self.keys[self._slots(keys.astype(U))] = keys

    def __len__(self) -> int:
        return len(self.keys)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(keys + GOLD * U(level + 1)) % U(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots, rest = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            at = self._place(keys[rest], level, 64 * len(bits))
            word, bit = bits[at >> 6], (at & 63).astype(U)
            hit = (word >> bit & U(1)).astype(bool)
            low = word[hit] & ((U(1) << bit[hit]) - U(1))
            slots[rest[hit]] = before[at[hit] >> 6] + np.bitwise_count(low)
            rest = rest[~hit]
        return slots

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that are not in it."""
        slots = self._slots(keys)
        some = np.flatnonzero(slots >= 0)
        slots[some[self.keys[slots[some]] != keys[some]]] = -1
        return slots


@dataclass(frozen=True)
class Phrases:
    """The frequent phrases of one length: the hash of their keys, and their frequencies by slot."""

    hash: PerfectHash
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Slots (one word shorter) of the phrases without their last word."""
        return (self.hash.keys >> U(32)).astype(np.int64)

    @property
    def rest(self) -> np.ndarray:
        return (self.hash.keys & U(0xFFFFFFFF)).astype(np.int64)


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of binary texts one after the other, and for each whether it begins a piece."""
    offsets = np.frombuffer(texts.buffers()[1], dtype="<i4" if pa.types.is_binary(texts.type) else "<i8")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    kind = KIND[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets - offsets[0]] = True
    edge = edge[:-1]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    at = np.flatnonzero(begins)
    letters = LOWER[data[inside]]
    lengths = np.add.reduceat(inside, at, dtype=np.int64) if len(at) else np.zeros(0, dtype=np.int64)
    piece = np.cumsum((kind == 2) | edge, dtype=np.int64)[at]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)])), pa.py_buffer(letters)])
    return words, np.diff(piece, prepend=-1) != 0


CHUNK = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one lang, as numbers of a list of their words; -1 begins a piece."""
    for b in batches:
        langs = b.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            texts = b.column("text").filter(pc.equal(langs.indices, code))
            for run in runs(texts, CHUNK_BYTES):
                words, begins = _tokens(texts[run])
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                ids = coded.indices.to_numpy().astype(np.int32)
                counts = np.bincount(ids, minlength=len(coded.dictionary))
                stream = np.insert(ids, np.flatnonzero(begins), -1)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(ids)]), pa.array([coded.dictionary.cast(pa.binary())], CHUNK.field("words").type), pa.array([counts]), pa.array([stream.tobytes()], pa.binary())], schema=CHUNK)


def chunks(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return written(rows.mapInArrow(_chunks, "lang string, n long, words array<binary>, counts array<long>, ids binary"), "chunks")


def vocabulary(parts: DataFrame, least: int) -> pa.Table:
    """lang, word, n of the words that occur `least` times in their lang, in order; a word's place is its number."""
    each = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    n = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    return n.where(F.col("n") >= least).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])


def encoded(parts: DataFrame, known: pa.Table) -> DataFrame:
    """ids (numbers of words, -1 for gaps) of each chunk; words between two gaps are left out, as they begin no phrase."""
    spark = parts.sparkSession
    langs = known["lang"].combine_chunks().dictionary_encode() if known.num_rows else None
    sent = spark.sparkContext.broadcast({} if langs is None else {
        lang: (int(np.argmax(codes == i)), known["word"].combine_chunks().filter(pa.array(codes == i)))
        for codes in [langs.indices.to_numpy()] for i, lang in enumerate(langs.dictionary.to_pylist())})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words, ids in zip(b.column("lang").to_pylist(), b.column("words"), b.column("ids"), strict=True):
                if lang not in sent.value:
                    continue
                first, own = sent.value[lang]
                at = pc.index_in(words.values, own)
                number = pc.fill_null(at, -1 - first).to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(first)
                stream = np.append(number, np.int32(-1))[np.frombuffer(ids.as_buffer(), dtype=np.int32)]
                word = np.concatenate([[False], stream >= 0, [False]])
                keep = word[1:-1] & (word[:-2] | word[2:])
                # one gap is as good as many
                keep |= ~word[1:-1] & np.concatenate([[False], keep[:-1]])
                if keep.any():
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([stream[keep].tobytes()], pa.binary())})

    return written(parts.select("lang", "words", "ids").mapInArrow(code, "ids binary"), "encoded")


def _keys(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two phrases of one length follow each other by a word: places, and keys of the phrase that both make."""
    at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    return at, slots[at].astype(U) << U(32) | slots[at + 1].astype(U)


def _streams(batches: Iterator[pa.RecordBatch], shorter: list[Phrases], share: int, shares: int) -> Iterator[np.ndarray]:
    """Keys of all occurrences of phrases one word longer than the last of `shorter`, chunk by chunk; of several shares, one."""
    for b in batches:
        for ids in b.column("ids"):
            slots = np.frombuffer(ids.as_buffer(), dtype=np.int32).astype(np.int64)
            for phrases in shorter:
                at, keys = _keys(slots)
                slots = np.full(max(0, len(slots) - 1), -1, dtype=np.int64)
                slots[at] = phrases.hash.lookup(keys)
            _, keys = _keys(slots)
            yield keys[mixed(keys ^ GOLD) % U(shares) == share] if shares > 1 else keys


def _pack(a: np.ndarray) -> bytes:
    """A sorted or small-valued array, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) & U(buckets - 1)).astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sums of their counts."""
    at, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return at, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(at)).astype(np.int64)


def full_buckets(texts: DataFrame, keys_of: Callable, buckets: int, least: int) -> np.ndarray:
    """A bit for each bucket, packed: whether its keys occur `least` times together."""
    top = max(255, least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for keys in keys_of(batches):
            at, n = np.unique(_bucket_of(keys, buckets), return_counts=True)
            held.append((at, n))
            size += len(at)
            if size > 8 * BUCKETS:
                held = [_summed(held)]
                size = len(held[0][0]) // 2
        at, n = _summed(held) if held else (np.zeros(0, dtype=np.int64),) * 2
        if not len(at):
            return
        # a bucket that one task alone fills needs no more than `least`
        n = np.minimum(n, top).astype("<u4")
        cuts = np.flatnonzero(np.diff(at // BUCKETS, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
            blob = [_pack(np.diff(at[a:b] % BUCKETS, prepend=0).astype("<u4")), _pack(n[a:b])]
            yield pa.RecordBatch.from_pydict({"part": pa.array([int(at[a]) // BUCKETS], pa.int32()), "at": pa.array(blob[:1], pa.binary()), "n": pa.array(blob[1:], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        sums = np.zeros(min(BUCKETS, buckets), dtype=np.int64)
        for at, n in zip(t["at"], t["n"], strict=True):
            sums[np.cumsum(_unpack(at.as_py(), "<u4"), dtype=np.int64)] += _unpack(n.as_py(), "<u4")
        return pa.table({"part": t["part"][:1], "bits": pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())})

    found = texts.mapInArrow(count, "part int, at binary, n binary").groupBy("part").applyInArrow(add, "part int, bits binary")
    bits = np.zeros(buckets // 8, dtype=np.uint8)
    for part, own in zip(*(c.to_pylist() for c in found.toArrow().columns), strict=True):
        at = part * (BUCKETS // 8)
        bits[at : at + len(own)] = np.frombuffer(own, dtype=np.uint8)
    return bits


def _in_full(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = _bucket_of(keys, 8 * len(bits))
    return keys[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]


def candidates(texts: DataFrame, keys_of: Callable, bits: np.ndarray) -> np.ndarray:
    """Distinct keys that stand in full buckets, put together range by range of the buckets."""
    sent, buckets = texts.sparkSession.sparkContext.broadcast(bits), 8 * len(bits)
    packed = lambda part, keys: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "keys": pa.array([_pack(np.diff(keys, prepend=U(0)))], pa.binary())})

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, fresh, size = np.zeros(0, dtype=U), [], 0
        for keys in keys_of(batches):
            fresh.append(np.unique(_in_full(keys, sent.value)))
            size += len(fresh[-1])
            if size > max(BUCKETS, len(found)):
                found, fresh, size = np.unique(np.concatenate([found, *fresh])), [], 0
        found = np.unique(np.concatenate([found, *fresh]))
        part = _bucket_of(found, buckets) // BUCKETS
        for p in np.unique(part):
            yield packed(int(p), found[part == p])

    def merge(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([packed(t["part"][0].as_py(), np.unique(np.concatenate([np.cumsum(_unpack(x.as_py(), "<u8"), dtype=U) for x in t["keys"]])))])

    found = texts.mapInArrow(distinct, "part int, keys binary").groupBy("part").applyInArrow(merge, "part int, keys binary").toArrow()["keys"]
    return np.concatenate([np.zeros(0, dtype=U), *(np.cumsum(_unpack(x.as_py(), "<u8"), dtype=U) for x in found)])


def counted(texts: DataFrame, keys_of: Callable, bits: np.ndarray, keys: PerfectHash) -> np.ndarray:
    """Occurrences of each slot's key."""
    sent = texts.sparkSession.sparkContext.broadcast((bits, keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, perfect = sent.value
        sums = np.zeros(len(perfect), dtype="<i8")
        for own in keys_of(batches):
            slots = perfect.lookup(_in_full(own, bits))
            sums += np.bincount(slots[slots >= 0], minlength=len(sums))
        for at in np.flatnonzero(np.add.reduceat(sums, np.arange(0, len(sums), SLOTS))):
            part = pa.array([int(at)], pa.int32()), pa.array([TaskContext.get().partitionId() % BRANCHES], pa.int32())
            yield pa.RecordBatch.from_arrays([*part, pa.array([_pack(sums[at * SLOTS : (at + 1) * SLOTS])], pa.binary())], ["part", "branch", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(_unpack(x.as_py(), "<i8") for x in t["sums"])
        return pa.table({"part": t["part"][:1], "branch": t["branch"][:1], "sums": pa.array([_pack(total)], pa.binary())})

    kind = "part int, branch int, sums binary"
    found = texts.mapInArrow(count, kind).groupBy("part", "branch").applyInArrow(add, kind).groupBy("part").applyInArrow(add, kind).toArrow()
    out = np.zeros(len(keys), dtype=np.int64)
    for part, own in zip(found["part"].to_pylist(), found["sums"].to_pylist(), strict=True):
        own = _unpack(own, "<i8")
        out[part * SLOTS : part * SLOTS + len(own)] = own
    return out


def longer(texts: DataFrame, shorter: list[Phrases], occurrences: int, least: int, per_pass: int = PASS) -> Phrases:
    """The frequent phrases one word longer than the last of `shorter` (none: of two words)."""
    sent = texts.sparkSession.sparkContext.broadcast(shorter)
    shares = max(1, -(-occurrences // per_pass))
    buckets = max(BUCKETS, 1 << math.ceil(math.log2(max(1, occurrences / shares / PER_BUCKET))))
    keys, counts = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)]
    for share in range(shares):
        keys_of = lambda batches, share=share: _streams(batches, sent.value, share, shares)
        bits = full_buckets(texts, keys_of, buckets, least)
        perfect = PerfectHash(candidates(texts, keys_of, bits))
        n = counted(texts, keys_of, bits, perfect) if len(perfect) else counts[0]
        keys.append(perfect.keys[n >= least])
        counts.append(n[n >= least])
    own, n = np.concatenate(keys), np.concatenate(counts)
    found = PerfectHash(own)
    by_slot = np.zeros(len(own), dtype=np.int64)
    by_slot[found.lookup(own)] = n
    return Phrases(found, by_slot)


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, per_pass: int = PASS) -> tuple[pa.Table, dict[str, int], list[Phrases]]:
    """Frequent words (lang, word, n), words of each lang, and the frequent phrases of 2 words and more, length by length."""
    parts = chunks(docs)
    words = {r["lang"]: r["n"] for r in parts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    known = vocabulary(parts, least)
    texts, found = encoded(parts, known), []
    occurrences = pc.sum(known["n"]).as_py() or 0
    while occurrences and len(found) < longest - 1:
        found.append(longer(texts, found, occurrences, least, per_pass))
        occurrences = int(found[-1].counts.sum())
    return known, words, found


def cuts(known: np.ndarray, found: list[Phrases], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each cut of the phrases of a length, from the first on: frequencies of the part before and the part after."""
    counts = [known, *(p.counts for p in found)]
    slots = np.arange(len(counts[length - 1]))
    first, rest = {length: slots}, {length: slots}
    for m in range(length, 1, -1):
        first[m - 1], rest[m - 1] = found[m - 2].first[first[m]], found[m - 2].rest[rest[m]]
    return [(counts[k - 1][first[k]], counts[length - k - 1][rest[length - k]]) for k in range(1, length)]


def contained(found: list[Phrases], length: int, share: int) -> np.ndarray:
    """Which phrases of a length are inside a longer one that has `share` percent of their frequency."""
    own = found[length - 2].counts
    out = np.zeros(len(own), dtype=bool)
    if length - 1 < len(found):
        up = found[length - 1]
        for part in (up.first, up.rest):
            out[part[100 * up.counts >= share * own[part]]] = True
    return out


def _wide(a: np.ndarray, columns: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, columns - a.shape[1])), constant_values=-1)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, per_pass: int = PASS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each lang."""
    spark = docs.sparkSession
    known, words, found = mined(docs, least, longest, per_pass)
    counts = known["n"].to_numpy()
    wide = 2 * (longest - 1)
    flat: dict[str, list] = {"words": [], "a": [], "cuts": []}
    spelt = np.arange(len(counts))[:, None]
    for length in range(2, len(found) + 2):
        own = found[length - 2]
        spelt = np.hstack([spelt[own.first], spelt[own.rest][:, -1:]])
        keep = np.flatnonzero(~contained(found, length, share))
        flat["words"].append(_wide(spelt[keep], longest))
        flat["a"].append(own.counts[keep])
        flat["cuts"].append(_wide(np.stack([x[keep] for pair in cuts(counts, found, length) for x in pair], axis=1), wide))
    total = sum(len(a) for a in flat["a"])
    join = lambda name, columns: np.concatenate(flat[name]) if flat[name] else np.zeros((0, columns), dtype=np.int64)
    sent = spark.sparkContext.broadcast((join("words", longest), join("a", 1), join("cuts", wide), known["word"].to_pylist(), known["lang"].to_pylist(), words))
    schema = "lang string, phrase binary, a long, l long, r long, n long, score long"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt, a, pairs, names, langs, words = sent.value
        best: dict[str, list[tuple]] = {}
        for b in batches:
            for i in b.column("id").to_pylist():
                of = int(a[i])
                lang = langs[spelt[i, 0]]
                n = words[lang]
                options = [(1000 * of * n // (x * y), k, x, y) for k, (x, y) in enumerate(pairs[i].reshape(-1, 2).tolist()) if x >= 0]
                value, _, x, y = min(options)
                best.setdefault(lang, []).append((-value, -of, b" ".join(names[w] for w in spelt[i] if w >= 0), x, y, n))
        rows = [(lang, p, -of, x, y, n, -value) for lang, own in best.items() for value, of, p, x, y, n in sorted(own)[:top]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "phrase", "a", "l", "r", "n", "score"])

    scored = spark.range(0, total, 1, max(1, -(-total // SCORED))).mapInArrow(score, schema)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: Lists of words of every piece, all their phrases, candidates and cuts; HUGEINT holds the products.
OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i:i + k - 1])) AS p FROM lists, range(1, 6) t(k)
), f AS (
  SELECT lang, k, p, count(*) AS n FROM grams GROUP BY lang, k, p HAVING count(*) >= 100
), candidates AS (
  SELECT * FROM f WHERE k >= 2
), inner_parts AS (
  SELECT lang, m AS k, unnest(list_transform(range(1, (k - m + 2)::BIGINT), lambda i: p[i:i + m - 1])) AS p, n FROM candidates, range(2, 5) t(m) WHERE m < k
), inside AS (
  SELECT lang, k, p, max(n) AS most FROM inner_parts GROUP BY lang, k, p
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.k = i.k AND c.p = i.p WHERE i.most IS NULL OR 100 * i.most < 100 * c.n
), all_cuts AS (
  SELECT c.lang, c.p, c.n AS a, cut, x.n AS l, y.n AS r, t.n, (1000::HUGEINT * c.n * t.n) // (x.n::HUGEINT * y.n) AS score
  FROM kept c JOIN range(1, 5) k(cut) ON cut < c.k JOIN totals t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.k = cut AND x.p = c.p[1:cut] JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.p = c.p[cut + 1:c.k]
), least AS (
  SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS o FROM all_cuts
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
  FROM least WHERE o = 1
)
SELECT * FROM ranked WHERE rank <= 2000
"""
