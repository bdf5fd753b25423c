"""Best-fit packing of tokenised documents with swap-based local search.

Lengths are whole numbers up to the capacity, so any corpus is, to the packer, a histogram of at most `capacity`
counts. Bins of equal content are kept as one pattern with a count, and every step works on whole counts: best
fit in decreasing order, then a local search that moves a piece, exchanges one for one, or two for one, between
underfull bins whenever this raises the sum of squared fills, until bins empty or nothing improves. The work and
what the driver holds thus depend on the capacity and not on the number of documents.

Pieces of one length are interchangeable: the n-th piece of a length goes to the n-th place of that length. The
number n is a rank inside (length, slot of a hash) plus the counts of earlier slots; slots grow with the pieces, so
a length that holds a third of all rows is still dealt evenly.

Defined cases: a null text is empty and has the closing id alone; repeated rows are separate documents; an empty
table gives an empty result; only documents over the capacity are cut, and their last piece may be shorter.
"""

from __future__ import annotations

import os
import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.common import runs, table, written

CAPACITY = 2048
CLOSING_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Slots of a hash that pieces are ranked in: one for so many pieces, and at least this many.
SLOT_ROWS, MIN_SLOTS = 50_000, 64
#: Bytes, about, of words and their ids that a task keeps, what one takes besides its letters, and text encoded together.
CACHE_BYTES, HELD, SLICE_BYTES = 64 << 20, 200, 4 << 20
#: Marks behind a word that the tokenizer cuts off as one token run.
MARKS = string.punctuation.replace("'", "")
#: Words of ASCII and Latin-1 letters: they are single code points in composed form, and so are their lower-case ones.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts as arrays. The tokenizer never joins across white space, so the ids of a text are those of its words
    in turn, and each distinct word is encoded once for a slice of texts.

    Nor does it join a run of letters with the ASCII marks behind it, where lower case and composition leave letters
    letters: LETTERS is the set for which that holds. Such a word is a stem, whose case does not matter, and marks; every other
    word is encoded whole. Ids of stems, marks and other words are kept from slice to slice, up to CACHE_BYTES."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _one_by_one(self, some: list[str]) -> None:
        for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _learn(self, stems: list[str], others: list[str]) -> None:
        for at in range(0, len(stems), 1024):  # letters alone are one token run, which an id with a word end closes
            part = stems[at : at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                data = ids.tobytes()
                self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
            else:
                self._one_by_one(part)
        for at in range(0, len(others), 1024):
            self._one_by_one(others[at : at + 1024])
        self.held += sum(HELD + 2 * len(w) for w in stems) + sum(HELD + 2 * len(w) for w in others)

    def _ids(self, parts: list[str], letters: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, one after another, and how many each has."""
        if self.held > CACHE_BYTES:
            self.known, self.held = {"": b""}, 0
        known = self.known
        self._learn([w for w, x in zip(parts, letters, strict=True) if x and w not in known], [w for w, x in zip(parts, letters, strict=True) if not x and w not in known])
        found = list(map(known.__getitem__, parts))
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after another, and how many each has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words, word_of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        stems = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(stems, LETTERS)
        # a stem of letters in lower case, or the whole word; and the marks behind a stem
        first = pc.if_else(plain, pc.utf8_lower(stems), words).dictionary_encode()
        sizes = [pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (words, stems)]
        behind = np.where(plain.to_numpy(zero_copy_only=False), sizes[0] - sizes[1], 0)
        marked = np.flatnonzero(behind)
        tails, tail_of = np.unique([w[-n:] for w, n in zip(words.take(pa.array(marked)).to_pylist(), behind[marked].tolist(), strict=True)] or [""], return_inverse=True)
        own = first.indices.to_numpy(zero_copy_only=False)
        is_plain = np.zeros(len(first.dictionary), dtype=bool)
        is_plain[own[plain.to_numpy(zero_copy_only=False)]] = True
        parts = [*first.dictionary.to_pylist(), *tails.tolist(), ""]
        ids, n = self._ids(parts, [*is_plain.tolist(), *[False] * (len(tails) + 1)])
        # each word is a part and a tail, which may be the empty one at the end
        tail = np.full(len(words), len(parts) - 1)
        tail[marked] = len(is_plain) + tail_of[: len(marked)]
        of_token = np.stack([own[word_of], tail[word_of]], axis=1).ravel() if len(word_of) else np.zeros(0, dtype=np.int64)
        length = n[of_token]
        ends = np.cumsum(length)
        start = np.cumsum(n) - n
        at = np.repeat(start[of_token] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        upto = np.append(0, ends)[2 * split.offsets.to_numpy().astype(np.int64)] if len(ends) else np.zeros(len(texts) + 1, dtype=np.int64)
        return ids[at], np.diff(upto)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of every document (doc_id, text). What a task keeps of the tokenizer's work ends with it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        for b in batches:
            for s in runs(b["text"], SLICE_BYTES):
                texts = b["text"].slice(s.start, s.stop - s.start)
                ids, n = encoder.encode(texts)
                ids = np.insert(ids, np.cumsum(n), CLOSING_ID).astype("<u4", copy=False)
                n += 1
                cuts = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                at = (4 * ((np.cumsum(n) - n)[row] + start)).tolist()
                data = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(data[a : a + 4 * k]) for a, k in zip(at, length.tolist(), strict=True)]
                doc_id = b["doc_id"].slice(s.start, s.stop - s.start).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


# A pattern is a sorted tuple of (length, times); bins are a Counter of patterns.


def _total(p: tuple) -> int:
    return sum(n * k for n, k in p)


def _changed(p: tuple, out: tuple = (), into: tuple = ()) -> tuple:
    c = dict(p)
    for n in out:
        c[n] -= 1
    for n in into:
        c[n] = c.get(n, 0) + 1
    return tuple(sorted((n, k) for n, k in c.items() if k))


def best_fit(lengths: dict[int, int], capacity: int) -> Counter:
    """Best fit in decreasing order over a histogram: each length fills the fullest bins that can take it."""
    by_room: dict[int, Counter] = defaultdict(Counter)
    for n in sorted(lengths, reverse=True):
        left = lengths[n]
        for room in sorted(r for r in by_room if r >= n):
            if not left:
                break
            for p, count in sorted(by_room[room].items()):
                fit = room // n
                full = min(count, left // fit)
                moves = [(full, fit)] if full else []
                rest = left - full * fit
                if full < count and 0 < rest:
                    moves.append((1, min(rest, fit)))
                for bins, k in moves:
                    by_room[room][p] -= bins
                    by_room[room - k * n][_changed(p, into=(n,) * k)] += bins
                    left -= bins * k
                by_room[room] += Counter()
                if not left:
                    break
            if not by_room[room]:
                del by_room[room]
        fit = capacity // n
        if left >= fit:
            by_room[capacity - fit * n][((n, fit),)] += left // fit
        if left % fit:
            by_room[capacity - left % fit * n][((n, left % fit),)] += 1
    return sum(by_room.values(), Counter())


def _step(a: tuple, b: tuple, capacity: int) -> tuple[tuple, tuple] | None:
    """The exchange between a bin a and an emptier bin b that fills a most: what leaves a, what leaves b."""
    room = capacity - _total(a)
    best, gain = None, 0
    own = [n for n, _ in a]
    theirs = [n for n, _ in b]
    pairs = {x + y: (x, y) for i, (x, k) in enumerate(b) for y in ([x] if k > 1 else []) + theirs[i + 1 :]}
    singles = {n: (n,) for n in theirs}
    for out in [(), *((n,) for n in own)]:
        freed = out[0] if out else 0
        for options in (singles, pairs) if out else (singles,):
            for size, into in options.items():
                if gain < size - freed <= room:
                    best, gain = (out, into), size - freed
    return best


def _window(low: int, room: int) -> int:
    """Bits low + 1 to low + room."""
    return ((1 << room) - 1) << (low + 1)


class _Wants:
    """What a pattern has to give, and what would fill it, as sets of sizes in the bits of one number each."""

    def __init__(self, p: tuple, capacity: int):
        room = capacity - _total(p)
        sizes = [n for n, k in p for _ in range(min(k, 2))]
        self.total = _total(p)
        self.singles = sum(1 << n for n, _ in p)
        self.pairs = 0
        for i, x in enumerate(sizes):
            for y in sizes[i + 1 :]:
                self.pairs |= 1 << (x + y)
        self.for_one = 0  # sizes of two that gain where one piece leaves
        for n, _ in p:
            self.for_one |= _window(n, room)
        self.single = self.for_one | _window(0, room)

    def gains(self, giver: _Wants) -> bool:
        return bool(giver.singles & self.single or giver.pairs & self.for_one)


def improve(bins: Counter, capacity: int) -> Counter:
    """Local search over underfull bins. Each step takes from the emptiest bins that have something to give and fills the
    fullest ones that gain. It raises the sum of squared fills, so the search ends: where no pair of bins gains, or where there are
    as few bins as the pieces' total needs, so that none can be emptied."""
    done = Counter({p: c for p, c in bins.items() if _total(p) == capacity})
    open_ = Counter({p: c for p, c in bins.items() if _total(p) < capacity})
    left = sum(bins.values()) + -sum(_total(p) * c for p, c in bins.items()) // capacity  # bins beyond the fewest
    known: dict[tuple, _Wants] = {}
    while left > 0:
        order = sorted(open_, key=lambda p: (_total(p), p))
        wants = [known.setdefault(p, known.get(p) or _Wants(p, capacity)) for p in order]
        # what the bins from each place on would take; bins of one total take from each other
        take, one, two = [(0, 0)] * len(order), 0, 0
        for i in range(len(order) - 1, -1, -1):
            one, two = one | wants[i].single, two | wants[i].for_one
            take[i] = one, two
        first = 0
        found = None
        for i, (b, giver) in enumerate(zip(order, wants, strict=True)):
            if giver.total > wants[first].total:
                first = i
            if giver.singles & take[first][0] or giver.pairs & take[first][1]:
                at = next((j for j in range(len(order) - 1, first - 1, -1) if wants[j].gains(giver) and (j != i or open_[b] > 1)), None)
                if at is not None:
                    found = order[at], b
                    break
        if not found:
            break
        a, b = found
        times = open_[b] // 2 if a == b else min(open_[a], open_[b])
        out, into = _step(a, b, capacity)
        open_[a] -= times
        open_[b] -= times
        for p in (_changed(a, out, into), _changed(b, into, out)):
            if p:
                (done if _total(p) == capacity else open_)[p] += times
            else:
                left -= times
        open_ += Counter()
    return done + open_


def places(bins: Counter) -> dict[str, np.ndarray]:
    """For each pattern and length in it: the first of its places among those of the length, how many of the length
    a bin holds, the first sequence number, and the offset in the sequence. Sorted by length and first place."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for p, count in sorted(bins.items(), key=lambda x: (-_total(x[0]), x[0])):
        offset = 0
        for n, k in reversed(p):
            rows.append((n, used[n], k, sequence, offset))
            used[n] += k * count
            offset += n * k
        sequence += count
    rows.sort()
    names = ("length", "first", "times", "sequence", "offset")
    return {k: np.array(v, dtype=np.int64) for k, v in zip(names, zip(*rows, strict=True), strict=True)} if rows else {k: np.zeros(0, np.int64) for k in names}


def pack_lengths(lengths: dict[int, int], capacity: int = CAPACITY) -> Counter:
    return improve(best_fit(lengths, capacity), capacity)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs with their sequence_id and offset."""
    spark = docs.sparkSession
    found = written(pieces(docs, path, capacity), "pack-pieces")
    slots = max(MIN_SLOTS, found.count() // SLOT_ROWS)
    found = found.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slots)))
    counts = written(found.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = places(pack_lengths(lengths, capacity))
    #: One number orders (length, place); places of one length are fewer than 2^48.
    plan["order"] = plan["length"] * (1 << 48) + plan["first"]
    shared = spark.sparkContext.broadcast(plan)
    earlier = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "piece")) - 1
    ranked = found.withColumn("_rank", rank).join(before, ["length", "slot"])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, place: pd.Series) -> pd.DataFrame:
        p = shared.value
        n, place = length.to_numpy(np.int64), place.to_numpy(np.int64)
        at = np.searchsorted(p["order"], n * (1 << 48) + place, side="right") - 1
        bin_, nth = np.divmod(place - p["first"][at], p["times"][at])
        return pd.DataFrame({"sequence_id": p["sequence"][at] + bin_, "offset": p["offset"][at] + nth * n})

    return ranked.withColumn("_p", placed("length", F.col("before") + F.col("_rank"))).select("doc_id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
