"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's bag is its character n-grams (and the word) between boundary marks, hashed to rows of an embedding table; the bag's
embedding is their mean. Misspellings that training never saw share n-grams, so their means stay close. A document is
the average of the bags of its distinct words and goes through a two-class softmax. The average is weighted: a word's
weight is exp(attention . embedding), normalised over the document. With equal weights a single insult in a text of a thousand
words moves the average by a thousandth; the attention vector learns which words a text is judged by. Table, attention
vector, softmax and bias start at random and are trained together by the gradient of the documents' loss.

Training takes the labelled rows whose crc32(doc_id) mod 3 is not 1, at most MAX_PER_CLASS of each class (those
of the smallest hash of the id, one text for each): this bound is the only sample, and every document is scored over its
whole text. The trained model is folded into two numbers for each table row, a broadcast of fixed size.

Defined cases: null, empty and wordless texts have no bag and get the softmax of the bias alone; null labels are
left out; repeated rows are scored one by one; a doc_id that is null is not held out and never trained on, one with several texts
trains on the least; without labels of both classes every score is 0; only doc_id and text of the documents are read, so
other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import runs, table

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
MAX_PER_CLASS = 2000
EPOCHS, RATE = 60, 0.05
THRESHOLD = 0.7
SEED = 7
#: Bytes of text, about, that are scored together, and words that are hashed together.
SLICE_BYTES, CHUNK = 4 << 20, 20_000
MARKS = " .,;:!?\"'()[]{}#*$%&|<>+=_~/\\-"


@dataclass(frozen=True)
class Model:
    """What each bucket adds to the toxic class over the other and to the attention; bias: the softmax's own difference."""

    logit: np.ndarray
    attention: np.ndarray
    bias: float


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of the texts, and (text, word) of each of them that a text has, in order."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    of = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    pairs = np.unique(of * max(1, len(words)) + coded.indices.to_numpy(zero_copy_only=False))
    text, word = np.divmod(pairs, max(1, len(words)))
    full = np.array([len(w) > 0 for w in words], dtype=bool)[word]  # white space at an end leaves an empty word
    return words, text[full], word[full]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of each word, one after another, and where each word starts."""
    bounded = [f"\x02{w.strip(MARKS) or w}\x03" for w in words]
    code = np.frombuffer("".join(bounded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in bounded], dtype=np.int64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = end[owner] - np.arange(len(code))  # characters from here to the word's end
    mixed = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    found, of = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            h = np.full(max(0, len(code) - n + 1), n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ mixed[k : k + len(h)]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            inside = left[: len(h)] >= n
            found.append((h[inside] % np.uint64(BUCKETS)).astype(np.int32))
            of.append(owner[: len(h)][inside])
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in bounded], dtype=np.int32)
    found.append(whole)
    of.append(np.arange(len(words)))
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return np.concatenate(found)[order], np.concatenate([[0], np.cumsum(np.bincount(of_all, minlength=len(words)))[:-1]])


def _means(rows: np.ndarray, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The mean of the rows (one for each bucket) over each bag."""
    if not len(starts):
        return np.zeros((0, *rows.shape[1:]), dtype=rows.dtype)
    return np.add.reduceat(rows[buckets], starts, axis=0) / np.diff(np.append(starts, len(buckets)))[:, None].astype(rows.dtype)


def _pooled(attention: np.ndarray, values: np.ndarray, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the words of each document, and the weighted averages of their values."""
    weight = np.exp(attention - np.maximum.reduceat(attention, first)[of])
    weight /= np.add.reduceat(weight, first)[of]
    return weight, np.add.reduceat(weight * values, first)


def _softmax(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(texts: list[str | None], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    y = np.array(toxic, dtype=np.float32)
    zero = np.zeros(BUCKETS, dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return Model(zero, zero, -1e9)
    words, text, flat = distinct_words(pa.array(texts, pa.string()))
    kept, of = np.unique(text, return_inverse=True)  # texts without words teach nothing
    y = y[kept]
    if not 0 < y.sum() < len(y):
        return Model(zero, zero, -1e9)
    first = np.searchsorted(of, np.arange(len(kept)))
    parts = [subwords(words[at : at + CHUNK]) for at in range(0, len(words), CHUNK)]
    buckets = np.concatenate([b for b, _ in parts])
    starts = np.concatenate([s + before for (_, s), before in zip(parts, np.cumsum([0, *(len(b) for b, _ in parts[:-1])]), strict=True)])
    del parts
    used, own = np.unique(buckets, return_inverse=True)
    sizes = np.diff(np.append(starts, len(own)))
    # the words that a bucket is in, bucket by bucket
    own = own.astype(np.int32)
    order = np.argsort(own, kind="stable").astype(np.int32)
    holders, at = np.repeat(np.arange(len(words), dtype=np.int32), sizes)[order], np.searchsorted(own[order], np.arange(len(used)))
    del order, buckets
    rng, single = np.random.default_rng(seed), np.float32
    rows, softmax, attention, bias = (rng.normal(0, 0.1, shape).astype(single) for shape in ((len(used), DIM), (DIM, 2), DIM, 2))
    bias[:] = 0
    balance = (np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)).astype(single)
    params, sides = (rows, softmax, attention, bias), np.array([-1, 1], dtype=single)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for epoch in range(1, epochs + 1):
        step = softmax[:, 1] - softmax[:, 0]
        seen = np.stack([step, attention])
        both = _means(rows @ seen.T, own, starts)
        value = both[flat, 0]
        weight, z = _pooled(both[flat, 1], value, first, of)
        error = (_softmax(z + bias[1] - bias[0]) - y) * balance
        part = error[of] * weight
        g_word = np.stack([np.bincount(flat, weights=g, minlength=len(words)) for g in (part, part * (value - z[of]))], axis=1) / sizes[:, None]
        g_bucket = np.add.reduceat(g_word.astype(single)[holders], at, axis=0)
        g_seen = rows.T @ g_bucket
        grads = (g_bucket @ seen, np.outer(g_seen[:, 0], sides) + 1e-6 * softmax, g_seen[:, 1], error.sum() * sides)
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)).astype(single)
    folded = np.zeros((2, BUCKETS), dtype=single)
    folded[:, used] = (rows @ np.stack([softmax[:, 1] - softmax[:, 0], attention]).T).T
    return Model(folded[0], folded[1], float(bias[1] - bias[0]))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    words, text, flat = distinct_words(texts)
    out = np.full(len(texts), float(_softmax(np.array(model.bias))))
    if not len(flat):
        return out
    rows = np.stack([model.logit, model.attention], axis=1).astype(float)
    both = np.concatenate([_means(rows, *subwords(words[at : at + CHUNK])) for at in range(0, len(words), CHUNK)])
    kept, of = np.unique(text, return_inverse=True)
    _, z = _pooled(both[flat, 1], both[flat, 0], np.searchsorted(of, np.arange(len(kept))), of)
    out[kept] = _softmax(z + model.bias)
    return out


def bucket3(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_PER_CLASS) -> Model:
    """The model of the labelled training rows, at most `bound` of each class. They are chosen from the labels alone, so the
    documents are only scanned against a list of that many ids. One task trains on them and gives the weights back; the driver
    holds neither the texts nor the training's arrays."""
    marked = labels.where(F.col("toxic").isNotNull() & F.coalesce(bucket3() != 1, F.lit(False)))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    chosen = [r for k in (1, 0) for r in marked.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(bound).collect()]
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def learn(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("doc_id")
        m = train(p["text"].tolist(), p["toxic"].tolist())
        return pd.DataFrame({"logit": [m.logit.tobytes()], "attention": [m.attention.tobytes()], "bias": [m.bias]})

    found = rows.groupBy(F.lit(0).alias("_all")).applyInPandas(learn, "logit binary, attention binary, bias double").first()
    if found is None:
        return train([], [])
    return Model(*(np.frombuffer(found[c], dtype=np.float32) for c in ("logit", "attention")), found["bias"])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column (0 to 1) of its text; a column of that name is replaced, the others are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = [scores(shared.value, texts.slice(s.start, s.stop - s.start)) for s in runs(texts, SLICE_BYTES)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return docs.withColumn(name, of(F.col("text").cast("string")))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(bucket3() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs."""
    model = fit(docs, labels)
    shown = "score" if "score" not in docs.columns else "_toxicity"
    return score(docs, model, shown).where(F.col(shown) < threshold).select(*docs.columns)
