"""Toxicity by a factorization machine over hashed terms (operator 4).

Terms are the words of the lower-cased text and byte n-grams of it with its
words set apart by one space (ASCII characters that are no letters count as
spaces), hashed into buckets; a document's features are the buckets it holds.
Training looks at a bounded, documented sample of labelled rows.  A bucket
becomes a feature if it tells the labels apart alone, or if it is one word of
a pair that does so together: the most frequent words are crossed with each
other, and pairs count whose label share differs from what the two words add
up to.  So words that say nothing alone, such as an insult or a group mention
whose meeting decides, are there for the machine.  It learns a weight per
feature and, through a short vector per feature, a weight for every pair of
features in one document.  Scoring is one Arrow map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revspark.llm.common import byte_batches, id_text, stored

#: Byte n-grams that count as terms.
GRAMS = (5, 7)
BUCKETS = 1 << 20
#: Buckets of whole words, after those of the n-grams.
WORD_BUCKETS = 1 << 18
ALL_BUCKETS = BUCKETS + WORD_BUCKETS
#: Labelled rows used for training, at most (those with the smallest hash of their id).
TRAIN_ROWS = 20_000
#: Features of the model that tell the labels apart alone, at most.
FEATURES = 3000
#: Most frequent words that are crossed, features taken from their pairs at most, and standard errors that a pair must differ by.
PAIR_WORDS = 1024
PAIR_FEATURES = 512
MIN_PAIR_Z = 7.0
#: A bucket needs this chi-square (one degree of freedom) and this many documents to become a feature.
MIN_CHI2 = 30.0
MIN_DOCS = 5
FACTORS = 8
#: Mini-batches of training, and documents in each.
STEPS = 1500
BATCH = 256
RATE = 0.01
DECAY = 1e-4

#: ASCII letters and all bytes of other characters stay; the rest is a space.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def term_buckets(text: str | None) -> np.ndarray:
    """Bucket of every n-gram of the text, in any order, with repeats."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split()
    data = b" " + b" ".join(words) + b" "
    b = np.frombuffer(data, np.uint8)
    out = []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h *= np.uint64(0x100000001B3)
            h ^= b[k:k + m]
        h *= np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    out.append(_word_buckets(b))
    return np.concatenate(out)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of each."""
    for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
        while len(_POWERS[k]) < n:
            done = _POWERS[k]
            _POWERS[k] = np.concatenate([done, done * np.uint64(pow(base, len(done), 1 << 64))])
    return _POWERS[0], _POWERS[1]


def _word_buckets(b: np.ndarray) -> np.ndarray:
    """Bucket of every word of bytes with one space before, between and after the words."""
    space = np.flatnonzero(b == 32)
    if len(space) < 2 or len(b) < 3:
        return np.empty(0, np.int32)
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], out=sums[1:])
    start, end = space[:-1] + 1, space[1:]
    h = (sums[end] - sums[start]) * down[start]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - WORD_BUCKETS.bit_length() + 1)).astype(np.int32) + np.int32(BUCKETS)


@dataclass
class Model:
    """buckets: the feature buckets, sorted; w, v: weight and factors of each; the last entry is the constant term."""

    buckets: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def slots(self) -> np.ndarray:
        table = np.full(ALL_BUCKETS, -1, np.int32)
        table[self.buckets] = np.arange(len(self.buckets))
        return table

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each feature list."""
        if not len(self.w):
            return np.zeros(len(features))
        idx, seg, starts = _flat(features, len(self.w) - 1)
        z, _ = _forward(self.w, self.v, idx, seg, starts)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _flat(features: list[np.ndarray], constant: int):
    """All lists one after the other, each with the constant feature at its end."""
    rows = [np.append(f, constant) for f in features]
    sizes = np.array([len(r) for r in rows])
    starts = np.cumsum(sizes) - sizes
    return np.concatenate(rows) if rows else np.empty(0, np.int64), np.repeat(np.arange(len(rows)), sizes), starts


def _forward(w, v, idx, seg, starts):
    if not len(starts):
        return np.zeros(0), np.zeros((0, v.shape[1]))
    vx = np.add.reduceat(v[idx], starts)
    pairs = 0.5 * (vx**2 - np.add.reduceat(v[idx] ** 2, starts)).sum(axis=1)
    return np.add.reduceat(w[idx], starts) + pairs, vx


def features_of(text: str | None, slots: np.ndarray) -> np.ndarray:
    """Sorted distinct features that the text holds."""
    at = slots[term_buckets(text)]
    return np.unique(at[at >= 0])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is never learned from: crc32 of the id's digits divisible by five; a null id counts as one."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(label, text) of the training sample: at most ``rows`` labelled documents that are not held out.

    Of an id with several labels the largest counts, and of one with several
    texts the greatest, so the bound holds for repeated ids; null labels and
    ids are no labels.  The sample's ids are broadcast: at most ``rows`` of them."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).dropna()
    ids = (named.groupBy("doc_id").agg(F.max("label").alias("label")).filter(~held_out())
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = id_text(docs).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text")).select("label", "text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a bucket, summed over the task."""
    n = np.zeros((2, ALL_BUCKETS), np.int32)
    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n[1 if label else 0][np.unique(term_buckets(text))] += 1
    for k in range(0, ALL_BUCKETS, 1 << 16):
        at = np.flatnonzero(n[:, k:k + (1 << 16)].any(axis=0)) + k
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[0, at].astype(np.int64)), pa.array(n[1, at].astype(np.int64))], names=["bucket", "neg", "pos"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """The model of a bounded sample of ``labels`` (doc_id, toxic) over ``docs``.

    Without any labelled row to learn from, the model scores everything 0."""
    byte_batches(docs.sparkSession)
    rows_df = stored(sample(docs, labels, rows), "toxic-train")
    n = {r["y"]: r["n"] for r in rows_df.groupBy((F.col("label") != 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model(np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    n1, n0 = float(n.get(True, 0)), float(n.get(False, 0))
    counts = stored(rows_df.mapInArrow(_count, "bucket int, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("a"), F.sum("pos").alias("b")), "toxic-counts")
    a, b, total = F.col("a"), F.col("b"), F.lit(n0 + n1)
    odds = b * (F.lit(n0) - a) - a * (F.lit(n1) - b)
    below = (a + b) * (total - a - b) * F.lit(n0) * F.lit(n1)
    chi2 = F.when(below > 0, odds * odds * total / below).otherwise(0.0)
    top = (counts.filter(a + b >= MIN_DOCS).withColumn("chi2", chi2).filter(F.col("chi2") >= MIN_CHI2)
           .orderBy(F.col("chi2").desc(), "bucket").limit(features).select("bucket").collect())
    words = (counts.filter((F.col("bucket") >= BUCKETS) & (a + b >= MIN_DOCS)).orderBy((a + b).desc(), "bucket").limit(PAIR_WORDS).select("bucket").collect())
    together = _pair_words(rows_df, np.sort(np.array([r[0] for r in words], np.int64)))
    buckets = np.union1d(np.array([r[0] for r in top], np.int64), together).astype(np.int64)
    empty = Model(buckets, np.zeros(len(buckets) + 1), np.zeros((len(buckets) + 1, FACTORS)))

    return fit(empty, *_sample_features(rows_df, buckets))


def _sample_features(rows_df: DataFrame, buckets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(features, label) of each row of the sample, on the driver.

    Bounded: TRAIN_ROWS rows of at most as many two-byte numbers as there are
    ``buckets``.  Sorted, so that their order does not depend on the partitioning."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.full(ALL_BUCKETS, -1, np.int32)
        slots[buckets] = np.arange(len(buckets))
        for b in batches:
            found = [features_of(t, slots).astype(np.int16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["label", "features"])

    table = rows_df.mapInArrow(extract, "label int, features binary").toArrow()
    found = sorted(zip(table.column("features").to_pylist(), table.column("label").to_pylist()))
    return [np.frombuffer(f, np.int16).astype(np.int64) for f, _ in found], np.array([label != 0 for _, label in found])


def _pair_words(rows_df: DataFrame, words: np.ndarray) -> np.ndarray:
    """Buckets of the words that tell the labels apart in pairs.

    For two words the documents fall into four cells (none, one, the other,
    both).  The words interact where the label's shares r of the cells do not
    add up: r(both) - r(one) - r(other) + r(none) is MIN_PAIR_Z standard errors
    or more from zero.  The strongest pairs give at most PAIR_FEATURES words."""
    if len(words) < 2:
        return np.empty(0, np.int64)
    x, y = _sample_features(rows_df, words)
    n, together, positive = len(words), np.zeros((len(words), len(words)), np.float32), np.zeros((len(words), len(words)), np.float32)
    for lo in range(0, len(x), 4096):
        block = np.zeros((min(4096, len(x) - lo), n), np.float32)
        for k, f in enumerate(x[lo:lo + 4096]):
            block[k, f] = 1
        together += block.T @ block
        block = block[y[lo:lo + 4096]]
        positive += block.T @ block
    docs, hits = np.diag(together).astype(np.float64), np.diag(positive).astype(np.float64)

    def cell(both, one, other, total) -> tuple:
        return both, one[:, None] - both, other[None, :] - both, total - one[:, None] - other[None, :] + both

    size = cell(together, docs, docs, float(len(x)))
    label = cell(positive, hits, hits, float(y.sum()))
    enough = np.min([c for c in size], axis=0) >= MIN_DOCS
    # Shares with half a document of either label added, so that no cell is certain.
    shares = [(k + 0.5) / (np.maximum(c, 0) + 1) for k, c in zip(label, size)]
    variance = sum(r * (1 - r) / (np.maximum(c, 0) + 1) for r, c in zip(shares, size))
    z = np.abs(shares[0] - shares[1] - shares[2] + shares[3]) / np.sqrt(variance)
    at = np.argwhere(np.triu(enough & (z >= MIN_PAIR_Z), 1))
    at = at[np.argsort(-z[at[:, 0], at[:, 1]], kind="stable")]
    seen: dict[int, None] = {}
    for i, j in at.tolist():
        if len(seen) + 2 > PAIR_FEATURES:
            break
        seen[i] = seen[j] = None
    return words[sorted(seen)]


def gradient(w, v, idx, seg, starts, y) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean log loss, by weight and by factor."""
    z, vx = _forward(w, v, idx, seg, starts)
    gs = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y))[seg]
    inner = vx[seg] - v[idx]
    return np.bincount(idx, gs, len(w)), np.stack([np.bincount(idx, gs * inner[:, f], len(w)) for f in range(v.shape[1])], axis=1)


def fit(start: Model, x: list[np.ndarray], y: np.ndarray) -> Model:
    """Minimises the log loss by Adam over mini-batches; fixed seed, so the same rows give the same model."""
    rng = np.random.default_rng(4)
    k, constant = len(start.w), len(start.w) - 1
    w, v = np.zeros(k), rng.normal(0, 0.01, (k, FACTORS))
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[constant] = np.log(share / (1 - share))
    v[constant] = 0
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    t = 0
    while t < STEPS:
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH)[:STEPS - t]:
            part = order[lo:lo + BATCH]
            gw, gv = gradient(w, v, *_flat([x[i] for i in part], constant), y[part])
            gw += DECAY * w
            gv += DECAY * v
            gw[constant] -= DECAY * w[constant]
            gv[constant] = 0
            t += 1
            for p, grad, m, s in ((w, gw, moments[0], moments[1]), (v, gv, moments[2], moments[3])):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad**2 - s)
                p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Model(start.buckets, w, v)


def scorer(model: Model):
    """Column function: text -> probability of label 1.  Null and empty texts have no terms and get the constant score."""
    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots = model.slots()
        for col in texts:
            yield pa.array(model.scores([features_of(t, slots) for t in col.to_pylist()]), pa.float64())
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row's whole text.

    Repeated rows give repeated results; only the two columns are read.  An
    empty table gives an empty result."""
    byte_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).select("doc_id", scorer(model)("text").alias("score"))


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5) of every row of ``docs``."""
    scored = score(docs, train(train_docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
