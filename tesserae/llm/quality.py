"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

A text's features are its words, pairs of neighbouring words, their shapes (each run of letters
of one case, of digits, or of one other character counts once) and pairs of shapes, and whether
a word repeats the one before; all are hashed to `buckets` weights. A feature's value is its
share of the text's features of its kind, so long and short texts weigh alike. Training takes
the labelled rows of smallest hash, at most `sample` of them (a fixed, documented bound), in the
order of that hash, and runs FTRL-proximal updates over them in one task. The weights, `buckets`
single-precision numbers whatever the corpus, are broadcast; a score is a sparse dot product.

Defined cases: null and empty texts have the intercept alone and so one common score; with no
usable label the score is 0.5; repeated labels of a document count each; labels that are null or
neither 0 nor 1 don't count; null ids are scored and never trained on; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.common import buffers, lean, least_hashed, pieces

_SALT = tuple(np.uint64(x) for x in (0x51ED270B, 0x2545F491, 0x3C6EF372, 0x1B873593))
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_SCALE = 4.0
_PIECE = 1 << 20  # bytes of text looked at in one go


@dataclass(frozen=True)
class Training:
    buckets: int = 1 << 18
    sample: int = 4_000  # labelled rows to learn from, at most
    passes: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.2


def features(raw: np.ndarray, at: np.ndarray, buckets: int):
    """The number of words before each row, then feature numbers of all words, kind by kind."""
    word, first = words.hashes(raw, at, fold=False)
    yield first
    if not len(word):
        return
    kind = _CLASS[raw]
    start, end, _ = words.spans(raw, at)
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[start] = True
    kept = np.cumsum(new)
    shape = words.mix(words._sums(kind[new], kept[start] - 1, kept[end - 1], words._BYTE))
    del kind, new, kept
    inner = np.ones(len(word), bool)
    inner[first[:-1][np.diff(first) > 0]] = False  # has a word before it in its row

    def number(h: np.ndarray) -> np.ndarray:
        return (words.mix(h) % np.uint64(buckets)).astype(np.int32)

    def with_before(h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), 7, np.uint64)
        out[1:] = words.mix(h[:-1] * np.uint64(3) + h[1:])
        out[~inner] = 7
        return out

    yield number(word ^ _SALT[0])
    yield number(with_before(word) ^ _SALT[1])
    yield number(shape ^ _SALT[2])
    yield number(with_before(shape) ^ _SALT[3])
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    yield number(np.where(again & inner, np.uint64(11), np.uint64(13)))


def _example(buckets: int):
    schema = pa.schema([("all", pa.int32()), ("rank", pa.int64()), ("y", pa.int32()), ("index", pa.binary()), ("value", pa.binary())])

    def run(it):
        for b in it:
            raw, at = buffers(b.column("text"))
            for lo, hi, part, offsets in pieces(raw, at, _PIECE):
                first, *kinds = features(part, offsets, buckets)
                every = np.stack(kinds, axis=1) if kinds else np.empty((0, 1), np.int32)
                index, value = [], []
                for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    keys, times = np.unique(every[p:q], return_counts=True)
                    index.append(keys.astype(np.int32).tobytes())
                    value.append((times * (_SCALE / max(q - p, 1))).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([0] * (hi - lo), pa.int32()), b.column("rank").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo).cast(pa.int32()), pa.array(index, pa.binary()), pa.array(value, pa.binary())], schema=schema)

    return run


class Ftrl:
    """FTRL-proximal logistic regression; the intercept, at the end, has no penalty."""

    def __init__(self, t: Training):
        self.t = t
        self.z, self.n = np.zeros(t.buckets + 1), np.zeros(t.buckets + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n, t = self.z[i], self.n[i], self.t
        free = i == t.buckets
        l1, l2 = np.where(free, 0, t.l1), np.where(free, 0, t.l2)
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((t.beta + np.sqrt(n)) / t.alpha + l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.t.alpha * w
        self.n[i] += g * g


def _train(t: Training):
    schema = pa.schema([("weights", pa.binary())])

    def run(examples: pa.Table) -> pa.Table:
        model = Ftrl(t)
        rank, label = np.asarray(examples.column("rank")), np.asarray(examples.column("y"))
        order = np.lexsort((label, rank)).tolist()
        (index, at), (value, _) = buffers(examples.column("index")), buffers(examples.column("value"))
        for _ in range(t.passes):
            for k in order:
                own = slice(at[k], at[k + 1])
                model.learn(np.append(index[own].view(np.int32), t.buckets), np.append(value[own].view(np.float32), 1.0), int(label[k]))
        return pa.table({"weights": [model.weights(np.arange(t.buckets + 1)).astype(np.float32).tobytes()]}, schema=schema)

    return run


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> np.ndarray:
    """Weights learnt from `docs` (doc_id, text) by `labels` (doc_id, y); the last one is the intercept."""
    usable = labels.where("y IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "y")
    # A fixed pseudo-random order of ids: the sample is the same however rows are dealt out.
    ranked = usable.withColumn("rank", F.xxhash64("doc_id"))
    chosen = least_hashed(ranked, "rank", training.sample, usable.count()).orderBy("rank", "doc_id", "y").limit(training.sample)
    # The sample's bound makes it fit to broadcast, so no text is shuffled to meet it.
    examples = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("rank", "y", "text").mapInArrow(lean(_example(training.buckets)), "all int, rank long, y int, index binary, value binary")
    found = examples.groupBy("all").applyInArrow(_train(training), "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros(training.buckets + 1, np.float32)


def _score(model, buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(it):
        w = model.value.astype(np.float64)
        for b in it:
            raw, at = buffers(b.column("text"))
            for lo, hi, part, offsets in pieces(raw, at, _PIECE):
                kinds = features(part, offsets, buckets)
                first = next(kinds)
                total = np.zeros(int(first[-1]) + 1)
                for index in kinds:
                    total[1:] += w[index]
                total = np.cumsum(total)
                margin = (total[first[1:]] - total[first[:-1]]) * (_SCALE / np.maximum(np.diff(first), 1)) + w[-1]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], schema=schema)

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score, the likelihood of label 1, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_score(sent, len(weights) - 1)), "doc_id long, score double")


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, by a modulus."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def quality(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. Labels are learnt from the rows not held out."""
    learn = labels.where(remainder("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("y"))
    out = score(docs, train(docs, learn, training))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _good(model, buckets: int, threshold: float):
    def run(it):
        for b, scores in ((b, np.concatenate([np.empty(0), *(np.asarray(x.column("score")) for x in _score(model, buckets)([b]))])) for b in it):
            yield b.filter(pa.array(scores >= threshold, pa.bool_()))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with all their columns, in one pass."""
    learn = labels.where(remainder("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("y"))
    weights = train(docs, learn)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.mapInArrow(lean(_good(sent, len(weights) - 1, threshold)), docs.schema)
