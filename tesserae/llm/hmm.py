"""Language-model scoring with a hidden Markov model over word classes.

A token's class is a hash of the word; the number of classes grows with the root of the counted
vocabulary, and the end of a text is a class of its own. Latent states follow each other and emit
classes; a class emits its words in proportion to their smoothed counts in the training corpus.
With the base model's probability p(w) = (c + 0.1) / (N + 0.1 (V + 1)) and p(class) the sum of p
over the class's known words and one unknown one, the probability of a text is

    P(text) = P_hmm(classes) * product over tokens of p(w) / p(class of w).

Counting. Every task reduces its texts to a vocabulary with training counts and a sparse matrix
of texts and words. Vocabularies are dealt out by ranges of word hashes, one range a task, and
summed there; the sums return to the batch they came from, and each batch scores its matrix. A
word as frequent as "the" costs a record a batch, and no table of all words is collected or
broadcast.

Training. Training texts are written once as sequences of classes. Baum-Welch starts from a random
model, which breaks the symmetry of the states. Every round runs the scaled forward and backward
recursions over every training text from its first token to its end, however long; a task's
expected counts, of a size set by states and classes, and its log likelihood are summed in two
levels. Rounds go on until the likelihood settles, `rounds` times at most. Scoring runs the scaled
forward recursion over whole texts in double precision, so the likelihood is exact.

Defined cases: null and empty texts have the end token alone; texts with null ids are scored and
count as held out; repeated rows count and are scored each; without training texts every token
is unknown and states say nothing; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.common import buffers, forget, lean, pieces, ranges, saved

_FLUSH = 1_500_000  # words of a batch
_ROOM = 1 << 18  # tokens whose forward probabilities are held at a time: few enough for a cache
_BATCH = 1 << 22  # tokens of texts that go forward together: the more, the fewer steps a token
_LONG = 2_048  # tokens of a text that trains among the long ones
_SHARDS = 64  # groups that tasks' counts are summed in before they meet


_FINE = 18  # bits of the finest classes that words are counted by


@dataclass(frozen=True)
class Shape:
    states: int = 8
    rounds: int = 8  # over all training texts, at most
    settled: float = 1e-4  # the gain of log10 likelihood a token under which rounds end
    prior: float = 20.0  # tokens' worth of the base classes in each state's emissions
    spread: float = 16.0  # classes for each unit of the vocabulary's square root

    def bits(self, types: int) -> int:
        """Classes are a power of two near `spread` times the root of the number of distinct words."""
        return min(max(round(math.log2(self.spread * math.sqrt(types + 1))), 4), _FINE)


def held_out(ids: list[int | None], modulus: int = 10) -> np.ndarray:
    return np.fromiter((d is None or zlib.crc32(str(d).encode()) % modulus == 0 for d in ids), bool, len(ids))


# ---- counts of words -------------------------------------------------------------------------

_COUNTED = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("sig", pa.binary()), ("valid", pa.binary()), ("starts", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("times", pa.binary()), ("ends", pa.int64())])
_COUNTED_DDL = "batch long, part int, words binary, counts binary, docs binary, sig binary, valid binary, starts binary, low binary, high binary, times binary, ends long"


def _count(parts: int):
    def flush(batch: int, hashes: list, rows: list, ids: list, sigs: list, learn: list):
        h, n = np.concatenate([np.empty(0, np.uint64), *hashes]), np.concatenate(rows)
        vocabulary, index = np.unique(h, return_inverse=True)
        train = np.concatenate(learn)
        row = np.repeat(np.arange(len(n)), n)
        counts = np.bincount(index[train[row]], minlength=len(vocabulary)).astype(np.uint32)
        cells, times = np.unique(row * max(len(vocabulary), 1) + index, return_counts=True)
        row, word = np.divmod(cells, max(len(vocabulary), 1))
        starts = np.searchsorted(row, np.arange(len(n) + 1))
        step = np.diff(word, prepend=0)
        step[starts[:-1][starts[:-1] < len(step)]] = word[starts[:-1][starts[:-1] < len(step)]]
        known = np.array([d is not None for d in ids], np.uint8)
        out = [(batch, -1, None, None, np.array([d or 0 for d in ids], np.int64).tobytes(), np.concatenate(sigs).tobytes(), known.tobytes(), starts.astype(np.int64).tobytes(), (step & 0xFFFF).astype(np.uint16).tobytes(), (step >> 16).astype(np.uint16).tobytes(), times.astype(np.uint32).tobytes(), int(train.sum()))]
        part = (((vocabulary >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        at = np.searchsorted(part, np.arange(parts + 1))
        out += [(batch, k, vocabulary[at[k] : at[k + 1]].tobytes(), counts[at[k] : at[k + 1]].tobytes(), *[None] * 7, 0) for k in range(parts)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _COUNTED, strict=True)], schema=_COUNTED)

    def run(it):
        batch = TaskContext.get().partitionId() << 24
        gathered: list[list] = [[] for _ in range(5)]
        total = 0
        for b in it:
            raw, at = buffers(b.column("text"))
            all_ids = b.column("doc_id").to_pylist()
            for lo, hi, part, offsets in pieces(raw, at):
                word, first = words.hashes(part, offsets, fold=True)
                ids = all_ids[lo:hi]
                for box, x in zip(gathered, (word, np.diff(first), ids, signature(word, first), ~held_out(ids)), strict=True):
                    box.extend(x) if x is ids else box.append(x)
                total += len(word) + len(ids)
                if total >= _FLUSH:
                    yield flush(batch, *gathered)
                    batch, total, gathered = batch + 1, 0, [[] for _ in range(5)]
        if total:
            yield flush(batch, *gathered)

    return run


def signature(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each row's words, to tell rows of one id apart."""
    return words.between(words.prefix(word, 4), first[:-1], first[1:]) ^ np.diff(first).astype(np.uint64)


_SUMMED = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("classes", pa.binary()), ("sums", pa.binary()), ("types", pa.binary())])


def _sum(class_bits: int):
    """Counts of a range's words over all batches, back to each batch, and sums by fine classes."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        own = [np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()]
        counts = [np.frombuffer(x, np.uint32) for x in t.column("counts").to_pylist()]
        vocabulary, index = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(index, weights=np.concatenate(counts), minlength=len(vocabulary)).astype(np.int64)
        at = np.cumsum([0, *(len(x) for x in own)])
        known = total > 0
        cls = (vocabulary[known] >> np.uint64(64 - class_bits)).astype(np.int64)
        classes, where = np.unique(cls, return_inverse=True)
        sums = np.bincount(where, weights=total[known], minlength=len(classes)).astype(np.int64)
        types = np.bincount(where, minlength=len(classes)).astype(np.int64)
        rows = [(b, part, total[index[at[k] : at[k + 1]]].tobytes(), None, None, None) for k, b in enumerate(t.column("batch").to_pylist())]
        rows.append((-1, part, None, classes.tobytes(), sums.tobytes(), types.tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUMMED, strict=True)], schema=_SUMMED)

    return run


_BASE = pa.schema([("doc_id", pa.int64()), ("sig", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64())])


def _base(tokens: int, types: int, ends: int):
    norm = np.log10(tokens + 0.1 * (types + 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.sort_by("part")
        total = np.frombuffer(b"".join(right.column("counts").to_pylist()), np.int64)
        value = np.log10(total + 0.1) - norm
        for r in left.to_pylist():
            starts = np.frombuffer(r["starts"], np.int64)
            step = np.frombuffer(r["low"], np.uint16).astype(np.int64) | np.frombuffer(r["high"], np.uint16).astype(np.int64) << 16
            times = np.frombuffer(r["times"], np.uint32).astype(np.int64)
            # A text's words as numbers: the sum of its steps so far.
            whole = np.cumsum(step)
            before = np.concatenate([[0], whole])[starts[:-1]]
            word = whole - np.repeat(before, np.diff(starts))

            def by_text(x: np.ndarray) -> np.ndarray:
                run = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
                return run[starts[1:]] - run[starts[:-1]]

            score = np.add.reduceat(np.append(times * value[word], 0.0), starts[:-1]) if len(starts) > 1 else np.empty(0)
            score = np.where(np.diff(starts) > 0, score, 0.0) + np.log10(ends + 0.1) - norm
            ids = pa.array(np.frombuffer(r["docs"], np.int64), mask=np.frombuffer(r["valid"], np.uint8) == 0)
            out.append(pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(r["sig"], np.int64)), pa.array(by_text(times) + 1), pa.array(by_text(times * (total[word] > 0)) + int(ends > 0)), pa.array(score)], schema=_BASE))
        return pa.Table.from_batches(out, schema=_BASE)

    return run


# ---- the model -------------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # classes + 1 x states
    base: np.ndarray  # p(class), classes + 1

    @classmethod
    def guess(cls, base: np.ndarray, states: int) -> Model:
        rng = np.random.Generator(np.random.PCG64(10))
        share = base / base.sum()
        emit = share[:, None] * rng.uniform(0.2, 1.8, (len(base), states))
        step = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), step, emit / emit.sum(axis=0), base)

    def fitted(self, counts: np.ndarray, prior: float) -> Model:
        """Maximum a posteriori parameters of expected counts (start, steps, emissions in one array)."""
        k = len(self.start)
        start, step, emit = counts[:k] + 1, counts[k : k + k * k].reshape(k, k) + 1, counts[k + k * k :].reshape(-1, k)
        emit = emit + prior * (self.base / self.base.sum())[:, None]
        return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), self.base)


def _sequences(raw: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens, each text's end included, the texts' offsets and their signatures."""
    word, first = words.hashes(raw, at, fold=True)
    cls = (word >> np.uint64(64 - bits)).astype(np.int64)
    n = len(first) - 1
    out = np.full(len(cls) + n, 1 << bits, np.int64)
    offsets = first + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = cls
    return out, offsets, signature(word, first)


def _ragged(starts: np.ndarray, lengths: np.ndarray):
    """Time-major order of sequences, longest first: for each step the tokens' places."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    return order, starts, active


def forward(model: Model, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion."""
    lengths = np.diff(offsets)
    order, starts, active = _ragged(offsets[:-1], lengths)
    total = np.zeros(len(lengths))
    alpha = np.repeat(model.start[None, :], len(lengths), axis=0)
    for t, n in enumerate(active.tolist()):
        alpha = alpha[:n] if t == 0 else alpha[:n] @ model.step
        alpha = alpha * model.emit[tokens[starts[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def expected(model: Model, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Expected counts of starts, steps and emissions: the E step of Baum-Welch."""
    return estep(model, tokens, offsets)[0]


def estep(model: Model, tokens: np.ndarray, offsets: np.ndarray, room: int = _ROOM) -> tuple[np.ndarray, float]:
    """Expected counts over whole sequences, and their log10 likelihood.

    All sequences go forward and backward a step at a time, longest first, in single precision. What
    the backward recursion needs of the forward one is kept for `room` tokens at a time and worked
    out again from the state before them, so memory doesn't grow with the sequences' lengths."""
    k = len(model.start)
    counts = np.zeros(k + k * k + model.emit.size)
    lengths = np.diff(offsets)
    if not len(lengths):
        return counts, 0.0
    order, _, active = _ragged(offsets[:-1], lengths)
    small = np.int32 if len(tokens) < 2**31 else np.int64
    at = np.concatenate([[0], np.cumsum(active)]).astype(small)
    place = np.empty(len(lengths), small)
    place[order] = np.arange(len(lengths), dtype=small)
    major = np.empty(len(tokens), tokens.dtype)  # step by step
    where = np.arange(len(tokens), dtype=small)
    where -= np.repeat(offsets[:-1].astype(small), lengths)
    where = at[where]
    where += np.repeat(place, lengths)
    major[where] = tokens
    del where
    # A row a state: sums and products of all sequences run over contiguous numbers.
    emit, step, ones = (np.ascontiguousarray(x, np.float32) for x in (model.emit.T, model.step, np.ones(k)))
    forth, start = np.ascontiguousarray(step.T), model.start.astype(np.float32)[:, None]

    def ahead(lo: int, hi: int, before: np.ndarray):
        """Emissions, scaled forward probabilities and scales of the steps from `lo` to `hi`."""
        base = at[lo]
        e = emit.take(major[base : at[hi]], axis=1)
        alpha, scale = np.empty_like(e), np.empty(e.shape[1], np.float32)
        cuts = (at[lo : hi + 1] - base).tolist()
        for t, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), lo):
            now = forth @ before[:, : j - i] if t else np.repeat(start, j - i, axis=1)
            now *= e[:, i:j]
            total = ones @ now
            now /= total
            scale[i:j], alpha[:, i:j] = total, now
            before = now
        return e, alpha, scale

    bounds, befores = [0], [np.empty((k, 0), np.float32)]
    while bounds[-1] < len(active):
        lo = bounds[-1]
        hi = max(int(np.searchsorted(at, at[lo] + room, side="right")) - 1, lo + 1)
        bounds.append(min(hi, len(active)))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        held = ahead(lo, hi, befores[-1])
        befores.append(held[1][:, at[hi - 1] - at[lo] :].copy())
    steps, beta, likelihood = np.zeros((k, k)), np.ones((k, active[0]), np.float32), 0.0
    emitted = counts[k + k * k :].reshape(-1, k)
    for s in range(len(bounds) - 2, -1, -1):
        lo, hi = bounds[s], bounds[s + 1]
        if held is None:
            held = ahead(lo, hi, befores[s])
        e, alpha, scale = held
        held = None
        base = at[lo]
        cuts = (at[lo : hi + 1] - base).tolist()
        for t in range(hi - 1, lo - 1, -1):
            i, j = cuts[t - lo], cuts[t - lo + 1]
            b = beta[:, : j - i]
            push = e[:, i:j] * b
            push /= scale[i:j]
            alpha[:, i:j] *= b  # now the probability of each state
            if t:
                before = alpha[:, cuts[t - lo - 1] :][:, : j - i] if t > lo else befores[s][:, : j - i]
                steps += before @ push.T
                np.matmul(step, push, out=b)
        if not lo:
            counts[:k] = alpha[:, : active[0]].sum(axis=1, dtype=np.float64)
        own = major[base : at[hi]]
        for state in range(k):
            emitted[:, state] += np.bincount(own, weights=alpha[state], minlength=emit.shape[1])
        likelihood += float(np.log10(scale).sum(dtype=np.float64))
    counts[k : k + k * k] = (steps * model.step).reshape(-1)
    return counts, likelihood


_SEQUENCES = pa.schema([("tokens", pa.binary()), ("lengths", pa.binary())])


def _encode(bits: int):
    """Texts as sequences of classes, packed in rows of many: long ones apart, so that few rows
    take the many steps that a long text takes."""
    kind = np.uint16 if bits < 16 else np.uint32

    def packed(box: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tokens, lengths = (np.concatenate(x) for x in zip(*box, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([tokens.tobytes()], pa.binary()), pa.array([lengths.astype(np.int32).tobytes()], pa.binary())], schema=_SEQUENCES)

    def run(it):
        boxes, held = ([], []), [0, 0]
        for b in it:
            raw, at = buffers(b.column("text"))
            for _, _, part, offsets in pieces(raw, at):
                tokens, bounds, _ = _sequences(part, offsets, bits)
                lengths = np.diff(bounds)
                for n, mine in enumerate((lengths <= _LONG, lengths > _LONG)):
                    if mine.any():
                        boxes[n].append((tokens[np.repeat(mine, lengths)].astype(kind), lengths[mine]))
                        held[n] += int(lengths[mine].sum())
                        if held[n] >= _BATCH:
                            yield packed(boxes[n])
                            boxes[n].clear()
                            held[n] = 0
        for box in boxes:
            if box:
                yield packed(box)

    return run


def _expect(model, bits: int, parts: int):
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary())])
    kind = np.uint16 if bits < 16 else np.uint32

    def run(it):
        total = None
        for b in it:
            for tokens, lengths in zip(b.column("tokens"), b.column("lengths"), strict=True):
                tokens, lengths = np.frombuffer(tokens.as_buffer(), kind), np.frombuffer(lengths.as_buffer(), np.int32)
                own = np.append(*estep(model.value, tokens, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])))
                total = own if total is None else total + own
        if total is not None:
            shard = TaskContext.get().partitionId() % _SHARDS
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([shard] * parts, pa.int32()), pa.array([x.tobytes() for x in np.array_split(total, parts)], pa.binary())], schema=schema)

    return run


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(len(t.column("counts")[0].as_buffer()) // 8)
    for x in t.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.float64)
    return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "counts": [total.tobytes()]})


def train(docs: DataFrame, base: np.ndarray, shape: Shape, bits: int) -> Model:
    """Baum-Welch on all rows of `docs` (text), whole, with 2**`bits` classes and the end."""
    spark = docs.sparkSession
    sequences = saved(docs.select("text").mapInArrow(lean(_encode(bits)), "tokens binary, lengths binary"), "sequences")
    model = Model.guess(base, shape.states)
    k = shape.states
    parts, before = min(32, max(1, len(base) >> 9)), -np.inf
    for _ in range(shape.rounds):
        sent = spark.sparkContext.broadcast(model)
        told = sequences.mapInArrow(lean(_expect(sent, bits, parts)), "part int, shard int, counts binary")
        # In two levels: however many tasks there are, no group gathers the counts of all of them.
        told = told.groupBy("part", "shard").applyInArrow(_add, "part int, counts binary")
        rows = told.groupBy("part").applyInArrow(_add, "part int, counts binary").collect()
        sent.unpersist()
        if not rows:
            break
        counts = np.concatenate([np.frombuffer(r["counts"], np.float64) for r in sorted(rows, key=lambda r: r["part"])])
        counts, likelihood = counts[:-1], counts[-1] / max(counts[k + k * k : -1].sum(), 1.0)
        model = model.fitted(counts, shape.prior)
        if likelihood - before < shape.settled:
            break
        before = likelihood
    forget(sequences)
    return model


def _likelihood(model, bits: int):
    schema = pa.schema([("_id", pa.int64()), ("_sig", pa.int64()), ("gain", pa.float64())])

    def scored(m: Model, lost: np.ndarray, texts: list) -> pa.RecordBatch:
        ids, sigs, tokens, lengths = zip(*texts, strict=True)
        tokens, bounds = np.concatenate(tokens), np.cumsum(np.concatenate([[0], *lengths]))
        gain = forward(m, tokens, bounds) - np.add.reduceat(lost[tokens], bounds[:-1])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.concatenate(sigs).view(np.int64)), pa.array(gain)], schema=schema)

    def run(it):
        m = model.value
        lost = np.log10(m.base)
        texts, gathered = [], 0
        for b in it:
            raw, at = buffers(b.column("text"))
            for lo, hi, part, offsets in pieces(raw, at):
                tokens, bounds, sig = _sequences(part, offsets, bits)
                texts.append((b.column("doc_id").slice(lo, hi - lo), sig, tokens.astype(np.int32), np.diff(bounds)))
                gathered += len(tokens)
                if gathered >= 1_000_000:  # many texts at a time make the recursion's steps worth while
                    yield scored(m, lost, texts)
                    texts, gathered = [], 0
        if texts:
            yield scored(m, lost, texts)

    return run


def score(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out_of = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(True))
    parts = ranges(rows)
    counted = saved(rows.mapInArrow(lean(_count(parts)), _COUNTED_DDL), "vocabularies")
    # One range a task: the largest task holds one range of words, however many there are.
    summed = counted.where("part >= 0").select("batch", "part", "words", "counts").repartitionById(parts, "part").groupBy("part")
    summed = saved(summed.applyInArrow(_sum(_FINE), "batch long, part int, counts binary, classes binary, sums binary, types binary"), "counts")
    ends = counted.where("part < 0").agg(F.sum("ends")).first()[0] or 0
    known, distinct = np.zeros(1 << _FINE), np.zeros(1 << _FINE)
    for r in summed.where("batch < 0").select("classes", "sums", "types").collect():  # a number a fine class, whatever the words
        np.add.at(known, np.frombuffer(r["classes"], np.int64), np.frombuffer(r["sums"], np.int64))
        np.add.at(distinct, np.frombuffer(r["classes"], np.int64), np.frombuffer(r["types"], np.int64))
    tokens, types = int(known.sum()) + ends, int(distinct.sum()) + (ends > 0)
    bits = shape.bits(types)
    norm = tokens + 0.1 * (types + 1)
    p = np.append((known + 0.1 * distinct).reshape(1 << bits, -1).sum(axis=1) + 0.1, ends + 0.1) / norm
    matrix = counted.where("part < 0").select("batch", "docs", "sig", "valid", "starts", "low", "high", "times")
    returned = summed.where("batch >= 0").select("batch", "part", "counts")
    base = matrix.groupBy("batch").cogroup(returned.groupBy("batch")).applyInArrow(_base(tokens, types, ends), "doc_id long, sig long, n_tokens long, n_known long, base_score double")
    model = train(rows.where(~out_of), p, shape, bits)
    sent = spark.sparkContext.broadcast(model)
    gains = rows.mapInArrow(lean(_likelihood(sent, bits)), "_id long, _sig long, gain double").dropDuplicates(["_id", "_sig"])
    out = base.join(gains, base["doc_id"].eqNullSafe(gains["_id"]) & (base["sig"] == gains["_sig"]))
    return out.select("doc_id", out_of.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))
