"""MinHash near-dedup: universal hash minima, banding, signature and set verification, stars.

1. Each document's set of word shingles is hashed; documents with one set are one class, so
   copies are never compared with each other.
2. `bands` x `rows` universal hash minima of the set are cut into bands. Classes that share a
   band meet in a bucket. A bucket proposes a link from each member to its least member only:
   the minimum is partially aggregated and the join back to the members can be split, so a
   bucket of any size is spread.
3. Proposed links are checked on the minima (their agreement estimates the similarity) and then
   confirmed on the full sets: each class is compared with the centre it shares most bands with.
   The confirmed links' components make most other proposals superfluous.
4. Buckets that still hold several components are taken up again: each member outside the
   bucket's largest component is compared with all members, in blocks dealt to different tasks,
   on the full sets. So no link between members of a bucket is missed because neither was its
   centre, and only links that join components leave a task.

With 24 bands of 6 minima two sets of similarity 0.85 share no band with a chance of 1.2e-5
(0.80 in the wider setting of 25 bands of 5 minima: 5e-5). Full sets hold 64-bit hashes of shingles: two
shingles of a compared pair of sets of 1,000 are taken for one with a chance of 5e-14, and classes
are told apart by 128 bits more.

Defined cases: null texts are empty; a text of fewer words than a shingle has one shingle, all
its words; one without words has an empty set and links with nothing, also not with its like;
repeated ids are one node whose links are those of all its rows; null ids link with nothing and
stay; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.common import batches, buffers, lean, pieces, saved
from tesserae.llm.components import components

_BLOCK = 256  # members of a bucket that are compared with each other in one go


@dataclass(frozen=True)
class Setting:
    shingle: int = 5
    percent: int = 80  # links have 100 * intersection >= percent * union
    bands: int = 25
    rows: int = 5
    slack: float = 0.2  # minima may agree by so much less than the threshold; beyond 4.5 sigma

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(5))
        return rng.integers(0, 2**31, self.hashes, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, self.hashes, np.uint32)


CONTRACT = Setting(shingle=3, percent=85, bands=24, rows=6)


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    word, first = words.hashes(raw, at, fold=True)
    grams = words.rolling(word, size)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            one = np.sort(grams[lo : hi - size + 1])
            keep = np.empty(len(one), bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        elif hi > lo:
            out.append(words.rolling(word[lo:hi], hi - lo, seed=hi - lo))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(one: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set."""
    x = (one >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(best, (a[:, None] * x[None, lo : lo + 2048] + b[:, None]).min(axis=1), out=best)
    return best


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("minima", pa.binary())])


def _sign(setting: Setting):
    def run(it):
        a, b = setting.coefficients()
        for batch in it:
            ids = batch.column("doc_id")
            raw, at = buffers(batch.column("text"))
            for lo, hi, part, offsets in pieces(raw, at):
                sets = shingle_sets(part, offsets, setting.shingle)
                digest = [(int(np.add.reduce(words.mix(s))), int(np.bitwise_xor.reduce(words.mix(s ^ np.uint64(0xA5A5)))) if len(s) else 0) for s in sets]
                both = np.array(digest, np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0].copy().view(np.int64)), pa.array(both[:, 1].copy().view(np.int64)), pa.array([minima(s, a, b).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                    schema=_SIGNED,
                )

    return run


def _bands(setting: Setting):
    schema = pa.schema([("band", pa.int32()), ("bucket", pa.int64()), ("node", pa.int64())])

    def run(it):
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            raw, _ = buffers(batch.column("minima"))
            rows = raw.view(np.uint32).reshape(n, setting.bands, setting.rows).astype(np.uint64)
            h = np.zeros((n, setting.bands), np.uint64)
            for k in range(setting.rows):
                h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
            nodes = np.asarray(batch.column("node"))
            yield from batches(schema, {"band": np.tile(np.arange(setting.bands, dtype=np.int32), n), "bucket": h.reshape(-1).view(np.int64), "node": np.repeat(nodes, setting.bands)})

    return run


def _agree(setting: Setting):
    """Pairs whose minima agree often enough."""
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("shared", pa.int64())])
    least = (setting.percent / 100 - setting.slack) * setting.hashes

    def run(it):
        for batch in it:
            if batch.num_rows:
                x, y = (buffers(batch.column(k))[0].view(np.uint32).reshape(batch.num_rows, -1) for k in ("x", "y"))
                good = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in ("a", "c", "shared")], schema=schema)

    return run


def _confirm(setting: Setting):
    """Pairs whose full sets are similar enough."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(it):
        last, kept = None, np.empty(0, np.uint64)
        for batch in it:
            if not batch.num_rows:
                continue
            a, c = np.asarray(batch.column("a")), np.asarray(batch.column("c"))
            raw, at = buffers(batch.column("x"))
            other, start = buffers(batch.column("y"))
            good = np.zeros(len(a), bool)
            for lo, hi, part, offsets in pieces(raw, at):
                for k, one in enumerate(shingle_sets(part, offsets, setting.shingle), lo):
                    if c[k] != last:  # pairs of one centre come together
                        text = other[start[k] : start[k + 1]]
                        last, kept = c[k], shingle_sets(text, np.array([0, len(text)]), setting.shingle)[0]
                    both = len(one) + len(kept) - len(np.union1d(one, kept))
                    good[k] = both > 0 and 100 * both >= setting.percent * (len(one) + len(kept) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(c[good])], schema=schema)

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, setting: Setting) -> DataFrame:
    x = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    y = x.join(texts.select(F.col("doc_id").alias("c"), F.col("text").alias("y")), "c")
    return y.select("a", "c", "x", "y").mapInArrow(lean(_confirm(setting)), "u long, v long")


def _across(setting: Setting):
    """Links that join components of one bucket: strays of one block against members of another.

    All sizes of intersections of two blocks come from products of their incidence matrices;
    only links that connect components not yet connected here leave the task."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        node, comp, stray = (np.asarray(t.column(k)) for k in ("node", "component", "stray"))
        raw, at = buffers(t.column("text"))
        sets = [s for _, _, part, offsets in pieces(raw, at) for s in shingle_sets(part, offsets, setting.shingle)]
        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
        size = np.array([len(s) for s in sets])
        both = common(sets, left, right)
        good = (both > 0) & (100 * both >= setting.percent * (size[left][:, None] + size[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :])
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        u, v = [], []
        for p, q in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
            r, s = root(int(comp[left[p]])), root(int(comp[right[q]]))
            if r != s:
                up[max(r, s)] = min(r, s)
                u.append(int(node[left[p]]))
                v.append(int(node[right[q]]))
        return pa.table({"u": u, "v": v}, schema=schema)

    return run


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, slab: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets in `left` with those in `right`."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(left) or not len(right):
        return out
    every = np.concatenate([sets[k] for k in (*left.tolist(), *right.tolist())])
    row = np.repeat(np.arange(len(left) + len(right)), [len(sets[k]) for k in (*left.tolist(), *right.tolist())])
    keys, column, n = np.unique(every, return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(shared.sum()), slab):
        part = slice(*np.searchsorted(column, [lo, lo + slab]))
        m = np.zeros((len(left) + len(right), slab), np.float32)
        m[row[part], column[part] - lo] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return out


def near_groups(docs: DataFrame, setting: Setting = CONTRACT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least id reachable by links), kept."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = saved(rows.mapInArrow(lean(_sign(setting)), "doc_id long, n_shingles long, set_hi long, set_lo long, minima binary"), "signed")
    # Classes of one set; the least id stands for a class.
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["set_hi", "set_lo", "n_shingles"]
    classes = filled.groupBy(*key).agg(F.min("doc_id").alias("node"))
    members = filled.join(classes, key)
    member = saved(members.select("doc_id", "node").distinct(), "classes")
    nodes = saved(members.where("doc_id = node").groupBy("node").agg(F.first("minima").alias("minima")), "nodes")
    banded = saved(nodes.mapInArrow(lean(_bands(setting)), "band int, bucket long, node long"), "bands")
    centres = banded.groupBy("band", "bucket").agg(F.min("node").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "bucket", "c")
    met = banded.join(centres, ["band", "bucket"]).where("node <> c").groupBy(F.col("node").alias("a"), "c").agg(F.count(F.lit(1)).alias("shared"))
    x = met.join(nodes.select(F.col("node").alias("a"), F.col("minima").alias("x")), "a")
    y = x.join(nodes.select(F.col("node").alias("c"), F.col("minima").alias("y")), "c")
    agreed = saved(y.select("a", "c", "shared", "x", "y").mapInArrow(lean(_agree(setting)), "a long, c long, shared long"), "agreed")
    # The copies of a node's text differ in nothing that counts, so any row of that id will do.
    texts = rows.where("doc_id IS NOT NULL")
    best = agreed.groupBy("a").agg(F.max_by("c", F.struct("shared", -F.col("c"))).alias("c"))
    first = saved(_confirmed(best, texts, setting), "links")
    label = components(first)

    # Buckets that still hold several components: the strays outside the largest against all.
    many = banded.join(centres, ["band", "bucket"]).select("band", "bucket", "node")
    many = many.join(label, "node", "left").select("band", "bucket", "node", F.coalesce("component", "node").alias("component"))
    held = many.groupBy("band", "bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    ask = held.groupBy("band", "bucket").agg(F.max_by("component", F.struct("n", "component")).alias("body"), F.sum("n").alias("m"), F.max("n").alias("top"), F.count(F.lit(1)).alias("parts"))
    ask = ask.where("parts > 1").select("band", "bucket", "body", F.ceil(F.col("m") / _BLOCK).cast("int").alias("blocks"), F.ceil((F.col("m") - F.col("top")) / _BLOCK).cast("int").alias("strays"))
    left = many.join(ask, ["band", "bucket"]).withColumn("h", F.xxhash64("node"))
    key = ["band", "bucket", "node", "component"]
    strays = left.where("component <> body").select(*key, F.pmod("h", "strays").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("stray"))
    others = left.select(*key, F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("i"), F.pmod("h", "blocks").cast("int").alias("j"), F.lit(False).alias("stray"))
    dealt = strays.unionByName(others).join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    second = dealt.select(*key, "i", "j", "stray", "text").groupBy("band", "bucket", "i", "j").applyInArrow(_across(setting), "u long, v long")
    final = components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).union(second))
    whole = member.join(final, "node", "left").select(F.col("doc_id").alias("d"), F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles").join(whole.groupBy("d").agg(F.min("component").alias("component")), F.col("doc_id") == F.col("d"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, setting: Setting | None = None) -> DataFrame:
    """The rows of `docs` whose id stands for its group, with all their columns."""
    gone = near_groups(docs, setting or Setting()).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def brute_force(texts: dict[int, str | None], setting: Setting) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, component), pair by pair: what `near_groups` is tested against."""
    import re

    fold = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[d] = {tuple(w[i : i + setting.shingle]) for i in range(len(w) - setting.shingle + 1)} if len(w) >= setting.shingle else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(d: int) -> int:
        while up[d] != d:
            d = up[d]
        return d

    order = sorted(sets)
    for i, p in enumerate(order):
        for q in order[:i]:
            both = len(sets[p] & sets[q])
            if both and 100 * both >= setting.percent * len(sets[p] | sets[q]):
                r, s = sorted((root(p), root(q)))
                up[s] = r
    return {d: (len(sets[d]), root(d)) for d in order}
