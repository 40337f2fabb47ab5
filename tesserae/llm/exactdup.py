"""Exact dedup: counting quotient filters over fingerprints, then byte verification.

Every partition builds a counting quotient filter of its texts' 64-bit fingerprints. The high
bits of a fingerprint, the quotient, name a slot; the low bits, the remainder, are kept sorted
inside the slot with a counter. Filters are cut into ranges of quotients and travel as slots' sizes,
remainders and counters, so that filters of many partitions merge range by range, losslessly, by
sorted remainders: a copied text is one entry with a counter in each partition, however many
copies there are. Fingerprints with a
count above one route their documents to byte verification, which groups by the whole
normalised text; all other documents are unique for certain.

Texts are equal when identical after lower-casing A-Z only. Defined cases: null texts are
empty; of equal texts the largest id stays, and rows that repeat that id all stay; null ids
count in groups and stay only where no row of the group has an id; an empty table gives no
row; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import blob, lean, ranges, saved

_ROWS = 500  # texts held as Python objects at a time
_MARK = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_sha256", pa.string())])
_PART = pa.schema([("part", pa.int32()), ("filter", pa.binary())])
_FOUND = pa.schema([("fp", pa.int64()), ("count", pa.int64())])
_TEXT = pa.schema([("fp", pa.int64()), ("doc_id", pa.int64()), ("norm", pa.binary())])


class CountingQuotientFilter:
    """A multiset of fingerprints of 64 bits, of which the `top` leading ones are the same for all.

    The next `bits` bits are the quotient, which names a slot; `sizes` has the number of entries of
    each slot. The rest, the remainder, is sorted inside its slot and has a counter."""

    def __init__(self, top: int, bits: int, sizes: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.top, self.bits, self.sizes, self.remainders, self.counts = top, bits, sizes, remainders, counts

    @classmethod
    def of(cls, prints: np.ndarray) -> CountingQuotientFilter:
        """Fingerprints in any order, each as often as it occurs."""
        keys, counts = np.unique(prints.astype(np.uint64), return_counts=True)
        bits = max(1, int(len(keys)).bit_length())
        return cls(0, bits, np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), keys & _low(64 - bits), counts.astype(np.int64))

    def __len__(self) -> int:
        return len(self.remainders)

    def quotients(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def prints(self, lead: int = 0) -> np.ndarray:
        """All distinct fingerprints, ascending, given the bits that all share: nothing is lost."""
        rest = 64 - self.top - self.bits
        shared = np.uint64(lead << (64 - self.top) if self.top else 0)
        return shared | (self.quotients().astype(np.uint64) << np.uint64(rest)) | self.remainders

    def widened(self, bits: int) -> CountingQuotientFilter:
        """The same with longer quotients: leading bits of remainders move over, and order stays."""
        more = bits - self.bits
        if more <= 0:
            return self
        rest = 64 - self.top - bits
        quotients = (self.quotients() << more) | (self.remainders >> np.uint64(rest)).astype(np.int64)
        return CountingQuotientFilter(self.top, bits, np.bincount(quotients, minlength=1 << bits), self.remainders & _low(rest), self.counts)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' entries, slot by slot: remainders of a slot are sorted in either filter, so
        each of one finds its place among the other's by passing the smaller ones. Nothing is
        sorted or hashed again, and slots hold about one entry, so the work is linear."""
        bits = max(self.bits, other.bits, int(len(self) + len(other)).bit_length())
        a, b = self.widened(bits), other.widened(bits)
        start = np.cumsum(b.sizes) - b.sizes
        slot = a.quotients()
        place = start[slot]  # of the first entry of `b` that isn't smaller
        counts, fresh = a.counts.copy(), np.ones(len(b), bool)
        end = place + b.sizes[slot]
        todo = np.flatnonzero(place < end)
        while len(todo):
            theirs, mine = b.remainders[place[todo]], a.remainders[todo]
            same = theirs == mine
            counts[todo[same]] += b.counts[place[todo[same]]]
            fresh[place[todo[same]]] = False
            todo = todo[theirs < mine]
            place[todo] += 1
            todo = todo[place[todo] < end[todo]]
        before = np.concatenate([[0], np.cumsum(fresh)])
        at = np.arange(len(a)) + before[place]
        size = len(a) + int(before[-1])
        new = np.ones(size, bool)
        new[at] = False
        remainders, out = np.empty(size, np.uint64), np.empty(size, np.int64)
        remainders[at], out[at] = a.remainders, counts
        remainders[new], out[new] = b.remainders[fresh], b.counts[fresh]
        added = np.bincount(b.quotients()[fresh], minlength=1 << bits)
        return CountingQuotientFilter(a.top, bits, a.sizes + added, remainders, out)

    def cut(self, lead: int):
        """(leading bits, filter) for each range of fingerprints with `lead` equal leading bits that has entries."""
        whole = self.widened(lead)
        per = 1 << (whole.bits - lead)
        ends = np.concatenate([[0], np.cumsum(whole.sizes)])
        for k in np.flatnonzero(np.diff(ends[::per])).tolist():
            lo, hi = ends[k * per], ends[(k + 1) * per]
            yield k, CountingQuotientFilter(self.top + lead, whole.bits - lead, whole.sizes[k * per : (k + 1) * per], whole.remainders[lo:hi], whole.counts[lo:hi])

    def pack(self) -> bytes:
        """Slots' sizes, remainders in as many bytes as they need, and counters."""
        wide = -(-(64 - self.top - self.bits) // 8)
        kept = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
        return blob(np.array([self.top, self.bits, len(self)], np.int64)) + blob(self.sizes.astype(np.uint32)) + blob(kept) + blob(self.counts.astype(np.uint32 if (self.counts < 2**32).all() else np.int64))

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        top, bits, n = np.frombuffer(data, np.int64, 3).tolist()
        at, wide = 24 + (4 << bits), -(-(64 - top - bits) // 8)
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at).reshape(n, wide)
        counts = np.frombuffer(data, np.uint32 if len(data) - at - n * wide == 4 * n else np.int64, n, at + n * wide)
        return cls(top, bits, np.frombuffer(data, np.uint32, 1 << bits, 24).astype(np.int64), remainders.reshape(-1).view("<u8"), counts.astype(np.int64))


def _low(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def merged(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """Pairwise, so that each entry is merged a logarithmic number of times."""
    while len(filters) > 1:
        filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + filters[len(filters) // 2 * 2 :]
    return filters[0]


def _norms(column: pa.Array) -> list[bytes]:
    # bytes.lower() changes A-Z alone
    return [(x or b"").lower() for x in column.cast(pa.binary()).to_pylist()]


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts))


def _mark(it):
    for b in it:
        for lo in range(0, b.num_rows, _ROWS):
            texts = _norms(b.column("text").slice(lo, _ROWS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, _ROWS), pa.array(_fingerprints(texts).view(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], schema=_MARK)


def _filters(lead: int):
    def build(it):
        filters: list[CountingQuotientFilter] = []
        for b in it:
            filters.append(CountingQuotientFilter.of(np.asarray(b.column("fp")).view(np.uint64)))
            while len(filters) > 1 and len(filters[-2]) <= 2 * len(filters[-1]):
                filters.append(filters.pop().merge(filters.pop()))
        if filters:
            found = list(merged(filters).cut(lead))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([f.pack() for _, f in found], pa.binary())], schema=_PART)

    return build


def _merge(t: pa.Table) -> pa.Table:
    whole = merged([CountingQuotientFilter.unpack(x) for x in t.column("filter").to_pylist()])
    more = whole.counts > 1
    return pa.table({"fp": pa.array(whole.prints(t.column("part")[0].as_py())[more].view(np.int64)), "count": pa.array(whole.counts[more])}, schema=_FOUND)


def _texts(it):
    for b in it:
        for lo in range(0, b.num_rows, _ROWS):
            texts = _norms(b.column("text").slice(lo, _ROWS))
            yield pa.RecordBatch.from_arrays([pa.array(_fingerprints(texts).view(np.int64)), b.column("doc_id").slice(lo, _ROWS), pa.array(texts, pa.binary())], schema=_TEXT)


def repeated_fingerprints(marked: DataFrame, parts: int) -> DataFrame:
    """(fp, count) of the fingerprints that occur more than once; filters are cut into `parts`
    ranges, or up to twice as many, and each range is merged in a task of its own."""
    lead = max(parts - 1, 1).bit_length()
    filters = marked.select("fp").mapInArrow(lean(_filters(lead)), "part int, filter binary").repartitionById(1 << lead, "part")
    return filters.groupBy("part").applyInArrow(_merge, "fp long, count long")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = saved(rows.mapInArrow(lean(_mark), "doc_id long, fp long, text_sha256 string"), "prints")
    repeated = repeated_fingerprints(marked, ranges(rows))
    suspects = marked.join(repeated.select("fp"), "fp", "left_semi").select("doc_id").distinct()
    suspect_rows = rows.join(suspects, rows["doc_id"].eqNullSafe(suspects["doc_id"]), "left_semi")
    verified = (
        suspect_rows.mapInArrow(lean(_texts), "fp long, doc_id long, norm binary")
        .groupBy("fp", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return marked.join(verified, ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `exact_groups` keeps, with all their columns."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept_id"]), "left_semi")


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
