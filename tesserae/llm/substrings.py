"""Substring dedup: words covered by a window of words that also starts earlier are removed.

A window is `size` consecutive words of one document; it repeats if the same words start
earlier, in a document of a smaller id or further up in the same one. All documents are each
other's reference, so the automata of the reference can't be broadcast within any fixed bound;
the shards of the reference are dealt out by content instead:

1. Each window elects an anchor, the run of `anchor` words of least hash in it. Windows in a row
   that elect one anchor form a segment. Equal windows elect equal anchors, so only segments of
   one anchor can share a window. Segments travel as packed records, (anchor, segment hash,
   document, place), to the range of their anchor's hash; a task sends each distinct segment of
   an anchor at most twice, for later ones repeat an earlier one of the same task.
2. In its range, an anchor all of whose segments are equal is settled: all but the earliest
   repeat whole. Only anchors in different segments, at the edges of shared passages, stay open.
3. Matching statistics decide open segments: the first documents to have an open segment send
   the hash of each of its windows to a range, where the earliest place of each window is found.
4. The repeated places come back to their documents, and the words they cover are removed.

Records are compared by 128 bits of hash. Every exchange is by hash and pre-aggregated in its
task, so a passage that a third of all documents share costs one record a task.

Defined cases: null texts have no words; texts of fewer words than a window lose nothing; rows
that repeat an id are one document as far as order goes, taken in their task's order, and each
lose what the id loses; null ids take no part and lose nothing; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.common import buffers, lean, pieces, ranges, saved

SIZE = 20
ANCHOR = 6
_SLAB = 1 << 23
_FLUSH = 4_000_000  # words whose records a task gathers before it sends them
_RECORD = np.dtype([("key", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
_SENT = pa.schema([("part", pa.int32()), ("records", pa.binary())])
_PLACE = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("open", pa.bool_())])


def segments(word: np.ndarray, first: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of the windows of each row: the anchor's hash, the segment's first window, its number of
    windows, and its row."""
    n = len(word) - size + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return np.empty(0, np.uint64), none, none, none
    grams = words.rolling(word, anchor)
    low = np.uint64((1 << 24) - 1)
    where = np.empty(n, np.int64)
    for lo in range(0, n, _SLAB):  # places must fit in the low bits; a segment may be cut anywhere
        hi = min(lo + _SLAB, n)
        part = grams[lo : hi + size - anchor]
        # Ties of the upper bits go to the leftmost.
        ranked = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        least = ranked[: hi - lo].copy()
        for k in range(1, size - anchor + 1):
            np.minimum(least, ranked[k : k + hi - lo], out=least)
        where[lo:hi] = lo + (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    ok = np.arange(n) + size <= first[row + 1]
    start = np.flatnonzero(ok)
    where, row = where[start], row[start]
    if not len(start):
        return np.empty(0, np.uint64), none, none, none
    new = np.ones(len(start), bool)
    new[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    runs = np.diff(np.append(head, len(start)))
    return grams[where[head]], start[head], runs, row[head]


def _pack(records: np.ndarray, parts: int):
    """Records by the range of their key's hash: anchors are least hashes themselves, so ranges of
    plain keys would be uneven."""
    part = (((words.mix(records["key"]) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, records[order[at[k] : at[k + 1]]].tobytes()


def _packed(groups: list[np.ndarray], parts: int):
    records = np.concatenate(groups) if groups else np.empty(0, _RECORD)
    found = list(_pack(_own_first(records), parts))
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([r for _, r in found], pa.binary())], schema=_SENT)


def _order(r: np.ndarray) -> np.ndarray:
    return np.lexsort((r["at"], r["doc"], r["hash"], r["key"]))


def _heads(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


_REPEATS = np.uint32(1 << 31)


def _own_first(r: np.ndarray) -> np.ndarray:
    """The earliest record of each key and hash; the rest, which repeat it, become one record
    for each document with a list of places: they are settled and only pass through."""
    r = r[_order(r)]
    new = _heads(r["key"], r["hash"], r["n"] & ~_REPEATS)
    settled = r[~new].copy()
    settled["n"] |= _REPEATS
    # Settled records go by document, so they load no single range.
    settled["key"] = words.mix(settled["doc"].view(np.uint64))
    return np.concatenate([r[new], settled])


def _segments(parts: int, size: int, anchor: int):
    def run(it):
        groups, gathered = [], 0
        for b in it:
            b = b.filter(b.column("doc_id").is_valid())
            ids = np.asarray(b.column("doc_id"))
            raw, at = buffers(b.column("text"))
            for lo, hi, part, offsets in pieces(raw, at):
                word, first = words.hashes(part, offsets, fold=False)
                key, start, runs, row = segments(word, first, size, anchor)
                if len(key):
                    r = np.empty(len(key), _RECORD)
                    sums = words.prefix(word, 1)
                    r["key"], r["hash"] = key, words.between(sums, start, start + runs + size - 1)
                    r["doc"], r["at"], r["n"] = ids[lo:hi][row], start - first[row], runs
                    groups.append(r)
                gathered += len(word)
                if gathered >= _FLUSH:
                    yield _packed(groups, parts)
                    groups, gathered = [], 0
        yield _packed(groups, parts)

    return run


def _windows(parts: int, size: int):
    """The window hashes of open segments."""

    def run(it):
        groups = []
        for b in it:
            ids = np.asarray(b.column("doc_id"))
            raw, at = buffers(b.column("text"))
            places, starts = _lists(b.column("places"))
            for lo, hi, part, offsets in pieces(raw, at):
                word, first = words.hashes(part, offsets, fold=False)
                one, two = words.prefix(word, 2), words.prefix(word, 3)
                begin, n = places["at"][starts[lo] : starts[hi]], places["n"][starts[lo] : starts[hi]]
                row = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
                window = np.repeat(begin, n) + _counting(n)
                row = np.repeat(row, n)
                lo_word = first[row] + window
                r = np.empty(len(window), _RECORD)
                r["key"], r["hash"] = words.between(one, lo_word, lo_word + size), words.between(two, lo_word, lo_word + size)
                r["doc"], r["at"], r["n"] = ids[lo:hi][row], window, 1
                groups.append(r)
            if sum(map(len, groups)) >= _FLUSH:
                yield _packed(groups, parts)
                groups = []
        yield _packed(groups, parts)

    return run


def _counting(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of `n`, in a row."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def _lists(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A column of lists of (at, n) as flat arrays and the rows' offsets; null lists are empty."""
    if column.null_count:
        column = column.fill_null([])
    starts = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.slice(starts[0], starts[-1] - starts[0])
    return {k: np.asarray(flat.field(k)).astype(np.int64) for k in ("at", "n")}, starts - starts[0]


def _settle(t: pa.Table) -> pa.Table:
    """Of the records of one range: the repeated places, and the open ones."""
    r = np.frombuffer(b"".join(t.column("records").to_pylist()), _RECORD)
    passed = r[(r["n"] & _REPEATS) != 0]
    r = r[(r["n"] & _REPEATS) == 0]
    r = r[_order(r)]
    key = np.cumsum(_heads(r["key"])) - 1
    new = _heads(r["key"], r["hash"], r["n"])
    several = np.bincount(key, weights=new) > 1 if len(r) else np.empty(0, bool)
    is_open = several[key] if len(r) else np.empty(0, bool)
    out = r[is_open | ~new]
    open_ = (is_open)[is_open | ~new] & new[is_open | ~new]
    return pa.table(
        {
            "doc_id": np.concatenate([out["doc"], passed["doc"]]),
            "at": np.concatenate([out["at"], passed["at"]]).astype(np.int32),
            "n": np.concatenate([out["n"], passed["n"] & ~_REPEATS]).astype(np.int32),
            "open": np.concatenate([open_, np.zeros(len(passed), bool)]),
        },
        schema=_PLACE,
    )


def _left(b: pa.RecordBatch, size: int, texts: bool):
    """(words, removed words, what is kept) of runs of rows: the text without the removed words, as
    given where there are none, or, if not `texts`, the digest of the kept words."""
    raw, at = buffers(b.column("given").field("text"))
    places, starts = _lists(b.column("places"))
    for lo, hi, part, offsets in pieces(raw, at):
        begin, end, first = words.spans(part, offsets)
        row = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
        a = first[row] + places["at"][starts[lo] : starts[hi]]
        z = a + places["n"][starts[lo] : starts[hi]] + size - 1
        depth = np.bincount(a, minlength=len(begin) + 1) - np.bincount(z, minlength=len(begin) + 1)
        gone = np.cumsum(depth)[:-1] > 0
        n = np.diff(first)
        lost = np.where(n > 0, np.add.reduceat(np.append(gone, False), first[:-1], dtype=np.int64), 0)
        data, kept = part.tobytes(), []
        for k in range(hi - lo):
            if texts and not lost[k]:
                kept.append(data[offsets[k] : offsets[k + 1]].decode())
                continue
            own = slice(first[k], first[k + 1])
            stay = ~gone[own]
            said = b" ".join([data[p:q] for p, q in zip(begin[own][stay].tolist(), end[own][stay].tolist(), strict=True)])
            kept.append(said.decode() if texts else hashlib.sha256(said).hexdigest())
        yield lo, hi, n, lost, kept


def _removed(size: int, texts: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(it):
        for b in it:
            for lo, hi, n, lost, kept in _left(b, size, texts):
                yield pa.RecordBatch.from_arrays([b.column("given").field("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def _rewritten(size: int, columns: list[str]):
    """Rows as they came, with `text` and `n_chars` of what is left."""

    def run(it):
        for b in it:
            given = b.column("given")
            there = given.field("text").is_valid()
            for lo, hi, _, _, kept in _left(b, size, True):
                out = {c: given.field(c).slice(lo, hi - lo) for c in columns}
                out["text"] = pa.array(kept, pa.string(), mask=~np.asarray(there.slice(lo, hi - lo)))
                if "n_chars" in out:
                    out["n_chars"] = pc.cast(pc.utf8_length(out["text"]), given.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)

    return run


def repeated_places(rows: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, at, n): the windows of a document from `at` on, `n` in a row, start earlier too."""
    parts = ranges(rows)
    sent = "part int, records binary"
    place = "doc_id long, at int, n int, open boolean"
    found = saved(rows.mapInArrow(lean(_segments(parts, size, anchor)), sent).repartitionById(parts, "part").groupBy("part").applyInArrow(_settle, place), "segments")
    todo = found.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("places"))
    near = rows.join(todo, "doc_id").select("doc_id", "text", "places")
    told = near.mapInArrow(lean(_windows(parts, size)), sent).repartitionById(parts, "part").groupBy("part").applyInArrow(_settle_windows, place)
    return found.where("NOT open").select("doc_id", "at", "n").union(told.select("doc_id", "at", "n"))


def _settle_windows(t: pa.Table) -> pa.Table:
    """All but the earliest place of each window; equal hashes are equal windows here."""
    r = np.frombuffer(b"".join(t.column("records").to_pylist()), _RECORD)
    passed = r[(r["n"] & _REPEATS) != 0]
    r = r[(r["n"] & _REPEATS) == 0]
    r = r[_order(r)]
    again = r[~_heads(r["key"], r["hash"])]
    out = np.concatenate([again, passed])
    return pa.table({"doc_id": out["doc"], "at": out["at"].astype(np.int32), "n": (out["n"] & ~_REPEATS).astype(np.int32), "open": np.zeros(len(out), bool)}, schema=_PLACE)


def _placed(docs: DataFrame, size: int) -> DataFrame:
    """Every row, as the struct `given`, with the repeated places of its id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = repeated_places(rows, size).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("places"))
    given = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("given"))
    return given.join(places, F.col("given.doc_id").cast("long") == F.col("doc_id"), "left").select("given", "places")


def dedup_substrings(docs: DataFrame, size: int = SIZE, texts: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, and `kept`: the text without the removed
    words (as given if nothing was removed, else words joined by one space), or, if not `texts`,
    the SHA-256 of the kept words joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _placed(rows, size).mapInArrow(lean(_removed(size, texts)), "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """`docs` with the repeated words gone from `text`, and `n_chars` as it then is; texts meet
    their places in one join and are rewritten in the same stage."""
    return _placed(docs, size).mapInArrow(lean(_rewritten(size, docs.columns)), docs.schema)


def brute_force(texts: dict[int, str | None], size: int) -> dict[int, tuple[int, int, str]]:
    """What `dedup_substrings` is tested against."""
    import re

    seen: set[tuple[str, ...]] = set()
    out = {}
    for d in sorted(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[d] or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM w WHERE len(w) >= 20)),
again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM again),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT word.* FROM word ANTI JOIN gone USING (doc_id, p)),
said AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN said USING (doc_id)
"""
