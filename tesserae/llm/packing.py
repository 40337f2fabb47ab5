"""Best-fit packing of documents into token sequences, improved by a swap-based local search.

Documents are tokenised and those longer than a sequence are cut into full pieces behind a
shorter first one. How pieces can share sequences depends on their lengths alone, and there are
at most `size` lengths however many documents there are; so packing is planned on the driver over
the number of pieces of each length, as patterns: which lengths make up a sequence, and how many
sequences do so. Best-fit decreasing puts the pieces of a length, longest first, into the fullest
sequences with room for them, all sequences of a pattern at once. Then a local search takes underfull sequences, least filled first, and moves a piece to another one, or
exchanges one piece for one, two for one or one for two, wherever that raises the sum of squared
fills, until sequences empty or nothing more is gained. A step treats all sequences of a pattern
alike, so the search's work is bounded by the number of patterns too.

Pieces find their places without meeting each other: a piece's rank among those of its length is
its place in its task's order plus the number of such pieces in tasks before, and ranges of ranks
belong to patterns.

Defined cases: null texts are empty and have the end token alone; every row is packed, repeated
rows and null ids too; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.bpe import _PLAIN, _QUICK
from tesserae.llm.common import lean, saved

SIZE = 1024  # tokens of a sequence
END = 2  # the id behind every document
_MEMORY = 200_000  # distinct pre-tokens remembered at a time, about 45 MB; a task forgets them at its end

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("nth", pa.int64()), ("ids", pa.binary())])

_tokenizers: dict[str, tuple] = {}


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens' bytes and ids of a byte-level BPE file whose ids follow its merges' order; None for others."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if ids != list(range(256, 256 + len(merges))) or any(c not in model["vocab"] for c in letters):
        return None
    kept = {*letters, *("".join(m) for m in merges)}
    return {bytes(letters[c] for c in token): model["vocab"][token] for token in kept}


class _Memory(dict):
    """Pre-tokens' packed ids, worked out when they are first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, token: str) -> bytes:
        if len(self) >= _MEMORY:
            self.clear()
        self[token] = out = array("I", self.encode(token)).tobytes()
        return out


def _tokenizer(path: str) -> tuple:
    """The tokenizer, and a memory of pre-tokens' packed ids; merges never cross a pre-token, and the
    same merges give the same ids in the quicker library, where the file allows it."""
    if path not in _tokenizers:
        import tiktoken
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        ranks = byte_ranks(path)
        if ranks is None:
            memory = _Memory(lambda token: t.encode(token, add_special_tokens=False).ids)
        else:
            memory = _Memory(tiktoken.Encoding("merges", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
        _tokenizers[path] = (t, memory)
    return _tokenizers[path]


def _forget() -> None:
    for _, memory in _tokenizers.values():
        memory.clear()


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Packed little-endian unsigned 32-bit ids of each text."""
    tokenizer, memory = _tokenizer(path)
    packed = memory.__getitem__
    split = [_QUICK.findall(t) if _PLAIN.fullmatch(t) else None for t in texts]
    odd = [t for t, parts in zip(texts, split, strict=True) if parts is None]
    whole = iter(tokenizer.encode_batch(odd, add_special_tokens=False))
    return [np.array(next(whole).ids, "<u4").tobytes() if parts is None else b"".join(map(packed, parts)) for parts in split]


def _cut(path: str, size: int, end: int, with_ids: bool):
    tail = np.array([end], "<u4").tobytes()

    def run(it):
        task, seen = TaskContext.get().partitionId(), Counter()
        for b in it:
            for lo in range(0, b.num_rows, 250):
                part = b.slice(lo, 250)
                out = []
                for doc, packed in zip(part.column("doc_id").to_pylist(), token_ids([t or "" for t in part.column("text").to_pylist()], path), strict=True):
                    packed += tail
                    total = len(packed) // 4
                    pieces = -(-total // size)
                    at = 0
                    for k in range(pieces):
                        length = total - size * (pieces - 1) if k == 0 else size
                        ids = packed[4 * at : 4 * (at + length)]
                        out.append((doc, k, at, length, zlib.crc32(ids), task, seen[length], ids if with_ids else None))
                        seen[length] += 1
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def best_fit(counts: dict[int, int], size: int) -> Counter:
    """Patterns (lengths of a sequence, longest first) and how many sequences follow each, by
    best-fit decreasing: all pieces of a length go, longest first, to the fullest sequences with
    room for them. A length splits one pattern at most at its last pieces, so patterns stay few."""
    by_space: dict[int, Counter] = {}
    spaces: list[int] = []  # sorted

    def put(pattern: tuple[int, ...], n: int, space: int) -> None:
        if space not in by_space:
            by_space[space] = Counter()
            insort(spaces, space)
        by_space[space][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                per = size // length
                if left >= per:
                    put((length,) * per, left // per, size - per * length)
                if left % per:
                    put((length,) * (left % per), 1, size - left % per * length)
                break
            space = spaces[at]
            pattern, n = by_space[space].popitem()
            if not by_space[space]:
                del by_space[space], spaces[at]
            used = min(n, left)
            left -= used
            put((*pattern, length), used, space - length)
            if n > used:
                put(pattern, n - used, space)
    out: Counter = Counter()
    for patterns in by_space.values():
        out.update(patterns)
    return out


def _without(pattern: tuple[int, ...], gone: Iterable[int], new: Iterable[int]) -> tuple[int, ...]:
    rest = Counter(pattern)
    rest.subtract(gone)
    rest.update(new)
    return tuple(sorted(rest.elements(), reverse=True))


def _parts(pattern: tuple[int, ...]) -> list[tuple[int, ...]]:
    """What one side of an exchange may give: nothing, one piece, or two."""
    held = Counter(pattern)
    ones = sorted(held)  # 44 at most, whatever the number of pieces: no more lengths have a sum of 1024
    twos = {(a, b) for a in ones for b in ones if a < b or a == b and held[a] > 1}
    return [(), *((a,) for a in ones), *sorted(twos)]


def local_search(bins: Counter, size: int) -> Counter:
    """Exchanges between underfull sequences that raise the sum of squared fills, until no sequence
    can give any more; each one raises a bounded whole number, so there is an end."""
    bins = Counter(bins)
    stuck: set[tuple[int, ...]] = set()
    while True:
        open_bins = sorted((sum(p), p) for p, n in bins.items() if n > 0 and sum(p) < size)
        donor = next(((f, p) for f, p in open_bins if p not in stuck), None)
        if donor is None:
            break
        fill, a = donor
        gives = [(sum(x), x) for x in _parts(a) if x]
        best = None
        for to, b in reversed(open_bins):
            if b == a and bins[a] < 2:
                continue
            space = size - to
            for back in _parts(b):
                got = sum(back)
                for total, give in gives:
                    if len(give) + len(back) > 3 or len(back) > 1 and len(give) > 1:
                        continue
                    moved = total - got
                    # sum of squares rises by 2 * moved * (to - fill + moved)
                    if 0 < moved <= space and to - fill + moved > 0:
                        gain = moved * (to - fill + moved)
                        if best is None or gain > best[0]:
                            best = (gain, b, give, back)
            if best is not None and best[0] >= space * (to - fill + space):
                break
        if best is None:
            stuck.add(a)
            continue
        _, b, give, back = best
        times = bins[a] // 2 if a == b else min(bins[a], bins[b])
        for p, n in ((a, -times), (b, -times), (_without(a, give, back), times), (_without(b, back, give), times)):
            if p:
                bins[p] += n
                stuck.discard(p)
    return +bins


def plan(counts: dict[int, int], size: int = SIZE) -> Counter:
    return local_search(best_fit(counts, size), size)


def _places(bins: Counter) -> dict[int, np.ndarray]:
    """For each length its ranges of ranks: (first rank, pieces of it in a sequence, first sequence, offset)."""
    cursor: Counter = Counter()
    out: dict[int, list] = {}
    base = 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length, per in sorted(Counter(pattern).items(), reverse=True):
            out.setdefault(length, []).append((cursor[length], per, base, offset))
            cursor[length] += per * n
            offset += per * length
        base += n
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def _place(places: dict[int, np.ndarray]):
    def run(it):
        for b in it:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                mine, rows = np.flatnonzero(length == n), places[n]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                step = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + step // row[:, 1]
                offset[mine] = row[:, 3] + step % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "rank"), pa.array(sequence), pa.array(offset)], names=[*(c for c in b.schema.names if c != "rank"), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and if `with_ids` its packed ids."""
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long, ids binary"
    cut = saved(docs.select("doc_id", "text").mapInArrow(lean(_cut(tokenizer, size, end, with_ids), _forget), ddl), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `size` rows at most
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = cut.join(offsets, ["length", "task"]).select(*columns, (F.col("before") + F.col("nth")).alias("rank"))
    names = {"piece": "int", "ids": "binary"}
    out = ", ".join(f"{c} {names.get(c, 'long')}" for c in columns)
    return ranked.mapInArrow(lean(_place(_places(plan(counts, size)))), f"{out}, sequence_id long, offset long")
