"""Byte-level BPE: overlapping chunks pre-tokenised in parallel, stitched, encoded, decoded.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own; where two
neighbours have a common boundary inside their overlap they have resynchronised, since a
pre-token depends on what follows its start alone, and the text is stitched there. Boundaries
so near a chunk's end that the missing text could change them don't count. Where an overlap has
no common boundary, pre-tokenisation goes on from the last sure boundary until it has one. Then
the pieces are encoded; as merges never cross a pre-token, equal pre-tokens have equal ids and
are merged once. Decoding concatenates the raw bytes of the ids.

Defined cases: null texts are empty and have no ids; every row gives one row, repeated rows and
null ids too; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import lean

CHUNK = 1 << 12  # characters of a chunk
OVERLAP = 1 << 8  # characters that a chunk has beyond the next one's start
_UNSURE = 16  # boundaries this near the end of a cut text may change with what follows
_MEMORY = 200_000  # distinct pre-tokens remembered at a time, about 50 MB; a task forgets them at its end

# Where the quick pattern agrees with the general one: ASCII, Latin letters, no other digits or spaces.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ʯ]*")
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ]+| ?[0-9]+| ?[^\sA-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ0-9]+|\s+(?!\S)|\s+")


class Splitter:
    """The pre-tokens of a text by a `regex` pattern, by `re` where the text allows."""

    def __init__(self, pattern: str):
        self._general = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return (_QUICK if _PLAIN.fullmatch(text) else self._general).findall(text)


def stitched(chunks: list[list[str]], starts: list[int], text: str, split: Splitter) -> list[str]:
    """The pre-tokens of `text` from those of its overlapping chunks."""
    out = list(chunks[0])
    ends = np.cumsum([len(t) for t in out]).tolist()
    for k in range(1, len(chunks)):
        reach = starts[k - 1] + sum(len(t) for t in chunks[k - 1])
        sure = reach - _UNSURE
        while ends and ends[-1] > sure:
            ends.pop()
            out.pop()
        mine = (np.cumsum([0] + [len(t) for t in chunks[k]]) + starts[k]).tolist()
        known = {p: i for i, p in enumerate(mine)}
        at = next((i for i in range(len(ends) - 1, -1, -1) if ends[i] in known and ends[i] >= starts[k]), None)
        if at is None and starts[k] == 0:
            at = -1
        if at is not None:
            join = known[ends[at]] if at >= 0 else 0
            del out[at + 1 :], ends[at + 1 :]
        else:  # go on from the last sure boundary until one of the next chunk's is met
            begin = ends[-1] if ends else 0
            fresh = split(text[begin : starts[k] + sum(len(t) for t in chunks[k])])
            join = len(chunks[k])
            for t in fresh:
                begin += len(t)
                out.append(t)
                ends.append(begin)
                if begin in known:
                    join = known[begin]
                    break
        out.extend(chunks[k][join:])
        ends.extend(mine[join + 1 :])
    return out


def cut(text: str, size: int, overlap: int) -> tuple[list[int], list[str]]:
    starts = list(range(0, max(len(text), 1), size))
    return starts, [text[s : s + size + overlap] for s in starts]


class Codec:
    """Ids of pre-tokens by a rank file, remembered as packed little-endian unsigned integers."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token
        encode = self._encoding.encode_ordinary

        class Memory(dict):
            def __missing__(self, token: str) -> bytes:
                if len(self) >= _MEMORY:
                    self.clear()
                ids = encode(token)
                self[token] = out = struct.pack(f"<{len(ids)}I", *ids)
                return out

        self.memory = Memory()
        self.packed = self.memory.__getitem__

    def encode(self, pretokens: list[str]) -> bytes:
        return b"".join(map(self.packed, pretokens))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[tuple[str, str], tuple[Splitter, Codec]] = {}


def codec(path: str, pattern: str) -> tuple[Splitter, Codec]:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = (Splitter(pattern), Codec(path, pattern))
    return _codecs[path, pattern]


def _forget() -> None:
    for _, code in _codecs.values():
        code.memory.clear()


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _row(packed: bytes, decoded: bytes, digests: bool) -> tuple:
    if digests:
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()
    return len(packed) // 4, packed, decoded


def _whole(path: str, pattern: str, size: int, overlap: int, digests: bool):
    """Texts of one task's rows: their chunks are pre-tokenised one after another."""
    schema = _DIGEST if digests else _OUT

    def run(it):
        split, code = codec(path, pattern)
        for b in it:
            rows = []
            for lo in range(0, b.num_rows, 500):
                for text in b.column("text").slice(lo, 500).to_pylist():
                    starts, parts = cut(text or "", size, overlap)
                    packed = code.encode(stitched([split(p) for p in parts], starts, text or "", split))
                    rows.append(_row(packed, code.decode(packed), digests))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, 500), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)
                rows = []

    return run


def _boundaries(path: str, pattern: str):
    """The pre-token lengths of one chunk of a long text."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("start", pa.int32()), ("own", pa.string()), ("lengths", pa.binary())])

    def run(it):
        split, _ = codec(path, pattern)
        for b in it:
            for lo in range(0, b.num_rows, 16):
                part = b.slice(lo, 16)
                lengths = [np.array([len(t) for t in split(p)], np.int32).tobytes() for p in part.column("part").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "k", "start", "part")), pa.array(lengths, pa.binary())], schema=schema)

    return run


def _join(path: str, pattern: str, size: int, digests: bool):
    """Chunks of one text to its ids."""
    schema = _DIGEST if digests else _OUT

    def run(t: pa.Table) -> pa.Table:
        split, code = codec(path, pattern)
        t = t.sort_by("k")
        parts = t.column("own").to_pylist()
        starts = t.column("start").to_pylist()
        text = "".join(p[:size] for p in parts)
        chunks = []
        for p, packed in zip(parts, t.column("lengths").to_pylist(), strict=True):
            at = np.concatenate([[0], np.cumsum(np.frombuffer(packed, np.int32))]).tolist()
            chunks.append([p[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
        packed = code.encode(stitched(chunks, starts, text, split))
        return pa.table([[x] for x in (t.column("doc_id")[0].as_py(), *_row(packed, code.decode(packed), digests))], schema=schema)

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, size: int = CHUNK, overlap: int = OVERLAP, spread: int = 8 * CHUNK, digests: bool = False) -> DataFrame:
    """One row a document: doc_id, n_tokens, and `ids` (packed little-endian unsigned 32-bit) with
    `decoded` bytes, or their SHA-256 digests if `digests`.

    Texts of more than `spread` characters are cut into chunk rows that any task may take, and
    come together only to be stitched; the chunks of shorter ones stay in their task.
    """
    rows = docs.select("doc_id", "text")
    ddl = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded binary")
    long = F.coalesce(F.length("text") > spread, F.lit(False))
    short = rows.where(~long).mapInArrow(lean(_whole(path, pattern, size, overlap, digests), _forget), ddl)
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size))
    parts = (
        rows.where(long)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # numbered before rows multiply
        .select("row", "doc_id", "text", F.posexplode(starts).alias("k", "start"))
        .select("row", "doc_id", "k", "start", F.substring(F.col("text"), F.col("start") + 1, F.lit(size + overlap)).alias("part"))
    )
    dealt = parts.repartition("row", "k").mapInArrow(lean(_boundaries(path, pattern)), "row long, doc_id long, k int, start int, own string, lengths binary")
    return short.unionByName(dealt.groupBy("row").applyInArrow(_join(path, pattern, size, digests), ddl))
