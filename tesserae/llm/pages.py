"""Main text of web pages: what a host repeats, found by suffix arrays, and the page's structure.

1. A page is read into blocks: the text between block-level tags, character references decoded,
   white space made one space, with the role its ancestors give it: `main` inside an article or
   main element, `frame` inside menus, headers, footers, sidebars, notices, adverts, forms,
   comments of readers and the like, `open` otherwise. Scripts, styles, markup and comments of
   the page itself have no text. Frame blocks go.
2. A task concatenates the token streams of its pages host by host, main and open blocks alike,
   and sorts their suffixes by the first `run` tokens (prefix doubling; a block's end sorts before
   any token). The array is sparse: of each `run` neighbouring suffixes of a block the one of
   least hash is elected, so equal passages elect equal suffixes wherever they stand. Equal
   neighbours from distinct pages of a host are substrings that the host repeats. Each distinct
   one leaves the task once, packed, with the number of its pages; the counts of all tasks meet by
   ranges of hashes, so a host of any size is spread and repeats between pages of different tasks
   are found all the same.
3. Repeats return to their pages. A block is judged by its windows of `run` elected-from suffixes:
   - an open block goes if substrings that any other page of the host has cover its greater part;
   - a main block goes if substrings that more than half of the host's pages have (of `WIDE` pages
     at least) cover its greater part: notices and adverts that stand inside articles. Main text
     of which such blocks would be the greater part is the article itself, and stays whole.
   Unique runs stay, beside main text too.

Defined cases: null html is empty; empty pages have an empty text; rows that repeat an id are one
page to the search for repeats, so that they don't make each other boilerplate; pages without an
id are told apart by their url; null or odd urls have the host ''; markup without an end is text;
an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import words
from tesserae.llm.common import buffers, lean, ranges, saved

RUN = 8  # tokens that make a substring long
WIDE = 8  # pages of a host from which on text of most of them is the host's, not the page's
_TOKENS = 1_000_000  # tokens of a suffix array
# No part may hold "<" unquoted and none gives back what it took, so broken markup costs one look at each byte.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^<>]*+>""", re.S)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role|aria-label|hidden|style|type)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"[\s\x1c-\x1f]+")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "svg", "math", "canvas", "object", "select", "button"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_FRAME = {"nav", "aside", "footer", "form", "menu", "dialog", "fieldset", "search", "head"}
_WORDS = "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
_FRAME_NAME = re.compile(r"(?:^|[^a-z])(?:" + "|".join(_WORDS) + r")(?:$|[^a-z])")
_FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "note"}
_MAIN_NAME = re.compile(r"(?:^|[^a-z])(?:article-?body|article-?content|entry-?content|post-?content|post-?body|main-?content|story-?body)(?:$|[^a-z])")
OPEN, MAIN, FRAME = 0, 1, 2


def _role(tag: str, attributes: str, inside: int) -> int:
    """The role of an element and what it holds, from the one around it."""
    if inside == FRAME or tag in _FRAME or tag == "header" and inside != MAIN:
        return FRAME
    names, role = "", ""
    for key, value in _MARKS.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "aria-label"):
            names += " " + value
        elif key == "role":
            role = value
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return FRAME
    if role in _FRAME_ROLES:
        return FRAME
    if tag in ("body", "html"):
        return inside
    if names and _MAIN_NAME.search(names):
        return MAIN
    if names and _FRAME_NAME.search(names):  # also an article that is a comment or an advert
        return FRAME
    return MAIN if tag in ("article", "main") or role in ("main", "article") else inside


def blocks(page: str) -> tuple[list[str], list[int]]:
    """Texts and roles of a page's blocks in order; empty blocks are left out."""
    texts: list[str] = []
    roles: list[int] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()  # elements of each name on the stack
    now: list[str] = []
    role, at, raw = OPEN, 0, ""

    def close() -> None:
        if now:
            said = _SPACE.sub(" ", entities.unescape("".join(now))).strip(" ")
            if said:
                texts.append(said)
                roles.append(role)
            now.clear()

    def push(tag: str) -> None:
        stack.append((tag, role))
        opened[tag] += 1

    def pop(k: int) -> None:
        """Leave the elements from the stack's `k`-th on."""
        nonlocal role
        role = stack[k][1]
        for name, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    for m in _TAG.finditer(page):
        begin, end = m.span()
        tag = (m.group(2) or "").lower()
        if raw:  # only its own end tag ends a raw element
            if tag == raw and m.group(1):
                raw, at = "", end
            elif begin >= at and (ended := _raw_end(page, raw, at)) is not None and ended <= begin:
                raw, at = "", ended
            if raw or at > begin:
                continue
        if begin < at:
            continue
        now.append(page[at:begin])
        at = end
        if not tag:
            continue
        if tag in _RAW and not m.group(1) and not m.group(3).rstrip().endswith("/"):
            ended = _raw_end(page, tag, end)
            at = len(page) if ended is None else ended
            now.append(" ")
            continue
        if tag == "br":
            now.append(" ")
        if tag not in _BLOCK:
            if not m.group(1) and tag not in _VOID and m.group(3) and not m.group(3).rstrip().endswith("/"):
                inner = _role(tag, m.group(3), role)
                if inner != role:  # an inline element with a role of its own
                    close()
                    push(tag)
                    role = inner
            elif m.group(1) and stack and stack[-1][0] == tag:
                close()
                pop(len(stack) - 1)
            continue
        close()
        if m.group(1):
            if opened[tag]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
        elif tag not in _VOID:
            if tag == "p" or tag == "li":  # their end tags may be missing
                for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    if stack[k][0] == tag:
                        pop(k)
                        break
                    if stack[k][0] not in ("p", "b", "i", "em", "strong", "span", "a", "font", "u"):
                        break
            push(tag)
            role = _role(tag, m.group(3), role)
    now.append(page[at:])
    close()
    return texts, roles


def _raw_end(page: str, tag: str, at: int) -> int | None:
    m = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^<>]*+>", re.I).search(page, at)
    return m.end() if m else None


def suffix_order(tokens: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first `depth` tokens, by prefix doubling inside groups (blocks
    of a stream), whose ends sort before any token: equal ranks have equal tokens, as many of them."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        same = np.zeros(n, bool)
        same[: n - step] = group[step:] == group[: n - step]
        after[~same] = -1
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def elected(token: np.ndarray, first: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks that begin at `first`: places of elected suffixes, how many windows elect each,
    and hashes of their first `run` tokens (of all tokens, for a block of fewer)."""
    none = np.empty(0, np.int64)
    length = np.diff(first)
    place, weight, key = [none], [none], [np.empty(0, np.uint64)]
    for n in range(1, run):  # short blocks are one substring each
        at = first[:-1][length == n]
        if len(at):
            place.append(at)
            weight.append(np.ones(len(at), np.int64))
            key.append(words.rolling(token, n, seed=n)[at])
    grams = words.rolling(token, run)
    if len(grams):
        block = np.repeat(np.arange(len(length)), length)
        inside = block[: len(grams)] == block[run - 1 :]
        most = np.uint64(2**64 - 1)
        ranked = np.concatenate([np.where(inside, grams >> np.uint64(1), most), np.full(run, most)])
        best, where = ranked[: len(grams)].copy(), np.arange(len(grams))
        # A window is `run` neighbouring suffixes; past a block's last one there are as many that don't count.
        for k in range(1, run):
            less = ranked[k : k + len(grams)] < best
            best[less] = ranked[k : k + len(grams)][less]
            where[less] = np.flatnonzero(less) + k
        begin = np.arange(len(grams))
        whole = inside & ((begin + 2 * run - 1 <= first[block[: len(grams)] + 1]) | (begin == first[block[: len(grams)]]))
        own = where[whole]
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        head = np.flatnonzero(new)
        place.append(own[head])
        weight.append(np.diff(np.append(head, len(own))))
        key.append(grams[own[head]])
    place, weight, key = np.concatenate(place), np.concatenate(weight), np.concatenate(key)
    order = np.argsort(place, kind="stable")
    return place[order], weight[order], key[order]


def _stream(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the blocks of pages, where each block begins, and each block's page."""
    raw, at = buffers(pa.array([t for page in texts for t in page], pa.string()))
    token, first = words.hashes(raw, at, fold=False)
    return token, first, np.repeat(np.arange(len(texts)), [len(page) for page in texts])


def _read(b: pa.RecordBatch, structure: bool) -> tuple[list[list[str]], list[list[int]]]:
    """Texts and roles of the main and open blocks of a batch's pages; all are open without structure."""
    texts, roles = [], []
    for page in b.column("html"):
        said, given = blocks(page.as_py() or "")
        keep = [k for k, r in enumerate(given) if not structure or r != FRAME]
        texts.append([said[k] for k in keep])
        roles.append([given[k] if structure else OPEN for k in keep])
    return texts, roles


def _parts_of(b: pa.RecordBatch, rows: int = 250):
    for lo in range(0, b.num_rows, rows):
        yield b.slice(lo, rows)


_COUNTED = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("pages", pa.binary()), ("counts", pa.binary()), ("opens", pa.binary()), ("which", pa.binary()), ("hosts", pa.binary())])


def _suffixes(run: int, structure: bool, parts: int):
    """The distinct elected substrings of a task's pages, host by host, with their pages' number."""

    def array(boxes: list[list[np.ndarray]]) -> pa.RecordBatch:
        token, length, row_of, is_open, host, page = (np.concatenate(x) for x in zip(*boxes, strict=True))
        first = np.concatenate([[0], np.cumsum(length)])
        block = np.repeat(np.arange(len(length)), length)
        rank = suffix_order(token, block, run)
        place, _, key = elected(token, first, run)
        owner = block[place]
        key = words.mix(key ^ words.mix(host.view(np.uint64))[owner])
        host, page, is_open, rank = host[owner], page[owner], is_open[owner], rank[place]
        order = np.lexsort((page, rank, host))
        host, page, is_open, rank, key = (x[order] for x in (host, page, is_open, rank, key))
        new = np.ones(len(order), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (host[1:] != host[:-1])
        fresh = new.copy()
        fresh[1:] |= page[1:] != page[:-1]
        head = np.flatnonzero(new)
        key, page = key[head], page[head]
        count = np.add.reduceat(fresh, head, dtype=np.uint32) if len(head) else np.empty(0, np.uint32)
        opens = np.maximum.reduceat(is_open, head) if len(head) else np.empty(0, np.uint8)
        order = np.argsort(key)
        names, which = np.unique(host[head], return_inverse=True)
        key, page, count, opens, which = key[order], page[order], count[order], opens[order], which.astype(np.uint32)[order]
        part = (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        at = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(at)).tolist()
        cut = [[x[at[k] : at[k + 1]].tobytes() for k in some] for x in (key, page, count, opens, which)]
        cut.append([names.tobytes()] * len(some))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in cut)], schema=_COUNTED)

    def work(it):
        boxes, held = [], 0
        for b in it:
            for part in _parts_of(b):
                texts, roles = _read(part, structure)
                token, first, row = _stream(texts)
                role = np.fromiter((r for page in roles for r in page), np.uint8, len(row))
                host, page = (np.asarray(part.column(k))[row] for k in ("host", "page"))
                order = np.argsort(host, kind="stable")  # the streams of a host's pages, one after another
                length = np.diff(first)
                start = np.repeat(first[:-1][order] - np.concatenate([[0], np.cumsum(length[order])[:-1]]), length[order])
                boxes.append([token[start + np.arange(len(token))], length[order], row[order], (role == OPEN).astype(np.uint8)[order], host[order], page[order]])
                held += len(token)
                if held >= _TOKENS:
                    yield array(boxes)
                    boxes, held = [], 0
        if held:
            yield array(boxes)

    return work


def _repeats(t: pa.Table) -> pa.Table:
    """Of one range of hashes, those of substrings that distinct pages have."""
    key, page, count, opens = (np.frombuffer(b"".join(t.column(k).to_pylist()), kind) for k, kind in (("keys", np.uint64), ("pages", np.int64), ("counts", np.uint32), ("opens", np.uint8)))
    host = np.concatenate([np.frombuffer(names, np.int64)[np.frombuffer(which, np.uint32)] for names, which in zip(t.column("hosts").to_pylist(), t.column("which").to_pylist(), strict=True)])
    order = np.argsort(key, kind="stable")
    key, page, count, opens, host = key[order], page[order], count[order], opens[order], host[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    low, high = np.minimum.reduceat(page, head), np.maximum.reduceat(page, head)
    several = (low != high) | (np.maximum.reduceat(count, head) > 1)
    pages = np.add.reduceat(count, head, dtype=np.int64)
    return pa.table({"key": key[head][several].view(np.int64), "host": host[head][several], "pages": pages[several], "in_open": np.maximum.reduceat(opens, head)[several] > 0})


def _places(run: int, structure: bool):
    """Where elected substrings stand: page, block, and the windows that elect them."""
    schema = pa.schema([("key", pa.int64()), ("page", pa.int64()), ("sig", pa.int64()), ("block", pa.int32()), ("at", pa.int32()), ("weight", pa.int32())])

    def work(it):
        for b in it:
            for part in _parts_of(b):
                texts, _ = _read(part, structure)
                token, first, row = _stream(texts)
                place, weight, key = elected(token, first, run)
                block = np.searchsorted(first, place, side="right") - 1  # blocks have a token at least
                host, page, sig = (np.asarray(part.column(k)) for k in ("host", "page", "sig"))
                key = words.mix(key ^ words.mix(host.view(np.uint64))[row[block]])
                nth = block - np.searchsorted(row, row[block])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(x[row[block]]) for x in (page, sig)), pa.array(nth.astype(np.int32)), pa.array((place - first[block]).astype(np.int32)), pa.array(weight.astype(np.int32))], schema=schema)

    return work


def chosen(texts: list[str], roles: list[int], found: dict[int, tuple[int, int]], run: int) -> list[str]:
    """The blocks that stay; `found` has windows of a block that repeats cover: any, and wide ones."""
    if not found:
        return texts
    size = [len(t.split(" ")) for t in texts]
    windows = [max(n - 2 * run + 2, 1) for n in size]
    gone = {k for k, (some, wide) in found.items() if 2 * (wide if roles[k] == MAIN else some) > windows[k]}
    main = sum(n for n, r in zip(size, roles, strict=True) if r == MAIN)
    if 2 * sum(size[k] for k in gone if roles[k] == MAIN) >= main:
        gone = {k for k in gone if roles[k] != MAIN}
    return [t for k, t in enumerate(texts) if k not in gone]


def _keep(run: int, structure: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def work(it):
        for b in it:
            for part in _parts_of(b):
                texts, roles = _read(part, structure)
                covered = ({f["block"]: (f["some"], f["wide"]) for f in found.as_py() or ()} for found in part.column("found"))
                out = ["\n".join(chosen(*page, run)) for page in zip(texts, roles, covered, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], schema=schema)

    return work


def extract(pages: DataFrame, run: int = RUN, structure: bool = True) -> DataFrame:
    """One row a page: page_id, url, text. Without `structure` roles count for nothing: the suffix
    arrays run over the whole token streams, what a host repeats goes and unique runs stay."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    page = F.coalesce("page_id", -F.abs(F.xxhash64("url") / 2).cast("long") - 1)
    keyed = given.select("page_id", "url", "html", F.xxhash64(host).alias("host"), page.alias("page"), F.xxhash64("html", "url").alias("sig"))
    parts = ranges(given)
    counted = keyed.select("host", "page", "html").mapInArrow(lean(_suffixes(run, structure, parts)), "part int, keys binary, pages binary, counts binary, opens binary, which binary, hosts binary")
    repeats = saved(counted.repartitionById(parts, "part").groupBy("part").applyInArrow(_repeats, "key long, host long, pages long, in_open boolean"), "repeats")
    # Only repeats that decide about a block return: those in open blocks, and what most pages of a host have.
    hosts = keyed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= WIDE)
    wide = F.coalesce(F.col("pages") * 2 > F.col("of"), F.lit(False))
    asked = saved(repeats.join(hosts, "host", "left").select("key", wide.alias("wide"), "in_open").where("wide OR in_open").select("key", "wide"), "asked")
    shown = "page_id long, url string, text string"
    if asked.isEmpty():
        return given.withColumn("found", F.lit(None).cast("array<struct<block: int, some: int, wide: int>>")).mapInArrow(lean(_keep(run, structure)), shown)
    places = keyed.select("host", "page", "sig", "html").mapInArrow(lean(_places(run, structure)), "key long, page long, sig long, block int, at int, weight int")
    place = places.join(asked, "key").groupBy("page", "sig", "block", "at").agg(F.max("weight").alias("weight"), F.max("wide").alias("wide"))  # rows may repeat
    judged = place.groupBy("page", "sig", "block").agg(F.sum("weight").cast("int").alias("some"), F.sum(F.when(F.col("wide"), F.col("weight")).otherwise(0)).cast("int").alias("wide"))
    found = saved(judged.groupBy("page", "sig").agg(F.collect_list(F.struct("block", "some", "wide")).alias("found")), "found")
    return keyed.join(found, ["page", "sig"], "left").select("page_id", "url", "html", "found").mapInArrow(lean(_keep(run, structure)), shown)
