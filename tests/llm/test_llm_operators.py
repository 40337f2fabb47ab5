"""Operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeated
rows, empty tables, columns with clashing names."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import bpe, chat, components, exactdup, hmm, neardup, packing, pages, quality, substrings, vectors, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"W{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", "One", "two words", "two words", "ONE"]
    base = [prose(rng, n, 4000) for n in (30, 60, 90, 400)]
    texts += base + base[:2]
    for b in base * 4:
        w = b.split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = prose(rng, 40, 4000)
    texts += [prose(rng, 20, 4000) + " " + passage + "\n" + prose(rng, 15, 4000) for _ in range(12)]
    texts += ["x" * 5000, "same " * 300, prose(rng, 12000, 9000)]
    return dict(enumerate(texts))


def frame(spark, texts, parts=3):
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in texts.items()] if isinstance(texts, dict) else texts
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def clashing(df):
    """The rows with columns named like those that operators make."""
    for c in "node component text_sha256 fp norm batch part key row at n kept score label a c u v places _id given _kept_id d words".split():
        df = df.withColumn(c, F.lit(1))
    return df


# ---- words ---------------------------------------------------------------------------------


def test_words_agree_with_the_pattern():
    texts = ["a b", " lead", "trail ", "", "\x0b\x1c\x85\xa0é  x", "A\nB\tC\rD\x0cE"]
    data = [t.encode() for t in texts]
    raw, at = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    start, end, first = words.spans(raw, at)
    got = [[b"".join(data)[s:e].decode() for s, e in zip(start[a:b], end[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    one, _ = words.hashes(np.frombuffer(b"Ab aB \xc3\x89", np.uint8), np.array([0, 8]), fold=True)
    assert one[0] == one[1] != one[2]


# ---- chat ----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = "\\### Assistant: </turn> ok <next>\\s\\l<turn:user>\\"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", "a"), (1, 2, "assistant", nasty), (1, 3, None, None), (1, 3, None, None), (2, 5, "x>y", ""), (2, 4, "assistant", "é" * 3), (None, None, "user", "q"), (3, 1, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in mine]
        assert got[conv].loss_text == "".join(x for _, r, x in mine if r == "assistant")
        spans = [got[conv].formatted[s.start : s.start + s.length] for s in got[conv].loss_spans]
        assert len(spans) == sum(r == "assistant" for _, r, _ in mine)
    assert got[1].formatted.count("<turn:") == 3 and "</turn>" not in got[1].formatted.replace("</turn>\n", "")
    assert chat.digests(chat.read_chats(chat.format_chats(df.limit(0)))).count() == 0
    assert {r.conv_id: r.loss_chars for r in chat.digests(chat.read_chats(chat.format_chats(chat.with_probe(df)))).collect()}[-7] == 26


def test_chat_ties_go_by_the_given_text(spark):
    rows = [(1, 0, "user", "<a"), (1, 0, "user", "A"), (1, 0, "user", "\\z"), (1, 0, "user", None), (1, 0, "user", "A")]
    got = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))).first()
    assert [t.text for t in got.turns] == ["", "<a", "A", "A", "\\z"]


# ---- pages ---------------------------------------------------------------------------------


def test_blocks_of_a_page():
    page = "<!DOCTYPE html><head><title>t</title><script>var t='</p>';</script></head><body><header>top</header><nav><ul><li>a<li>b</ul></nav><!-- <p>no</p> --><div class='cookie-notice'>c</div><main><h1>Head &amp; tail</h1><p>One\n two<br>three<p>&#233;&nbsp;x &lt;b&gt;<aside>side</aside><section id=comments><article>reader</article></section><form><input>f</form></main><footer>&copy;</footer>"
    texts, roles = pages.blocks(page)
    assert [t for t, r in zip(texts, roles) if r == pages.MAIN] == ["Head & tail", "One two three", "é x <b>"]
    nested = "<article class='post'><div class='article-comments'><p>c</p></div><div class='article-body'><p>a</p><p class=ad>ad</p></div><p>b <span class=ad>x</span></p></article><p>after</p>"
    assert [t for t, r in zip(*pages.blocks(nested)) if r == pages.MAIN] == ["a", "b"]
    assert [t for t, r in zip(*pages.blocks("<main><article class='comment'><p>r</p></article><p>t</p></main>")) if r == pages.MAIN] == ["t"]
    assert pages.blocks("") == ([], []) and pages.blocks("just text") == (["just text"], [pages.OPEN])


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    token, group = rng.integers(0, 3, 300).astype(np.uint64), np.repeat(np.arange(10), 30)
    for depth in (1, 3, 5, 8):
        rank = pages.suffix_order(token, group, depth)
        seen = {}
        for i, r in enumerate(rank):
            own = tuple(token[i : min(i + depth, (group[i] + 1) * 30)].tolist())
            assert seen.setdefault(int(r), own) == own
        assert [seen[r] for r in sorted(seen)] == sorted(set(seen.values()))


def test_equal_passages_elect_equal_suffixes():
    rng = np.random.default_rng(2)
    length = np.array([1, 3, 7, 8, 9, 14, 15, 16, 40, 200, 7, 40])
    first = np.concatenate([[0], np.cumsum(length)])
    token = rng.integers(0, 2**63, first[-1]).astype(np.uint64)
    token[first[-2] :] = token[first[8] : first[9]]  # the last block repeats the ninth
    place, weight, key = pages.elected(token, first, 8)
    block = np.searchsorted(first, place, side="right") - 1
    assert [int(weight[block == k].sum()) for k in range(12)] == [max(n - 14, 1) for n in length]
    for k, n in enumerate(length.tolist()):
        mine = place[block == k] - first[k]
        for w in range(max(n - 14, 1)):  # every window of eight neighbouring suffixes elects one
            assert any(w <= p < w + 8 for p in mine.tolist())
    assert (place[block == 8] - first[8]).tolist() == (place[block == 11] - first[11]).tolist() and key[block == 8].tolist() == key[block == 11].tolist()


def test_broken_markup_takes_linear_time():
    for bad in ("<a ", "<a x=\"", "<a '", "<!x ", "<script></script ", "</p", "<div>", "<p></div>", "<"):
        begin = time.time()
        pages.blocks("<p>x</p>" + bad * (1_000_000 // len(bad)))
        assert time.time() - begin < 8, bad
    assert pages.blocks("<p>x</p><a <b>bold</b>")[0][0] == "x"
    assert pages.blocks("<div>" * 100_000 + "deep" + "</p>" * 100_000)[0] == ["deep"]


def test_host_repeats_go_and_unique_runs_stay(spark):
    rng = random.Random(3)
    menu = "Home About us Contact Imprint and some more words here to read"
    rows, want = [], {}
    for k in range(40):
        own = prose(rng, 30, 5000)
        rows.append((k, f"https://h{k % 2}.example.org/{k}", f"<div>{menu}</div><div>{own}</div><div>{menu} again</div>"))
        want[k] = own
    rows += [(90, None, None), (91, "", ""), (92, "https://only.example.org", f"<p>{menu}</p>"), (93, "https://h0.example.org/x", f"<article><p>{menu}</p></article><div>{menu}</div>"), (94, "https://t.example.org", f"<p>{menu}</p>"), (94, "https://t.example.org", f"<p>{menu}</p>")]
    want |= {90: "", 91: "", 92: menu, 93: menu, 94: menu}
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(5)
    got = pages.extract(df).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    assert pages.extract(df.limit(0)).count() == 0


def test_suffix_arrays_alone(spark):
    rng = random.Random(4)
    own = {k: prose(rng, 25, 9000) for k in range(12)}
    menu, foot = prose(rng, 12, 9000), prose(rng, 9, 9000)
    rows = [(k, "http://a.org/x", f"<nav><p>{menu}</p></nav><article><p>{t}</p><p>{foot}</p></article>") for k, t in own.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in pages.extract(df, structure=False).collect()} == own
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == own  # most pages have the foot


def test_shared_text_of_an_article_stays_where_few_pages_or_copies_share_it(spark):
    rng = random.Random(6)
    told, whole = prose(rng, 15, 9000), prose(rng, 60, 9000)
    rows = [(k, "http://c.org/x", f"<article><p>{prose(rng, 25, 9000)}</p>{f'<p>{told}</p>' if k < 5 else ''}</article>") for k in range(12)]
    rows += [(k, "http://d.org/x", f"<article><h1>Same</h1><p>{whole}</p></article>") for k in range(20, 32)]  # copies of one article
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert all(got[k].endswith(told) == (k < 5) for k in range(12)) and all(got[k] == f"Same\n{whole}" for k in range(20, 32))


def test_text_beside_an_article_stays_unless_the_host_repeats_it(spark):
    rng = random.Random(5)
    own, told = {k: prose(rng, 25, 9000) for k in range(6)}, prose(rng, 15, 9000)
    rows = [(k, "http://b.org/x", f"<article><p>Teaser {k}</p></article><div>{t}</div><div>{told}</div>") for k, t in own.items() if k]
    rows.append((0, "http://b.org/y", f"<main><p>{own[0]}</p><p>{told}</p></main>"))
    rows.append((9, "http://b.org/z", f"<div>{own[0]}</div><div>short and unique</div>"))  # repeated from main text
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    want = {k: f"Teaser {k}\n{t}" for k, t in own.items() if k} | {0: f"{own[0]}\n{told}", 9: "short and unique"}
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == want


# ---- packing and encoding ------------------------------------------------------------------


def test_packing_places_every_piece(spark):
    texts = corpus() | {900: "<|endoftext|> \x1c ²3 日本", 901: None}
    rows = [(d, t, "en", "s", 1) for d, t in texts.items()] + [(3, "one", "en", "s", 1), (None, "two", "en", "s", 1)]
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    got = packing.pack(clashing(frame(spark, rows)), path).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in by_doc[d]})
        assert b"".join(m[4] for m in mine) == ids.tobytes()
        assert all(zlib.crc32(m[4]) == m[3] and (m[2] == 1024 or m[0] == 0) for m in mine)
    assert len(by_doc[3]) == 2 and len(by_doc[None]) == 1
    assert packing.pack(frame(spark, texts).limit(0), path).count() == 0


@pytest.mark.parametrize("size,seed", [(32, 1), (100, 2), (1024, 3), (7, 4)])
def test_plans_pack_all_and_search_never_hurts(size, seed):
    rng = random.Random(seed)
    for _ in range(20):
        counts = Counter(rng.choices(range(1, size + 1), k=rng.randrange(1, 400)))
        first = packing.best_fit(counts, size)
        best = packing.local_search(first, size)
        used = Counter()
        for pattern, n in best.items():
            assert n > 0 and sum(pattern) <= size
            for x in pattern:
                used[x] += n
        assert used == counts and sum(best.values()) <= sum(first.values())
        assert sum(best.values()) <= 11 / 9 * -(-sum(x * n for x, n in counts.items()) // size) + 1


@pytest.mark.parametrize("size,lengths,left,best", [(12, [6, 5, 5, 4, 2, 2], 3, 2), (100, [63, 62, 50, 34, 32, 22, 18, 16], 4, 3), (50, [31, 27, 24, 22, 17, 16, 15, 14, 12, 11], 5, 4)])
def test_search_empties_sequences_that_best_fit_leaves(size, lengths, left, best):
    counts = Counter(lengths)
    first = packing.best_fit(counts, size)
    assert sum(first.values()) == left and sum(packing.local_search(first, size).values()) == best == -(-sum(lengths) // size)


def test_search_looks_at_every_length_of_a_pattern():
    assert (3, 500) in packing._parts((500, *[20] * 24, 3)) and len(packing._parts(tuple(range(44, 0, -1)))) == 1 + 44 + 44 * 43 // 2


def test_search_empties_a_sequence():
    start = Counter({(6,): 1, (5, 4): 1, (4, 3): 1, (3,): 1, (3, 3): 1})
    assert sum(packing.local_search(start, 10).values()) < sum(start.values())


def test_chunks_resynchronise():
    split, code = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "'s", "'ll", "'", "1", "²", "é", "日本", "!!", "\t", "\x1c", "\xa0", "x" * 50, " " * 40, "_", "😀", "<|endoftext|>"]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(100)))
        size, overlap = rng.choice([3, 10, 40]), rng.choice([1, 5, 30])
        starts, parts = bpe.cut(t, size, overlap)
        packed = code.encode(bpe.stitched([split(p) for p in parts], starts, t, split))
        assert np.frombuffer(packed, "<u4").tolist() == own.encode_ordinary(t)
        assert code.decode(packed) == t.encode()


def test_encoding_rows(spark):
    texts = corpus()
    rows = [(d, t, "en", "s", 1) for d, t in texts.items()] + [(None, "q", "en", "s", 1), (3, "one", "en", "s", 1)]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = clashing(frame(spark, rows))
    got = bpe.encode_texts(df, path, P.PATTERN, size=1000, overlap=50, spread=2000).collect()
    _, code = bpe.codec(path, P.PATTERN)
    assert len(got) == len(rows)
    for r in got:
        want = "q" if r.doc_id is None else texts[r.doc_id] or ""
        assert bytes(r.decoded) == want.encode() and np.frombuffer(bytes(r.ids), "<u4").tolist() == code._encoding.encode_ordinary(want) and r.n_tokens * 4 == len(r.ids)
    assert bpe.encode_texts(df.limit(0), path, P.PATTERN).count() == 0


# ---- duplicates ----------------------------------------------------------------------------


def test_counting_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 50, 200, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(5)]
    merged = exactdup.CountingQuotientFilter.of(parts[0])
    for p in parts[1:]:
        merged = merged.merge(exactdup.CountingQuotientFilter.unpack(exactdup.CountingQuotientFilter.of(p).pack()))
    want = Counter(np.concatenate(parts).tolist())
    assert dict(zip(merged.prints().tolist(), merged.counts.tolist())) == dict(want)
    for lead in (1, 3, 9):
        cut = list(merged.cut(lead))
        assert [x for k, f in cut for x in f.prints(k).tolist()] == sorted(want)
        assert [x for k, f in cut for x in exactdup.CountingQuotientFilter.unpack(f.pack()).prints(k).tolist()] == sorted(want)
        k, one = cut[0]
        both = one.merge(exactdup.CountingQuotientFilter.unpack(one.pack()))
        assert both.prints(k).tolist() == one.prints(k).tolist() and both.counts.tolist() == (2 * one.counts).tolist()
    rare = exactdup.CountingQuotientFilter.of(np.array([5, 2**63, 5, 2**64 - 1], np.uint64))
    assert rare.merge(exactdup.CountingQuotientFilter.of(np.empty(0, np.uint64))).prints().tolist() == [5, 2**63, 2**64 - 1]
    assert exactdup.merged([rare] * 5).counts.tolist() == [10, 5, 5]


def test_exact_groups(spark):
    texts = corpus()
    rows = [(d, t, "en", "s", 1) for d, t in texts.items()] + [(3, "one", "en", "s", 1), (None, "one", "en", "s", 1), (None, "alone", "en", "s", 1)]
    df = clashing(frame(spark, rows))
    got = exactdup.exact_groups(df).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(d)
    want = Counter()
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        for d in ids:
            want[d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exactdup.exact_groups(df.limit(0)).count() == 0
    kept = exactdup.drop_copies(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in kept.collect()} == {max(i for i in ids if i in texts) for ids in groups.values() if any(i in texts for i in ids)}


@pytest.mark.parametrize("setting", [neardup.CONTRACT, neardup.Setting()])
def test_near_groups(spark, setting):
    texts = corpus()
    df = clashing(frame(spark, texts))
    want = neardup.brute_force(texts, setting)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(df, setting).collect()}
    assert got == want
    kept = neardup.drop_near_copies(frame(spark, texts), setting)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_near_groups_of_awkward_rows(spark):
    df = frame(spark, [(5, "a b c d", "en", "s", 1), (5, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (None, "a b c d", "en", "s", 1), (None, None, "en", "s", 1)])
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(df).collect())
    assert got == Counter({(5, 2, 4, False): 2, (4, 2, 4, True): 1, (None, 2, None, True): 1, (None, 0, None, True): 1})
    assert neardup.near_groups(df.limit(0)).count() == 0


def test_strays_of_a_large_bucket(spark):
    """Links between members of which neither is the centre of a bucket."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(200)]
    texts = {}
    for d in range(320):
        w = list(base)
        for p in rng.sample(range(200), rng.randrange(0, 9)):
            w[p] = f"r{rng.randrange(6)}_{p}"
        texts[d] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(frame(spark, texts), neardup.CONTRACT).collect()}
    assert got == neardup.brute_force(texts, neardup.CONTRACT)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (None, 3), (3, None)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            r, s = sorted((root(a), root(b)))
            up[s] = r
    nodes = {x for p in links if None not in p for x in p}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in nodes if root(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("size", [20, 8])
def test_repeated_windows(spark, size):
    texts = corpus(2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(clashing(frame(spark, texts)), size, texts=False).collect()}
    assert got == substrings.brute_force(texts, size)


def test_repeated_windows_of_awkward_rows(spark):
    long = " ".join(f"k{i}" for i in range(30))
    df = frame(spark, [(1, long, "en", "s", 1), (None, long, "en", "s", 1), (2, None, "en", "s", 1), (3, long + "\nand  more", "en", "s", 9)])
    got = {r.doc_id: (r.text, r.n_chars) for r in substrings.remove_repeats(clashing(df)).collect()}
    assert got == {1: (long, len(long)), None: (long, len(long)), 2: (None, None), 3: ("and more", 8)}
    assert substrings.dedup_substrings(df.limit(0)).count() == 0


def test_segments_may_be_cut_anywhere(monkeypatch, spark):
    monkeypatch.setattr(substrings, "_SLAB", 7)
    texts = [t or "" for t in corpus(5).values()]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    word, first = words.hashes(raw, at, fold=False)
    _, start, runs, row = substrings.segments(word, first, 20, 6)
    covered = sorted(s + k for s, n in zip(start.tolist(), runs.tolist()) for k in range(n))
    assert covered == [i for a, b in zip(first[:-1].tolist(), first[1:].tolist()) for i in range(a, b - 19)]
    assert all(first[r] <= s and s + n + 19 <= first[r + 1] for s, n, r in zip(start, runs, row))


# ---- vectors -------------------------------------------------------------------------------


def naive_vectors(rows, cosine):
    n, up = Counter(), {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def usable(r):
        return r[0] is not None and r[1] is not None and r[2] and all(c is not None and math.isfinite(c) for c in r[2]) and any(r[2])

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if usable(a) and usable(b) and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2]), np.array(b[2])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    r, s = sorted((root(a[0]), root(b[0])))
                    up[s] = r
    return {k: (n[k], root(k)) for k in up}


@pytest.mark.parametrize("dim,blocks,chunk", [(16, 4, 4096), (64, 8, 40), (3, 8, 4096), (1, 8, 4096)])
def test_near_vectors(spark, monkeypatch, dim, blocks, chunk):
    monkeypatch.setattr(vectors, "_CHUNK", chunk)
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((6, dim))
    rows = [(i, int(i % 3), (centres[i % 6] + rng.standard_normal(dim) * 0.25).astype(np.float32).tolist()) for i in range(240)]
    rows += [(500, 1, rows[1][2]), (501, 1, [x * 7 for x in rows[1][2]]), (502, None, rows[1][2]), (503, 1, None), (504, 1, []), (505, 1, [0.0] * dim), (506, 1, [math.nan] * dim), (507, 1, [None] * dim), (508, 1, [math.inf] * dim), (509, 1, [1.0, 2.0, 3.0, 4.0, 5.0])]
    df = clashing(spark.createDataFrame([(i, la, e) for i, la, e in rows], "vec_id long, label int, embedding array<float>").withColumnRenamed("label", "kind")).drop("label").withColumnRenamed("kind", "label").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, 0.93, blocks).collect()}
    assert got == naive_vectors(rows, 0.93)
    assert vectors.near_vectors(df.limit(0)).count() == 0


# ---- models --------------------------------------------------------------------------------


def test_quality_learns_from_labels(spark):
    rng = random.Random(6)
    rows, labels = [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0)], []
    for d in range(400):
        good = rng.random() < 0.6
        w = prose(rng, 40, 300).split()
        rows.append((d, " ".join(w) if good else " ".join(x + rng.choice(["###", "$$$"]) for x in w), "en", "s", 1))
        labels.append((d, int(good), 0))
    labels += [(None, 1, 0), (5, None, 0), (6, 7, 0)]
    df, lab = clashing(frame(spark, rows)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(df, lab).collect()}
    assert len(got) == len(rows) and got[9000].score == got[9001].score
    held = [(r.predicted, labels[d][1]) for d, r in got.items() if r.held_out and d < 400]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.97
    assert {r.score for r in quality.quality(df, lab.limit(0)).collect()} == {0.5}
    assert quality.quality(df.limit(0), lab).count() == 0
    good = {r.doc_id for r in quality.keep_good(frame(spark, rows), lab).collect()}
    assert good == {d for d, r in got.items() if r.predicted}


def test_hidden_markov_scores(spark):
    rng = random.Random(7)
    texts = {d: prose(rng, rng.randrange(0, 60), 50 if d % 2 else 80) for d in range(150)} | {900: None, 901: "", 902: "Ab aB AB", 903: prose(rng, 3000, 50)}
    shape = hmm.Shape(states=3, rounds=3)
    rows = [(d, t, "en", "s", 1) for d, t in texts.items()] + [(None, "w1 w2", "en", "s", 1), (902, "Ab aB AB", "en", "s", 1)]
    got = hmm.score(clashing(frame(spark, rows)), shape).collect()
    assert len(got) == len(rows)
    token = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), "\n"] for d, t in texts.items()}
    counts = Counter(w for d, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 10 for w in token[d])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        w = token[r.doc_id] if r.doc_id is not None else ["w1", "w2", "\n"]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    assert hmm.score(frame(spark, rows).limit(0), shape).count() == 0


def test_training_reads_whole_texts_to_the_end(spark):
    """What only the later parts of texts say shapes the model, whatever the sample's settings."""
    rng = random.Random(8)
    texts = {d: " ".join(["x"] * 20 + [rng.choice("ab" if j // 8 % 2 else "cd") for j in range(160)]) for d in range(60)}
    df = frame(spark, texts).select("doc_id", "text")
    base = np.ones(65)
    got = hmm.train(df.where("crc32(cast(cast(doc_id AS string) AS binary)) % 10 <> 0"), base, hmm.Shape(states=2, rounds=30, settled=1e-4), 6)
    learnt = [t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 10]
    raw, at = pages.buffers(pages.pa.array(learnt))
    tokens, offsets, _ = hmm._sequences(raw, at, 6)
    want, before = hmm.Model.guess(base, 2), -np.inf
    for n in range(1, 1000):
        counts, said = hmm.estep(want, tokens, offsets, 50)
        want = want.fitted(counts, 20.0)
        if said / len(tokens) - before < 1e-4:
            break
        before = said / len(tokens)
    assert n > 2 and np.allclose(got.step, want.step, rtol=1e-3) and np.allclose(got.emit, want.emit, rtol=1e-2)


def test_forward_and_expected_counts():
    """Likelihoods against the sum over all paths; expected counts against their definition."""
    import itertools

    rng = np.random.default_rng(3)
    model = hmm.Model.guess(rng.uniform(0.5, 1.5, 5), 2)
    tokens, offsets = np.array([0, 3, 1, 4, 2, 4, 4]), np.array([0, 4, 6, 7])
    got = hmm.forward(model, tokens, offsets)
    counts = np.zeros(2 + 4 + 10)
    for k in range(3):
        seq, total, own = tokens[offsets[k] : offsets[k + 1]], 0.0, np.zeros(16)
        for path in itertools.product(range(2), repeat=len(seq)):
            p, c = model.start[path[0]], np.zeros(16)
            c[path[0]] += 1
            for i, (z, x) in enumerate(zip(path, seq)):
                if i:
                    p *= model.step[path[i - 1], z]
                    c[2 + 2 * path[i - 1] + z] += 1
                p *= model.emit[x, z]
                c[6 + 2 * x + z] += 1
            total += p
            own += p * c
        counts += own / total
        assert math.isclose(got[k], math.log10(total), rel_tol=1e-9)
    for room in (1, 2, 3, 100):
        assert np.allclose(hmm.estep(model, tokens, offsets, room)[0], counts, rtol=1e-4, atol=1e-5)
    better = model.fitted(counts, 0.001)
    assert hmm.forward(better, tokens, offsets).sum() > got.sum()


# ---- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    texts = {d: prose(rng, rng.randrange(30, 200), 5000) for d in range(120)}
    texts |= {200: texts[1], 201: "".join(c.upper() if c.isascii() else c for c in texts[1]), 202: texts[2] + " w", 203: " ".join(texts[3].split()[:28]) + " " + prose(rng, 100, 5000)}
    bad = {300 + k: " ".join(w + "###" for w in prose(rng, 80, 5000).split()) for k in range(80)}
    frame(spark, texts | bad).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 300), 0) for d in texts | bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen.append({r.doc_id: r.text for r in docs.collect()})
    good, exact, near, sub = seen
    assert set(texts) <= set(good) and not set(good) & set(bad)
    assert set(good) - set(exact) == {1, 200}
    brute = neardup.brute_force(exact, neardup.Setting())
    assert set(near) == {d for d in exact if brute[d][1] == d}
    left = substrings.brute_force(near, 20)
    assert all((left[d][1] == 0) == (sub[d] == near[d]) for d in near)
    assert sum(len(t.split()) for t in near.values()) - sum(len(t.split()) for t in sub.values()) == sum(n for _, n, _ in left.values())
    assert {r.doc_id for r in docs.collect()} == set(sub)


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names, no labels and no rows."""
    import corpus_pipeline

    long = " ".join(f"k{i}" for i in range(60))
    rows = [(1, long, "en", "s", 9), (1, long, "en", "s", 9), (None, long, None, None, None), (None, None, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "x" * 300_000, "en", "s", 1), (5, long + " tail", "en", "s", 1), (6, "one two", "en", "s", 1), (7, "ONE two", "en", "s", 1)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(frame(spark, rows))
    want = {
        "quality": Counter(r[0] for r in rows),  # without labels nothing is rejected
        "exact_dedup": Counter([1, 1, 3, 4, 5, 7]),  # the row without an id and the null text have equals with one
        "near_dedup": Counter([1, 1, None, None, 2, 3, 4, 6]),  # 5 is near 1, and 7 has the words of 6
        "substring_dedup": Counter(r[0] for r in rows),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "packing":
            ends = [r.start + r.length for r in got]
            assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in got}) == len(got) and max(ends) > 30_000 and sum(r.piece == 0 for r in got) == len(rows)
        else:
            assert out.columns == docs.columns and Counter(r.doc_id for r in got) == want[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_classifier_learns_from_repeated_and_long_texts(spark):
    rows = [(d, ("good words here " if d % 2 else "zzz bad !!! ") * (30_000 if d < 4 else 20), "en", "s", 1) for d in range(40)]
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(30)] * 2 + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(clashing(frame(spark, rows + rows[:2] + [(None, "good words here", "en", "s", 1)])), labels).collect()
    assert len(got) == 43 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None)
