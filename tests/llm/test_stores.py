"""Token stores, ranked search and conversation tries against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quakeframe.llm import conversation_trie as trie
from quakeframe.llm import lexical, token_store, url_filter
from tests.llm.test_llm import DOCS, ODD, odd

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# -- 3 URL filters ---------------------------------------------------------------------


def test_thousands_of_rules_that_share_tokens(spark):
    """Every rule's expression on every URL, in plain Python."""
    rng = random.Random(9)
    words = ["com", "net", "en", "de", "shop", "news", "x", "rated", "a1", "b2", "c3"] + [f"w{k}" for k in range(40)]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    rules = [url_filter.prefix_rule(".".join(pick(rng.choice([1, 2]))) + "/" + "/".join(pick(rng.choice([1, 2, 3]))) + rng.choice(["/", ""]), rng.choice(["allow", "block"])) for _ in range(1500)]
    rules += [url_filter.word_rule(rng.choice("-_.").join(pick(rng.choice([1, 2, 3])))) for _ in range(800)]
    rules += [url_filter.word_rule("x-rated"), url_filter.Rule("free", 0, 1, "block", r"[0-9]{4}", ()), url_filter.Rule(None, 1, 0, "allow", "", ())]
    urls = ["http://" + ".".join(pick(rng.choice([1, 2, 3]))) + "/" + rng.choice("/-_.").join(pick(rng.choice([0, 1, 3, 6]))) + rng.choice(["", "?q=casino", "#x", "/2024"]) for _ in range(400)]
    urls += ["http://q.q/x-rated/", "http://q.q/x_rated", None, "no scheme", "http://", "http://q.q/12345", "http://q.q/", ""]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, tuple(rules)).collect()}
    compiled = [(re.compile(r.pattern), r) for r in rules]
    for k, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        place = host.lower() + re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(-r.tier, r.size, -i, r) for i, (p, r) in enumerate(compiled) if p.search(place)] if url is not None else []
        won = max(fits, key=lambda x: x[:3])[3] if fits else None
        assert got[k] == ((won.name, won.verdict) if won else (None, "allow")), url
    assert len(got) == len(urls)
    assert got[400] == (None, "block")


# -- 11 token store --------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return token_store.Encoder(BYTES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text("ab'stredvmSL \n\t　!?1²é漢😀\x1c\x85_-", max_size=40)), max_size=6))
def test_encoder_is_the_library(encoder, texts):
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder.encode(texts)] == want


def test_encoder_odd_texts(encoder):
    texts = ["x" * 300_000, "<|endoftext|> a <|endoftext|>", "", None, "don't've''s 's\n's", " " * 5000 + "a", "a" + "\n" * 3000, "ab " * 500_000]
    want = [e.ids for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in encoder.encode(texts)] == want


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(token_store, "WORDS", 200)
    small, rng = token_store.Encoder(BYTES), random.Random(2)
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 5]))) for _ in range(60)) for _ in range(3)]
        assert [x.tolist() for x in small.encode(texts)] == [e.ids for e in small.library.encode_batch(texts, add_special_tokens=False)]
        assert small.rows <= 200


def test_words_that_share_a_tag(monkeypatch, encoder):
    """All words with one tag: the first is found by its letters, the others by the dictionary."""
    blind = token_store.Encoder(BYTES)
    blind.random = np.zeros_like(blind.random)
    texts = ["the cat sat on the mat", "the dog sat on the cat"] * 3
    for _ in range(2):
        assert [x.tolist() for x in blind.encode(texts)] == [x.tolist() for x in encoder.encode(texts)]
    assert blind.clashes


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    array = np.array(sorted(keys), np.uint64)
    slots = token_store.PerfectHash.build(array).slots(array)
    assert sorted(slots.tolist()) == list(range(len(keys)))


def stored(rows):
    """Brute force: the library, one document after another."""
    library, out, start = Tokenizer.from_file(BYTES), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, token_store.stored_digests(docs, BYTES).collect()))
    assert got == sorted(stored([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_store_files_and_keys(spark, monkeypatch):
    monkeypatch.setattr(token_store, "PART_KEYS", 10)  # many parts
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    store = token_store.write_store(docs, BYTES)
    again = token_store.Store.open(store.folder)
    assert len(again.parts) == 20 and again.docs.sum() == 200
    payload = b"".join(token_store._read(f"{again.folder}/{f}.bin") for f in again.files)
    want = stored([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len(payload) == 2 * sum(n for _, _, n, _ in want)
    keys = spark.createDataFrame([(k,) for k in (3, 150, 3, 10**12, -5, 199)], "key long")
    found = {r["doc_id"]: r for r in token_store.fetch(spark, again, keys, "key").collect()}
    assert sorted(found) == [3, 150, 199]  # foreign keys have other fingerprints
    for doc_id, start, n, crc in want:
        if doc_id in found:
            ids = np.frombuffer(payload, "<u2", n, 2 * start)
            assert found[doc_id]["ids"] == ids.tolist() and found[doc_id]["start"] == start
            assert zlib.crc32(ids.astype("<u4").tobytes()) == crc


def test_store_odd_rows(spark):
    rows = ODD + [(9, f"repeated {k % 7}", "en", "s", 1) for k in range(60)] + [(None, "another", None, None, None)]
    got = token_store.stored_digests(odd(spark, rows).repartition(6), BYTES).collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((n, c) for _, _, n, c in stored([(r[0], r[1]) for r in rows]))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in in_order] == np.cumsum([0] + [r["n_tokens"] for r in in_order[:-1]]).tolist()
    ids = [r["doc_id"] for r in in_order]
    assert ids == sorted(ids, key=lambda k: (k is not None, k or 0))
    assert token_store.stored_digests(spark.createDataFrame([], DOCS), BYTES).count() == 0


# -- 12 ranked search ------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df, out = Counter(w for _, c in counts for w in c), []
    for item, text in items:
        asked, scores = Counter(TERM.findall((text or "").translate(FOLD))), []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, times in asked.items() if w in c)
            if score > 0:
                scores.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,splits,together", [(1 << 22, 64, 64), (2000, 1, 3), (1 << 15, 2, 1)])
def test_ranking_matches_scoring_all(spark, monkeypatch, block, splits, together):
    monkeypatch.setattr(lexical, "SPLITS", splits)
    monkeypatch.setattr(lexical, "TOGETHER", together)
    rng = random.Random(block)
    words = [f"w{k}" for k in range(60)] + ["été", "Ñu", "9a"]
    docs = [(k * 7 % 400, " ".join(rng.choices(words, [1 / (1 + j) for j in range(63)], k=rng.choice([0, 3, 20, 90])))) for k in range(400)]
    docs += [(1000 + k, "w1 w2 w3 the same text w40") for k in range(120)]  # ties
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 4, 25])))) for k in range(17)] + [(99, "w40 w3 w1"), (100, "nothing known"), (101, None)]
    made = lexical.index_block
    size = max(1, block // 100)

    def cut(ids, texts):
        return made(ids, texts)

    blocks = [cut(np.array([i for i, _ in docs[a : a + size]], np.int64), [t for _, t in docs[a : a + size]]) for a in range(0, len(docs), size)]
    rows = [tuple(bytearray(np.asarray(x, kind).tobytes()) for x, (_, kind) in zip(b, lexical._FIELDS, strict=True)) for b in blocks]
    index = spark.createDataFrame(rows, lexical._INDEX).repartition(3)
    # Workers import the module anew, so the search itself also runs here with the settings above.
    queries = lexical.Queries.of([t for _, t in items])
    n_docs, n_terms = lexical.totals(index)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in lexical.frequencies(index, queries).tolist()], np.int64)
    best = lexical.Best(len(items), 10)
    for b in blocks:
        lexical.search_block({name: np.asarray(x, kind) for x, (name, kind) in zip(b, lexical._FIELDS, strict=True)}, queries, weights, n_docs, n_terms, best)
    here = sorted(((items[q][0], r + 1, int(best.doc[q, r]), int(best.score[q, r])) for q, r in zip(*np.nonzero(best.score), strict=True)), key=repr)
    want = ranked(docs, items)
    assert here == want
    assert sorted(map(tuple, lexical.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr) == want


def test_interval_search_leaves_most_documents(monkeypatch):
    """Rare terms decide: most documents are never split off."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"c{k}" for k in range(20)], k=30)) for _ in range(3000)]
    for k in range(12):
        texts[k * 200] += " rare" * 3
    block = {n: np.asarray(x, kind) for x, (n, kind) in zip(lexical.index_block(np.arange(3000), texts), lexical._FIELDS, strict=True)}
    queries, best, seen = lexical.Queries.of(["rare c1"]), lexical.Best(1, 10), []
    add = lexical.Best.add
    monkeypatch.setattr(lexical.Best, "add", lambda self, item, score, doc: (seen.append(len(item)), add(self, item, score, doc)))
    monkeypatch.setattr(lexical, "SPLITS", 1)
    df = [int(np.diff(block["offsets"])[queries.terms(block)[1][list(queries.terms(block)[0]).index(t)]]) for t in range(2)]
    weights = np.array([math.floor(1000 * math.log(6002 / (2 * d + 1))) for d in df])
    lexical.search_block(block, queries, weights, 3000, int(block["lengths"].sum()), best)
    assert best.doc[0].tolist() and set(best.doc[0].tolist()) <= {k * 200 for k in range(12)} and sum(seen) < 40


def test_range_maxima_are_first_places():
    rng = np.random.default_rng(1)
    sizes = np.array([50, 33, 8, 8, 1, 1])
    begins = np.cumsum(sizes) - sizes
    values = rng.integers(0, 9, sizes.sum())
    low, high, want = [], [], []
    for b, n in zip(begins, sizes, strict=True):
        for i in range(n):
            for j in range(i + 1, n + 1):
                low.append(b + i)
                high.append(b + j)
                want.append(b + i + int(np.argmax(values[b + i : b + j])))
    assert lexical.RangeMaxima(values, begins, sizes).places(np.array(low), np.array(high)).tolist() == want


def test_ranking_odd_rows(spark):
    items = spark.createDataFrame([(1, "same words"), (1, "SAME line"), (2, None), (3, ""), (None, "été Σίσυφος"), (4, "wort x")], "item_id long, text string").selectExpr("*", "'clash' as score", "1 as rank")
    got = lexical.rank_documents(odd(spark), items).collect()
    want = ranked([(r[0], r[1]) for r in ODD], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(map(tuple, got), key=repr) == want
    assert lexical.rank_documents(spark.createDataFrame([], DOCS), items).count() == 0
    assert lexical.rank_documents(odd(spark), items.limit(0)).count() == 0


# -- 13 conversation trie --------------------------------------------------------------


def tree(sequences):
    """Nodes of a trie from (conv_id, [(key, words), ...])."""
    members, ends, kids, found, out = defaultdict(list), defaultdict(list), defaultdict(list), {}, []
    for conv, turns in sequences:
        turns = tuple(turns)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
        ends[turns].append(conv)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=lambda p: -len(p)):
        n, words = len(members[p]), p[-1][1] if p else 0
        leaves, saved = sum(found[k][0] for k in kids[p]) or 1, sum(found[k][1] for k in kids[p]) + (n - 1) * words
        found[p] = leaves, saved
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(kids[p]), leaves, saved, digest))
    return sorted(out, key=repr)


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [((r, t), len(re.findall(r"[^\x20\x09-\x0D]+", t))) for _, _, r, t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return [(c, own.get(c - c % 20, [])[: h[c]] + own[c][h[c] :]) for c in own]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
@pytest.mark.parametrize("group", [2, 64])
def test_trie_query(spark, sf, group):
    path = f"/root/testdata/{sf}/conversations.parquet"
    got = trie.conversation_trie(spark.read.parquet(path), group).collect()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(path).to_pylist()]
    assert sorted(map(tuple, got), key=repr) == tree(rebuilt(rows))


@pytest.mark.parametrize("seed", range(4))
def test_trie_of_crowded_prefixes(spark, seed, monkeypatch):
    """Few different turns, many copies, prefixes of others, over many ranges of few sequences."""
    rng = random.Random(seed)
    monkeypatch.setattr(trie, "PIECE", 8)
    convs = [(k, [(bytes([rng.choice(b"ab")]) * 16, 3) for _ in range(rng.choice([0, 1, 2, 5, 9, 30]))]) for k in range(300)]
    convs += [(1000 + k, [(b"a" * 16, 3)] * 4) for k in range(100)]
    words = {b"a" * 16: 3, b"b" * 16: 5}
    convs = [(c, [(k, words[k]) for k, _ in t]) for c, t in convs]
    rows = spark.createDataFrame([(c, [bytearray(k) for k, _ in t], [w for _, w in t]) for c, t in convs], "conv_id long, keys array<binary>, words array<long>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = trie.trie_of(rows, 3).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, got), key=repr) == tree(convs)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=6), min_size=1, max_size=25), st.integers(1, 6))
def test_forests_merge_at_any_boundary(texts, width):
    """Cut anywhere, contracted and merged, two at a time."""
    distinct = sorted(set(texts))
    counts = Counter(texts)
    number = {t: k for k, t in enumerate(distinct)}
    paths = [([c.encode() for c in t], [2] * len(t)) for t in distinct]
    hangs = [[(len(t), counts[t], number[t], 0, 0, 0, t)] for t in distinct]
    nodes, level = [], []
    for g, a in enumerate(range(0, len(paths), width)):
        rows = [r for b in trie.forest(paths[a : a + width], hangs[a : a + width], g, False, False) for r in b.to_pylist()]
        nodes += [r for r in rows if r["forest"] is None]
        level.append([r for r in rows if r["forest"] is not None])
    while True:
        groups, close = [level[a : a + 2] for a in range(0, len(level), 2)], len(level) <= 2
        level = []
        for g, some in enumerate(groups):
            both = [r for rows in some for r in rows]
            rows = [r for b in trie.forest([(r["keys"], r["words"]) for r in both], [[tuple(h[k] for k in trie._HANG.names) for h in r["hangs"]] for r in both], g, close, True) for r in b.to_pylist()]
            nodes += [r for r in rows if r["forest"] is None]
            level.append([r for r in rows if r["forest"] is not None])
        if close:
            break
    late = {r["digest"]: r["conv_id"] for r in nodes if r["digest"]}
    got = [(r["conv_id"], r["depth"], late[r["parent_digest"]] if r["parent_digest"] else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in nodes]
    want = [x[:7] for x in tree([(number[t], [(c, 2) for c in t]) for t in texts])]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_trie_odd_rows(spark):
    long = [(45, k, "user", f"turn {k}") for k in range(3000)]
    rows = [(0, 1, "user", "b"), (0, None, "user", "a"), (0, 2, None, None), (7, 0, None, ""), (7, 0, None, ""), (7, 1, "x", "y" * 200_000), (None, 1, "user", "lost"), (-3, 0, "user", "a"), (41, 5, "user", "a")] + long
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *(f"'clash' as {c}" for c in ("keys", "words", "base", "n", "depth", "forest", "digest", "turns", "h")))
    got = sorted(map(tuple, trie.conversation_trie(df).collect()), key=repr)
    fixed = [r if r[0] != -3 else r for r in rows]
    own = dict(rebuilt([r for r in fixed if r[0] is None or r[0] >= 0]))
    own[-3] = dict(rebuilt([(-3, 0, "user", "a")]))[-3]  # its family's first, 0 by truncating division, lends nothing unless h > 0
    h = zlib.crc32(b"-3") % 4
    first = [((r or "", t or ""), len((t or "").split())) for _, _, r, t in [(0, 0, "user", "a"), (0, 1, "user", "b"), (0, 2, None, None)]]
    own[-3] = first[:h] + [(("user", "a"), 1)][h:]
    assert got == tree(list(own.items()))
    assert trie.conversation_trie(df.limit(0)).count() == 0
