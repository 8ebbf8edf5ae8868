import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quakeframe.llm import bpe, exact_dedup, html_extract, langid, line_dedup, media, mixing, queries, simhash_dedup, toxicity, url_filter
from quakeframe.llm.common import BATCH_BYTES, word_hashes
from quakeframe.llm.components import connected_components
from tests.oracle import duck_rows, spark_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and very long texts, ties, repeated rows.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "src1", 0),
    (3, " \t\n\x0b\x0c\r", None, "src2", 6),
    (4, "same words here in a line of text", "en", "src1", 33),
    (5, "same words  here in a line of text", "en", None, 34),
    (5, "same words  here in a line of text", "en", None, 34),
    (None, "same words here in a line of text", "en", "src1", 33),
    (6, "x" * 200_000, "de", "src2", 200_000),
    (7, "wort " * 60_000, "de", "src2", 300_000),
    (8, "été ça où Σίσυφος 漢字 😀 <|endoftext|> 12 ½", "fr", "src3", 40),
    (9, "42 %%% ... !!!", "es", "src3", 14),
]


def odd(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    for name in ("fp", "key", "kept", "score", "line", "h1", "domain", "budget", "ids", "_id", "norm") if extra else ():
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


def documents(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


# -- oracles ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql_oracle(spark, name, sf):
    path = f"/root/testdata/{sf}"
    assert spark_rows(queries.QUERIES[name](spark, path)) == duck_rows(queries.ORACLES[name], path)


def test_every_query_on_empty_tables(spark, tmp_path):
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


# -- components ------------------------------------------------------------------------


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(5, 5), (700, 701), (700, 701)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    want = {}
    for x in list(parent):
        want.setdefault(find(x), set()).add(x)
    got = {}
    for node, root in connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(root, set()).add(node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert all(root in members for root, members in got.items())


# -- 1 HTML ----------------------------------------------------------------------------


def test_marginals_are_exact():
    """Sum-product against the sum over all labelings."""
    rng = np.random.default_rng(1)
    model = html_extract.Model(rng.normal(0, 1, len(html_extract.FEATURES)), rng.normal(0, 1, (2, 2)))
    tree = html_extract.parse("<body><div class=ad>x<p>y</p></div><article><h1>t</h1><p>z")
    n = len(tree.parent)
    total, each = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        e = sum(sum(model.weights[i] for i in f) for f, y in zip(tree.features, labels, strict=True) if y)
        e += sum(model.edges[labels[tree.parent[i]]][labels[i]] for i in range(1, n))
        total += np.exp(e)
        each += np.exp(e) * np.array(labels)
    assert np.allclose(model.marginals(tree)[0], each / total)


def test_html_learns_its_labels_on_other_pages():
    model = html_extract.default_model()
    right = size = 0
    for tree, label in html_extract.labelled_pages(150, seed=99):
        got = np.array(model.marginals(tree)[0]) > 0.5
        runs = [i for i, t in enumerate(tree.text) if t is not None]
        right += int((got[runs] == (label[runs] > 0)).sum())
        size += len(runs)
    assert right / size > 0.97


def test_html_pages():
    model = html_extract.default_model()
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
      <header class="site-header"><a href=/>Home</a><p>The daily paper</p></header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
      <div class="cookie-notice">We use cookies on this site. Please accept them now.</div><!-- <p>hidden</p> -->
      <main><article><h1>A &amp; B</h1><p>First  paragraph&nbsp;of <b>the</b>\n text, which goes on for a while.<div class="ad">Buy our things now, they are cheap and good.</div>
      <p>Second one<br>continues here and has an end.</p><aside>Read also this other story of ours.</aside></article></main>
      <form><label>Name</label><input name=q><button>Send</button></form>
      <section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this article very much, thanks for it.</p></div></section>
      <aside class=sidebar><p>Some teaser text for another article here.</p></aside><footer>&copy; 2020 Someone, all rights.</footer></body></html>"""
    assert html_extract.main_text(model, page) == "A & B\n\nFirst paragraph of the text, which goes on for a while.\n\nSecond one continues here and has an end."


def test_html_query(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>"), (4, "u", "<!-- open"), (5, "u", "plain words only, no markup at all."), (6, "u", "<div " * 2000)], "page_id long, url string, html string")
    got = html_extract.extract_pages(pages.selectExpr("*", "1 as text")).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2, 4)] == ["", "", ""]


def test_hyphenated_names_of_the_article(spark):
    model = html_extract.default_model()
    words = "A plain sentence of the article that goes on for a while. " * 3
    page = f"<html><body><nav><a href='/'>Home</a></nav><article><p>{words}</p><p class='ad-hoc'>{words}</p></article></body></html>"
    assert html_extract.main_text(model, page) == "\n\n".join([words.strip()] * 2)
    page = f"<html><body><nav><a href='/'>Home</a></nav><div class='form-content'><p>{words}</p><p>{words}</p></div></body></html>"
    assert html_extract.main_text(model, page) == "\n\n".join([words.strip()] * 2)


@pytest.mark.parametrize(
    "name",
    "menu-item-description meta-analysis ad-free more-info comment-on-policy search-results-summary share-price-table form-factor-x ad-hoc related-work legal-history tag-cloud-study".split(),
)
def test_names_that_begin_like_a_layout(name):
    """A part of the article stays, whatever its compound name begins with; a part of the layout goes."""
    model = html_extract.default_model()
    words = "A plain sentence of the article that goes on for a while. " * 3
    for tag, inner in (("div", words), ("div", f"<p>{words}</p>"), ("p", words), ("section", f"<p>{words}</p>")):
        page = f"<html><body><nav><a href='/'>Home</a></nav><article><p>{words}</p><{tag} class='{name}'>{inner}</{tag}><p>{words}</p></article></body></html>"
        assert html_extract.main_text(model, page) == "\n\n".join([words.strip()] * 3)
    for junk in ("ad", "ad-box", "sidebar-left", "cookie-notice", "comment-list", "site-footer", "newsletter-signup", "nav-links"):
        page = f"<html><body><article><p>{words}</p><div class='{junk}'>{words}</div><p>{words}</p></article><div id='{junk}'><p>{words}</p></div></body></html>"
        assert html_extract.main_text(model, page) == "\n\n".join([words.strip()] * 2), junk


@pytest.mark.parametrize("tag", ["div", "p", "li", "td", "blockquote", "dd"])
def test_pages_of_open_tags_take_linear_time(tag):
    import time

    took = []
    for n in (20_000, 200_000):
        for page in (f"<{tag}>" * n + "last words", f"<div><{tag}>" * (n // 2) + "</section></i></li>" * n + "last words"):
            begin = time.perf_counter()
            assert html_extract.parse(page).text[-1] == "last words"
            took.append(time.perf_counter() - begin)
    assert max(took[2:]) < 10 and max(took[2:]) < 40 * max(took[:2])


def test_html_generated_pages(spark, sf_dir):
    """The generated pages' articles, cut out by their own markup."""
    got = {r.page_id: r.text for r in queries.op1_html_extraction(spark, sf_dir).collect()}
    for p in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[p["page_id"]] == "\n\n".join(b for b in blocks if b), p["page_id"]


@pytest.mark.parametrize(
    ("part", "inner"),
    [
        ("<svg-icon name=x></svg-icon>", []), ("<video-js id=v></video-js>", []), ("<select-box></select-box>", []), ("<title-bar></title-bar>", []),
        ("<svg class='i'/>", []), ("<math/>", []), ("<svg class='i'>", []), ("<canvas>", []), ("<svg><text>gone</text></svg>", []), ("<script>let gone</script>", []),
        ("<template data-a='>'>gone</template>", []), ("<p><math><mi>energy</mi></math></p>", ["energy"]), ("<noscript><p>plain words</p></noscript>", ["plain words"]),
        ("<object data=x>instead of it</object>", ["instead of it"]),
    ],
)
def test_page_goes_on_after(part, inner):
    runs = [x for x in html_extract.parse(f"<p>one</p>{part}<p>two</p><p>three</p>").text if x is not None]
    assert runs == ["one", *inner, "two", "three"]


def test_unclosed_raw_text_runs_to_the_end():
    runs = [x for x in html_extract.parse("<p>one</p><script>let x = '<p>two</p>'").text if x is not None]
    assert runs == ["one"]


# -- 2 SimHash -------------------------------------------------------------------------


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ ß\t\n\x0b\xa0\x85", max_size=40))
def test_simhash_of_any_text(text):
    assert simhash_dedup.simhash(text) == brute_simhash(text)


def brute_components(ids, codes):
    root = dict(zip(sorted(set(codes)), sorted(set(codes)), strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    least = {}
    for i, c in zip(ids, codes, strict=True):
        if i is not None:
            least[find(c)] = min(least.get(find(c), i), i)
    return {(i, f"{c:016x}", least.get(find(c))) for i, c in zip(ids, codes, strict=True)}


def test_near_duplicates_brute_force(spark, sf_dir):
    docs = documents(sf_dir)
    got = simhash_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {tuple(r) for r in got.collect()} == brute_components([d["doc_id"] for d in docs], [brute_simhash(d["text"]) for d in docs])


def test_near_duplicates_odd_rows(spark):
    got = simhash_dedup.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert {tuple(r) for r in got} == brute_components([r[0] for r in ODD], [brute_simhash(r[1]) for r in ODD])


@pytest.mark.parametrize("most", [64, 3, 0])
def test_links_find_all_near_codes(spark, most):
    """However many codes a bucket holds before they meet by whole codes."""
    rng = random.Random(1)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for c in list(codes):
        codes |= {c ^ 1 << rng.randrange(64), c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), c ^ 7 << rng.randrange(60)}
    base = rng.getrandbits(64)
    for shift in (0, 32):  # a segment that 150 codes share, near and far from each other
        codes |= {base ^ 1 << shift + k for k in range(32)} | {base ^ rng.getrandbits(32) << shift for _ in range(118)}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    parts = {}
    for node, root in connected_components(simhash_dedup.links(spark.createDataFrame([(c,) for c in signed], "fp long"), most)).collect():
        parts.setdefault(root, set()).add(node % (1 << 64))
    want = {}
    for i, _, c in brute_components(list(range(len(codes))), list(codes)):
        want.setdefault(c, set()).add(list(codes)[i])
    assert sorted(map(sorted, parts.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


# -- 3 URLs ----------------------------------------------------------------------------


def test_url_rules(spark):
    cases = [
        ("http://A.Example.COM/en/71?x#y", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("https://b.com/en/", "b.com", "/en/", "com/en/", "block"),
        ("https://com/en/x", "com", "/en/x", "com/en/", "block"),
        ("https://xexample.com/en/7", "xexample.com", "/en/7", "com/en/", "block"),
        ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        ("http://example.net/de/9", "example.net", "/de/9", "net/de/", "allow"),
        ("http://z.org/es", "z.org", "/es", None, "allow"),
        ("http://z.org/es/", "z.org", "/es/", "org/es/", "block"),
        ("http://best-casino.dk/a", "best-casino.dk", "/a", None, "block"),
        ("no scheme", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://", "", "", None, "allow"),
        ("ftp://ÄB.COM?q/en/", "Äb.com", "", None, "allow"),
        ("a://h.net/de/://b", "h.net", "/de/://b", "net/de/", "allow"),
        ("http://h.org#/es/", "h.org", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(None, cases[0][0]), (0, cases[0][0])], "page_id long, url string")
    got = sorted(map(tuple, url_filter.judge_urls(pages.selectExpr("*", "'q' as host", "'q' as token")).collect()), key=repr)
    want = sorted([(i, *c[1:]) for i, c in enumerate(cases)] + [(None, *cases[0][1:]), (0, *cases[0][1:])], key=repr)
    assert got == want


# -- 4 lines ---------------------------------------------------------------------------


def test_line_dedup(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [
        (1, f"Hello there, World!\n\nshort\n{long}", None, None, None),
        (2, "hello THERE world\nshort\n\nother", None, None, None),
        (3, long.replace("word17 ", "wort17 ") + "\nunique line that nobody else has", None, None, None),
        (4, None, None, None, None),
        (5, "", None, None, None),
        (6, "other\nother", None, None, None),
        (None, "short", None, None, None),
        (7, long.upper(), None, None, None),
    ]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in line_dedup.dedup_lines(odd(spark, rows)).collect()}
    assert got[1] == (4, 0, []) and got[2] == (4, 2, [0, 1]) and got[6] == (2, 2, [0, 1]) and got[7] == (1, 1, [0])
    assert got[3] == (2, 1, [0])
    assert 4 not in got and 5 not in got and None not in got
    cleaned = {r.doc_id: r.text for r in line_dedup.clean_documents(odd(spark, rows)).collect()}
    assert cleaned[2] == "\nother" and cleaned[4] is None and cleaned[None] == "short"


def test_repeated_documents_are_judged_as_one(spark):
    rows = [(1, "alpha beta gamma\nepsilon", None, None, None), (2, "epsilon\n\nzeta eta", None, None, None), (2, "epsilon\n\nzeta eta", None, None, None)]
    got = sorted(tuple(r) for r in line_dedup.dedup_lines(odd(spark, rows)).collect())
    assert got == [(1, 2, 0, []), (2, 3, 1, [0])]


def test_fuzzy_lines_join(spark):
    base = " ".join(f"term{i}" for i in range(900))
    rows = [(i, base.replace(f" term{i} ", f" changed{i} "), None, None, None) for i in range(1, 9)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(odd(spark, rows)).collect()}
    assert got == {1: 0} | dict.fromkeys(range(2, 9), 1)


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def alike(x, y):
    """Edit similarity of 0.8 in words or in characters."""
    off = lambda a, b: abs(len(a) - len(b)) * 5 <= max(len(a), len(b)) and 5 * edits(a, b) <= max(len(a), len(b))
    return x == y or off(x.split(" "), y.split(" ")) or off(x, y)


def dropped_by_all_pairs(lines):
    """Numbers of the lines that go when every pair is compared."""
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(lines)), 2):
        if find(i) != find(j) and alike(lines[i], lines[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [i for i in range(len(lines)) if find(i) != i]


def dropped(spark, lines):
    return line_dedup.dedup_lines(odd(spark, [(1, "\n".join(lines), None, None, None)])).collect()[0].dropped


@pytest.mark.parametrize("part", [line_dedup.PART, 7])
def test_similar_lines_of_one_key_are_linked(spark, part, monkeypatch):
    """Pairs that share one phrase alone with many unlike lines, and whose every other window is broken by edits."""
    monkeypatch.setattr(line_dedup.other_pairs, "__defaults__", (part,))
    lines = []
    for k in range(60):
        own = [f"w{k}x{j}" for j in range(11)]
        lines += [" ".join([*own, *"one phrase that all lines hold".split()]), " ".join([f"z{k}y{j}" if j in (2, 5, 8) else w for j, w in enumerate(own)] + "one phrase that all lines hold".split())]
    texts = line_dedup.durable(line_dedup.distinct_texts(line_dedup.raw_lines(odd(spark, [(1, "\n".join(lines), None, None, None)]))))
    keys = line_dedup.window_keys(texts).collect()
    number = {r.id: r.line for r in texts.collect()}
    held = {}
    for r in keys:
        held.setdefault(number[r.id], set()).add(r.key)
    share = {k for k in range(60) if held.get(2 * k, set()) & held.get(2 * k + 1, set())}
    root = {number[r.node]: r.root for r in line_dedup.text_groups(texts).collect()}
    linked = {k for k in range(60) if 2 * k in root and root[2 * k] == root.get(2 * k + 1)}
    assert len(share) > 10 and linked == share


def edited(rng, words, n):
    """words with n of them replaced, taken out or put in."""
    out = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.random()
        new = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
        out[at : at + (kind < 0.8)] = [new] if kind < 0.6 or kind >= 0.8 else []
    return out


@pytest.mark.parametrize("size", [5, 8, 12, 16, 25, 50, 100, 200])
def test_recall_of_similar_lines(spark, size):
    """Pairs with one word to a fifth of the words edited, among them phrases that half of the lines share; brute force says which are similar."""
    rng = random.Random(size)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice((2, 3, 3, 4, 5, 6, 8, 10)))) for _ in range(2000)]
    pairs = []
    for k in range(300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        if k % 2 and size >= 25:
            base[4:11] = "that passage which many of lines hold".split()
        pairs.append((" ".join(base), " ".join(edited(rng, base, rng.randint(1, size // 5)))))
    similar = [k for k, (x, y) in enumerate(pairs) if alike(x, y)]
    found = set(dropped(spark, [line for p in pairs for line in p]))
    recall = np.mean([2 * k + 1 in found for k in similar])
    print(f"lines: recall at {size} words {recall:.3f} of {len(similar)}")
    assert len(similar) > 200 and recall >= 0.95
    assert not [k for k in range(300) if 2 * k in found and size > 8]  # the bases are unlike each other


@pytest.mark.parametrize(("most", "count", "own"), [((9, 13), 400, 30), ((2, 5), 400, 30), ((5, 11), 1500, 10)])
def test_recall_of_lines_of_one_template(spark, most, count, own):
    """Pairs that share long words with all other lines, and words of their own of which one was changed."""
    rng = random.Random(own)
    word = lambda a, b: "".join(rng.choice("etaoinshrdlucmf") for _ in range(rng.randint(a, b)))
    shared = [word(*most) for _ in range(18)]
    lines = []
    for _ in range(count):
        words = [word(2, 9) for _ in range(own)]
        changed = list(words)
        changed[rng.randrange(own)] = word(2, 9)
        lines += [" ".join(shared[:6] + w[: own // 2] + shared[6:] + w[own // 2 :]) for w in (words, changed)]
    found = set(dropped(spark, lines))
    recall = np.mean([k + 1 in found for k in range(0, len(lines), 2)])
    print(f"lines: recall in a template of {most} letters, {own} own words {recall:.3f}")
    assert recall >= 0.95


def test_short_lines_by_characters(spark):
    """Under five words all pairs up to MOST_EDITS edits share a segment; a few lose each other to unlike least texts of their segments."""
    rng = random.Random(8)
    lines = []
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 4)))
        lines.append(text)
        for _ in range(3):
            copy = list(text)
            for _ in range(rng.randint(1, max(1, len(text) // 5))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [rng.choice("abcdefgh")] * rng.randint(0, 1)
            lines.append(" ".join("".join(copy).split()) or "x")
    assert max(map(len, lines)) < 35
    got, want = set(dropped(spark, lines)), set(dropped_by_all_pairs(lines))
    print(f"lines: recall under 5 words {len(got & want) / len(want):.3f} of {len(want)}")
    assert got <= want and len(got) >= 0.95 * len(want) > 50


def test_lines_of_one_common_word(spark):
    lines = ["0 " * n + x for n in (6, 9, 14, 21, 32) for x in ("1", "2")] + ["0 0 0 7 0"]
    assert dropped(spark, lines) == [1, 3, 5, 7, 9] == dropped_by_all_pairs(lines)


def test_similarity(spark):
    from pyspark.sql import functions as F

    base = [f"w{k}" for k in range(200)]
    far = base[:120] + [f"x{k}" for k in range(40)] + base[160:]
    pairs = [("a b c d e", "a b x d e"), ("a b c d e", "a x y z e"), ("a", "a"), ("a b c d e f", "b c d e f"), (" ".join(base), " ".join(far)), ("page 12", "page 13"), ("été 12", "hiver 3")]
    pairs += [(" ".join(base * 40), " ".join(base * 33)), (" ".join(base * 40), " ".join(base * 31))]  # beyond the widest band
    cut = [F.struct(F.col(c).alias("norm"), F.char_length(c).alias("n")).alias(c) for c in "xy"]
    got = [r.s for r in spark.createDataFrame(pairs, "x string, y string").select(*cut).select(line_dedup.similar("x", "y").alias("s")).collect()]
    assert got == [True, False, True, True, True, True, False, True, False]


# -- 5 exact ---------------------------------------------------------------------------


def brute_exact(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, i))
    out, stands = [], set()
    for i, text, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[norm])[3]
        kept = (-len(text or ""), i is None, i or 0, i) == min(groups[norm]) and norm not in stands  # of equal rows one
        stands |= {norm} if kept else set()
        out.append((i, keep, len(groups[norm]), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_duplicates_odd_rows(spark, bits):
    rows = [*ODD, (20, "a. b. c.", None, None, None), (21, "c. a. b.", None, None, None), (22, "a.b.\nc.", None, None, None), (23, "a. b. d.", None, None, None)]
    got = exact_dedup.exact_duplicates(odd(spark, rows), least=1, most=4096, key_bits=bits)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(rows)


def test_chunks_join_to_the_text(spark):
    text = "".join(random.Random(4).choice("ab.c!😀é") for _ in range(20_000)) + "z" * 9000
    got = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks("t").alias("c")).first().c
    assert "".join(got) == text and max(map(len, got)) <= exact_dedup.MOST_CHUNK


# -- 6 toxicity ------------------------------------------------------------------------


def test_word_hashes():
    h, at = word_hashes("Ab aB, é1 ab".encode())
    assert at.tolist() == [0, 3, 7, 11] and h[0] == h[1] == h[3] != h[2]


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{path}/labels.parquet").to_pylist()}
    rows = queries.op6_toxicity(spark, path).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    right = np.mean([r.predicted == labels[r.doc_id] for r in held])
    good, bad = [r.score for r in held if not labels[r.doc_id]], [r.score for r in held if labels[r.doc_id]]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    print("toxicity: held-out accuracy", right, "auc", auc, len(held))
    assert right > 0.95 and auc > 0.95


def test_toxicity_reads_whole_texts_in_any_batching():
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "ee"]) for _ in range(30)) + (" awful fool" if k % 2 else "") for k in range(80)]
    model = toxicity.train(texts, np.array([k % 2 for k in range(80)]), ["en"] * 80)
    mixed = [None, "", "x " * 400_000 + "awful fool", *texts]
    whole, _ = toxicity.logits(model, mixed)
    alone = [toxicity.logits(model, [t])[0][0] for t in mixed]
    assert np.allclose(whole, alone) and whole[2] > model.thresholds[0] > whole[1] == whole[0]


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    one = toxicity.score_documents(odd(spark), labels.where("toxic = 0")).collect()
    assert {r.predicted for r in one} == {0}


def test_toxicity_learns_from_every_labelled_row(spark):
    """Two clean rows share a word of their own: about 0.64 of such words have both rows among those that are trained on."""
    rows = [(k, f"plain w{k // 2}q" + (" awful fool" if k % 10 == 0 else " kind"), "en", int(k % 10 == 0)) for k in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.selectExpr("doc_id", "1 AS quality", "toxic"), shard=1500)
    assert len(model.learned) > 0.55 * 4000
    raw, guess = toxicity.logits(model, [r[1] for r in rows])
    assert all((raw >= model.thresholds[guess]) == np.array([r[3] for r in rows], bool))
    again = toxicity.fit(docs.drop("toxic").repartition(7), docs.selectExpr("doc_id", "1 AS quality", "toxic").repartition(3), shard=1500)
    assert (again.learned == model.learned).all() and np.allclose(again.emb, model.emb, atol=1e-4) and np.allclose(again.thresholds, model.thresholds, atol=0.02)


# -- 7 mixing --------------------------------------------------------------------------


def brute_share(budget, items):
    """items: {name: (weight, capacity)}; fills the smallest capacities per weight first."""
    out, left = {}, dict(items)
    while left:
        unit = budget / sum(w for w, _ in left.values())
        full = {k: c for k, (w, c) in left.items() if unit * w >= c}
        if not full:
            return out | {k: unit * w for k, (w, _) in left.items()}
        for k, c in full.items():
            out[k] = c
            budget -= c
            del left[k]
        budget = max(budget, 0)
    return out


def test_share_out(spark):
    rng = random.Random(5)
    nodes, want = [], {}
    for p in range(6):
        items = {f"n{k}": (rng.choice([1.0, 2.0, 0.5]), float(rng.randrange(1, 100))) for k in range(rng.randrange(1, 8))}
        budget = rng.random() * sum(c for _, c in items.values()) * (1.2 if p == 0 else 1)
        nodes += [(p, k, w, c, budget) for k, (w, c) in items.items()]
        want |= {(p, k): v for k, v in brute_share(budget, items).items()}
    df = spark.createDataFrame(nodes, "p int, name string, weight double, capacity double, parent_budget double")
    for r in mixing.share_out(df, ["p"], "name").collect():
        assert abs(r.budget - want[r.p, r["name"]]) < 1e-6


def test_mixing_takes_prefixes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = {"lang": {"en": 0.2, "de": 3.0}}
    got = mixing.mix(docs, share=1.1, epochs=3, weights=weights).collect()
    leaves = {}
    for r in mixing.mix(docs, share=1e9, epochs=1).collect():
        leaves.setdefault((r.domain, r.lang, r.source), []).append((r.doc_id, r.n_tokens))
    taken = Counter((r.domain, r.lang, r.source, r.epoch) for r in got)
    for leaf, members in leaves.items():
        budget = next((r.budget for r in got if (r.domain, r.lang, r.source) == leaf), 0)
        before, want = 0, Counter()
        for e in (1, 2, 3):
            for i, n in sorted(members, key=lambda m, e=e: (hashlib.md5(f"17:{e}:{m[0]}".encode()).hexdigest(), m[0])):
                want[e] += before < budget - 1e-3
                before += n
        assert all(taken[(*leaf, e)] == want[e] for e in (1, 2, 3)), leaf


def test_mixing_odd_rows(spark):
    got = mixing.mix(odd(spark), share=1.0, epochs=1).collect()
    assert Counter(r.doc_id for r in got)[5] == 2 and {r.doc_id for r in got} >= {4, 6, 7, 8, None}
    assert mixing.mix(odd(spark), share=0.0).count() == 0


# -- 8 media ---------------------------------------------------------------------------


def test_companding_tables():
    assert media.MULAW_PCM[0xFF] == 0 == media.MULAW_PCM[0x7F] and media.MULAW_PCM[0] == -32124 and media.MULAW_PCM[0x80] == 32124
    assert media.ALAW_PCM[0xD5] == 8 and media.ALAW_PCM[0x55] == -8 and media.ALAW_PCM[0xAA] == 32256 and media.ALAW_PCM[0x2A] == -32256
    assert len(set(media.ALAW_PCM.tolist())) == 256 and len(set(media.MULAW_PCM.tolist())) == 255


def test_adpcm_matches_a_scalar_decoder():
    data = random.Random(6).randbytes(5 * 64)
    want = []
    for at in range(0, len(data), 64):
        block = data[at : at + 64]
        sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        want.append(sample)
        for byte in block[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                diff = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
                sample = max(-32768, min(32767, sample - diff if nibble & 8 else sample + diff))
                index = max(0, min(88, index + int(media.CHANGES[nibble & 7])))
                want.append(sample)
    assert media.adpcm_decode(data, 64).tolist() == want


def test_media_query(spark):
    got = {(r.doc_id, r.payload_sha256): r for r in media.media_digests(odd(spark)).collect()}
    for i, text, *_ in ODD:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i, hashlib.sha256(padded).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-32:]))
        stored = media.wav(padded, media.MULAW)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.features(media.MULAW, 8000, padded, media.adpcm_blocks(padded))


def test_decode_media(spark):
    rows = [(k, media.wav(bytes(range(256)) * 9, tag, bits=b, align=a)) for k, (tag, b, a) in enumerate([(media.MULAW, 8, 1), (media.ALAW, 8, 1), (media.IMA_ADPCM, 4, 576)])]
    df = spark.createDataFrame([*rows, (8, b"junk"), (9, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.decode_media(df).collect()}
    assert got[8].pcm_wav is None and got[9].pcm_wav is None
    assert got[0].n_samples == 2 * 2304 and got[2].n_samples == 2 * 4 * 1145
    tag, rate, align, data = media.read_wav(bytes(got[1].pcm_wav))
    assert (tag, rate, align) == (media.PCM, 16000, 2) and np.frombuffer(data, "<i2")[0] == media.ALAW_PCM[0]


# -- 9 languages -----------------------------------------------------------------------


def test_language_held_out(spark):
    path = "/root/testdata/sf0.1"
    lang = {r["doc_id"]: r["lang"] for r in documents(path)}
    rows = queries.op9_language_id(spark, path).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    print("language: held-out accuracy", np.mean(held), len(held))
    assert np.mean(held) > 0.97


def test_codewords_are_apart():
    for n in (2, 4, 5, 9, 30):
        c = langid.codewords(n)
        assert len({tuple(r) for r in c.tolist()}) == n
    assert min((a != b).sum() for a, b in itertools.combinations(langid.codewords(4), 2)) == 4


def test_numbers_are_no_letters():
    model = langid.train(["the cat and the dog", "der hund und die katze"], ["en", "de"])
    assert {langid.identify(model, t)[0] for t in ("½ ²", "①", "Ⅷ", "12 _", "")} == {"und"}
    assert langid.identify(model, "Ⅷ the cat")[0] == "en"


def test_samples_are_the_first_by_hash(spark):
    from quakeframe.llm.common import first_by_hash

    rows = spark.range(30_000).selectExpr("id as doc_id", "if(id % 7 = 0, 'a', 'b') as lang").union(spark.createDataFrame([(1, None)], "doc_id long, lang string"))
    hashes = {r[0]: r[1] % (1 << 64) >> 52 for r in rows.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    got = {g: {r.doc_id for r in first_by_hash(rows, "lang", 50).collect() if r.lang == g} for g in "ab"}
    for g in "ab":
        rest = [hashes[i] for i in range(30_000) if (i % 7 == 0) == (g == "a") and i not in got[g]]
        assert len(got[g]) == 50 and max(hashes[i] for i in got[g]) <= min(rest)


def test_language_scores_against_plain_loops(spark, sf_dir):
    """Every document of a table, counted and decoded letter by letter from the same model."""
    texts = {r["doc_id"]: r["text"] for r in documents(sf_dir)}
    some = [r for r in documents(sf_dir) if r["text"] and r["lang"]][:60]
    model = langid.train([r["text"] for r in some], [r["lang"] for r in some])
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in langid.predict(rows, model).collect():
        text = texts[r.doc_id]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        fold = [b if b > 127 else b | 32 if chr(b).isalpha() else 32 for b in f" {text} ".encode()]
        counts = Counter()
        for i in range(len(fold)):
            key = 0
            for k in range(min(3, len(fold) - i)):
                key = (key * 2654435761 + fold[i + k] * 40503 + k + 1) % (1 << 32)
                counts[(key ^ key >> 15) % langid.BUCKETS] += 1
        total = sum(counts.values())
        margin = [b + sum(n / total * float(model.weights[k, j]) for k, n in counts.items()) for j, b in enumerate(model.bias)]
        loss = [sum(t * np.log1p(np.exp(-c * x)) for t, c, x in zip(model.trust, code, margin, strict=True)) for code in model.codes]
        p = np.exp(min(loss) - np.array(loss))
        k = int(np.argmin(loss))
        assert r.lang_pred == model.names[k] and abs(r.score - p[k] / p.sum()) < 1e-3, r.doc_id


def test_language_odd_rows(spark):
    got = langid.identify_documents(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 9)} == {"und"}
    assert all(r.lang_pred in ("en", "de", "fr", "es") for r in got if r.doc_id in (4, 6, 7, 8))


# -- 10 BPE ----------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    v = bpe.Vocabulary(PATH)
    return bpe.Encoder(v, bpe.build_lexicon(["the", "and", "nation", "nations", "station", "été", "of"], v))


def check(encoder, tokenizer, texts):
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert encoder.vocabulary.decode(ids) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_cases(encoder, tokenizer):
    texts = ["", None, "The nations' stations aren't 42½ ²x²", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "ΣΊΣΥΦΟΣ ΟΔΟΣ", "e\u0301te\u0301 ÉTÉ", "漢字 かな 한국어 😀👍🏽", "İstanbul ǅ ß ẞ", "x\x1cy\x85z\xa0w\u200bq\u2028r\ufeff", "'S 'RE'Ve ''ll", "aaaaaaaaaa" * 50, "ab" * 3000, "__init__ a_b", "ªº ⅷ ①", "\x00\x01", "z" * 45 + " " + "né" * 30]
    check(encoder, tokenizer, texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_bpe_any_text(encoder, tokenizer, texts):
    check(encoder, tokenizer, texts)


def test_bpe_query(spark, tokenizer, sf_dir):
    rows = documents(sf_dir)
    got = {r.doc_id: r for r in queries.op10_bpe(spark, sf_dir).collect()}
    for d in rows:
        ids = tokenizer.encode(d["text"], add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark):
    got = bpe.encode_documents(odd(spark), PATH).collect()
    assert len(got) == len(ODD) and all(r.n_tokens == len(r.ids) for r in got)


def test_lexicon_is_minimal_and_maps_back(tmp_path):
    words = {w.encode(): [k, k + 1][: k % 2 + 1] for k, w in enumerate(["tap", "taps", "top", "tops", "", "été", "t", "zaps", "zap"])}
    lexicon = bpe.Lexicon.compile(words)
    lexicon.save(str(tmp_path / "x"))
    mapped = bpe.Lexicon.load(str(tmp_path / "x"))
    probe = [*words, b"ta", b"tapsx", b"x" * 99, b"zop"]
    for w, row in zip(probe, mapped.find(probe).tolist(), strict=True):
        ids = None if row < 0 else mapped.ids[mapped.offsets[row] : mapped.offsets[row + 1]].tolist()
        assert ids == (words.get(w) if w else None)
    # t, a|o, p, s and the shared ends; zap(s) shares tap(s)'s suffix: fewer arcs than letters of a trie
    assert len(mapped.keys) == len(set(mapped.keys.tolist())) and len(mapped.keys) < sum(map(len, words)) - 6


# -- pipeline --------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, sf_dir, tokenizer):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(cp.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir)
    rows = {r.doc_id: r.asDict() for r in clean.collect()}
    assert set(rows) <= {d["doc_id"] for d in documents(sf_dir)} and clean.columns == columns
    base = spark.createDataFrame(list(map(tuple, (r.values() for r in rows.values()))), docs.schema)
    exact = stages["exact_dedup"](spark, base, sf_dir)
    kept = [r for r in brute_exact([(d["doc_id"], d["text"]) for d in rows.values()]) if r[3]]
    assert {r.doc_id for r in exact.collect()} == {k[0] for k in kept} and exact.columns == columns
    left = {k[0]: rows[k[0]] for k in kept}
    base = spark.createDataFrame([tuple(r.values()) for r in left.values()], docs.schema)
    near = stages["simhash_near_dedup"](spark, base, sf_dir)
    parts = brute_components(list(left), [brute_simhash(d["text"]) for d in left.values()])
    assert {r.doc_id for r in near.collect()} == {i for i, _, c in parts if i == c} and near.columns == columns
    mixed = stages["mixing"](spark, near, sf_dir)
    assert mixed.columns == columns and 0 < mixed.count() <= near.count()
    final = {r.doc_id: (r.n_tokens, r.ids) for r in cp.run(spark, sf_dir).collect()}
    assert set(final) == {r.doc_id for r in mixed.collect()}
    for i, (n, ids) in final.items():
        assert n == len(ids) and ids == tokenizer.encode(rows[i]["text"], add_special_tokens=False).ids


def test_pipeline_decodes(spark, sf_dir, tokenizer):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    got = dict(cp.STAGES)["bpe"](spark, docs, sf_dir).collect()
    assert len(got) == 40
    for r in got:
        assert r.decoded == tokenizer.decode(r.ids, skip_special_tokens=False)


def test_pipeline_odd_rows(spark, sf_dir):
    import corpus_pipeline as cp

    base = odd(spark, extra=False)
    for name, stage in cp.STAGES:
        out = stage(spark, base, sf_dir).collect()
        assert len(out) <= len(ODD), name
        empty = stage(spark, base.limit(0), sf_dir).collect()
        assert not empty, name


def test_pipeline_keeps_rows_without_ids(spark, sf_dir):
    """Null and repeated ids are decided by their texts, row by row."""
    import corpus_pipeline as cp

    stages = dict(cp.STAGES)
    exact = stages["exact_dedup"](spark, odd(spark, extra=False), sf_dir).collect()
    assert sorted(map(tuple, exact), key=repr) == sorted(set(filter(brute_kept, ODD)), key=repr)
    rows = [(None, "one text alone without an id at all", None, None, None), (None, "and another one that nobody else has got", None, None, None), (3, "first text of three", None, None, None)]
    rows += [(3, "quite unlike words under the same number here", None, None, None), (3, "first text of three", None, None, None)]
    for name in ("exact_dedup", "simhash_near_dedup"):
        got = stages[name](spark, odd(spark, rows, extra=False), sf_dir).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(set(rows), key=repr), name


def brute_kept(row):
    """Whether row is the one of its group in ODD that stays."""
    same = [r for r in ODD if re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") == re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")]
    best = min(same, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
    return row is best


def test_registered_names():
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in e.queries()} and "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    json.dumps(e.oracle_sql())


def test_bpe_every_character(encoder, tokenizer):
    """Each code point alone, between letters and after a sign."""
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(characters), 4000):
        text = " ".join(f"a{c}b:{c}" for c in characters[k : k + 4000])
        check(encoder, tokenizer, [text])


def test_unlike_lines_of_one_key_do_not_leave_the_join(spark):
    """Lines of one length that share a passage, short ones that share a beginning: their pairs grow with the square; links stay."""
    shared = "one passage of many words that all lines hold"
    lines = [" ".join([*(f"v{k}x{j}" for j in range(11)), shared]) for k in range(60)]
    lines += [f"abcdef {''.join(random.Random(k).sample('ghijklmnopqrstuvwxyz', 14))}" for k in range(60)]
    texts = line_dedup.durable(line_dedup.distinct_texts(line_dedup.raw_lines(odd(spark, [(1, "\n".join(lines), None, None, None)]))))
    keys = line_dedup.durable(line_dedup.window_keys(texts).union(line_dedup.segment_keys(texts)))
    sharing = keys.groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sharing >= 50
    groups = spark.createDataFrame([], "node long, root long")
    assert line_dedup.other_pairs(keys, texts, groups).count() < 100  # of 3,540


def test_only_shared_keys_are_kept(spark, monkeypatch):
    """Keys that one text has alone go, and of keys that the same texts have one stays; links stay."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(7))
    lines = [" ".join(word() for _ in range(30)) for _ in range(40)]
    lines += [" ".join([word(), *line.split()[1:]]) for line in lines[:20]]
    texts = line_dedup.durable(line_dedup.distinct_texts(line_dedup.raw_lines(odd(spark, [(1, "\n".join(lines), None, None, None)]))))
    every = line_dedup.durable(line_dedup.window_keys(texts).union(line_dedup.segment_keys(texts)))
    members = lambda keys: {k: frozenset(r.id for r in rows) for k, rows in itertools.groupby(sorted(keys.collect(), key=lambda r: r.key), lambda r: r.key)}
    had, kept = members(every), list(members(line_dedup.shared_keys(every)).values())
    assert set(kept) == {m for m in had.values() if len(m) > 1} and len(kept) == len(set(kept)) == 20 < len(had)
    # What is verified reads the texts that share a key, and no others.
    read, real = [], line_dedup.similar_pairs
    monkeypatch.setattr(line_dedup, "similar_pairs", lambda table, pairs: read.append(table.count()) or real(table, pairs))
    assert line_dedup.text_groups(texts).count() == 40 and read == [40, 40]


def test_maps_keep_every_similar_pair(spark):
    rng = random.Random(5)
    texts = []
    for k in range(300):
        size = rng.choice((1, 2, 3, 4, 4, 5, 5, 8, 30))
        own = ["".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(size)]
        letters = list(" ".join(own))
        for _ in range(rng.randint(0, max(1, len(letters) // 5))):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.choice((0, 1))] = rng.choice(("", "a", "b"))
        texts += [" ".join(own), " ".join("".join(letters).split()) or "a"]
    rows = [(k, t, len(t), t.count(" ") + 1) for k, t in enumerate(texts)]
    table = line_dedup.durable(spark.createDataFrame(rows, "id long, norm string, n int, n_words int"))
    whole = table.join(line_dedup.held_maps(table), "id")
    one, two = (whole.selectExpr(f"struct(*) AS {x}") for x in "xy")
    pairs = one.crossJoin(two).where("x.id < y.id").select(line_dedup.similar("x", "y").alias("alike"), line_dedup.close_maps("x", "y").alias("close"))
    counts = {(r.alike, r.close): r["count"] for r in pairs.groupBy("alike", "close").count().collect()}
    assert counts.get((True, False), 0) == 0 and counts[(True, True)] > 150 and counts[(False, False)] > counts[(False, True)]


def test_training_convolves_a_step_at_once(monkeypatch):
    """A step's texts share one convolution; weights are those of texts taken one by one."""
    rng = np.random.default_rng(3)
    prepared = [np.concatenate([np.zeros(2, np.int64), rng.integers(0, 40, rng.integers(0, 30)), np.zeros(2, np.int64)]) for _ in range(100)]
    calls = []
    real = toxicity._convolve_rows
    monkeypatch.setattr(toxicity, "_convolve_rows", lambda taps, rows: calls.append(len(rows)) or real(taps, rows))
    w = toxicity._begin(rng.normal(0, 1, 40))
    before = toxicity._begin(np.zeros(40))
    before.emb[:], before.dense[:] = w.emb, w.dense
    toxic = rng.integers(0, 2, 100)
    toxicity._descend(w, prepared, toxic, np.ones(100), np.arange(100))
    assert len(calls) == -(-100 // toxicity.STEP)
    # The first step's pools, text by text.
    flat = before.parts()[0].transpose(1, 0, 2).reshape(toxicity.DIM, -1)
    taps = (before.emb @ flat).astype(np.float32)
    ends = np.cumsum([0, *(len(p) - 2 for p in prepared)])
    whole = real(taps, np.concatenate([*(p[:-2] for p in prepared), np.zeros(2, np.int64)]))
    for p, i, j in zip(prepared, ends[:-1], ends[1:], strict=True):
        assert np.array_equal(whole[i:j], toxicity.convolve(taps[p]))


def test_whole_texts_go_to_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")
        simhash_dedup.fingerprints(docs)
        assert spark.conf.get(key) == BATCH_BYTES
        spark.conf.set(key, "1m")
        simhash_dedup.fingerprints(docs)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_long_lines_of_one_passage_do_not_become_pairs(spark):
    """Unlike lines of one length that share a long passage, or are of a few words repeated; links stay."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("etaoinshrd") for _ in range(6))
    passage = [word() for _ in range(50)]
    lines = [" ".join([*(word() for _ in range(150)), *passage]) for _ in range(60)]
    lines += [" ".join([*["again"] * n, *["elsewhere"] * (90 - n), *passage[:3]]) for n in (5, 35, 65)]
    texts = line_dedup.durable(line_dedup.distinct_texts(line_dedup.raw_lines(odd(spark, [(1, "\n".join(lines), None, None, None)]))))
    # One key that all of them hold.
    keys = line_dedup.durable(texts.selectExpr("id", "1 AS size", "7L AS key"))
    groups = spark.createDataFrame([], "node long, root long")
    assert line_dedup.other_pairs(keys, texts, groups).count() < 100  # of 1,953
    close = [" ".join([word(), *lines[0].split()[1:]]), " ".join(["again"] * 30 + ["elsewhere"] * 60 + passage[:3])]
    assert dropped(spark, lines + close) == [len(lines), len(lines) + 1]


def test_verifying_moves_texts_in_rounds(spark, monkeypatch):
    """Pairs grow faster than texts: what verifying them moves at once is bounded by the texts."""
    rng = random.Random(22)
    rows = [(k, " ".join("".join(rng.choice("etaoin") for _ in range(3)) for _ in range(12))) for k in range(60)]
    rows += [(60 + k, "x " + text[text.index(" ") + 1 :]) for k, text in rows]
    texts = line_dedup.durable(spark.createDataFrame([(k, t, len(t), 12) for k, t in rows], "id long, norm string, n int, n_words int"))
    a, b = (texts.select(line_dedup.F.col("id").alias(x)) for x in "ab")
    pairs = a.crossJoin(b).where("a < b")
    moved, real = [], line_dedup.durable
    monkeypatch.setattr(line_dedup, "durable", lambda df, **options: moved.append(df.columns) or real(df, **options))
    monkeypatch.setattr(line_dedup, "AT_ONCE", 1)
    links = line_dedup.similar_pairs(texts, real(pairs))
    assert {(r.a, r.b) for r in links.collect()} == {(k, 60 + k) for k in range(60)}
    # 7,140 pairs move a text each, 59.5 times the 120 texts: at most about twice that many letters a round, and their links.
    assert len(moved) - 1 in (29, 30, 31)


def test_long_lines_of_few_words_by_characters(spark):
    """Under five words and over 34 letters: as many edits as similarity allows, spread over the text, shift or not."""
    rng = random.Random(23)
    lines, want = [], set()
    for n in (35, 39, 44, 47, 60, 64, 99, 180, 400):
        for count, kinds in itertools.product((1, 2, 4), ("=", "+", "-", "=+-")):
            base = [rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)]
            for k in range(1, count):
                base[k * n // count] = " "
            copy, most = list(base), (n if "+" not in kinds else n * 19 // 20) // 5
            for at in sorted(rng.sample(range(1, n - 1), n // 2), reverse=True):
                # No two edits within a few letters of each other, and no blanks moved.
                if most and " " not in base[at - 1 : at + 2] and (at % 5 == 2 or n < 60):
                    kind = rng.choice(kinds)
                    copy[at : at + (kind != "+")] = ["#"] if kind == "=" else ["%", base[at]][:1] if kind == "+" else []
                    most -= 1
            copy = ["z" if c == "#" else "q" if c == "%" else c for c in copy]
            lines += ["".join(base), "".join(copy)]
            if alike(lines[-2], lines[-1]) and edits(lines[-2], lines[-1]) > 6:
                want.add(len(lines) - 1)
    found = set(dropped(spark, lines))
    assert len(want) > 60 and want <= found and all(k % 2 and alike(lines[k - 1], lines[k]) for k in found)


def test_every_two_similar_lines_of_few_words_share_a_key(spark):
    """Pieces of 4 letters are a quarter of a text, edits a fifth: the worst edits leave one whole."""
    rng = random.Random(24)
    rows, pairs = [], []
    for n in range(35, 140):
        base = "".join(rng.choice("abcdefgh") for _ in range(n))
        copy = list(base)
        for k in range(n // 5):
            copy[4 * k + rng.randrange(4)] = rng.choice(("y", "", "y"))
        for other in ("".join(copy), base[n // 5 :], base[: n - n // 5], base[n // 10 : n - n // 5 + n // 10]):
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), base, n, 1), (len(rows) + 1, other, len(other), 1)]
    texts = spark.createDataFrame(rows, "id long, norm string, n int, n_words int")
    held = {}
    for r in line_dedup.segment_keys(texts).collect():
        held.setdefault(r.id, set()).add(r.key)
    assert [p for p in pairs if not held[p[0]] & held[p[1]]] == []
