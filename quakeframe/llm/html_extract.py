"""Main text of HTML pages by a tree-structured graphical model.

The DOM's block elements and text runs are the nodes; a node's label says whether it
holds main content.  Each node has a potential from its own features, each parent-child
edge one from both labels; sum-product messages go up and then down the tree and give
exact marginals.  Weights are fitted by gradient on the marginals of labelled pages,
which ``labelled_pages`` composes from parts of known label.  Text runs whose marginal is
over one half are the main text.

Defined cases: null, empty and text-free pages give the empty text; broken markup is read
as far as it goes (unclosed elements end with their parent, unclosed comments and raw text
run to the end, other skipped elements without an end are skipped by their tag alone; any
depth of open elements takes linear time); pages with a null id or url are returned; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they do.
RAW = {"script", "style", "iframe", "textarea", "title"}  # hold text only, up to their end tag
SKIPPED = RAW | {"template", "svg", "canvas", "audio", "video", "select"}
FALLBACK = {"noscript", "object"}  # stand inside of text, with text of their own
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set(
    "html body div section article main nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th"
    " caption blockquote pre figure figcaption address details summary dialog menu center hgroup search button label head".split()
) | FALLBACK
BREAKS = {"br", "hr"}
#: Start tags that end an open element of the named kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Kinds of words in class, id and role, and of elements: each is a feature of a node.
NAMED = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar topbar toc skip",
    "head": "header masthead banner branding logo hero-bar",
    "foot": "footer foot colophon copyright legal imprint",
    "side": "sidebar aside rail widget widgets related recommended recommendations trending popular more complementary teaser promo newsletter subscribe signup",
    "note": "cookie cookies consent gdpr notice alert modal popup overlay paywall toast disclaimer warning message",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors adsense banner-ad promotion commercial",
    "form": "form search searchbox login signin register input contact-form poll survey",
    "talk": "comment comments reply replies discussion disqus respond feedback responses reviews",
    "share": "share sharing social follow buttons tags tagcloud meta byline rating print",
    "good": "article content main post entry story text body page-content entry-content post-content article-body story-body main-content prose",
}
#: Words for a part of a layout: with one of them last, a compound's first word says what the part holds.
FRAME = set("area bar block box bottom cell column container frame grid group holder inner item items left link links list outer panel right row section slot top unit wrap wrapper zone".split())
_KIND = {word: kind for kind, words in NAMED.items() for word in words.split()}
ELEMENT = {
    "nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "button": "form", "label": "form",
    "dialog": "note", "search": "form", "article": "good", "main": "good", "address": "share", "head": "note",
}
KINDS = tuple(NAMED)
PLAIN = ("p", "heading", "list", "table", "quote", "other", "run", "root")
SIZES = ("tiny", "short", "medium", "long")
FEATURES = (
    ["bias"] + [f"{at}_{k}" for at in ("tag", "name", "lead") for k in KINDS] + [f"is_{k}" for k in PLAIN] + [f"text_{k}" for k in SIZES]
    + ["linked", "half_linked", "sentence", "copyright"]
)
_INDEX = {name: i for i, name in enumerate(FEATURES)}
_GROUP = {"p": "p", "pre": "quote", "blockquote": "quote", "ul": "list", "ol": "list", "li": "list", "dl": "list", "dt": "list", "dd": "list", "html": "root", "body": "root"}
_GROUP |= {f"h{i}": "heading" for i in range(1, 7)} | dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "table")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<odd>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|</?[a-zA-Z][^>]*(?:>|$)|<[!?/][^>]*(?:>|$)",
    re.S | re.I,
)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in SKIPPED}
_NAME = re.compile(r"(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")


class Tree:
    """Nodes in page order: parent number (-1 at the root), feature numbers, text of runs (None for elements)."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.features: list[list[int]] = []
        self.text: list[str | None] = []

    def add(self, parent: int, features: list[int], text: str | None) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        return len(self.parent) - 1


def kind_of(name: str) -> str | None:
    """The feature of a hyphenated name, if any of its words is of a kind.

    A name says what an element is ("name") if it is such a word, ends in one, or begins with
    one and ends in a layout's word; one that only begins with such a word is about it ("lead").
    """
    parts = name.split("-")
    told = next((_KIND[w] for w in (name, parts[-1]) if w in _KIND), None)
    if told:
        return "name_" + told
    if parts[0] in _KIND:
        return ("name_" if parts[-1] in FRAME else "lead_") + _KIND[parts[0]]
    return None


_element_memo: dict[tuple[str, str], list[int]] = {}


def element_features(tag: str, rest: str) -> list[int]:
    key = (tag, rest)
    if (known := _element_memo.get(key)) is not None:
        return known
    found = {"bias", "is_" + _GROUP.get(tag, "other")}
    if tag in ELEMENT:
        found.add("tag_" + ELEMENT[tag])
    if tag not in ("html", "body"):  # page-wide classes say little about the page's parts
        for m in _NAME.finditer(rest):
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower().replace("_", "-")
            for word in _WORD.findall(value):
                if feature := kind_of(word):
                    found.add(feature)
        if _HIDDEN.search(rest):
            found.add("name_note")
    out = sorted(_INDEX[x] for x in found)
    if len(_element_memo) > 20_000:
        _element_memo.clear()
    _element_memo[key] = out
    return out


def run_features(text: str, linked: int) -> list[int]:
    n = len(text)
    found = ["bias", "is_run", "text_" + SIZES[(n > 20) + (n > 60) + (n > 200)]]
    if linked >= 0.8 * n:
        found.append("linked")
    elif linked >= 0.4 * n:
        found.append("half_linked")
    if text[-1] in ".!?…。！？:;\"”»":
        found.append("sentence")
    if "©" in text[:40]:
        found.append("copyright")
    return [_INDEX[x] for x in found]


def parse(page: str) -> Tree:
    """The tree of block elements and text runs; inline elements only count as links or not."""
    tree = Tree()
    root = tree.add(-1, element_features("html", ""), None)
    stack: list[tuple[str, int]] = [("html", root)]
    pieces: list[str] = []
    linked, anchors, at = 0, 0, 0
    held: Counter[str] = Counter()  # open elements of each tag
    open_ended: set[str] = set()  # skipped elements without an end tag in the rest of the page

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            pieces.append(raw)
            if anchors and not raw.isspace():
                linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                tree.add(stack[-1][1], run_features(text, linked), text)
            pieces.clear()
        linked = 0

    def shut(begin: int) -> None:
        while len(stack) > begin:
            held[stack.pop()[0]] -= 1

    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["odd"] or "").lower()
        if tag in SKIPPED and not m["end"] and not (tag == "svg" and m[0].endswith("/>")):
            end = None if tag in open_ended else _END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in RAW:
                at = len(page)
            else:
                open_ended.add(tag)
        if m["tag"] is None:
            continue
        if tag in BREAKS:
            say(" ")
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            anchors = 0 if m["end"] else 1
            continue
        if tag not in BLOCK:
            continue
        flush()
        anchors = 0
        if m["end"]:
            if held[tag] > 0:  # else the tag ends nothing, and no search for it is made
                shut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag == "html":
            continue
        top = stack[-1][0]
        if tag == "body":
            shut(1)
        elif tag not in FALLBACK and (top == "p" or (top[0] == "h" and top[1:].isdigit() and tag != "p")):
            shut(len(stack) - 1)  # a block ends an open paragraph, and a block other than a paragraph an open heading
        if tag in CLOSES and any(held[t] > 0 for t in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    shut(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section"):
                    break
        stack.append((tag, tree.add(stack[-1][1], element_features(tag, m["rest"] or ""), None)))
        held[tag] += 1
    say(page[at:])
    flush()
    return tree


class Model:
    """weights: the log-odds a feature adds to its node; edges: log potentials [parent label][child label]."""

    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights.tolist(), edges.tolist()

    def marginals(self, tree: Tree) -> tuple[list[float], list[tuple[float, float]]]:
        """P(label 1) of each node, and of each node but the root P(parent 1, child 1) and P(parent 1, child 0).

        Messages are log-odds.  Children follow their parents in page order, so that one
        pass backwards sends all messages up and one forwards sends all down.
        """
        parent, w = tree.parent, self.weights
        (e00, e01), (e10, e11) = [[math.exp(x) for x in row] for row in self.edges]
        n = len(parent)
        up = [0.0] * n
        belief = [sum([w[i] for i in f]) for f in tree.features]
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):
            b = exp(min(max(belief[i], -40.0), 40.0))
            up[i] = m = log((e10 + e11 * b) / (e00 + e01 * b))
            belief[parent[i]] += m
        out = [0.0] * n
        both: list[tuple[float, float]] = [(0.0, 0.0)] * n
        full = [0.0] * n
        full[0] = belief[0]
        out[0] = 1 / (1 + exp(-min(max(full[0], -40.0), 40.0)))
        for i in range(1, n):
            c = exp(min(max(full[parent[i]] - up[i], -40.0), 40.0))
            down = (e01 + e11 * c) / (e00 + e10 * c)
            full[i] = belief[i] + log(down)
            out[i] = 1 / (1 + exp(-min(max(full[i], -40.0), 40.0)))
            b = exp(min(max(belief[i], -40.0), 40.0))
            total = e00 + e01 * b + c * (e10 + e11 * b)
            both[i] = (c * e11 * b / total, c * e10 / total)
        return out, both


# Parts of the labelled pages.  {t}: a sentence or more, {s}: a few words, {l}: links.
CONTENT = (
    "<h1>{s}</h1>", "<h2>{s}</h2>", "<p>{t}</p>", "<p>{t}</p>", "<p>{t}</p>", "<p>{t} <a href='/x'>{s}</a> {t}</p>", "<ul><li>{t}</li><li>{s}</li></ul>",
    "<blockquote><p>{t}</p></blockquote>", "<p><b>{t}<br><p>{t}", "<table><tr><td>{s}</td><td>{s}</td></tr></table>", "<div><p>{t}</p></div>", "<div>{t}</div>",
    "<pre>{t}</pre>", "<p>{s}</p>", "<figure><figcaption>{s}</figcaption></figure>", "<section><h3>{s}</h3><p>{t}</p></section>", "<h3>{s}</h3><p>{t}</p>",
    "<ol><li>{s}</li><li>{t}</li></ol>", "<p>{t}", "<p>{l} {t}</p>", "{t}",
)
INSIDE = ("{t}", "<p>{t}</p>", "<p>{t}</p><p>{t}</p>", "{s}", "<ul><li>{l}</li><li>{l}</li></ul>", "<h3>{s}</h3><p>{t}</p>", "{l} {l}", "<div><p>{t}</p><p>{s}</p></div>", "<div>{t}</div>")
WRAPS = ("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='main'><div class='post entry-content'>{}</div></div>", "<section>{}</section>", "<div>{}</div>", "<main><article class='post'>{}</article></main>", "<article><div class='article-body'>{}</div></article>")
JUNK_TAGS = ("nav", "header", "footer", "aside", "form", "dialog", "menu")


def labelled_pages(n: int = 500, seed: int = 5) -> list[tuple[Tree, np.ndarray]]:
    """Pages of known content, with a label for each node: 1 for content runs and all that stands above one."""
    rng = np.random.default_rng(seed)

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def fill(pattern: str, mark: str) -> str:
        def words(a: int, b: int) -> str:
            return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(int(rng.integers(a, b))))

        made = {"{t}": lambda: mark + words(6, 60) + ".", "{s}": lambda: mark + words(1, 7), "{l}": lambda: f"<a href='/x'>{mark + words(1, 4)}</a>"}
        return re.sub(r"\{[tsl]\}", lambda m: made[m[0]](), pattern)

    kinds = sorted(_KIND)

    def word() -> str:
        return "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(3, 10))))

    def named(part: str) -> str:
        """Content under a name of its own: a compound that begins with any kind's word tells nothing here."""
        name = pick((word(), f"{word()}-{word()}", *[f"{pick(kinds)}-{word()}"] * 3, f"{pick(kinds)}-{word()}-{word()}"))
        tag = pick(("div", "div", "section", "p")) if part.startswith("{t}") else pick(("div", "div", "section"))
        return f"<{tag} {pick(('class', 'id'))}='{name}'>{part}</{tag}>"

    def junk() -> str:
        kind = pick([k for k in KINDS if k != "good"])
        inner = fill(pick(INSIDE), "~") if rng.random() < 0.7 else fill(pick(INSIDE) + pick(INSIDE), "~")
        name = pick([w for w in NAMED[kind].split()])
        chance = rng.random()
        name = f"{name}-{pick(sorted(FRAME))}" if chance < 0.25 else f"{word()}-{name}" if chance < 0.35 else f"{name}-{word()}" if chance < 0.4 else name
        if rng.random() < 0.45:
            tag = pick(JUNK_TAGS)
            title = f" class='{name}'" if rng.random() < 0.3 else ""
            if tag == "footer" and rng.random() < 0.5:
                inner = "&copy; ~" + inner
            return f"<{tag}{title}>{inner}</{tag}>"
        tag = pick(("div", "div", "section", "ul", "p"))
        inner = f"<li>{inner}</li>" if tag == "ul" else fill("{t}", "~") if tag == "p" else inner
        return f"<{tag} {pick(('class', 'id'))}='{name}'>{inner}</{tag}>"

    out = []
    for _ in range(n):
        parts = [fill(named(pick(CONTENT)) if rng.random() < 0.35 else pick(CONTENT), "") for _ in range(int(rng.integers(1, 9)))]
        for _ in range(int(rng.integers(0, 3))):
            parts.insert(int(rng.integers(0, len(parts) + 1)), junk())
        body = pick(WRAPS).replace("{}", "".join(parts))
        body = "".join(junk() for _ in range(int(rng.integers(0, 4)))) + body + "".join(junk() for _ in range(int(rng.integers(0, 4))))
        if rng.random() < 0.3:
            body = f"<div class='{pick(('wrapper', 'page', 'container', 'site'))}'>{body}</div>"
        tree = parse(f"<html><body>{body}</body></html>")
        label = np.zeros(len(tree.parent))
        for i in range(len(label) - 1, -1, -1):
            if tree.text[i] is not None and "~" not in tree.text[i]:
                label[i] = 1
            if label[i] and tree.parent[i] >= 0:
                label[tree.parent[i]] = 1
        out.append((tree, label))
    return out


def train(pages: list[tuple[Tree, np.ndarray]], rounds: int = 60, penalty: float = 0.01) -> Model:
    """Maximum conditional likelihood: the gradient is what is seen less what the marginals expect (Adam).

    By what labels mean, no node without content holds one with content: that edge
    potential starts at, and stays near, impossible.
    """
    weights, edges = np.zeros(len(FEATURES)), np.array([[0.5, -12.0], [0.0, 0.0]])
    mean, square = [np.zeros_like(weights), np.zeros_like(edges)], [np.zeros_like(weights), np.zeros_like(edges)]
    steps, batch = rounds * -(-len(pages) // 25), 25
    step = 0
    for _ in range(rounds):
        for at in range(0, len(pages), batch):
            model, gw, ge = Model(weights, edges), -penalty * weights, -penalty * edges
            for tree, label in pages[at : at + batch]:
                out, both = model.marginals(tree)
                gap = label - np.array(out)
                lengths = [len(f) for f in tree.features]
                np.add.at(gw, np.concatenate([np.asarray(f) for f in tree.features]), np.repeat(gap, lengths))
                up = np.array(tree.parent[1:], np.int64)
                if len(up):
                    p11, p10 = np.array(both[1:]).T
                    p01, y, z = np.array(out[1:]) - p11, label[up], label[1:]
                    ge += [[((1 - y) * (1 - z)).sum() - (1 - p11 - p10 - p01).sum(), ((1 - y) * z).sum() - p01.sum()], [(y * (1 - z)).sum() - p10.sum(), (y * z).sum() - p11.sum()]]
            ge[0, 1] = 0
            step += 1
            rate = 0.5 * (1 - (step - 1) / steps)
            for k, (x, g) in enumerate(((weights, gw / batch), (edges, ge / batch))):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g**2
                x += rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
    return Model(weights, edges)


_trained: list[Model] = []


def default_model() -> Model:
    """Trained once a driver process."""
    if not _trained:
        _trained.append(train(labelled_pages(400), rounds=12))
    return _trained[0]


def main_text(model: Model, page: str | None) -> str:
    if not page:
        return ""
    tree = parse(page)
    keep = model.marginals(tree)[0]
    return "\n\n".join(text for text, p in zip(tree.text, keep, strict=True) if text is not None and p > 0.5)


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(shared.value, x.as_py()) for x in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
