"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements with the text that stands directly in them. Boosted trees give every node the probability
that its text is main text. Decoding gives each subtree one of: all kept, all dropped, or mixed, where the
children decide, so that no node contradicts the ones above it.

There are no labels. Pages that mark their article up (article, main) teach: text inside is main unless a
boilerplate element or name stands between. Every training node also comes without its marks, so that pages without
such markup are judged by density and shape, and twice with the shape of others, so that marks outweigh the shape of
the pages at hand.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.llm import boosting
from lithoframe.llm.common import add_text_columns, portions, thinned

SCHEMA = "text string, n_chars long"

# Element names of HTML, and words that sites name their parts with.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
HIDDEN = frozenset("noscript template svg object canvas audio video select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var "
                   "math maction menclose merror mfenced mfrac mmultiscripts mover mpadded mphantom mprescripts mroot mrow "
                   "mspace msqrt mstyle msub msubsup msup mtable munder munderover none semantics".split())
# Parts of a formula that stand beside each other: inline, with a space before.
TOKENS = frozenset("mi mn mo ms mtext mtr mlabeledtr mtd annotation annotation-xml".split())
ENDS_P = frozenset("address article aside blockquote details dialog div dl dd dt fieldset figcaption figure footer form h1 "
                   "h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul xmp".split())
BLOCKS = ENDS_P | frozenset("body dd dt tr td th tbody thead tfoot caption".split())
# Elements of HTML that can't stand in svg and end it.
ENDS_SVG = BLOCKS - frozenset("tr td th tbody thead tfoot caption".split()) | frozenset(
    "b big body br center code em embed i img listing meta ruby s small span strong strike sub sup tt u var".split())
SAME_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section main div".split())
MAIN_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form menu button dialog fieldset".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp li td dd dt figcaption".split())
MAIN_NAMES = frozenset("article body content entry main post story text".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert advertisement adverts alert author banner bar bio breadcrumb breadcrumbs byline comment comments "
    "complementary contentinfo cookie cookies copyright disclaimer discussion disqus donate feedback filter foot footer form "
    "gdpr head header legal links login masthead menu meta modal more nav navbar navigation newsletter notice overlay "
    "pager pagination popup promo promoted promotion rail recommended register related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar "
    "trending warning widget".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"""
                  r"""((?>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)(?:>|\Z)|[^>]*(?:>|\Z))""", re.S)
_PAIRS = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|"
                    rf"<(/?)({'|'.join(sorted(HIDDEN))})(?=[\s/>])[^>]*", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_XMP = re.compile(r"</xmp(?=[\s/>])[^>]*>", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
N_FEATURES = 18
#: Columns that tell the marks of a node, of those around it and of those inside; the others tell density and shape.
NAMES = (8, 9, 10, 11, 16, 17)


@dataclass(frozen=True)
class Settings:
    pages: int = 1024       # bound of the training sample
    trees: int = 40
    depth: int = 4
    rate: float = 0.2


@dataclass
class Page:
    """Nodes in page order, and the text segments that stand directly in them."""
    tag: list = field(default_factory=lambda: ["html"])
    parent: list = field(default_factory=lambda: [-1])
    depth: list = field(default_factory=lambda: [0])
    main: list = field(default_factory=lambda: [0])      # names of main text in class, id and role
    other: list = field(default_factory=lambda: [0])     # and of other parts
    at: list = field(default_factory=list)               # node of a segment
    text: list = field(default_factory=list)
    linked: list = field(default_factory=list)           # its characters inside links


def ended(source: str) -> set[int]:
    """Where the elements of HIDDEN begin that have an end tag of their own."""
    opened, found = {}, set()
    for m in _PAIRS.finditer(source):
        name = (m[3] or "").lower()
        if m[2] and opened.get(name):
            found.add(opened[name].pop())
        elif name and not m[2] and not m[0].endswith("/"):
            opened.setdefault(name, []).append(m.start())
    return found


def parse(source: str | None) -> Page:
    """Elements are closed as browsers do where it matters for text: p by a block, li by li, and all by the end.

    The tags of head count for nothing: what may stand in it has no text, and anything else ends it. An element of HIDDEN
    ends at its end tag or where its parent is closed, svg at an element of HTML, and one without an end tag at the next block.
    """
    page, stack, pieces, links, hidden, pos = Page(), [0], [], 0, [], 0
    anchors, inline, whole, closed = 0, {}, None, True
    source = source or ""

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                page.at.append(stack[-1])
                page.text.append(text)
                page.linked.append(min(len(text), links))
            pieces.clear()
        links = 0

    def close(names, stop=frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[k]]
            if tag in names:
                flush()
                del stack[k:]
                return
            if tag in stop:
                return

    def add(raw: str) -> None:
        nonlocal links
        if raw and not hidden:
            pieces.append(raw)
            if anchors:
                links += len(raw)

    while pos < len(source):
        m = _TAG.search(source, pos)
        if m is None:
            add(source[pos:])
            break
        add(source[pos:m.start()])
        pos = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(name):]
                continue
            if hidden and not inline.get(name) and not any(page.tag[k] == name for k in stack[1:]):
                continue
            hidden.clear()
            if name in INLINE or name in TOKENS:
                inline[name] = max(0, inline.get(name, 0) - 1)
                if name == "a":
                    anchors = max(0, anchors - 1)
            elif name in ("br", "p") and not any(page.tag[k] == name for k in stack):
                add(" ")
            else:
                close((name,))
            continue
        if hidden and (hidden[0] == "svg" and name in ENDS_SVG and not {"foreignobject", "desc"} & set(hidden)
                       or not closed and name in BLOCKS):
            hidden.clear()
        if name in RAW:
            if "svg" in hidden and m[3].endswith("/>"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, pos)
            pos = end.end() if end else len(source)
            continue
        if hidden or name in HIDDEN:
            if not m[3].endswith("/>") and name not in VOID:
                if not hidden:
                    whole = ended(source) if whole is None else whole
                    closed = m.start() in whole
                hidden.append(name)
            continue
        if name in VOID:
            if name == "br":
                add(" ")
            elif name == "hr":
                flush()
            continue
        if name in INLINE or name in TOKENS:
            if not m[3].endswith("/>"):
                inline[name] = inline.get(name, 0) + 1
            anchors += name == "a"
            if name in TOKENS:
                add(" ")
            continue
        if name in ("html", "head"):
            inline[name] = 1
            continue
        if name in ENDS_P:
            close(("p",), SCOPE)
        if name in SAME_ENDS:
            close(SAME_ENDS[name], SCOPE - {name})
        flush()
        names = [w.lower() for x in _NAMED.findall(m[3]) for w in _WORDS.findall(" ".join(x))] if m[3] != ">" else ()
        page.tag.append(name)
        page.parent.append(stack[-1])
        page.depth.append(len(stack))
        page.main.append(sum(w in MAIN_NAMES for w in names))
        page.other.append(sum(w in OTHER_NAMES for w in names))
        stack.append(len(page.tag) - 1)
        if name == "xmp":
            end = _XMP.search(source, pos)
            add(html.escape(source[pos:end.start() if end else len(source)], quote=False))
            pos = end.end() if end else len(source)
            close((name,))
    flush()
    return page


def subtree_sums(page: Page, values: np.ndarray) -> np.ndarray:
    """Sums over each node and all below it (children come after their parents)."""
    total = values.astype(float).copy()
    for k in range(len(total) - 1, 0, -1):
        total[page.parent[k]] += total[k]
    return total


def marks_of(page: Page) -> np.ndarray:
    """1 for an element or name of main text, -1 for one of another part (which wins), 0 for neither."""
    made = np.array([-1.0 if t in OTHER_TAGS or o else 1.0 if t in MAIN_TAGS or m else 0.0
                     for t, m, o in zip(page.tag, page.main, page.other)])
    made[[t in ("html", "body") for t in page.tag]] = 0
    return made


def node_features(page: Page) -> np.ndarray:
    n = len(page.tag)
    parent, at = np.array(page.parent), np.array(page.at, np.int64)
    length = np.array([len(t) for t in page.text], float)
    own = np.bincount(at, length, n)
    marks = np.bincount(at, [sum(map(t.count, ".,;:!?")) for t in page.text], n)
    columns = np.stack([own, np.bincount(at, page.linked, n), marks, np.bincount(at, minlength=n), np.ones(n),
                        np.array([t == "p" for t in page.tag])], axis=1)
    for k in range(n - 1, 0, -1):
        columns[parent[k]] += columns[k]
    chars, linked, marks, segments, nodes, paragraphs = columns.T
    up = np.maximum(parent, 0)
    siblings = np.bincount(up[1:], minlength=n)[up]
    place, seen = np.zeros(n), {}
    for k in range(1, n):
        place[k] = seen[up[k]] = seen.get(up[k], -1) + 1
    tags = np.array([hash_kind(t) for t in page.tag])
    alike = np.unique(up * 64 + tags, return_inverse=True, return_counts=True)
    own = marks_of(page)
    nearest, above = own.copy(), np.zeros((n, 2))
    for k in range(1, n):
        p = parent[k]
        nearest[k] = own[k] or nearest[p]
        above[k] = above[p] + (own[p] > 0, own[p] < 0)
    inside = np.stack([own > 0, own < 0], axis=1).astype(float)
    for k in range(n - 1, 0, -1):
        inside[parent[k]] += inside[k]
    safe = np.maximum(chars, 1)
    return np.stack([
        np.log1p(chars), linked / safe, chars / nodes, np.array(page.depth, float), np.log1p(siblings),
        place / np.maximum(siblings - 1, 1), alike[2][alike[1]] / np.maximum(siblings, 1), 100 * marks / safe,
        own, nearest, inside[:, 0], inside[:, 1], np.log1p(paragraphs), chars / np.maximum(segments, 1),
        chars / np.maximum(chars[up], 1), np.array([t in TEXT_TAGS for t in page.tag], float),
        above[:, 0], above[:, 1]], axis=1)


def hash_kind(tag: str) -> int:
    return sum(tag.encode()) % 64


def weak_labels(page: Page) -> np.ndarray | None:
    """Per node 1 if most of its text is main by the page's own markup, else 0, nan without text; None if the page has none."""
    n = len(page.tag)
    if not any(t in MAIN_TAGS for t in page.tag):
        return None
    own, state = marks_of(page), np.zeros(n)
    for k in range(1, n):
        state[k] = own[k] > 0 if own[k] else state[page.parent[k]]
    at = np.array(page.at, np.int64)
    length = np.array([len(t) for t in page.text], float)
    good, all_ = np.bincount(at, length * state[at], n), np.bincount(at, length, n)
    good, all_ = subtree_sums(page, good), subtree_sums(page, all_)
    return np.where(all_ > 0, (good >= 0.5 * all_).astype(float), np.nan)


def decode(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """Which nodes keep the text that stands directly in them.

    keep and drop take every node of a subtree at its log probability; mixed pays for the node's own certainty.
    Nodes without text below have no say.
    """
    n = len(page.tag)
    length = np.zeros(n)
    np.add.at(length, np.array(page.at, np.int64), [len(t) for t in page.text])
    has = subtree_sums(page, length) > 0
    z = np.clip(log_odds, -12, 12)
    log_p, log_q = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
    keep, drop = np.where(has, log_p, 0.0), np.where(has, log_q, 0.0)
    mixed = np.where(has, np.log(2) + np.minimum(log_p, log_q), 0.0)
    own = np.where(length > 0, np.maximum(log_p, log_q), 0.0)
    best = np.zeros(n)
    choice = np.zeros(n, np.int8)      # 0 drop, 1 keep, 2 mixed
    below = own.copy()
    for k in range(n - 1, -1, -1):
        options = (drop[k], keep[k], mixed[k] + below[k])
        choice[k] = int(np.argmax(options))
        best[k] = options[choice[k]]
        p = page.parent[k]
        if p >= 0:
            keep[p] += keep[k]
            drop[p] += drop[k]
            below[p] += best[k]
    kept = np.zeros(n, bool)
    forced = np.full(n, 2, np.int8)
    for k in range(n):
        p = page.parent[k]
        forced[k] = forced[p] if p >= 0 and forced[p] != 2 else choice[k]
        kept[k] = forced[k] == 1 or (forced[k] == 2 and log_odds[k] > 0)
    return kept


def learn(pages: DataFrame, source: str = "html", settings: Settings = Settings()) -> bytes:
    """The trees, from at most about ``pages`` different pages drawn by a hash of their source; b"" if none marks its article
    up. Copies of a page count once.

    Node features are made where the pages are; one task fits the trees on that bounded sample.
    """
    s = settings
    every = pages.select(F.col(source).alias("_html")).filter(F.col("_html").isNotNull())
    n = every.select(F.xxhash64("_html")).distinct().count()
    drawn = thinned(every, F.col("_html"), s.pages, n).distinct()

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(0).to_pylist():
                page = parse(x)
                y = weak_labels(page)
                if y is not None and page.text:
                    use = ~np.isnan(y)
                    rows.append(np.concatenate([node_features(page)[use], y[use, None]], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["_x"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for b in batches for x in b.column(0).to_pylist())
        if not rows:
            return
        both = np.frombuffer(b"".join(rows)).reshape(-1, N_FEATURES + 1)
        x, y = both[:, :-1], both[:, -1]
        rng, views = np.random.default_rng(0), [x]
        blank = x.copy()
        blank[:, NAMES] = 0
        views.append(blank)
        for _ in range(2):
            shuffled = rng.permuted(x, axis=0)
            shuffled[:, NAMES] = x[:, NAMES]
            views.append(shuffled)
        every = np.concatenate(views)
        trees = boosting.fit(every, np.tile(y, len(views)), np.ones(len(every)), s.trees, s.depth, s.rate)
        yield pa.RecordBatch.from_arrays([pa.array([trees.to_bytes()], pa.binary())], ["model"])

    row = drawn.mapInArrow(featured, "_x binary").repartition(1).mapInArrow(trained, "model binary").first()
    return bytes(row["model"]) if row else b""


def untrained(x: np.ndarray) -> np.ndarray:
    """Without a model: names and kinds alone."""
    return np.where(x[:, 9] < 0, -4.0, np.where(x[:, 1] > 0.6, -2.0, 2.0))


def extract(pages: DataFrame, model: bytes, source: str = "html", prefix: str = "") -> DataFrame:
    """pages with text, the kept blocks joined by blank lines, and n_chars, its code points.

    A block is text with no block element inside; white space in it is one space. Null, empty and text-free pages give an
    empty text. New names begin with ``prefix``; input columns of these names are replaced.
    """
    def batch(sources: list) -> pd.DataFrame:
        odds, texts = (boosting.Trees.from_bytes(model).log_odds if model else untrained), []
        for part in portions(sources):
            parsed = [parse(x) for x in part]
            features = [node_features(p) if p.text else np.empty((0, N_FEATURES)) for p in parsed]
            scores = np.split(odds(np.concatenate(features)), np.cumsum([len(f) for f in features])[:-1])
            for page, z in zip(parsed, scores):
                kept = decode(page, z) if page.text else ()
                texts.append("\n\n".join(t for k, t in zip(page.at, page.text) if kept[k]))
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return add_text_columns(pages, source, batch, SCHEMA, prefix)
