"""Main text of web pages with a tree-structured graphical model over the DOM.

Every block element and every block of text is a node with two states, content and boilerplate. A node's own potential
comes from discrete features (tag with the share of linked text below it, words of class and id, text length, share of
links, sentence end, a box's share of the page's text, and what the ancestors of a text are marked as); a potential on each parent-child edge depends on the
kind of the parent, so that what is marked as no content says so to all below it, while a box that only lays out other
boxes says nothing. Sum-product messages go
up and then down the tree, which gives the exact marginal of every node; the blocks of text whose content marginal is
over a half are the result, in page order.

The potentials are counts from labelled pages: pages of a bounded sample (``MAX_PAGES`` with the least hash of their
id) that mark their article and hold half of their text in it. The label is the mark alone: what lies in it is content, but for nested menus and the like;
what holds it has no label, and neither has what its class calls no content inside it. On half of the pages the mark and
all class words are hidden from the features, so that what is learned is not the labels' own rule. Fixed pseudo-counts say what tags and class names mean before any page is seen;
counts outweigh them as they grow, up to a bound for each feature. A feature that was never seen keeps its pseudo-counts:
a list without links is not judged by the menus. What is collected and broadcast is one count per feature value.
Pages are read where they lie and never shuffled. ``held_out_f1`` measures the model on labelled pages that it was not
trained on, with mark and class words hidden.

Defined cases: null and empty pages, and pages without content, give an empty text; a page cut off in a tag, entity
or comment loses that piece only; unclosed elements end where the next sibling or an ancestor's end says; nesting of
any depth, very long pages and quotes that never close are handled in linear time; text of elements that only some
browsers draw (mathematics, drawings, objects) is text like any other; repeated rows each get a result; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 2_000
#: Log odds of one feature at most, by kind, and the share of sampled pages (by hash of their id) that only measure.
MOST_ODDS, HELD_OUT = {"tag": 4.0, "class": 8.0, "text": 2.0, "under": 4.0, "share": 2.0}, 5

#: Elements of HTML by their role in a page.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title select option button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
FENCES = frozenset("table ul ol dl td th article section main aside nav div body html blockquote form header footer".split())

#: Pseudo-counts (content, boilerplate) of feature values.
TAG_HINTS = {
    "nav": (0.2, 12), "footer": (0.2, 12), "aside": (0.2, 12), "form": (0.2, 12), "menu": (0.2, 12), "dialog": (0.2, 12), "header": (0.4, 8), "head": (0.2, 12), "fieldset": (0.2, 12),
    "noscript": (1, 3), "article": (15, 0.3), "main": (10, 0.7), "p": (4, 2), "h1": (4, 2), "h2": (3, 2), "h3": (3, 2), "blockquote": (4, 1), "pre": (4, 1), "body": (1, 20), "html": (1, 20), "ul": (2, 2), "li": (2, 2),
}
BAD_WORDS = (
    "ad ads advert advertisement adsbygoogle banner breadcrumb breadcrumbs byline-share comment comments commentlist cookie cookies consent disqus foot footer form gdpr hero-nav login masthead menu modal nav navbar "
    "navigation newsletter notice notification notifications popup promo promoted promotion reader-comments related replies reply respond share sharing sidebar signup site-header skip social sponsor sponsored subscribe toolbar widget"
).split()
GOOD_WORDS = "article body content entry main post story text articlebody prose".split()
CLASS_HINTS = {"bad": (0.2, 20), "good": (8, 2), "none": (3, 3)}
UNDER_HINTS = {"bad": (0.2, 20), "good": (6, 2)}
SHARE_HINTS = ((2, 3), (2, 2), (3, 2))  # of a box that holds less than a tenth, less than half, or more of the page's text
#: Elements that are no content by themselves, those that say so of all below them, and what only lays out.
NO_CONTENT = frozenset("nav aside footer form menu dialog header fieldset".split())
NEVER_BELOW = frozenset("nav aside footer menu dialog".split())
BOXES = frozenset("div section main center td article".split())
#: A class word that begins so is about the layout ("has-sidebar").
ABOUT_LAYOUT = re.compile(r"^(?:has|with|without|no|is|show|hide)[-_]")

TOKEN = re.compile(r"<!--|<[!?]|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu"}


class Page:
    """Nodes in page order, parents before children: parent index, tag, class group, and text of text nodes."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["#root"]
        self.group: list[str] = ["none"]
        self.text: dict[int, str] = {}
        self.linked: dict[int, int] = {}
        self._stack: list[tuple[str, int]] = [("#root", 0)]
        self._pieces: list[str] = []
        self._linked, self._anchors = 0, 0
        self._open_tags: Counter = Counter()
        self._never: set[str] = set()  # end marks that do not come any more
        self._read(source)
        self._flush()

    def _owner(self) -> int:
        return self._stack[-1][1]

    def _add(self, tag: str, group: str) -> int:
        self.parent.append(self._owner())
        self.tag.append(tag)
        self.group.append(group)
        return len(self.tag) - 1

    def _flush(self) -> None:
        text = " ".join("".join(self._pieces).split())
        if text:
            node = self._add("#text", "none")
            self.text[node], self.linked[node] = text, min(self._linked, len(text))
        self._pieces, self._linked = [], 0

    def _say(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            self._pieces.append(text)
            if self._anchors:
                self._linked += len(text.strip())

    def _pop_to(self, depth: int) -> None:
        for tag, _ in self._stack[depth:]:
            self._anchors -= tag == "a"
            self._open_tags[tag] -= 1
        if any(tag in BLOCKS for tag, _ in self._stack[depth:]):
            self._flush()
        del self._stack[depth:]

    def _open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._pieces.append(" ")
            return
        block = tag in BLOCKS
        if block:
            ends = ("p", *CLOSES.get(tag, ()))
            for depth in range(len(self._stack) - 1, 0, -1) if any(self._open_tags[x] for x in ends) else ():
                name = self._stack[depth][0]
                if name == "p" or name in CLOSES.get(tag, ()):
                    self._pop_to(depth)
                    if name not in ("td", "th", "p") or tag not in ("tr", "tbody", "tfoot"):
                        break
                elif name in FENCES:
                    break
            self._flush()
        if tag in VOID or rest.rstrip().endswith("/") and not block and tag != "a":
            return
        node = self._add(tag, class_group(rest)) if block else self._owner()
        self._stack.append((tag, node))
        self._open_tags[tag] += 1
        self._anchors += tag == "a"

    def _close(self, tag: str) -> None:
        for depth in range(len(self._stack) - 1, 0, -1) if self._open_tags[tag] else ():
            if self._stack[depth][0] == tag:
                self._pop_to(depth)
                return
            if tag not in BLOCKS and self._stack[depth][0] in BLOCKS:
                return
        if tag in BLOCKS:
            self._flush()

    def _after(self, source: str, mark: str, at: int) -> int:
        """Place after the next mark, or -1; a mark that does not come any more is looked for once."""
        found = -1 if mark in self._never else source.find(mark, at)
        if found < 0:
            self._never.add(mark)
            return -1
        return found + len(mark)

    def _tag_end(self, source: str, at: int) -> tuple[str, int]:
        """The attributes of a tag, and the place after it; a quote that never closes is a character like others."""
        start = at
        while True:
            stop = _TAG_STOP.search(source, at)
            if stop is None:
                return source[start:], len(source)
            at = stop.end()
            if stop[0] == ">":
                return source[start : at - 1], at
            at = max(at, self._after(source, stop[0], at))

    def _raw_end(self, source: str, tag: str, at: int) -> int:
        """Place after the end tag of an element whose content is no text of the page, or -1."""
        if "/" + tag in self._never:
            return -1
        stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
        if stop is None:
            self._never.add("/" + tag)
            return -1
        return stop.end()

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = TOKEN.search(source, at)
            if m is None:
                self._say(source[at:])
                return
            self._say(source[at : m.start()])
            if not m["tag"]:
                at = self._after(source, "-->" if m[0] == "<!--" else ">", m.end())
                if at < 0:
                    return
                continue
            tag = m["tag"].lower()
            rest, at = self._tag_end(source, m.end())
            if m["end"]:
                self._close(tag)
            elif tag in RAW and not rest.rstrip().endswith("/"):
                stop = self._raw_end(source, tag, at)
                at = stop if stop >= 0 else len(source) if tag in ("script", "style", "textarea", "title") else at
            else:
                self._open(tag, rest)


_TAG_STOP = re.compile("[>\"']")


def class_group(rest: str) -> str:
    """What class, id and role say: bad, good or none."""
    if "=" not in rest and "hidden" not in rest:
        return "none"
    good = False
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" and not m[2] or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value) or name == "role" and value in ROLES:
            return "bad"
        if name in ("class", "id"):
            words = [w for w in value.split() if not ABOUT_LAYOUT.match(w)]
            parts = {p for w in words for p in re.split(r"[-_]+", w)} | set(words)
            if parts & _BAD:
                return "bad"
            good = good or bool(parts & _GOOD)
    return "good" if good else "none"


_BAD, _GOOD = frozenset(BAD_WORDS), frozenset(GOOD_WORDS)


def link_share(linked: int, n: int) -> int:
    return 0 if linked * 5 < n or not n else 1 if linked * 5 < 3 * n else 2


def unders(page: Page, hide_mark: bool = False) -> list[str]:
    """What the ancestors of each node are marked as: bad if any is, else good if any is, else none. The page's own
    elements (body and above) are not asked."""
    out = ["none"] * len(page.tag)
    for i in range(1, len(page.tag)):
        p = page.parent[i]
        tag, group = page.tag[p], "none" if hide_mark else page.group[p]
        if out[p] == "bad" or tag in NEVER_BELOW or group == "bad" and tag not in TOP:
            out[i] = "bad"
        elif out[p] == "good" or not hide_mark and (tag in ("article", "main") or group == "good" and tag not in TOP):
            out[i] = "good"
    return out


def features(page: Page, hide_mark: bool = False) -> list[tuple]:
    """Per node its feature values; hidden marks: no article or main, and no words of class, id or role."""
    out = []
    total, linked = [0] * len(page.tag), [0] * len(page.tag)
    for i in range(len(page.tag) - 1, 0, -1):
        if i in page.text:
            total[i], linked[i] = len(page.text[i]), page.linked[i]
        total[page.parent[i]] += total[i]
        linked[page.parent[i]] += linked[i]
    under = unders(page, hide_mark)
    for i, (tag, group) in enumerate(zip(page.tag, page.group, strict=True)):
        links = link_share(linked[i], total[i])
        if tag == "#text":
            n = total[i]
            size = 0 if n < 20 else 1 if n < 60 else 2 if n < 200 else 3
            own = ("text", size, links, page.text[i][-1] in ".!?:;\"'”»)…")
            out.append((own,) if under[i] == "none" else (own, ("under", under[i])))  # no mark above says nothing
        else:
            shown = "div" if hide_mark and tag in ("article", "main") else tag
            own = (("tag", shown, links), ("class", "none" if hide_mark else group))
            share = 0 if total[i] * 10 < total[0] else 1 if total[i] * 2 < total[0] else 2
            out.append((*own, ("share", share)) if shown in BOXES else own)
    return out


TOP = ("#root", "html", "body")


def edge_kinds(page: Page, hide_mark: bool = False) -> list[str]:
    """The kind of each node as a parent: bad by its mark, top of the page, a box that holds boxes only, a box, or a part."""
    holds_text, holds_box = [False] * len(page.tag), [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        holds_box[page.parent[i]] |= page.tag[i] in BOXES
        holds_text[page.parent[i]] |= page.tag[i] not in BOXES and page.tag[i] not in NO_CONTENT
    out = []
    for tag, group, text, box in zip(page.tag, page.group, holds_text, holds_box, strict=True):
        if tag in TOP:
            out.append("top")
        elif tag in NEVER_BELOW or group == "bad" and not hide_mark:
            out.append("bad")
        elif tag in BOXES:
            out.append("wrap" if box and not text else "box")
        else:
            out.append("part")
    return out


def labels(page: Page) -> list[bool | None] | None:
    """Content flags of the nodes of a page that marks its article; None for other pages.

    The mark is the article, else the main element, with the most text, if that is half of the page's text at least. A
    node that holds the mark has no flag, nor has what is called no content by its class inside the mark."""
    n = len(page.tag)
    total = [len(page.text.get(i, "")) for i in range(n)]
    for i in range(n - 1, 0, -1):
        total[page.parent[i]] += total[i]
    largest = (max((i for i in range(n) if page.tag[i] == tag), key=lambda i: (total[i], -i), default=None) for tag in ("article", "main"))
    mark = next((i for i in largest if i is not None and 2 * total[i] >= total[0]), None)
    if mark is None:
        return None
    inside, gone, unsure, out = [False] * n, [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        p = page.parent[i]
        inside[i] = inside[p] or i == mark
        gone[i] = gone[p] or page.tag[i] in NO_CONTENT
        unsure[i] = unsure[p] or page.group[i] == "bad"
        out[i] = False if gone[i] or not inside[i] else None if unsure[i] else True
    holder = page.parent[mark]
    while holder >= 0:
        out[holder], holder = None, page.parent[holder]
    return out


def count_page(source: str | None, hide_mark: bool, into: Counter) -> None:
    page = Page(source or "")
    truth = labels(page)
    if truth is None:
        return
    kinds = edge_kinds(page, hide_mark)
    for i, f in enumerate(features(page, hide_mark)):
        if truth[i] is None:
            continue
        for value in f:
            into["own", repr(value), truth[i]] += 1
        if i and truth[page.parent[i]] is not None:
            into["edge", kinds[page.parent[i]] + ("+" if truth[page.parent[i]] else "-"), truth[i]] += 1


#: Pseudo-counts of a child in its parent's state against one in the other, and the least share of either, by kind.
EDGES = {"top": (6.0, 0.01), "wrap": (2.0, 0.1), "box": (30.0, 0.01), "part": (30.0, 0.01), "bad": (200.0, 0.0001)}


class Model:
    """Log potentials, from counts and the fixed pseudo-counts."""

    def __init__(self, counts: dict[tuple[str, str, bool], float]):
        self.counts = counts
        self.own: dict[tuple, tuple[float, float]] = {}
        kinds = {k[1].partition(",")[0] for k in counts if k[0] == "own"}
        # As many of each state for every kind of feature: a potential is a likelihood, not a share of the sample.
        self.seen = {kind: [sum(c for (own, value, y), c in counts.items() if own == "own" and value.startswith(kind) and y == state) for state in (False, True)] for kind in kinds}
        self.edges = {}
        for kind, (same, least) in EDGES.items():
            for parent in (False, True):
                c = [counts.get(("edge", kind + ("+" if parent else "-"), y), 0) + (same if y == parent else 1.0) for y in (False, True)]
                self.edges[kind, parent] = tuple(math.log(max(x / sum(c), least)) for x in c)

    def potential(self, value: tuple) -> tuple[float, float]:
        """(boilerplate, content) of a feature value."""
        found = self.own.get(value)
        if found is None:
            good, bad = TAG_HINTS.get(value[1], (1, 1)) if value[0] == "tag" else CLASS_HINTS[value[1]] if value[0] == "class" else UNDER_HINTS[value[1]] if value[0] == "under" else SHARE_HINTS[value[1]] if value[0] == "share" else (1.0 + value[1], 2.0 + 2 * value[2])
            key = repr(value)
            no, yes = self.seen.get(key.partition(",")[0], (0, 0))
            if no and yes:
                half = (no + yes) / 2
                good, bad = good + self.counts.get(("own", key, True), 0) * half / yes, bad + self.counts.get(("own", key, False), 0) * half / no
            most = MOST_ODDS[value[0]]
            found = self.own[value] = (0.0, max(-most, min(most, math.log(good / bad))))
        return found

    def marginals(self, page: Page, hide_mark: bool = False) -> list[float]:
        """Content probability of every node, by messages up the tree and then down."""
        n = len(page.tag)
        own = [[0.0, 0.0] for _ in range(n)]
        for i, f in enumerate(features(page, hide_mark)):
            for value in f:
                a, b = self.potential(value)
                own[i][0] += a
                own[i][1] += b
        belief = [x[:] for x in own]
        kinds = edge_kinds(page, hide_mark)
        up = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            p = page.parent[i]
            kind = kinds[p]
            message = []
            for state in (0, 1):
                e = self.edges[kind, bool(state)]
                message.append(_log_add(e[0] + belief[i][0], e[1] + belief[i][1]))
            up[i] = (message[0], message[1])
            belief[p][0] += message[0]
            belief[p][1] += message[1]
        for i in range(1, n):
            p = page.parent[i]
            kind = kinds[p]
            rest = (belief[p][0] - up[i][0], belief[p][1] - up[i][1])
            top = max(rest)
            e0, e1 = self.edges[kind, False], self.edges[kind, True]
            for state in (0, 1):
                belief[i][state] += _log_add(rest[0] - top + e0[state], rest[1] - top + e1[state])
        return [1 / (1 + math.exp(max(-700.0, min(700.0, b[0] - b[1])))) for b in belief]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def extract(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = Page(source)
    content = model.marginals(page)
    return "\n\n".join(text for i, text in page.text.items() if content[i] > 0.5)


def labelled_sample(pages: DataFrame, max_pages: int, seed: int) -> DataFrame:
    """html, whether marks are hidden, and whether the page is held out, of the sampled pages."""
    ids = pages.select("page_id").orderBy(F.xxhash64(F.lit(seed), F.col("page_id")), "page_id").limit(max_pages).distinct()
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed + k), F.col("page_id")), F.lit(n)) == 0
    return pages.select("page_id", "html").join(F.broadcast(ids), "page_id").select("html", draw(1, 2).alias("hide"), draw(2, HELD_OUT).alias("held_out"))


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, seed: int = 5) -> Model:
    """Counts over the labelled pages of the sample that are not held out."""
    sample = labelled_sample(pages, max_pages, seed).where("not held_out").select("html", "hide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for source, hide in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                count_page(source.as_py(), hide, counts)
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["kind", "value", "content", "n"]
        )

    found = sample.mapInArrow(run, "kind string, value string, content boolean, n long").groupBy("kind", "value", "content").agg(F.sum("n").alias("n"))
    return Model({(r.kind, r.value, r.content): float(r.n) for r in found.collect()})


def held_out_f1(pages: DataFrame, model: Model, max_pages: int = MAX_PAGES, seed: int = 5) -> float | None:
    """F1 over the characters of text blocks of the held-out labelled pages, with marks and class words hidden."""
    sample = labelled_sample(pages, max_pages, seed).where("held_out").select("html")
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0, 0, 0]
        for batch in batches:
            for source in batch.column(0):
                page = Page(source.as_py() or "")
                truth = labels(page)
                if truth is not None:
                    content = shared.value.marginals(page, hide_mark=True)
                    for i, text in page.text.items():
                        if truth[i] is None:
                            continue
                        sums[0] += len(text) * (truth[i] and content[i] > 0.5)
                        sums[1] += len(text) * truth[i]
                        sums[2] += len(text) * (content[i] > 0.5)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=["both", "true", "said"])

    both, true, said = sample.mapInArrow(run, "both long, true long, said long").agg(F.sum("both"), F.sum("true"), F.sum("said")).first()
    return 2 * both / (true + said) if true else None


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [extract(x.as_py(), shared.value) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
