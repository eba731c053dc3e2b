"""The main text of web pages.

A page is parsed into its block elements. Boosted trees over features of each block (subtree
density of text, links and tags, tokens of its attributes, depth, siblings, ancestors) give the
probability that it belongs to the article. Decoding picks the most likely labelling of the
whole tree in which, down any path, blocks are first outside, then article, then left out: no
block of the article hangs below one that was left out.

The trees are trained here, on at most ``SAMPLE_PAGES`` pages: first on pages laid out anew from
their texts by a grammar of usual page parts, with the labels known; then on the pages
themselves, labelled by elements whose meaning is fixed (article, main, nav, footer and others).
Extraction is one pass without a shuffle.

Defined results: a null, empty or textless html gives an empty text; broken and unclosed markup
is closed as browsers do for paragraphs, list items and cells, else at the end of its parent;
rows with equal or null ids are handled one by one; an empty table gives an empty result. Only
the columns asked for are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlog.llm import text_arrays as ta
from viewlog.llm.boosting import BoostedTrees
from viewlog.llm.labelled import thinned

SAMPLE_PAGES = 400
MADE_PAGES = 600
PAGES_AT_ONCE = 64

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_SIGN = re.compile("[>\"']")
_LONG_NUMBER = re.compile(r"&#(?:([xX])([0-9a-fA-F]{12,})|([0-9]{12,}));?")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_ATTRIBUTE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements whose content is no markup, and those whose text is never shown as page text.
RAW = {"script", "style", "textarea", "title", "xmp", "noframes", "iframe", "noembed"}
SILENT = {"head", "script", "style", "title", "textarea", "noscript", "template", "svg", "select", "button", "object"}
SILENT |= {"iframe", "noframes", "noembed", "canvas", "audio", "video", "math", "map", "datalist", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
SAME_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}

TAG_GROUPS = [
    {"article", "main"},
    {"section"},
    {"div", "center"},
    {"p"},
    {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"},
    {"ul", "ol", "dl", "menu"},
    {"li", "dt", "dd"},
    {"table", "tbody", "thead", "tr", "td", "th"},
    {"blockquote", "pre", "figure", "figcaption"},
    {"nav"},
    {"aside"},
    {"header"},
    {"footer"},
    {"form", "fieldset"},
    {"body", "html"},
]
WORD_GROUPS = [
    {"content", "article", "main", "post", "entry", "story", "body", "text", "prose", "page", "hentry", "blog"},
    {"nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "tabs", "pagination", "pager", "links"},
    {"footer", "foot", "copyright", "legal", "colophon", "bottom"},
    {"header", "masthead", "top", "topbar", "head", "logo", "banner", "branding", "byline", "meta", "toolbar"},
    {"sidebar", "side", "aside", "widget", "widgets", "rail", "related", "complementary", "recommended", "more", "teaser"},
    {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promoted", "promotion", "outbrain"},
    {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "notification", "warning", "hidden"},
    {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion", "reader", "feedback", "responses"},
    {"share", "social", "follow", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "register"},
]


class Block:
    """A block element with what its subtree holds."""

    __slots__ = ("tag", "groups", "parent", "children", "runs", "chars", "links", "tags", "words", "stops", "depth", "order")

    def __init__(self, tag: str, groups: int, parent: Block | None):
        self.tag, self.groups, self.parent = tag, groups, parent
        self.children: list[Block] = []
        self.runs: list[tuple[int, str]] = []  # (place in the page, text) of own text
        self.chars = self.links = self.tags = self.words = self.stops = 0
        self.depth = parent.depth + 1 if parent else 0
        self.order = 0


def _word_groups(attributes: str) -> int:
    """A bit for each group of words found in the attributes that name a part."""
    found = 0
    for match in _ATTRIBUTE.finditer(attributes):
        name = match[1].lower()
        value = match[2] or match[3] or match[4] or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            found |= 1 << 6
        elif name != "style":
            for word in _ATTRIBUTE_WORD.findall(value):
                for g, group in enumerate(WORD_GROUPS):
                    if word.lower() in group:
                        found |= 1 << g
    return found


class _Tags:
    """The markup of a page from left to right, in time linear in its length.

    A tag ends at the first ``>`` outside quotes. Where a scan from one place ends depends only
    on the first sign (``>`` or a quote) it meets, so the end found for a sign is kept: tags that
    never close, or quotes that swallow others, are not scanned again and again.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {sign: page.rfind(sign) for sign in ">\"'"}
        self.ends: dict[int, int] = {}  # by place of a sign: the end of a tag scanned from there, or -1
        self.seen = (0, -1)  # from the first place on, the next sign is at the second

    def _sign(self, at: int) -> int:
        found = _TAG_SIGN.search(self.page, at)
        return found.start() if found else len(self.page)

    def _end(self, at: int) -> int:
        """The place of the ``>`` that closes a tag whose name ends at ``at``; -1 if none does."""
        if not self.seen[0] <= at <= self.seen[1]:
            self.seen = (at, self._sign(at))
        sign, chain = self.seen[1], []
        while sign < len(self.page) and sign not in self.ends and self.page[sign] != ">":
            chain.append(sign)
            quote = self.page[sign]
            if sign == self.last[quote]:
                sign = len(self.page)
            else:
                sign = self._sign(self.page.find(quote, sign + 1) + 1)
        end = -1 if sign == len(self.page) else self.ends.get(sign, sign)
        self.ends.update(dict.fromkeys(chain, end))
        return end

    def next(self, at: int) -> tuple[int, int, str, bool, str, bool] | None:
        """(start, end, name, is an end tag, attributes, closes itself); no name for a comment."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", False, "", False
            if start > self.last[">"]:
                start = page.find("<!--", start)  # no tag closes here; a comment may be left open
                return (start, len(page), "", False, "", False) if start >= 0 else None
            if page.startswith(("<!", "<?"), start):
                return start, page.index(">", start) + 1, "", False, "", False
            ends = page.startswith("/", start + 1)
            name = _TAG_NAME.match(page, start + 1 + ends)
            end = self._end(name.end()) if name else -1
            if end >= 0:
                attributes = page[name.end() : end]
                alone = attributes.endswith("/")
                return start, end + 1, name[0].lower(), ends, attributes[:-1] if alone else attributes, alone
            at = start + 1
        return None


def _characters(text: str) -> str:
    """Text with its references decoded; numbers beyond all characters are the replacement sign."""
    return html.unescape(_LONG_NUMBER.sub(_long_number, text))


def _long_number(match: re.Match) -> str:
    sign, digits = (match[1], match[2]) if match[1] else ("", match[3])
    digits = digits.lstrip("0") or "0"
    return f"&#{sign}{digits};" if len(digits) < 8 else "\ufffd"


def parse(page: str) -> list[Block]:
    """The blocks of a page in page order; the first is the root."""
    root = Block("html", 0, None)
    blocks, stack = [root], [("html", root)]  # open elements, each with its block
    piece: list[str] = []
    link, silent, place = 0, 0, 0
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
    outer = [0]  # places in the stack of the elements that are not inline

    def flush() -> None:
        nonlocal place
        if piece:
            text = " ".join(_characters("".join(piece)).split())
            piece.clear()
            if text:
                place += 1
                stack[-1][1].runs.append((place, text))

    def add(text: str) -> None:
        if not silent and text:
            piece.append(text)
            if link:
                stack[-1][1].links += len(text)

    def push(tag: str, block: Block) -> None:
        opened.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            outer.append(len(stack))
        stack.append((tag, block))

    def close(count: int) -> None:
        nonlocal link, silent
        for _ in range(count):
            tag, _ = stack[-1]
            if tag not in INLINE:
                flush()
                outer.pop()
            stack.pop()
            opened[tag].pop()
            link -= tag == "a"
            silent -= tag in SILENT

    def depth_of(tags: set, until: set) -> int:
        """How many open elements end with the innermost of ``tags``; 0 if none is open."""
        inner, bound = (max((opened[t][-1] for t in ts if opened.get(t)), default=0) for ts in (tags, until))
        return len(stack) - inner if inner > bound else 0

    markup = _Tags(page)
    at = 0
    while at < len(page):
        match = markup.next(at)
        if not match:
            add(page[at:])
            break
        start, end, tag, ends, attributes, alone = match
        add(page[at:start])
        at = end
        if not tag:
            continue
        if ends:
            count = depth_of({tag}, set())
            if tag in INLINE and count and outer[-1] > len(stack) - count:
                count = 0  # a stray end tag does not close blocks
            close(count)
            continue
        if tag in CLOSES_P:
            close(depth_of({"p"}, {"table", "button", "td", "th"}))
        if tag in SAME_CLOSES:
            inner, until = SAME_CLOSES[tag]
            close(depth_of(inner, until))
        if tag in ("br", "hr"):
            flush()
        if tag in VOID or alone and tag in ("svg", "path"):
            continue
        if tag == "html":
            continue
        if tag in INLINE:
            push(tag, stack[-1][1])
            stack[-1][1].tags += 1
            link += tag == "a"
        elif tag in SILENT:
            flush()
            push(tag, stack[-1][1])
            silent += 1
        else:
            flush()
            block = Block(tag, _word_groups(attributes) if attributes else 0, stack[-1][1])
            block.order = len(block.parent.children)
            block.parent.children.append(block)
            blocks.append(block)
            push(tag, block)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if tag not in SILENT:
                add(page[at : end.start()] if end else page[at:])
            at = end.start() if end else len(page)
    flush()
    return blocks


def _sum_up(blocks: list[Block]) -> None:
    """Totals of subtrees; children stand after their parents."""
    for b in reversed(blocks):
        for _, text in b.runs:
            b.chars += len(text)
            b.words += text.count(" ") + 1
            b.stops += text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?")
        b.tags += 1
        if b.parent:
            p = b.parent
            p.chars += b.chars
            p.links += b.links
            p.tags += b.tags
            p.words += b.words
            p.stops += b.stops


_TAG_OF = {tag: g for g, group in enumerate(TAG_GROUPS) for tag in group}


def block_features(blocks: list[Block]) -> np.ndarray:
    """A row for each block."""
    _sum_up(blocks)
    total = max(1, blocks[0].chars)
    rows, above, before = [], {}, 0
    tags: dict[int, Counter] = {}  # of the children of a block
    groups = len(WORD_GROUPS)
    for b in blocks:
        parent = b.parent
        up_tags, up_words = above.get(id(parent), (0, 0))
        tag = _TAG_OF.get(b.tag, -1)
        above[id(b)] = (up_tags | (1 << tag if tag >= 0 else 0), up_words | b.groups)
        own = sum(len(t) for _, t in b.runs)
        siblings = parent.children if parent else [b]
        if id(parent) not in tags:
            tags[id(parent)] = Counter(s.tag for s in siblings)
        alike = tags[id(parent)][b.tag]
        near = siblings[b.order - 1].chars if b.order else 0
        after = siblings[b.order + 1].chars if b.order + 1 < len(siblings) else 0
        rows.append(
            [
                tag,
                b.depth,
                b.order,
                len(siblings),
                alike,
                min(b.chars, 20000),
                b.chars / total,
                b.chars / max(1, parent.chars if parent else total),
                min(1.0, b.links / max(1, b.chars)),
                b.tags / max(1, b.words),
                b.stops / max(1, b.words),
                min(own, 5000),
                len(b.children),
                before / total,
                min(near, 5000),
                min(after, 5000),
                *[up_tags >> g & 1 for g in (0, 1, 4, 5, 9, 10, 11, 12, 13)],
                *[b.groups >> g & 1 for g in range(groups)],
                *[up_words >> g & 1 for g in range(groups)],
            ]
        )
        before += own
    return np.array(rows, float)


def decode(blocks: list[Block], p: np.ndarray) -> np.ndarray:
    """Which blocks are article: the likeliest labels that go outside, article, left out.

    A block weighs by its own text (and a little by itself), so a wrong guess about an empty
    wrapper costs less than one about a paragraph.
    """
    number = {id(b): i for i, b in enumerate(blocks)}
    p = np.clip(p, 1e-4, 1 - 1e-4)
    own = np.array([sum(len(t) for _, t in b.runs) for b in blocks], float)
    weight = 0.3 + np.log1p(own)
    gain = np.stack([np.log(1 - p), np.log(p), np.log(1 - p)]) * weight
    best = gain.copy()
    for i in range(len(blocks) - 1, 0, -1):
        parent = number[id(blocks[i].parent)]
        best[0, parent] += best[:, i].max()
        best[1, parent] += best[1:, i].max()
        best[2, parent] += best[2, i]
    state = np.zeros(len(blocks), np.int64)
    state[0] = best[:2, 0].argmax()
    for i in range(1, len(blocks)):
        least = state[number[id(blocks[i].parent)]]
        state[i] = least + best[least:, i].argmax()
    return state == 1


def text_of(blocks: list[Block], chosen: np.ndarray) -> str:
    runs = [run for b, keep in zip(blocks, chosen, strict=True) if keep for run in b.runs]
    return " ".join(text for _, text in sorted(runs))


# Pages laid out anew: (tags, attribute values) of the parts; {} stands for a word of the group.
_ARTICLE = [("article", ""), ("main", ""), ("div", "{0}"), ("div", "{0} {0}"), ("section", "{0}"), ("td", "{0}"), ("div", "")]
_OTHERS = [
    ([("nav", ""), ("ul", "{1}"), ("div", "{1}"), ("nav", "{1}"), ("ol", "{1}")], "links"),
    ([("footer", ""), ("div", "{2}"), ("footer", "{2}")], "short"),
    ([("header", ""), ("div", "{3}"), ("header", "{3}")], "short"),
    ([("aside", ""), ("div", "{4}"), ("aside", "{4}"), ("section", "{4}")], "list"),
    ([("div", "{5}"), ("aside", "{5}"), ("section", "{5}"), ("p", "{5}")], "short"),
    ([("div", "{6}"), ("section", "{6}"), ("p", "{6}")], "short"),
    ([("div", "{7}"), ("section", "{7}"), ("ol", "{7}"), ("ul", "{7}")], "comments"),
    ([("form", ""), ("form", "{8}"), ("div", "{8}")], "form"),
]


class _Layout:
    """Writes pages with known labels from the words of real ones."""

    def __init__(self, words: list[str], rng: np.random.Generator):
        self.words, self.rng = words, rng

    def _some(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high))
        start = int(self.rng.integers(0, max(1, len(self.words) - n)))
        return html.escape(" ".join(self.words[start : start + n]))

    def _open(self, forms: list) -> tuple[str, str]:
        tag, names = forms[int(self.rng.integers(len(forms)))]

        def word(match) -> str:
            group = sorted(WORD_GROUPS[int(match[1])])
            return group[int(self.rng.integers(len(group)))]

        names = re.sub(r"\{(\d)\}", word, names)
        kind = ("class", "id")[int(self.rng.integers(2))]
        return tag, f"<{tag} {kind}='{names.replace(' ', '-' if kind == 'id' else ' ')}'>" if names else f"<{tag}>"

    def part(self, number: int) -> str:
        """A part that is not article; the marker tells the labeller."""
        forms, style = _OTHERS[number]
        tag, begin = self._open(forms)
        inner = "li" if tag in ("ul", "ol") else "p" if self.rng.random() < 0.5 else "div"
        count = int(self.rng.integers(2, 7))
        if style == "links":
            body = "".join(f"<li><a href='/x'>{self._some(1, 4)}</a></li>" for _ in range(count))
            body = body if tag in ("ul", "ol") else f"<ul>{body}</ul>"
        elif style == "list":
            body = f"<h3>{self._some(1, 4)}</h3>" + "".join(
                f"<{inner}><a href='/x'>{self._some(2, 9)}</a></{inner}>" for _ in range(count)
            )
        elif style == "comments":
            body = "".join(f"<{inner}><b>{self._some(1, 3)}</b> {self._some(3, 40)}</{inner}>" for _ in range(count))
        elif style == "form":
            body = f"<label>{self._some(1, 4)}</label><input name=q><p>{self._some(2, 12)}</p><button>Go</button>"
        elif tag == "p" or self.rng.random() < 0.4:
            body = self._some(3, 25)
        else:
            body = "".join(f"<{inner}>{self._some(2, 15)}</{inner}>" for _ in range(count // 2 + 1))
        return f"{begin}{body}</{tag}>"

    def page(self) -> tuple[str, list[tuple[str, bool]]]:
        """Chunks of html with their labels; joined they are the page."""
        rng = self.rng
        if rng.random() < 0.03:  # text without any markup
            return (chunk := self._some(5, 200)), [(chunk, True)]
        tag, begin = self._open(_ARTICLE)
        bare = rng.random() < 0.15  # paragraphs that no element holds together
        before = [int(n) for n in rng.choice([0, 2, 5, 6, 7], rng.integers(0, 4))]
        after = [int(n) for n in rng.choice(len(_OTHERS), rng.integers(0, 5))]
        inside = [int(n) for n in rng.choice([1, 2, 3, 4, 5, 6, 7], rng.integers(0, 3))] if rng.random() < 0.5 else []
        chunks: list[tuple[str, bool]] = [("<html><body>", False)]
        if tag == "td" or rng.random() < 0.4:
            wrappers = ("<div>", "<div id='wrapper'>", "<table><tr>")
            chunks.append((wrappers[2 if tag == "td" else int(rng.integers(2))], False))
        chunks += [(self.part(n), False) for n in before]
        chunks += [] if bare else [(begin, True)]
        if rng.random() < 0.7:
            chunks.append((f"<h{int(rng.integers(1, 4))}>{self._some(2, 14)}</h1>", True))
        blocks = int(rng.integers(1, 14))
        for i in range(blocks):
            kind = rng.random()
            text = self._some(1, 120) if rng.random() < 0.8 else self._some(1, 6)
            if kind < 0.75:
                chunks.append((f"<p>{text}" + ("</p>" if rng.random() < 0.8 else ""), True))
            elif kind < 0.82:
                chunks.append((f"<ul><li>{text}<li>{self._some(2, 20)}</ul>", True))
            elif kind < 0.88:
                chunks.append((f"<blockquote>{text}</blockquote>", True))
            elif kind < 0.94:
                chunks.append((f"<h2>{self._some(1, 8)}</h2><p>{text}</p>", True))
            else:
                chunks.append((f"<div>{text}<br>{self._some(1, 30)}</div>", True))
            if inside and rng.random() < 0.4:
                chunks.append((self.part(inside.pop()), False))
        chunks += [] if bare else [(f"</{tag}>", True)]
        chunks += [(self.part(n), False) for n in after]
        return "".join(c for c, _ in chunks), chunks


def _made_examples(pages: list[str], rng: np.random.Generator, count: int):
    """Features and labels of pages laid out anew."""
    words = [w for p in pages for b in parse(p) for _, t in b.runs for w in t.split()]
    if not words:
        return
    layout = _Layout(words, rng)
    for _ in range(count):
        page, chunks = layout.page()
        # A block's label is that of the chunk it begins in: blocks of all chunks, in order.
        blocks = parse(page)
        starts, at = [], 0
        for chunk, label in chunks:
            starts.append((at, label))
            at += len(chunk)
        opened = [start for start, name, ends in _tags(page) if name and not ends and _is_block(name)]
        if len(opened) != len(blocks) - 1:
            continue
        labels, chunk = [not opened], 0
        for place in opened:
            while chunk + 1 < len(starts) and starts[chunk + 1][0] <= place:
                chunk += 1
            labels.append(starts[chunk][1])
        yield block_features(blocks), np.array(labels, float)


def _tags(page: str):
    """(start, name, is an end tag) of all markup, that inside raw elements included."""
    markup, at = _Tags(page), 0
    while found := markup.next(at):
        start, at, name, ends, _, _ = found
        yield start, name, ends


def _is_block(tag: str) -> bool:
    return tag not in INLINE and tag not in SILENT and tag not in VOID and tag != "html"


_SURE_OUT = {"nav", "footer", "aside", "form", "header"}


def _own_examples(pages: list[str]):
    """Features and labels of the pages themselves, where elements of fixed meaning tell them."""
    for page in pages:
        blocks = parse(page)
        if not any(b.tag in ("article", "main") for b in blocks):
            continue
        labels: dict[int, bool] = {}
        for b in blocks:
            inherited = labels.get(id(b.parent), False)
            out = b.tag in _SURE_OUT or b.groups & ~1
            labels[id(b)] = not out and (inherited or b.tag in ("article", "main"))
            if b.parent is not None and b.parent.tag in _SURE_OUT:
                labels[id(b)] = False
        yield block_features(blocks), np.array([labels[id(b)] for b in blocks], float)


def fit(pages: list[str], made: int = MADE_PAGES) -> BoostedTrees:
    rng = np.random.default_rng(11)
    examples = [*_made_examples(pages, rng, made), *_own_examples(pages)]
    model = BoostedTrees(trees=60, depth=5, rate=0.25, bins=32)
    if not examples:
        return model
    x = np.concatenate([e[0] for e in examples])
    y = np.concatenate([e[1] for e in examples])
    return model.fit(x, y)


def main_texts(model: BoostedTrees, pages: list[str]) -> list[str]:
    parsed = [parse(p) for p in pages]
    tables = [block_features(b) for b in parsed]
    if not tables or not model.grown:
        return [""] * len(pages)
    p = model.probability(np.concatenate(tables))
    cuts = np.cumsum([0, *(len(t) for t in tables)])
    return [text_of(b, decode(b, p[low:high])) for b, low, high in zip(parsed, cuts[:-1], cuts[1:], strict=True)]


def sample_pages(pages: DataFrame, rows: int = SAMPLE_PAGES) -> list[str]:
    """Pages with the smallest hashes, whatever the partitioning."""
    few = thinned(F.col("html"), rows, pages.count())
    chosen = pages.select("html").filter(F.col("html").isNotNull() & few).orderBy(F.xxhash64("html"), F.length("html")).limit(rows)
    return [r["html"] for r in chosen.collect()]


def extract_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(page, main_text): ``page`` holds the columns named in ``keep`` (default: all)."""
    spark = pages.sparkSession
    ta.small_batches(spark)
    sent = ta.send(spark, fit(sample_pages(pages)))
    keep = pages.columns if keep is None else keep
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("page"), "html")
    schema = T.StructType([rows.schema["page"], T.StructField("main_text", T.StringType())])

    def extracted(batches):
        model = ta.received(sent)
        for batch in batches:
            for low in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(low, PAGES_AT_ONCE)
                texts = main_texts(model, [h or "" for h in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("page"), pa.array(texts, pa.string())], ["page", "main_text"]
                )

    return rows.mapInArrow(extracted, schema)
