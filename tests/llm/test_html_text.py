"""Main text of pages: against the article element of the given ones, and on other layouts."""

from __future__ import annotations

import html
import re
import time

import pytest

from viewlog.llm import html_text
from viewlog.llm.queries import QUERIES


def article(page: str) -> str:
    """The given pages hold their text in one article element."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"</?(?:p|h1|br)\b[^>]*>", " \0 ", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).replace("\0", " ").split())


def test_query_gives_the_articles(spark, data):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = QUERIES["op4_html_extraction"](spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"])
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])


@pytest.fixture(scope="module")
def model(spark, data):
    return html_text.fit(html_text.sample_pages(spark.read.parquet(f"{data}/pages.parquet"), 100))


LONG = "A sentence of the article that says something at length. Then another one follows it here."
LAYOUTS = {
    f"<body><header><h1>Site</h1></header><div id='content'><h2>Title</h2><p>{LONG}</p><p>It &amp; <b>th</b>is. {LONG}</p>"
    "<div class='ad'>Buy this now</div></div><div class='sidebar'><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div>"
    "<form><label>Name</label><input></form><footer>Copyright</footer>": f"Title {LONG} It & this. {LONG}",
    f"<main><p>{LONG}</p><aside>By the way</aside><section id='comments'><p>I think so too.</p></section></main>": LONG,
    f"<nav><a href=/>Home</a></nav><article><p>{LONG}<p>{LONG}<script>var a = '<p>no</p>';</script></article>": f"{LONG} {LONG}",
    "": "",
    "<html><head><title>t</title></head><body></body></html>": "",
}


def test_other_layouts(model):
    assert html_text.main_texts(model, list(LAYOUTS)) == list(LAYOUTS.values())


def test_decoding_never_keeps_below_what_was_left_out(model):
    rng = html_text.np.random.default_rng(4)
    blocks = html_text.parse("<div><div><p>a b<div>c</div></div><ul><li>d<li>e<p>f</ul></div><p>g" * 20)
    number = {id(b): i for i, b in enumerate(blocks)}
    for _ in range(50):
        chosen = html_text.decode(blocks, rng.random(len(blocks)))
        for i, b in enumerate(blocks[1:], 1):
            up, seen_out = number[id(b.parent)], False
            while chosen[i] and up:
                seen_out |= not chosen[up]
                assert not (seen_out and chosen[up])
                up = number[id(blocks[up].parent)]


def test_broken_markup_and_long_pages():
    for page in ("<", "<p", "<p class='x", "<!-- open", "</div></p>", "<script>never closed", "a<b>c<d", "<p>x" * 50_000, "<div>" * 3000, "&#x41;&bogus;&amp"):
        html_text.block_features(html_text.parse(page))


@pytest.mark.parametrize("part", ["<a ", '<a href="', "<a href='x\" ", "<div>", "<div>x", "<b>", "<li>", "<td><p>", "<!", "<?", "</b>", "<p><i></p>", "&#1", "<a title=\"'>"])
def test_a_megabyte_of_any_markup_takes_seconds(part):
    """Time grows with the page, not with its square, whatever is left open."""
    page = part * (2**20 // len(part))
    for text in (page, page + "</a>end>"):
        start = time.process_time()
        blocks = html_text.parse(text)
        html_text.decode(blocks, html_text.block_features(blocks)[:, 6])
        assert time.process_time() - start < 15


TAG = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S
)


def test_tags_match_a_plain_pattern():
    """The scanner finds what a backtracking pattern finds (names hold no quotes here)."""
    rng = html_text.np.random.default_rng(3)
    parts = ["<a ", "<b", ">", '"', "'", "x ", " y=", "/", "</", "<!--", "-->", "<!", "<?", "- ", "<"]
    for _ in range(5000):
        page = "".join(rng.choice(parts, rng.integers(1, 14)))
        if re.search(r"<[a-z/]*[\"'<]", page):
            continue
        want = [(m.start(), (m[2] or "").lower(), bool(m[1])) for m in TAG.finditer(page)]
        assert list(html_text._tags(page)) == want, page


def test_numbers_of_characters_of_any_length():
    digits = "9" * 6000
    texts = {
        f"<p>a &#{digits}; b &#x{digits} c": "a \ufffd b \ufffd c",
        f"<p>&#{'0' * 5000}65;&#x{'0' * 5000}42;&#{'0' * 20}67d": "ABCd",
        "<p>&#xabcdefabcdefabcdefg &#abcdefabcdefabc; &#0;": "\ufffdg &#abcdefabcdefabc; \ufffd",
    }
    for page, want in texts.items():
        blocks = html_text.parse(page)
        assert html_text.text_of(blocks, [True] * len(blocks)) == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "p"), (1, "", "p"), (None, f"<main><p>{LONG}</p></main>", "p")], "page_id long, html string, page string")
    assert sorted(r["main_text"] for r in html_text.extract_text(df).collect()) == ["", "", LONG]
    assert html_text.extract_text(df.limit(0)).collect() == []


def test_all_siblings_of_a_tag_count():
    blocks = html_text.parse("<body><div>" + "<section>s</section>" * 50 + "<p>text</p>" * 200 + "</div></body>")
    alike = html_text.block_features(blocks)[:, 4]
    assert {a for b, a in zip(blocks, alike, strict=True) if b.tag == "p"} == {200}
    assert {a for b, a in zip(blocks, alike, strict=True) if b.tag == "section"} == {50}
