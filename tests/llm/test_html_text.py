import random
import re
import time
from html import unescape
from itertools import product

import pytest
from pyspark.sql import functions as F

from codestrata.llm import html_text as h

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><a href=/>Home</a> <a href=/a>About us.</a></nav></header>
<div class="cookie-notice">We use cookies. Please accept them all.</div><!-- <p>hidden</p> -->
<main><article class="post"><header><h1>The &amp; title</h1></header>
<p>First <b>bold</b>   paragraph&nbsp;here,<br>with a <a href="x">link</a>.</p><div class="advert"><p>Buy this now. It is cheap.</p></div>
<ul><li>One item<li>Two items</ul><p>Short.<p>Unclosed paragraph with &eacute; and &#x4e2d;.
<script>var a = "<p>no</p>";</script><form><label>Name</label><input><button>Send</button></form>
<section id="comments"><article class="comment"><p>A reader says a long thing here. Really.</p></article></section></article></main>
<aside><p>Related reading that goes on for a while. And on.</p></aside><footer>&copy; Someone</footer></body></html>"""


def test_article_without_what_surrounds_it():
    assert h.main_text(PAGE).split("\n\n") == [
        "The & title", "First bold paragraph here, with a link.", "One item", "Two items", "Short.", "Unclosed paragraph with é and 中."]


def test_pages_without_an_article():
    text = "This is a sentence of the page. It has more than one of them, and goes on. "
    page = f"<body><div id=top-nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div><p>{text}</p><p>{text * 2}</p></div><div class=footer>Imprint</div></body>"
    assert h.main_text(page) == f"{text.strip()}\n\n{(text * 2).strip()}"
    assert h.main_text("Plain text, no tags at all. Two sentences.") == "Plain text, no tags at all. Two sentences."
    named = "<div class=menu>Menu here</div><div class='post-content'><p>Tiny</p><p>Also tiny</p></div><p>Outside text</p>"
    assert h.main_text(named) == "Tiny\n\nAlso tiny"


def test_the_tables_pages(spark):
    """The pages of the fixtures hold one plain article each."""
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", row.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", article))
        parts = [" ".join(unescape(re.sub("<[^>]+>", "", x)).split()) for x in parts]
        assert h.main_text(row.html) == "\n\n".join(x for x in parts if x)


def test_minimum_cut_is_minimal():
    r = random.Random(11)
    for _ in range(200):
        n = r.randint(1, 7)
        terminal = [r.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, r.randint(0, 6)) for a in range(n) for b in range(a) if r.random() < 0.5]

        def cost(side):
            return (sum(-t for t, s in zip(terminal, side) if s and t < 0) + sum(t for t, s in zip(terminal, side) if not s and t > 0)
                    + sum(c for a, b, c in edges if side[a] != side[b]))

        assert cost(h.minimum_cut(terminal, edges)) == min(map(cost, product((False, True), repeat=n)))


def test_smoothing_carries_short_blocks():
    text = "A longer sentence stands here, as running text does. And one more of its kind follows it. " * 2
    page = f"<div><p>{text}</p><p>Yes</p><p>{text}</p></div>"
    assert h.main_text(page).split("\n\n")[1] == "Yes"


@pytest.mark.parametrize("page", ("<", "<p", "</p>" * 5000, "<div>" * 20_000 + "x", "<a href=\"" * 3000, "<!--", "&" * 1000,
                                  "<p title='>'>x</p>", "<b><i></b></i>", "<p>" + "word " * 100_000))
def test_broken_and_long_pages_end(page):
    assert isinstance(h.main_text(page), str)


ARTICLE = "<article><p>The text of the article stands here, and it is whole.</p></article>"


@pytest.mark.parametrize("page", (
    "<script>for(i=0;i<n;i++){f(i)}</script>", "<script>if(a<b)c()</SCRIPT >", "<script>x='<!--'</script>",
    "<head><script>i<n</script><style>a<b{}<!--</style><title>a<b <!-- c</title></head>", "<textarea>a<b <!-- <p></textarea>",
    "<noscript><style>a<b</noscript>", "<iframe><!--</iframe>", "<script>a='</scripts>';i<n</script>"))
def test_raw_text_ends_at_its_own_end_tag(page):
    assert h.main_text(page + ARTICLE) == "The text of the article stands here, and it is whole."
    assert h.main_text(ARTICLE.replace("</p>", f"</p>{page}")) == h.main_text(ARTICLE)


@pytest.mark.parametrize("value", ("x" * 5000 + "> <p>Markup. Of a value.</p> " * 300, "{'a': '>', 'b': ' hidden '}" * 2000, "a>b" * 2_000_000))
def test_values_of_any_length_are_no_text(value):
    for quote in "\"'":
        value = value.replace(quote, "’")
        page = f"<article><p data-json={quote}{value}{quote} id=x>The text of it stands here, whole.<img src = {quote}{value}{quote}> And so on.</p></article>"
        assert h.main_text(page) == "The text of it stands here, whole. And so on."


@pytest.mark.parametrize(("tag", "text"), (
    ("<p title=\"no end>", "The text."), ("<p it's>", "The text."), ("<p title=it's>", "The text."), ("<p a=\"\"b=''>", "The text."),
    ("<p a='\">'>", "The text."), ("<p a==\"x>", "The text."), ("<p a= >", "The text."), ("<p =>", "The text.")))
def test_quotes_in_tags(tag, text):
    assert h.main_text(f"<article>{tag}{text}</p></article>") == text


def test_odd_tags_take_linear_time():
    for one in ("<a x=\">\"", "<a x='", "<a x=\"", "<a x", "<a", "<!", "<a x='>", "<a x=y=", "<p x=\"'>", "<a b=\"'\" c='\">"):
        for end in ("", ">", "\">", "'\""):
            page = one * 100_000 + end
            before = time.process_time()
            tokens, at = h._Tokens(page), 0
            while token := tokens.next(at):
                assert token[1] > at
                at = token[1]
            assert time.process_time() - before < 5


def test_table(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, None, "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = [x.text for x in h.extract_pages(pages).collect()]
    assert out == ["", "", h.main_text(PAGE), h.main_text(PAGE), ""]
    assert h.extract_pages(pages.limit(0)).count() == 0


TEXT = "This is a sentence of the article that says a thing or two. And it goes on with one more of the kind."
BODY = f"<h1>Title here</h1><p>{TEXT}</p><p>{TEXT} {TEXT}</p>"
WHOLE = ["Title here", TEXT, f"{TEXT} {TEXT}"]


@pytest.mark.parametrize(("page", "more"), (
    (f"<form runat=server action=x><input type=hidden name=v><nav><a href=1>Home</a></nav><article>{BODY}</article><input></form>", []),
    (f"<article class='legal'>{BODY}</article>", []),
    (f"<main id='social-history'>{BODY}</main>", []),
    (f"<article>{BODY}<div class='related-work'><p>{TEXT}</p></div></article>", [TEXT]),
    (f"<div class='page-with-sidebar'><article>{BODY}</article></div>", []),
    (f"<article>{BODY}</article><section><h2>Comments</h2><p>{TEXT}</p><p>{TEXT}</p></section>", []),
    (f"<article>{BODY}<section><h2>3 Comments</h2><p>{TEXT}</p></section><p>After. {TEXT}</p></article>", [f"After. {TEXT}"]),
    (f"<article>{BODY}<h2>Leave a reply</h2><p>{TEXT}</p><h2>Notes</h2><p>{TEXT}</p></article>", ["Notes", TEXT]),
    (f"<article>{BODY}<h2>The comments of the board</h2><p>{TEXT}</p></article>", ["The comments of the board", TEXT]),
    (f"<main>{BODY}</main><article><h2>Read this too</h2><p>{TEXT}</p></article>", []),
    (f"<article>{BODY}<form><label>Name</label><p>Please fill in all fields. Thank you.</p><input><input><button>Go</button></form></article>", []),
    (f"<article>{BODY}<div class='advert'><p>{TEXT}</p></div><div class='related-posts'><p>{TEXT}</p></div></article>", []),
    (f"<article>{BODY}<article class='comment'><p>{TEXT}</p></article></article>", []),
    (f"<article>{BODY}</article><article class='teaser'><p>{TEXT}</p></article>", []),
))
def test_names_forms_and_threads(page, more):
    assert h.main_text(f"<body>{page}</body>").split("\n\n") == WHOLE + more


MIXED = (
    f"<div><p>{TEXT}</p><p>Yes</p><p>{TEXT}</p></div>",
    f"<div><p>{TEXT}</p><ul><li>One</li><li>Two</li></ul><p>{TEXT}</p></div>",
    f"<article><p>{TEXT}</p><p><a href=1>All of this is linked</a></p><p>{TEXT}</p></article>",
    f"<div class=top><a href=1>One</a></div><div><p>{TEXT}</p><p>Short</p></div><div>Foot</div>",
    f"<div><div>Home</div><div>News. </div><div>Sport</div></div><div><p>{TEXT}</p></div>",
)


def test_the_cut_decides():
    """Blocks whose scores speak against them are kept by what stands around them."""
    up = 0
    for page in MIXED:
        blocks = h.blocks(page)
        for s, content in zip(h.scores(blocks), h.labels(blocks), strict=True):
            up += content and s < 0
    assert up >= 2


def test_labels_are_of_least_energy():
    for page in (*MIXED, PAGE[:900]):
        blocks = h.blocks(page)
        assert len(blocks) <= 14
        scores, edges = h.scores(blocks), h.smoothness(blocks)

        def energy(side):
            return (sum(abs(s) for s, content in zip(scores, side) if (s > 0) != content and s)
                    + sum(c for a, b, c in edges if side[a] != side[b]))

        least = min(energy(side) for side in product((False, True), repeat=len(blocks)))
        assert energy(h.labels(blocks)) == least
