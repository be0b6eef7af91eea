"""Main text of pages on which names, headings and repeated texts mislead."""

import random
import time

import pytest

from textmill.llm import templates


def texts(spark, pages, host="one.example"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in sorted(templates.main_text(frame).collect(), key=lambda r: r.page_id)]


NAMED = [
    ("<article class='post has-sidebar'><p>Text</p></article>", "Text"),
    ("<main class='entry comments-open'><p>Text</p></main>", "Text"),
    ("<div class='layout-no-sidebar'><article><p>Text</p></article></div>", "Text"),
    ("<article><section id='search-algorithms'><p>Text</p></section><section id=header-files>More</section></article>", "Text\n\nMore"),
    ("<article><div class='related-work'>Text</div><div class='article-header'><h1>T</h1></div></article>", "Text\n\nT"),
    ("<div class=sidebar><main><p>Text</p></main></div><div class=sidebar>no</div>", "Text"),
    ("<form id=search><article class=header><p>Text</p></article></form><form>no</form>", "Text"),
    ("<article><p>Text</p><div class='ad-slot'>no</div></article><div class=comments><article>no</article></div>", "Text"),
    ("<aside><article>no</article></aside><div class='site_header'>no</div><div><p>Text</p></div>", "Text"),
]


@pytest.mark.parametrize("page, text", NAMED)
def test_names(page, text):
    assert templates.extract(f"<body>{page}</body>", {}) == text


def titled(n):
    return (
        f"<body><div id=menu><a href=/>Home</a></div><div id=content><h1>Title {n}</h1><p>First {n}</p><p>Second {n}</p>"
        f"<ul><li>Item {n}</li><li><a href=/x>Linked {n}</a></li></ul><h2>Part {n}</h2><p>Third {n}</p></div><footer>no</footer></body>"
    )


@pytest.mark.parametrize("n", [1, 3, 12])
def test_pages_without_an_article(spark, n):
    parts = ("Title", "First", "Second", "Item", "Linked", "Part", "Third")
    assert texts(spark, [titled(i) for i in range(n)]) == ["\n\n".join(f"{p} {i}" for p in parts) for i in range(n)]


def test_repeated_text(spark):
    page = (
        "<body>{open}<h1>Title {n}</h1><div class=line>Written by <b>our staff</b></div><p>Text {n} that is long enough to outweigh the rest of it</p>"
        "<div class=box><p>Read more in our paper</p></div><p>Shared by <i>page {n}</i></p>{close}<div>All rights</div></body>"
    )
    for tag in ("article", "div"):
        pages = [page.format(open=f"<{tag}>", close=f"</{tag}>", n=i) for i in range(6)]
        assert texts(spark, pages) == [
            f"Title {i}\n\nText {i} that is long enough to outweigh the rest of it\n\nShared by page {i}" for i in range(6)]


def test_copies_are_not_template_text(spark):
    page = "<body><article><h1>Title</h1><p>Text</p></article></body>"
    assert texts(spark, [page] * 8) == ["Title\n\nText"] * 8


def test_repeated_classes_lie_in_a_slot():
    assert templates._in_slots([(1, 3), (2, 4), (1, 6), (2, 7)], [0, 5, 9])
    assert not templates._in_slots([(1, 3), (2, 6)] * 2, [0, 5, 9])


@pytest.mark.parametrize("page, text", [
    ("<html><head><meta charset=utf-8><title>no</title><body><p>Text</p></body>", "Text"),
    ("<head><title>no</title><article><p>Text</p></article>", "Text"),
    ("<head><script>no</script>Text<p>More", "Text\n\nMore"),
    ("<head><title>no</title></head><body><p>Text", "Text"),
    ("<p>One <b title='a > b'>two</b> three</p>", "One two three"),
    ("<p title=\"never closed>One</p><p class=x>Two</p>", "One\n\nTwo"),
    ("<p>a < b and c > d</p><p>1 <2", "a < b and c > d\n\n1 <2"),
    ("<p>One</p><a href=x", "One\n\n<a href=x"),
    ("<!-- no <p>no</p> --><p>One</p><!-- no", "One"),
])
def test_markup_that_does_not_end(page, text):
    assert templates.extract(page, {}) == text


BOXES = "".join(f"<div class=box{i}><p>Site text {i} that stands on every page of the paper, long as it is</p></div>" for i in range(6))


@pytest.mark.parametrize("tag", ["article", "div"])
def test_short_articles_on_long_templates(spark, tag):
    pages = [f"<body><{tag}><h1>News {i}</h1><p>Short {i}.</p>{BOXES}</{tag}></body>" for i in range(12)]
    assert texts(spark, pages) == [f"News {i}\n\nShort {i}." for i in range(12)]


def test_copies_with_titles_of_their_own_stay(spark):
    page = "<head><title>Copy {n}</title></head><body><article><h1>Title</h1><p>Text</p></article><footer>Copy {n}</footer></body>"
    assert texts(spark, [page.format(n=n) for n in range(8)]) == ["Title\n\nText"] * 8


@pytest.mark.parametrize("page", [
    "<a " * 400_000, "<a \"" * 300_000, "<p '" * 300_000 + ">", "<div>" * 200_000, "<div><p>" * 200_000, "<!x" * 400_000,
    "</b>" * 300_000, "<b>" * 150_000 + "</i>" * 150_000, "<p>word</p>" * 450_000, "<ul>" + "<li>x" * 300_000,
])
def test_long_pages_take_linear_time(page):
    """About 1 to 5 MB each."""
    start = time.process_time()
    text = templates.extract(page, {})
    assert time.process_time() - start < 60
    assert text.count("word") == page.count("word")


def test_a_long_page_is_read_whole(spark):
    long = "<body><article>" + "".join(f"<p>Paragraph {i} of a page of five megabytes</p>" for i in range(110_000)) + "</article></body>"
    [text] = texts(spark, [long])
    assert text.split("\n\n") == [f"Paragraph {i} of a page of five megabytes" for i in range(110_000)]


def test_occurrence_vectors_against_plain_ones(spark):
    """Classes by page count, total and sketch are those of whole vectors, kept page by page."""
    rng = random.Random(4)
    pages = []
    for i in range(30):
        items = "".join(f"<li><a href=/{i}-{k}>item {k}</a></li>" for k in range(rng.randrange(5)))
        extra = rng.choice(["", "<div class=x><i>now and then</i></div>", "<div class=x><i>now and then</i></div>" * 2])
        pages.append(f"<body><ul>{items}</ul>{extra}<p>own {i}</p><p>shared text</p><footer>end</footer></body>")
    vectors = {}
    for n, page in enumerate(pages):
        for key, count in templates._tokens(page).items():
            vectors.setdefault(key, [0] * len(pages))[n] = count
    classes = {}
    for key, vector in vectors.items():
        in_pages = sum(map(bool, vector))
        if 2 * in_pages >= len(pages) and (not key[1] or in_pages >= templates.TEXT_PAGES):
            classes.setdefault(tuple(vector), set()).add(key[0])
    want = {frozenset(tokens) for tokens in classes.values() if len(tokens) > 1}
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    counted = templates.occurrences(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    [row] = templates.templates(counted).collect()
    found = {}
    for m in row.template:
        found.setdefault(m["class"], set()).add(m["token"])
    assert {frozenset(tokens) for tokens in found.values()} == want and not row.copies
