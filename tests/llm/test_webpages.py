"""Main text of pages."""

import html
import re

import pytest

from corpuswright.llm import webpages

LONG = "A sentence with a good many words that belongs to the article. " * 3


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.S)[1]
    inner = re.sub(r"</?(p|h1|br)>", " ", inner)
    return " ".join(html.unescape(re.sub(r"</?b>", "", inner)).split())


def test_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = webpages.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) and r["url"] for r in got)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p></p>", ""),
        ("<html><head><title>t</title></head><body></body></html>", ""),
        ("<article><h1>T</h1><p>a &amp; b&nbsp;c\n d</p><p>x<b>y</b>z</article>", "T a & b c d xyz"),
        ("<nav>m</nav><main><p>Short.</p></main><aside>s</aside><footer>f</footer>", "Short."),
        (f"<article><p>{LONG}</p><div class='share-bar'>like</div><p>End.</p></article>", f"{LONG.strip()} End."),
        (f"<article><p>{LONG}</p></article><section id='comments'><article><p>{LONG} no</p></article></section>", None),
        (f"<header>h</header><article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T {LONG.strip()}"),
        (f"<article><script>var t='</p>';</script><style>p</style><form>f<input></form><p>{LONG}", LONG.strip()),
        (f"<div class='ad'>buy<article><p>{LONG}</p></article>", LONG.strip()),
        (f"<article><p>&#233;&lt;p&gt; &unknown; & {LONG}</p></article>", f"é<p> &unknown; & {LONG.strip()}"),
        (f"<ul><li><a>m</a></li><li><a>n</a></li></ul><div><p>{LONG}</p><p>{LONG}</p><p>Mid.</p><p>{LONG}</p></div>", None),
    ],
)
def test_cases(page, text):
    got = webpages.main_text(page)
    if text is None:
        assert LONG.strip() in got and "no" not in got.split() and got.split()[0] == "A"
    else:
        assert got == text


def test_truncated_and_deep_pages():
    assert webpages.main_text(f"<article><p>{LONG}</p><p>cut <b") in (f"{LONG.strip()} cut", f"{LONG.strip()} cut <b")
    assert webpages.main_text("<div>" * 3000 + LONG) == LONG.strip()
    assert webpages.main_text("<article>" + f"<p>{LONG}</p>" * 2000) == " ".join([LONG.strip()] * 2000)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "c"), (1, "u", None, "c"), (None, None, f"<p>{LONG}</p>", None)], "page_id long, url string, html string, text string")
    got = webpages.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, len(LONG.strip())]
    assert webpages.extract(df.where("false")).count() == 0


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def words(n, word="word"):
    return " ".join([word] * n)


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", "<ul><li><a href=x>menu</a></li></ul><div>{}</div>"])
def test_one_long_line_does_not_push_out_the_others(wrap):
    texts = [words(40)] * 20 + [words(1200)] + [words(40)] * 20
    assert webpages.main_text(wrap.format(paragraphs(*texts))) == " ".join(texts)


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>"])
def test_short_lines_of_the_region_stay(wrap):
    items = "".join(f"<li>item {i}</li>" for i in range(12))
    page = wrap.format(f"{paragraphs(LONG, LONG)}<ul>{items}</ul>{paragraphs(LONG, LONG)}")
    want = [LONG.strip()] * 2 + [f"item {i}" for i in range(12)] + [LONG.strip()] * 2
    assert webpages.main_text(page) == " ".join(want)
    closing = [f"End {i}." for i in range(8)]
    assert webpages.main_text(wrap.format(paragraphs(LONG, LONG, LONG, *closing))) == " ".join([LONG.strip()] * 3 + closing)


@pytest.mark.parametrize(
    "page",
    [
        "<article class='post category-social'>{}</article>",
        "<article class='has-sidebar'>{}</article>",
        "<article id='notice-12' class='tag-promo'>{}</article>",
        "<body class='sidebar'>{}</body>",
        "<nav><a href=x>menu</a></nav><div class='content with-sidebar'>{}</div>",
        "<nav><a href=x>menu</a></nav><form action=x>{}<input></form>",
        "<div class='sidebar'>{}</div><footer>f</footer>",
        "<article><form>{}</form></article>",
        "<form><article>{}</article></form>",
    ],
)
def test_no_name_or_wrapper_loses_the_text(page):
    assert webpages.main_text(page.format(paragraphs(LONG, LONG))) == f"{LONG.strip()} {LONG.strip()}"


@pytest.mark.parametrize("part", ["form", "aside", "nav"])
def test_an_open_part_ends_with_what_encloses_it(part):
    page = f"<article><div><p>{LONG}</p><{part}>out</div><p>{LONG}</p><p>End.</p></article>"
    assert webpages.main_text(page) == f"{LONG.strip()} {LONG.strip()} End."


def test_main_around_a_nested_article():
    page = f"<main><h1>Title</h1><p>lead</p><article><p>{LONG}</p></article><p>end</p></main>"
    assert webpages.main_text(page) == f"Title lead {LONG.strip()} end"


def test_a_story_in_several_articles():
    parts = [f"part {i} {LONG.strip()}" for i in range(4)]
    page = "".join(f"<article>{paragraphs(t)}</article>" for t in parts)
    assert webpages.main_text(page + "<article><a href=x>More</a></article>") == " ".join(parts)


def test_ratios_choose_over_a_small_landmark():
    story = [LONG.strip()] * 6
    page = f"<article><p>Teaser of another page.</p></article><ul><li><a href=x>menu</a></li></ul><div>{paragraphs(*story)}</div>"
    assert webpages.main_text(page) == " ".join(story)
