from __future__ import annotations

import html
import re

from plumbline.llm.html_text import extract_pages, main_text
from plumbline.llm.queries import op8_html

P = "".join(f"<p>Sentence {i} of the story goes on, with enough words to count.</p>" for i in range(6))
STORY = " ".join(f"Sentence {i} of the story goes on, with enough words to count." for i in range(6))
AROUND = (
    '<header class="site"><h2>Site</h2><p>Slogan of the site in some words.</p></header><nav><a href="/a">One</a> <a href="/b">Two</a></nav>{}'
    '<aside><p>Read this too, it is a longer text beside the story.</p></aside><form><label>Mail</label><input name=m></form>'
    '<div id="cookie-notice">We use cookies, and say so in many more words than needed.</div><div class="comments"><p>A reader says a lot about all this, and on and on.</p></div><footer>© all</footer>'
)


def test_parts_around_an_article_are_left_out():
    for wrap in ("<article><h1>Title</h1>{}</article>", "<main><h1>Title</h1><div class=body>{}</div></main>", '<div class="post"><h1>Title</h1>{}</div>', '<div role="main"><h1>Title</h1><section>{}</section></div>'):
        page = f"<!doctype html><html><head><title>T</title><script>var a='<p>x</p>';</script></head><body>{AROUND.format(wrap.format(P))}</body></html>"
        assert main_text(page) == f"Title {STORY}", wrap


def test_comments_marked_as_articles_are_left_out():
    comments = '<article class="comment"><p>A long reader comment that goes on and on about the story.</p></article>' * 9
    assert main_text(f"<body><article><h1>Title</h1>{P}</article>{comments}</body>") == f"Title {STORY}"


def test_parts_inside_an_article_are_left_out():
    inner = P + '<div class="ad">Buy now</div><style>p{}</style><!-- <p>no</p> --><section id="comments"><p>me too</p></section>'
    assert main_text(f"<body><article>{inner}</article></body>") == STORY


def test_class_names_that_only_hold_a_word_leave_nothing_out():
    story = f"<h1>Title</h1>{P}"
    for page in (f'<div class="layout has-sidebar"><article>{story}</article></div>', f'<div class="no-sidebar">{story}</div>', f'<div class="post"><div class="post-header"><h1>Title</h1></div><div>{P}</div></div>'):
        assert main_text(f"<body>{page}</body>") == f"Title {STORY}", page
    assert main_text('<article><h1>T</h1><div class="social-science"><p>study text</p></div></article>') == "T study text"
    for name in ("site-header", "mainNav", "cookie-notice", "comments-area", "related posts", "x ad-slot"):
        assert main_text(f'<body><article>{story}</article><div class="{name}"><p>{"More words here. " * 40}</p></div></body>') == f"Title {STORY}", name


def test_marked_parts_longer_than_the_story():
    long = f"<p>{'Words of another kind, more of them than in the story. ' * 20}</p>"
    for name in ("sidebar-wide", "cookie-law-info", "comment-body", "ad-leaderboard"):
        assert main_text(f'<body><div class="post"><h1>Title</h1>{P}</div><div class="{name}">{long}</div></body>') == f"Title {STORY}", name
        assert main_text(f'<body><div class="{name} wide"><main><h1>Title</h1>{P}</main></div></body>') == f"Title {STORY}", name
    for name in ("ad-leaderboard", "newsletter-form-v2", "related-content"):
        assert main_text(f'<body><article><h1>Title</h1>{P}<div class="{name}"><p>Not the story.</p></div></article></body>') == f"Title {STORY}", name


def test_words_that_a_story_is_about():
    assert main_text(f'<body><div class="legal"><h1>Title</h1>{P}</div></body>') == f"Title {STORY}"
    assert main_text(f'<body><div class="legal"><h1>Title</h1>{P}</div><div class="imprint">Short.</div></body>').startswith(f"Title {STORY}")
    assert main_text(f'<article><h1>Title</h1>{P}<p class="share">Sharing is what the study is about.</p></article>') == f"Title {STORY} Sharing is what the study is about."
    assert main_text(f'<article><h1>Title</h1>{P}<p class="share"><a href="/x">Post it</a> <a href="/y">Mail it</a></p></article>') == f"Title {STORY}"
    assert main_text(f'<body><article><h1>Title</h1>{P}</article><div class="legal">Small print.</div></body>') == f"Title {STORY}"


def test_of_several_articles_the_larger_is_taken():
    assert main_text(f"<main><article><p>Short one.</p></article><article><h1>Title</h1>{P}</article></main>") == f"Title {STORY}"


def test_references_space_and_malformed_markup():
    page = "<article><h1>A&amp;B &lt;x&gt;</h1><p>one\n\t two<b>three<br>four<p>fi<i>ve</i> &eacute;&#x41;&nbsp;six</div><ul><li>a<li>b</ul>1 < 2 &bogus; end"
    assert main_text(page) == "A&B <x> one twothree four five éA six a b 1 < 2 &bogus; end"


def test_odd_pages():
    assert [main_text(p) for p in (None, "", "  \n", "<p></p>", "<script>x", "<!-- open", "plain & text", "<a href='/'>link</a>")] == ["", "", "", "", "", "", "plain & text", "link"]
    assert main_text("<div>" * 50_000 + "deep") == "deep"
    assert main_text("<article>" + "<p>word </p>" * 50_000 + "</article>") == " ".join(["word"] * 50_000)


def test_rows(spark):
    frame = spark.createDataFrame([(1, None, None, 3), (None, "u", "<p>x</p>", 3), (1, "v", "<p>x</p>", 3)], "page_id long, url string, html string, n_chars int")
    assert [tuple(r) for r in extract_pages(frame).collect()] == [(1, None, "", 0), (None, "u", "x", 1), (1, "v", "x", 1)]
    assert extract_pages(frame.limit(0)).count() == 0


def test_query_against_the_article_element(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op8_html(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", article)]
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, (t := " ".join(b for b in blocks if b)), len(t))
