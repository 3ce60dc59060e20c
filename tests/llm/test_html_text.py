from __future__ import annotations

import html
import re

import pytest

from panelytics.llm.html_text import extract, main_text, tree_of, weigh

FRAME = (
    '<html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="<p>x</p>";</script></head><body>'
    "<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
    '<div class="cookie-notice"><p>We use cookies, and this notice goes on for quite a while to look like text.</p></div>'
    '{body}<div id="sidebar"><p>Read more of what others read today</p></div><form><p>Your name</p><input></form>'
    '<section id="comments"><p>What a long and winding comment a reader has left below the article here.</p></section>'
    "<footer>&copy; 2020 Site</footer></body></html>"
)
PARAGRAPHS = ["First paragraph, with some words &amp; signs.", "Second  one\n follows <b>in bold</b> here.", "Third &eacute;nd<br>of it"]
WANT = "First paragraph, with some words & signs.\n\nSecond one follows in bold here.\n\nThird énd of it"


@pytest.mark.parametrize(
    "body",
    [
        "<article>{}</article>",
        "<main><div><div>{}</div></div></main>",
        '<div class="content"><div>{}</div></div>',
        "<div>{}</div><div class=ad><p>Buy now, buy more, and never stop buying</p></div>",
    ],
)
@pytest.mark.parametrize("close", ["</p>", ""])
def test_article_without_its_frame(body, close):
    text = "".join(f"<p>{p}{close}" for p in PARAGRAPHS)
    assert main_text(FRAME.format(body=body.format(text))) == WANT


def test_headings_and_lists_belong_to_the_article():
    body = "<article><h2>Title</h2><p>Some text of the article.<ul><li>one<li>two <i>three</i></ul><p>End.</article>"
    assert main_text(FRAME.format(body=body)) == "Title\n\nSome text of the article.\n\none\n\ntwo three\n\nEnd."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt; text", "plain < text"),
        ("<p>", ""),
        ("<!-- never closed <p>x</p>", ""),
        ("<script>never closed <p>x</p>", ""),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>a<p>b<p>c", "a\n\nb\n\nc"),
        ("<body><nav>only a menu</nav></body>", ""),
        ("<p>one<div>two</p></div>three", "one\n\ntwo\n\nthree"),
    ],
)
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    paragraphs = [f"Paragraph number {i} of a very long page." for i in range(20_000)]
    assert main_text("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs)) == "\n\n".join(paragraphs)


def test_links_lower_the_density():
    nodes = {n.name: n for n in weigh(tree_of("<div><p>some plain text here</p><pre><a>some</a> <a>link text</a> here</pre></div>"))}
    assert nodes["p"].density > nodes["pre"].density
    assert nodes["div"].gathered == pytest.approx(nodes["p"].density + nodes["pre"].density)


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = (re.sub("<b>", "", p).replace("<br>", " ") for p in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(" ".join(html.unescape(p).split()) for p in parts if p.strip())
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_rows_stay_apart(spark):
    rows = [(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F

    df = df.withColumn("text", F.lit(0)).withColumn("n_chars", F.lit("a"))
    got = extract(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]))
    assert extract(df.limit(0)).collect() == []


ARTICLE = "<p>Long paragraph of an article with words.</p><p>Another paragraph, with more words in it.</p>"
ARTICLE_TEXT = "Long paragraph of an article with words.\n\nAnother paragraph, with more words in it."


@pytest.mark.parametrize(
    "page",
    [
        "<body><div class='has-sidebar'><article>{}</article></div>",
        "<body><div class='content with-sidebar no-comments'>{}</div>",
        "<body><div id=sidebar><article>{}</article></div><div class=site-footer><p>Site</p></div>",
        "<body><div id=search>{}</div><div class=left-sidebar><p>More</p></div>",
        "<body><form id=aspnetForm><div>{}</div></form>",
        "<body><div>{}</div><aside><article>A teaser</article></aside>",
        "<body><article>{}</article><section id=comments>" + "<p>Longer than the article is what they say.</p>" * 9 + "</section>",
    ],
)
def test_wrappers_are_not_taken_for_the_frame(page):
    assert main_text(page.format(ARTICLE)) == ARTICLE_TEXT


def test_figures_keep_their_text():
    body = f"<article>{ARTICLE}<figure><pre>x = 1</pre><figcaption>Code</figcaption></figure></article>"
    assert main_text(FRAME.format(body=body)) == f"{ARTICLE_TEXT}\n\nx = 1\n\nCode"


def test_inline_frames_leave_their_line():
    page = f"<article><p>Keep <span class=ad>cut <span>this</span> too</span> it.</p>{ARTICLE}</article>"
    assert main_text(page) == f"Keep it.\n\n{ARTICLE_TEXT}"


@pytest.mark.parametrize(
    "page",
    [
        "<body><div><form><p>x</div><article>{}</article>",
        "<body><div><div class=ad>x</div><article>{}</article>",
        "<body><div><aside><p>x</div><div>{}</div>",
        "<body><aside><p>x<article>{}</article></body>",
        "<head><title>t</title><div>{}</div>",
    ],
)
def test_unclosed_frames_end_with_what_holds_them(page):
    assert main_text(page.format(ARTICLE)) == ARTICLE_TEXT


@pytest.mark.parametrize(
    "page",
    [
        "<body>A lead as bare text, with a good many words and no link in it.<div class=body>{}</div>",
        "<body><div>A lead as bare text, with a good many words and no link in it.<article>{}</article></div>",
        "<article><p>A lead as bare text, with a good many words and no link in it.</p><article>{}</article></article>",
        "<main><p>A lead as bare text, with a good many words and no link in it.</p><article>{}</article></main>",
    ],
)
def test_leads_beside_the_choice_are_kept(page):
    lead = "A lead as bare text, with a good many words and no link in it."
    assert main_text(page.format(ARTICLE)) == f"{lead}\n\n{ARTICLE_TEXT}"
    assert main_text(page.format(ARTICLE).replace(lead, f"<a>{lead}</a>").replace("body>", "body>Menu ", 1)).count("Menu") == 0


@pytest.mark.parametrize(
    "odd",
    [
        "<svg class=i/>",
        "<svg class='i' />",
        "<object data='a'/>",
        "<object data='a'>",
        "<iframe src='a' />",
        "<noscript>",
        "<noscript><img src=a>",
        "<noscript><img src=a><noscript>none</noscript>",
        "<select><option>One<option>Two",
        "<template><i>x</i>",
        "<svg><path d='M0 0'><g></g>",
        "<svg><title>A star</title><svg></svg><text>star</text></svg>",
        "<object data='a'><object data='b'>no player</object>neither</object>",
        "<script>var a = '<svg>';</script>",
        "<!-- <svg> -->",
        "<!-->",
        "<!--->",
        "<!-- odd --!>",
    ],
)
def test_skipped_elements_end_where_they_should(odd):
    for body in (f"{odd}<article>{ARTICLE}</article>", f"<article>{odd}{ARTICLE}</article>", f"<div>{odd}</div><div>{ARTICLE}</div>"):
        assert main_text(f"<html><head><title>t</title></head><body>{body}</body></html>") == ARTICLE_TEXT
        assert main_text(f"<body>{body}<p><svg></svg></p></body>".replace("</p><p>", f"</p>{odd}<p>")) == ARTICLE_TEXT


@pytest.mark.parametrize("times", [1, 5, 200])
@pytest.mark.parametrize(
    "comments",
    [
        "<div class=comments>{}</div>",
        "<section id='comments' class='section'><ol class=comment-list><li id=comment-17>{}</li></ol></section>",
        "<div id=comments><article class='comment-body'>{}</article></div>",
        "<div><article class=comment id=comment-3>{}</article></div>",
        "<div id=disqus_thread>{}",
    ],
)
@pytest.mark.parametrize("body", ["<div class=content>{}</div>", "<article>{}</article>", "<div><main>{}</main></div>"])
def test_comments_of_readers_stay_out_however_long(times, comments, body):
    said = "<p>What a long and winding comment a reader has left below the article.</p>" * times
    assert main_text(f"<body>{body.format(ARTICLE)}{comments.format(said)}</body>") == ARTICLE_TEXT


def test_many_unclosed_elements_take_linear_time():
    page = "<noscript><select><svg>" * 50_000 + f"<article>{ARTICLE}</article>"
    assert main_text(page) == ARTICLE_TEXT
