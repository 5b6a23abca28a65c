"""Main text of pages with planted layouts."""

import html
import re
import time

import duckdb
import pytest

from lintlake.llm.html import extract_pages, main_text
from lintlake.llm.warc import plain_text

from .conftest import prose

SENTENCES = [prose(n, 40).capitalize() + "." for n in range(6)]
BODY = "".join(f"<p>{s}</p>" for s in SENTENCES)
WANTED = "\n".join(SENTENCES)
LINKS = "<ul>" + "".join(f'<li><a href="/{n}">{prose(n, 3)}</a></li>' for n in range(12)) + "</ul>"


@pytest.mark.parametrize("page", [
    f"<body><nav>{LINKS}</nav><article>{BODY}</article><footer>&copy; x</footer>",
    f"<body><div class='top menu'>{LINKS}</div><div id='content'>{BODY}</div><div id=sidebar>{LINKS}<p>{SENTENCES[0]}</p></div>",
    f"<body><header><h2>Site</h2></header><main>{BODY}<aside><p>{SENTENCES[1]}</p></aside></main>",
    f"<body><div class=cookie-notice><p>{SENTENCES[2]}</p></div><div><div>{BODY}</div><section id='comments'>" + "".join(
        f"<div class=comment><p>{prose(50 + n, 60)}</p></div>" for n in range(9)) + "</section></div>",
    f"<body><div><form><p>{SENTENCES[3]}</p><input value=x><textarea>no</textarea></form>{BODY}</div><div class='ads'>{SENTENCES[0]}</div>",
    f"<div class='page-wrap'><div>{LINKS}</div><div>{BODY.replace('</p>', '')}</div></div><script>var a = '<p>no</p>';</script>",
    f"<table><tr><td>{LINKS}</td><td>{BODY}</td></tr></table><style>p {{}}</style><!-- <p>{SENTENCES[0]}</p> -->",
])
def test_layouts(page):
    assert main_text(page) == WANTED


PARTS = [prose(100 + n, 45).capitalize() + "." for n in range(8)]


def paragraphs(of):
    return "".join(f"<p>{s}</p>" for s in of)


@pytest.mark.parametrize("around", ["{}", f"<div>{LINKS}</div>{{}}<div>{LINKS}</div>"])
def test_articles_in_sections(around):
    """Wrappers of one child, headings and sections of other lengths don't end the article."""
    rows = "".join(f"<div class=row><div class=col>{paragraphs(PARTS[n:n + 4])}</div></div>" for n in (0, 4))
    assert main_text("<body>" + around.format(f"<div id=content>{rows}</div>")) == "\n".join(PARTS)
    sections = "".join(f"<section><h2>Part {n}</h2><div class=body>{paragraphs(PARTS[n:n + 2])}</div></section>" for n in (0, 2, 4, 6))
    wanted = "\n".join(x for n in (0, 2, 4, 6) for x in (f"Part {n}", *PARTS[n:n + 2]))
    assert main_text("<body>" + around.format(f"<div id=content>{sections}</div>")) == wanted
    deep = "".join(f"<div><div><div>{paragraphs(PARTS[n:m])}</div></div></div>" for n, m in ((0, 5), (5, 8)))
    assert main_text("<body>" + around.format(f"<div><div>{deep}</div></div>")) == "\n".join(PARTS)


@pytest.mark.parametrize("wrapper", [
    "div class='content-sidebar-wrap'", "div id='page' class='has-sidebar'", "div class=with-sidebar", "div class=header-fixed",
    "div class='menu-open'", "div class='review-body'", "div class=more", "div class=legal", "form action=/ method=post", "div role=form"])
def test_wrappers_that_sound_like_noise(wrapper):
    end = wrapper.split()[0]
    aside = f"<div class=sidebar>{LINKS}<p>{SENTENCES[0]}</p></div>"
    for inside in (BODY, f"<div>{BODY}</div>{aside}", f"<div class='site-menu-open'><div class=more-stuff>{BODY}</div></div>"):
        assert main_text(f"<body><header>{LINKS}</header><{wrapper}>{inside}</{end}><div class=cookie-notice><p>{SENTENCES[2]}</p></div>") == WANTED
    assert main_text(f"<body><div>{BODY}</div><{wrapper}><p>{SENTENCES[3]}</p></{end}>") == WANTED  # a minor share


def test_long_comments_stay_noise():
    talk = "".join(f"<p>{prose(50 + n, 60)}</p>" for n in range(8))
    assert main_text(f"<body><div><div>{BODY}</div><section id=comments>{talk}</section></div>") == WANTED


@pytest.mark.parametrize("markup", [
    "<svg class='icon'/>", "<math/>", "<object data=x>", "<canvas/>", "<svg class=icon><path d='M0'/>", "<svg><title>no</title><svg><text>no</text></svg>no</svg>",
    "<svg><foreignObject><div><p>no</div></foreignObject><style/><text>no</text></svg>", "<canvas id=c>no</canvas>", "<svg><script href=x /><text>no</text></svg>",
    "<svg><foreignObject><div>no</svg>"])
def test_drawings_lose_nothing_else(markup):
    """Neither the article's text nor that of a conversion record, which keeps all but markup."""
    page = f"<body><div>{markup}{BODY}</div>"
    assert main_text(page) == WANTED and plain_text(page.encode(), "text/html") == WANTED
    assert main_text(f"<body><article><p>a {markup}</p><p>b</p></article>") == "a\nb"


def test_text_inside_embedded_elements():
    page = "<article><p>x <math><mi>a</mi><mo>=</mo><mn>1</mn></math> y</p><object data=z><p>other <b>form</b></p></object><noscript><p>plain</p></noscript></article>"
    assert main_text(page) == plain_text(page.encode(), "text/html") == "x a=1 y\nother form\nplain"


def test_blocks_and_references():
    page = "<article><h1>A &lt;b&gt; &#8364;&#x41;&nbsp;x</h1><p>one<br>two <b>bo</b>ld\n\t <i>it</i></p><ul><li>x<li>y</ul><pre>a\n b</pre></article>"
    assert main_text(page) == "A <b> €A x\none\ntwo bold it\nx\ny\na b"
    assert main_text(None) == main_text("") == main_text("<nav>only menu</nav>") == ""
    assert main_text("plain words only") == "plain words only"
    assert main_text('<p title="unclosed>text</p>') in ("text", "")


def test_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r for r in extract_pages(pages).collect()}
    for page, url, source in duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(b.replace("<b>", "").replace("</b>", ""))).strip() for b in re.split(r"</?(?:p|h1|br)>", inside)]
        assert found[page].text == "\n".join(b for b in blocks if b) and found[page].url == url and found[page].n_chars == len(found[page].text)


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", f"<article><p>{prose(1, 30_000)}</p></article>"), (2, "u", "<p>x"), (2, "u", "<p>x")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = extract_pages(pages).collect()
    assert len(found) == 5 and sorted((r.text for r in found), key=len)[:4] == ["", "", "x", "x"] and max(r.n_chars for r in found) == len(prose(1, 30_000))
    assert extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["</b>", "</div>", "<div>", "<b>", "<p><b></i>", "<h1><table><td><span>", "<li><ul>", "<svg></b>", "<td></td></tr>"])
def test_hostile_pages_take_seconds(piece):
    page = "<article><p>First words.</p></article>" + piece * (500_000 // len(piece)) + "<p>Last words.</p>"
    start = time.perf_counter()
    text = main_text(page)
    assert time.perf_counter() - start < 20 and "words" in text


def test_text_of_elements_that_nest_too_deep():
    page = "<article>" + "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000 + "<p>after it</p></article>"
    assert "".join(main_text(page).split()) == "deeptextafterit"


@pytest.mark.parametrize("name", ["related-work", "more-details", "search-results", "legal", "note-more", "side-effects"])
def test_sections_of_articles_are_not_told_by_their_class(name):
    section = f"<section class='{name}'><h2>Heading</h2><p>{'Plain words of a section. ' * 5}</p></section>"
    links = "".join(f"<li><a href='/{n}'>Another article {n}</a></li>" for n in range(8))
    page = f"<body><article><p>{'The body of the article. ' * 20}</p>{section}</article><div class='{name}'><ul>{links}</ul></div></body>"
    text = main_text(page)
    assert "Plain words" in text and "Another article" not in text
