"""Pages of many shapes: the article is kept whole, and all else left out."""

import pytest

from tickloom.llm import html_region
from tickloom.llm.common import table

TITLE = "A title of some words"
PARTS = [f"Paragraph number {k} says a few things about rivers, and that they are long; it has enough words to be one of an article." for k in range(8)]
BODY = "".join(f"<p>{p}</p>" for p in PARTS)
HEAD = f"<h1>{TITLE}</h1>"
ARTICLE = " ".join([TITLE, *PARTS])
MENU = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(6)) + "</ul></nav>"
FOOT = "<footer><p>All rights reserved by somebody</p></footer>"
AD = "<div class='ad'>Buy this thing now and be glad about it for ever and ever.</div>"
SIDE = "<aside><h2>Latest</h2><ul><li><a href='/x'>Another story</a></li></ul></aside>"
COMMENTS = "<div class='comments'>" + "".join(f"<p>Reader {k} thinks that the story above is quite fine but too long to be read at once.</p>" for k in range(30)) + "</div>"
SEARCH = "<form action='/s'><label>Search here</label><input name='q'><button>Go</button></form>"

SHAPES = {
    "article": f"{MENU}<article>{HEAD}{BODY}</article>{FOOT}",
    "main": f"{MENU}<main>{HEAD}{BODY}</main>{SIDE}{FOOT}",
    "no marks": f"{MENU}<div id='story'>{HEAD}{BODY}</div>{AD}{FOOT}",
    "layout word on a wrapper": f"<div class='page has-sidebar'>{MENU}<div class='content'>{HEAD}{BODY}</div>{SIDE}</div>{FOOT}",
    "layout words on the body": f"<div class='with-header no-footer'><div class='wrap layout-sidebar'>{MENU}<article>{HEAD}{BODY}</article></div></div>",
    "page-wide form": f"<form id='aspnetForm' action='/p'><input type='hidden'>{MENU}<div>{HEAD}{BODY}</div>{FOOT}</form>",
    "page-wide form with a search form": f"<form id='f'>{MENU}<article>{HEAD}{BODY}</article></form>{SEARCH}{FOOT}",
    "wrapper that is called a widget": f"<div class='widget'>{MENU}<article>{HEAD}{BODY}</article>{FOOT}</div>",
    "heading block": f"{MENU}<article><div class='article-header'>{HEAD}</div>{BODY}</article>{FOOT}",
    "entry heading": f"{MENU}<div class='post'><div class='entry-header'>{HEAD}</div><div class='entry-content'>{BODY}</div></div>{FOOT}",
    "header element inside": f"<header><h2>Site name</h2></header><article><header>{HEAD}</header>{BODY}<footer>Tags and such</footer></article>",
    "notice paragraph inside": f"{MENU}<article>{HEAD}{BODY.replace('<p>Paragraph number 3', '<p class=notice>Paragraph number 3')}</article>",
    "advert paragraph inside": f"{MENU}<article>{HEAD}{BODY.replace('<p>Paragraph number 3', '<p class=ad>Buy it now, it is good</p><p>Paragraph number 3')}</article>",
    "advert block inside": f"{MENU}<article>{HEAD}{BODY.replace('<p>Paragraph number 3', AD + '<p>Paragraph number 3')}</article>",
    "comments longer than the article": f"{MENU}<article>{HEAD}{BODY}</article>{COMMENTS}{FOOT}",
    "comments inside a wrapper": f"<div class='page-with-comments'></div><div class='has-comments'><article>{HEAD}{BODY}</article>{COMMENTS}</div>",
    "cookie notice first": f"<div class='cookie-notice'><p>We use cookies, click to agree with all of it please.</p></div>{MENU}<article>{HEAD}{BODY}</article>",
    "subscription form after": f"<article>{HEAD}{BODY}</article><form class='newsletter'><p>Get our letter every day, it has all the news that there is.</p><input></form>",
    "inline marks": f"<article>{HEAD}{BODY.replace('rivers', '<em class=nav>ri</em>v<b>ers</b>')}</article>{FOOT}",
}


@pytest.fixture(scope="module")
def weights(spark):
    return html_region.learned_weights(table(spark, "/root/testdata/sf0.01", "pages"))


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(weights, shape):
    page = f"<html><head><title>{TITLE}</title><style>p {{}}</style></head><body>{SHAPES[shape]}<script>var x = '<p>no</p>';</script></body></html>"
    assert html_region.main_text(page, weights) == ARTICLE


def test_wrappers():
    """Only what holds most of the words outside links, and the heading or a form, wraps."""
    assert html_region.wrappers(SHAPES["article"]) == frozenset() == html_region.wrappers(SHAPES["comments longer than the article"])
    assert html_region.wrappers(SHAPES["page-wide form"]) == {1} and html_region.wrappers(SHAPES["wrapper that is called a widget"]) == {1}
    assert html_region.wrappers("") == frozenset() == html_region.wrappers("<form>") == html_region.wrappers("<div class='menu'><h1>")
