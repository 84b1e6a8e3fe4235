"""Pages whose tags, comments and names once hid their text."""

import pytest

from popspark.llm import html_text

P = "<p>one two three</p>"


@pytest.mark.parametrize("between", ['<svg class="i"/>', '<iframe src="x"/>', '<svg-icon name="x"></svg-icon>', "<select-menu>", "<title-bar></title-bar>", "<object-view>", "<!-->", "<!--->", "<!-- x --!>", "<!-- a > b -->", "<svg><title>no</title></svg>", "<script>if (a</b/.x) y()</script>", "<math/>", "<SVG\n/>", "<template><p>no</p></template>"])
def test_what_follows_an_element_or_comment_stays(between):
    assert html_text.prune([html_text.blocks(f"<article>{P}{between}<p>four</p></article>")]) == ["one two three\nfour"]


def test_noscript_counts_by_measure():
    text = " ".join(f"w{i}" for i in range(60))
    alone = f"<body><div id='app'></div><noscript><article><p>{text}</p></article></noscript></body>"
    beside = f"<article><p>{text}</p></article><noscript><p>Please enable scripts</p></noscript>"
    assert html_text.prune([html_text.blocks(alone)]) == [text] and html_text.prune([html_text.blocks(beside)]) == [text]


@pytest.mark.parametrize("open_", ['<div class="comment">', '<section class="reader-comments">', '<div class="ad-slot">', '<div class="newsletter">'])
def test_what_is_not_the_article_goes_from_inside_it(open_):
    end = "</section>" if "section" in open_ else "</div>"
    assert html_text.prune([html_text.blocks(f"<article>{P}{open_}<p>no</p>{end}<p>four</p></article>")]) == ["one two three\nfour"]


def test_headings_of_the_article_stay():
    page = f"<div class='content-header'><h1>Title</h1></div><div class='article-banner'><p>The lead</p></div><div class='post-body'>{P}</div><div class='post-footer'>no</div><div class='site-header'>no</div>"
    assert html_text.prune([html_text.blocks(page)]) == ["Title\nThe lead\none two three"]
