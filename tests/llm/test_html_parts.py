"""Pages whose article has parts that density sums alone, or names of classes, would lose."""

import pytest

from tessera.llm import html_text

WORDS = "word " * 100


def sections(title="<h1>Headline</h1>"):
    return f"{title}<p>Lede.</p><section><h2>First</h2>" + f"<p>{WORDS}</p>" * 10 + "</section><section><h2>Second</h2>" + f"<p>{WORDS}</p>" * 3 + "</section>"


PARTS = ["Headline", "Lede.", "First", "Second"]


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_headings_ledes_and_shorter_sections_stay(around):
    page = f"<body><nav><a href=x>Menu</a></nav><{around}>{sections()}</{around}><div>&copy; Site <a href=t>Terms</a></div></body>"
    text = html_text.extract(page)
    assert [w for w in text.split() if w != "word"] == PARTS


def test_split_articles_are_joined_and_links_left_out():
    links = "<div>" + "<a href=x>Some other story</a>" * 8 + "</div>"
    page = f"<body><article><p>{WORDS}</p><p>{WORDS}</p></article>{links}<article><p>{WORDS}</p></article></body>"
    assert html_text.extract(page) == " ".join([*WORDS.split() * 3])


@pytest.mark.parametrize("attributes", ["class='content has-sidebar'", "class='post no-comments'", "id='search-results'", "class=header"])
def test_hints_do_not_cut_what_holds_the_text(attributes):
    page = f"<body><div class=ad>Buy</div><div {attributes}><article>{sections()}</article></div></body>"
    assert [w for w in html_text.extract(page).split() if w != "word"] == PARTS


@pytest.mark.parametrize("header", ["header class='entry-header'", "div class='article-header'", "header class='header social'"])
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_headers_of_an_article_stay(header, around):
    if around == "div" and header.startswith("header"):
        pytest.skip("a header element outside of an article is the site's")
    title = f"<{header}><h1>Headline</h1></{header.split()[0]}>"
    text = html_text.extract(f"<body><{around}>{sections(title)}<div class=related><a href=x>More</a></div></{around}></body>")
    assert [w for w in text.split() if w != "word"] == PARTS


def test_long_hinted_parts_beside_the_article_are_left_out():
    reader = "<p>" + "reader " * 60 + "</p>"
    page = f"<body><article>{sections()}</article><div id=comments>{reader}</div></body>"
    assert "reader" not in html_text.extract(page)


def test_captions_formulas_and_links_in_prose_stay():
    page = (
        f"<article><figure><img src=x><figcaption>Caption</figcaption></figure><p>{WORDS}Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and "
        "<a class=related href=x>linked</a> end.</p></article>"
    )
    assert [w for w in html_text.extract(page).split() if w != "word"] == ["Caption", "Here", "x=2", "and", "linked", "end."]
