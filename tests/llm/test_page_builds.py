"""Main text of generated pages of several builds, against a reader that knows which blocks are the article's."""

import random
from html import escape, unescape
from html.parser import HTMLParser

import pytest
from inkstream.llm import html_text

WORDS = "river stone lantern quiet morning, harbour & window <paper> winter, garden; letter market shadow 42 bridge".split()


class Own(HTMLParser):
    """The texts of elements marked with data-own, whatever stands around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.texts = 0, []

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += tag not in ("br", "img")
        elif ("data-own", "1") in attrs:
            self.depth, self.texts = 1, [*self.texts, ""]

    def handle_endtag(self, tag):
        self.depth -= self.depth > 0

    def handle_data(self, data):
        if self.depth:
            self.texts[-1] += data


def reader(page):
    own = Own()
    own.feed(page)
    return "\n".join(" ".join(t.split()) for t in own.texts if t.split())


def say(rng, n):
    return escape(" ".join(rng.choice(WORDS) for _ in range(n)))


def block(rng, tag="p", n=None, link=False, name=""):
    text = say(rng, n or rng.randint(12, 40))
    name = f' class="{name}"' if name else ""
    return f"<{tag} data-own=1{name}>" + (f"<a href=/x>{text}</a>" if link else text.replace("stone", "<em>stone</em>", 1)) + f"</{tag}>\n"


def menu(rng, n=5, tag="ul", name=""):
    name = f' class="{name}"' if name else ""
    return f"<{tag}{name}>" + "".join(f"<li><a href=/{k}>{say(rng, 2)}</a></li>" for k in range(n)) + f"</{tag}>\n"


def advert(rng):
    kind = rng.choice(['div class="inline-ad-42"', 'div class="adbox"', 'div id="advert"', 'p class="advertisement"', 'div class="dfp-ad"', 'div id="newsletter-signup"', 'div class="cookie-wall"'])
    return f"<{kind}>{say(rng, 9)}</{kind.split()[0]}>\n"


def story(rng):
    parts = [block(rng)]
    for _ in range(rng.randint(1, 6)):
        parts.append(rng.choice([block(rng), block(rng, "h2", 3), block(rng, "li", 8), advert(rng), block(rng, "blockquote"), f'<div class="{rng.choice(["search-algorithms", "post-social-science", "code-comment-style", "widget-content", "post tags"])}">{block(rng)}</div>', "".join(block(rng, "p", 4, link=True) for _ in range(4))]))
    return "".join(parts) + block(rng)


def with_article(rng):
    return f"<header>{menu(rng)}</header><article><h1 data-own=1>{say(rng, 4)}</h1>{story(rng)}</article><footer>{say(rng, 20)}</footer>"


def menu_in_article(rng):
    return f"<nav>{menu(rng)}</nav><article>{menu(rng)}<h1 data-own=1><a href=/self>{say(rng, 4)}</a></h1>{story(rng)}</article>"


def main_and_teasers(rng):
    teasers = "".join(f"<article><h3><a href=/t>{say(rng, 3)}</a></h3><p>{say(rng, 14)}</p></article>" for _ in range(3))
    return f'<div class="site-header">{menu(rng)}</div><main><h1 data-own=1>{say(rng, 5)}</h1>{story(rng)}</main><section class="more">{teasers}</section>'


def plain_body(rng):
    return f'<div class="top-nav">{menu(rng)}</div><h1 data-own=1><a href=/self>{say(rng, 4)}</a></h1>{story(rng)}{menu(rng, 7)}<div class="footer-widgets">{say(rng, 30)}</div>'


def table_layout(rng):
    return f"<table><tr><td>{menu(rng, 8)}</td><td>{story(rng)}</td></tr></table>"


def unclosed(rng):
    return f"<body>{menu(rng, 4)}<p data-own=1>{say(rng, 30)}</p><p data-own=1>{say(rng, 30)}</p><div class=comments><p>{say(rng, 40)}"


BUILDS = [with_article, menu_in_article, main_and_teasers, plain_body, table_layout, unclosed]


@pytest.mark.parametrize("build", BUILDS, ids=lambda b: b.__name__)
@pytest.mark.parametrize("seed", range(25))
def test_a_page_gives_what_its_reader_finds(build, seed):
    page = f"<html><head><title>{escape('t')}</title><style>p {{}}</style></head><body>{build(random.Random(seed))}</body></html>"
    assert html_text.main_text(page) == reader(page)


def test_the_window_decides_inside_an_article_as_well(monkeypatch):
    page = menu_in_article(random.Random(1))
    want = reader(page)
    assert html_text.main_text(page) == want and unescape(want)
    monkeypatch.setattr(html_text, "WINDOW", 10**6)
    assert html_text.main_text(page) != want


def test_linked_lines_that_a_line_announces_stay():
    page = f"<body><p>{'Some words of text. ' * 5}</p>{{}}<ul>" + "<li><a href=x>a source</a></li>" * 5 + "</ul></body>"
    assert html_text.main_text(page.format("<h2>Sources</h2>")).count("a source") == html_text.main_text(page.format("<p>See also:</p>")).count("a source") == 5
    assert html_text.main_text(page.format("")).count("a source") == 0


@pytest.mark.parametrize("name", ["related", "discussion", "search", "results"])
def test_a_section_s_id_inside_an_article_is_a_topic(name):
    assert "own words" in html_text.main_text(f'<article><p>First.</p><section id="{name}"><p>own words</p></section></article>')


def test_an_article_in_a_section_of_other_names_is_kept():
    assert html_text.main_text('<section class="moreover"><article><p>own words</p></article></section>') == "own words"


def test_very_long_and_deep_pages():
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert html_text.main_text(long).count("\n") == 19_999
    assert html_text.main_text("<div>" * 5_000 + "deep words" + "</div>" * 5_000) == "deep words"
