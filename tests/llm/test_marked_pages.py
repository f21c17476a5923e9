"""Hand-marked pages: each sentence of the article comes out once and in order, nothing else does."""

import random
import re

import pytest

from inkstream.llm.html_text import main_text

# + is the article's, - isn't.
PAGES = [
    "<body><nav>{-}</nav><article><header><h1>{+}</h1></header><p>{+}</p><h2 id='related-work'>{+}</h2><p class=social>{+}</p><p id='search-trees'>{+}</p><ul><li class=share>{+}</ul></article><footer>{-}</footer>",
    "<article><p>{+}</p><ul><li><a href=1>{+}</a><li><a href=2>{+}</a><li><a href=3>{+}</a><li><a href=4>{+}</a></ul><p>{+}</p></article><aside>{-}</aside>",
    "<article><header>" + "<p>{+}</p>" * 300 + "<h1>{+}</h1></header><p>{+}</p></article><div class=comments>{-}</div>",
    "<header><p>{+}</p><p>{+}</p>",
    "<article><header><p>{+}</p><p>{+}</p></article><footer>{-}</footer>",
    "<body><p>{+}</p></body>",
    "<article><p>{+}<![CDATA[{+}]]></p><p>{+}<![CDATA[{+}",
    "<main><header><p>{-}</p></header><section id=comments-section>{-}</section><section id='search'><p>{+}</p></section><div class='cookie-notice'>{-}</div><div class='related-posts'>{-}</div><div class='widget-theory'>{+}</div></main>",
    "<div role=navigation>{-}</div><div role=main><p>{+}</p><form>{-}</form><math><mi>{+}</mi><annotation>{-}</annotation></math></div><div role=contentinfo>{-}</div>",
    "<div class='site-header'>{-}</div><div class='post-body'><h1>{+}</h1><p>{+}</p><p>{+}</p></div><div id='comments'><p>{-}</p><p>{-}</p></div><div id='sidebar'>{-}</div>",
    "<div itemprop=articleBody><p>{+}</p></div><div class=promo>{-}</div><div>{-}</div>",
    "<table><tr><td class=menu>{-}<td><p>{+}<p>{+}<tr><td colspan=2>{+}</table>",
    "<article><blockquote>{+}</blockquote><pre>{+}</pre><dl><dt>{+}<dd>{+}</dl><figure><img><figcaption>{+}</figcaption></figure><noscript>{-}</noscript><select><option>{-}</select><p hidden>{-}</p></article>",
]


def filled(page, draw):
    """The page with sentences of its own, and the article's in order: a reader that only knows the marks."""
    want, n = [], 0

    def one(m):
        nonlocal n
        n += 1
        text = f"S{n}x " + " ".join(draw.choice(["some", "plain", "words", "of", "text"]) for _ in range(draw.choice([1, 3, 12, 60])))
        if m[1] == "+":
            want.append(text)
        return text.replace(" ", draw.choice([" ", "\n ", "&#32;"]), 1)

    return re.sub(r"\{([+-])\}", one, page), want


@pytest.mark.parametrize("page", PAGES)
def test_each_sentence_comes_out_once(page):
    for seed in range(8):
        html, want = filled(page, random.Random(seed))
        text = main_text(html)
        assert re.findall(r"S\d+x[^\n]*?(?=\s*S\d+x|\s*$)", text) == want, (seed, html)
        assert [t for t in re.findall(r"S\d+x", text)] == [w.split()[0] for w in want]


def test_deep_and_broken_pages_take_linear_time():
    assert main_text("<div>" * 50_000 + "text" + "</p></b>" * 50_000) == "text"
    assert main_text("<article>" + "<header>" * 20_000 + "text").endswith("text")
    assert main_text("<article><p>a</p>" + "<header><p>n</p></header>" * 20_000 + "<p>b</p></article>") == "a\nb"


def test_a_menu_at_the_head_of_an_article_goes():
    links = "".join(f"<li><a href=x>m{k}</a>" for k in range(4))
    assert main_text(f"<article><ul>{links}</ul><h1><a href=y>Title</a></h1><p>Text.</p></article>") == "Title\nText."
    assert main_text(f"<article><ul>{links}</ul></article>") == "m0\nm1\nm2\nm3"
