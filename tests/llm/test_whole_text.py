"""Page text: nothing of the article is lost."""

import pytest

from inkstream.llm.html_text import main_text

LINKS = "".join(f"<li><a href=x>Source {k}</a></li>" for k in range(5))
VOUCHED = [
    ("<article><h1><a href=x>Title</a></h1><p>Text of it.</p></article>", "Title\nText of it."),
    (f"<main><p>Text of it.</p><ul>{LINKS}</ul></main>", "Text of it.\n" + "\n".join(f"Source {k}" for k in range(5))),
    (f"<article><p>One.</p><ul>{LINKS}</ul><p>Two.</p><nav>menu</nav></article>", "One.\n" + "\n".join(f"Source {k}" for k in range(5)) + "\nTwo."),
]


@pytest.mark.parametrize(("page", "want"), VOUCHED)
def test_linked_lines_of_an_article_stay(page, want):
    assert main_text(page) == want


LONG = "word " * 99 + "end"
UNVOUCHED = [
    ("<body><p>Short note.</p></body>", "Short note."),
    (f"<body><p>{LONG}</p><p>{LONG}</p><ul>{LINKS}</ul><p>A closing part, which has under a fifth of the rest.</p></body>", f"{LONG}\n{LONG}\nA closing part, which has under a fifth of the rest."),
    (f"<body><p>{LONG}</p><div class=related><p>a<p>b<p>c<p>d</div><p>End.</p></body>", f"{LONG}\nEnd."),
    (f"<body><div class='elementor-widget-container'><p>{LONG}</p></div><p>x</p></body>", f"{LONG}\nx"),
    (f"<body><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></body>", f"Title\n{LONG}"),
    (f"<body><nav>menu</nav><div class=search><p>{LONG}</p></div></body>", LONG),
    (f"<body><ul>{LINKS}</ul><p>{LONG}</p><ul>{LINKS}</ul></body>", LONG),
]


@pytest.mark.parametrize(("page", "want"), UNVOUCHED)
def test_pages_without_article_keep_their_text(page, want):
    assert main_text(page) == want
