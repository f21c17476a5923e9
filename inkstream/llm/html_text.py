"""Main text of raw pages by the line-block distribution.

A page is cut into lines at block markup, in page order, without building a tree.  What can't be article text is
stripped with its content: scripts, styles, menus, headers, footers, asides, forms, adverts, notices,
reader comments and the like, known by their element, or by a name (class, id or role) of a container.  A name counts only if
all its words are such words or layout words (``cookie-notice``, ``inline-ad-42``, but not ``search-algorithms``), and a word
that an article's topic may be as well (``social``, ``widget``) only if the name's last word isn't the text (``widget-content``) and no
other name of the element is (``post tags``).  Headings, paragraphs, list items and spans are judged only by whole names of adverts and cookie
notices.  Inside an ``article`` or ``main`` element an id counts only for adverts, sign-ups, cookie notices and reader comments.
A header there is stripped if it is closed and holds no heading.

A line's length is its text outside links; inside an ``article`` or ``main`` a heading or paragraph counts whole, and only the
lines there are looked at.  Lengths are summed over a window of lines sliding down the page; the text lies between the first
surge and the last dive.  A surge takes ``SURGE`` code points or a tenth of the page's largest sum,
whichever is less; inside ``article`` or ``main`` the markup vouches for lines, so any sum over nothing is one (a whole window of linked
lines at the head is a menu), and the dive is the element's end.  Elsewhere a dive is a whole window of linked lines, and such a
window of lines that are no paragraphs goes between surge and dive as well.  Headings just before the
first surge are its title.  Linked lines stay if the line before announces them (a heading, or a colon at its end).
If everything was stripped, what was so only for a name is the text; then what an unclosed element held.

Character references are decoded, white space inside a line becomes one space, lines are joined by a line feed.
Null or empty pages have an empty text.  Unclosed and crossed elements end with the block that holds them.
Repeated rows give a row each.  Nothing is cut by length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure

WINDOW, SURGE = 3, 40
#: Why a line is stripped: for a name of a container; for an element, or as it is hidden.
BY_NAME, BY_ELEMENT = 1, 2

# Elements of the HTML standard by what they mean here.
NOISE = frozenset("script style noscript template nav header footer aside form button select textarea iframe svg canvas audio video object dialog menu title head option label fieldset annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
MAIN = frozenset(["article", "main"])
HEADINGS, PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("p blockquote pre figcaption dd".split())
#: Elements that a name can mark; all others are text of whatever holds them.
CONTAINERS = frozenset("div section ul ol dl table tbody tr td center details figure blockquote ins dir".split())
#: Roles that mark what isn't the article, and those that mark it.
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN_ROLES = frozenset("main article".split())
#: Words of a name that tell what isn't the article.
NOISE_WORDS = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertisements advertising adsense adsbygoogle banner breadcrumb breadcrumbs comment comments comentarios kommentare commentaires cookie cookies consent disqus discussion "
    "footer footnav gdpr header masthead menu nav navbar navigation newsletter notice notices overlay pagination pager popup modal promo promoted promotion related recommended replies reply "
    "respond share sharing sharebar sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert paywall search".split()
)
#: Of these, what a name of any element means.
ADVERT_WORDS = frozenset("ad ads adbox adslot adunit advert adverts advertisement advertisements advertising adsense adsbygoogle sponsored cookie cookies gdpr".split())
#: Of these, what an id means inside an article as well: adverts, sign-ups, notices, reader comments.
ID_WORDS = ADVERT_WORDS | frozenset("consent newsletter signup subscribe promo paywall comment comments comentarios kommentare commentaires disqus replies respond".split())
#: Of these, what an article may be about.
TOPIC_WORDS = frozenset("widget widgets tags social search notice notices discussion alert skip share".split())
#: What the text itself is called.
TEXT_WORDS = frozenset("article body content entry main post story text".split())
#: Names of lists of other posts.
MORE_WORDS = frozenset("more read also next like this from news posts articles stories section list block wrap wrapper".split())
#: What else a whole name of such a container is made of.
LAYOUT_WORDS = frozenset(
    "a and app area article articles bar block body bottom box btn button buttons card cards col column container content cloud cta dfp entry form global group holder icons inline inner item items js left links list main media meta "
    "more next outer page panel post posts prev previous primary reader readers right row secondary section segment site slot stories story sub text the thread top trail unit user users vertical wall wide wrap wrapper".split()
)
#: Of the words, what an ``article`` element may be instead of the article.
ASIDE_WORDS = frozenset("ad advert comment comments promo related reply replies recommended sponsored".split())

#: Layout that an element has or lacks says nothing about the element.
_WITHOUT = re.compile(r"\b(?:has|have|no|not|with|without|hide|is)[-_]\w+", re.I)
#: Names of an article's own parts, or of any block in a page builder.
_OWN_PART = re.compile(r"(?<![A-Za-z])(?:elementor-widget|(?:entry|post|article|story)[-_]+header)(?![A-Za-z])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
_HEADER_OR_END = re.compile(r"<(/?)(header|article|main|h[1-6])(?=[\s/>])", re.I)


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]


def _whole(name: str, wanted: frozenset[str], own_text: bool = False) -> bool:
    """Whether a name is made of such words and layout words alone; one whose only such words are topics must not be the text's."""
    words = _words(name)
    if not all(w in NOISE_WORDS or w in LAYOUT_WORDS for w in words):
        return False
    found = wanted.intersection(words)
    return bool(found - TOPIC_WORDS) or bool(found) and not own_text and words[-1] not in TEXT_WORDS


def _is_named(value: str, wanted: frozenset[str]) -> bool:
    """Whether one of the names means noise."""
    names = value.split()
    own_text = any(w and all(x in TEXT_WORDS for x in w) for w in map(_words, names))
    return any(_whole(x, wanted, own_text) for x in names)


def _is_more(value: str) -> bool:
    return any("more" in w and MORE_WORDS.issuperset(w) for w in map(_words, value.split()))


def _is_noise(tag: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """Why an element is stripped (0: it isn't), and whether it is the article."""
    main = tag in MAIN
    if tag in NOISE:
        return BY_ELEMENT, False
    if not attributes:
        return 0, main
    out = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return BY_ELEMENT, False
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return BY_ELEMENT, False
        elif name == "itemprop":
            main = main or value == "articleBody"
        elif name == "role":
            main = main or value.lower() in MAIN_ROLES
            if tag in CONTAINERS and value.lower() in NOISE_ROLES:
                out = BY_NAME
        elif tag in MAIN:
            if ASIDE_WORDS.intersection(_words(_WITHOUT.sub(" ", value))):
                out = BY_NAME
        elif tag not in CONTAINERS:
            if _is_named(value, ADVERT_WORDS):
                out = BY_NAME
        elif _OWN_PART.search(value) and not NOISE_WORDS.intersection(_words(_OWN_PART.sub(" ", value))):
            continue
        elif _is_named(_OWN_PART.sub(" ", _WITHOUT.sub(" ", value)), ID_WORDS if inside and name == "id" else NOISE_WORDS) or not inside and _is_more(value):
            out = BY_NAME
    return out, main


@dataclass
class Line:
    """text; free: its code points outside links; noise: why it is stripped; main: whether the article holds it; heading, paragraph: whether it is in one; opener: the stripped element that holds it."""

    text: str
    free: int
    noise: int
    main: bool
    heading: bool
    paragraph: bool
    opener: int


def lines(page: str) -> tuple[list[Line], set[int]]:
    """The lines of a page, and the stripped elements that are never closed."""
    bottom = ("", 0, False, -1, 0, 0, 0)
    stack: list[tuple[str, int, bool, int, int, int, int]] = []  # element, noise, main, opener; links, headings and paragraphs up to here
    depth: Counter[str] = Counter()
    out: list[Line] = []
    open_: set[int] = set()
    parts: list[tuple[str, int, int]] = []  # text, noise, opener: a button or an annotation may stand inside a line
    free = at = 0
    bare: set[int] | None = None

    def flush() -> None:
        nonlocal parts, free
        _, _, main, _, _, headings, paragraphs = stack[-1] if stack else bottom
        for stripped in (False, True):
            part = [x for x in parts if (x[1] > 0) is stripped]
            text = _SPACE.sub(" ", html.unescape("".join(x[0] for x in part))).strip() if part else ""
            if text:
                out.append(Line(text, min(free, len(text)), part[0][1], main, headings > 0, paragraphs > 0, part[0][2]))
        parts, free = [], 0

    def add(text: str) -> None:
        nonlocal free
        _, noise, _, opener, links, _, _ = stack[-1] if stack else bottom
        parts.append((text, noise, opener))
        if not links and not noise:
            free += len(text.strip())

    def cut(k: int) -> None:
        depth.subtract(x[0] for x in stack[k:])
        del stack[k:]

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        if tag in BLOCK:
            flush()
        if m[1]:  # an end tag closes up to its element, but not beyond the article or page around it
            for k in range(len(stack) - 1, -1, -1) if depth[tag] > 0 else ():
                if stack[k][0] == tag:
                    open_.discard(stack[k][3] if not k or stack[k - 1][3] != stack[k][3] else -1)
                    cut(k)
                    break
                if stack[k][0] in MAIN and tag not in MAIN and tag not in ("body", "html"):
                    break
        else:
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):  # its like ends where it begins
                like = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                    if stack[k][0] in like:
                        cut(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            if tag not in VOID and not m[3].rstrip().endswith("/"):
                _, held, inside, opener, links, headings, paragraphs = stack[-1] if stack else bottom
                bad, main = _is_noise(tag, m[3], inside)
                if tag in ("header", "label") and inside and bad and not held:
                    bare = _bare_headers(page) if bare is None else bare
                    bad = BY_ELEMENT if m.start() in bare else 0
                if bad and not held:
                    opener = at
                    open_.add(at)
                stack.append((tag, max(held, bad), inside or main, opener, links + (tag == "a"), headings + (tag in HEADINGS), paragraphs + (tag in PARAGRAPHS)))
                depth[tag] += 1
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                    open_.discard(opener)
                    cut(len(stack) - 1)
    flush()
    return out, open_


def _bare_headers(page: str) -> set[int]:
    """Where headers begin that are closed before an article is, and hold no heading; in one pass."""
    waiting: list[tuple[int, bool]] = []  # where it begins, whether it holds a heading
    out = set()
    for m in _HEADER_OR_END.finditer(page):
        name = m[2].lower()
        if name == "header" and not m[1]:
            waiting.append((m.start(), False))
        elif name == "header" and waiting:
            at, titled = waiting.pop()
            if not titled:
                out.add(at)
            elif waiting:
                waiting[-1] = (waiting[-1][0], True)
        elif name[0] == "h" and name != "header" and waiting:
            waiting[-1] = (waiting[-1][0], True)
        elif name in MAIN and m[1]:
            waiting = []
    return out


def between(lengths: list[int], surge: int, vouched: bool) -> tuple[int, int] | None:
    """The first surge and the last dive (the line after the text) of the sums over a sliding window; None without a surge."""
    n = len(lengths)
    upto = [0]
    for x in lengths:
        upto.append(upto[-1] + x)
    sums = [upto[min(n, i + WINDOW)] - upto[i] for i in range(n)]
    surges = [i for i in range(n) if lengths[i] and sums[i] >= surge]
    if not surges:
        return None
    first = surges[0]
    # The text that surged last goes on until a whole window is empty.
    last = next((i for i in range(surges[-1] + 1, n) if not sums[i]), n)
    if vouched:
        first, last = 0 if first < WINDOW else first, n  # the element's end is the dive
    return first, last


def main_text(page: str) -> str:
    found, unclosed = lines(page)
    left = [x for x in found if not x.noise]
    if not left:
        left = [x for x in found if x.noise == BY_NAME] or [x for x in found if x.opener in unclosed]
        return "\n".join(x.text for x in left)
    vouched = any(x.main for x in left)
    if vouched:
        left = [x for x in left if x.main]
        lengths = [len(x.text) if x.heading or x.paragraph else x.free for x in left]
        surge = 1
    else:
        # A line that is mostly links isn't text.
        lengths = [x.free if 2 * x.free >= len(x.text) else 0 for x in left]
        largest = max(sum(lengths[i : i + WINDOW]) for i in range(len(left)))
        surge = min(SURGE, max(1, largest // 10))
    text = between(lengths, surge, vouched)
    if text is None:
        return "\n".join(x.text for x in left)
    first, last = text
    while first and left[first - 1].heading:
        first -= 1
    announces = lambda x: x.heading or x.text.endswith(":")
    if last < len(left) and announces(left[last - 1]):
        last = next((i for i in range(last, len(left)) if lengths[i]), len(left))
    kept, at = [], first
    while at < last:
        end = next((i for i in range(at + 1, last) if (lengths[i] > 0) != (lengths[at] > 0)), last)
        menu = not vouched and not lengths[at] and end - at >= WINDOW and not any(x.paragraph or x.heading for x in left[at:end])
        if not menu or at and announces(left[at - 1]):
            kept += left[at:end]
        at = end
    return "\n".join(x.text for x in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; other columns are left out."""
    configure(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
