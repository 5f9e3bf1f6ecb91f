"""Main text of web pages by two passes of block rules.

The first pass labels each block by its place (a menu or a footer is no article, an article element is), its share of
link text, its length and its density of stop words; short blocks without a clear sign stay open. The second pass gives
each open block the label of its nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .common import unused

# Elements of HTML by their part in the layout.
BLOCKS = frozenset([
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
    "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "title", "tr", "ul",
])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp", "svg", "math", "canvas", "object", "select", "button"])
#: Those that run to the end of the page when they are not closed; the others end with the block around them.
ENDLESS = frozenset(["script", "style", "textarea", "title", "iframe", "noframes", "xmp"])
OUTSIDE = frozenset(["nav", "menu", "footer", "aside", "form", "head", "dialog", "fieldset", "search", "dir", "label", "legend"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
INSIDE = frozenset(["article", "main"])
OUTSIDE_ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "note"])
INSIDE_ROLES = frozenset(["article", "main"])
#: Parts of class names and ids that mark what surrounds an article.
MARKS = frozenset([
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "foot", "gdpr", "header", "login", "masthead",
    "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "paywall", "popup", "promo", "promotion",
    "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "teaser",
    "toolbar", "topbar", "widget", "widgets",
])

#: Beside one of these a mark describes a frame around the whole page; and marks of an article's own head.
FRAMES = frozenset(["article", "container", "content", "has", "layout", "main", "no", "page", "root", "with", "without", "wrap", "wrapper"])
HEADLINES = frozenset(["banner", "header", "masthead"])

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset([
    "a", "about", "after", "all", "also", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "for", "from", "had", "has",
    "have", "he", "her", "his", "if", "in", "into", "is", "it", "its", "more", "no", "not", "of", "on", "one", "or", "other", "she", "so",
    "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "we", "were", "what", "when", "which",
    "who", "will", "with", "would", "you",
    "aber", "als", "am", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "des", "die", "ein", "eine", "einem", "einen",
    "einer", "er", "es", "für", "hat", "ich", "im", "ist", "mit", "nach", "nicht", "noch", "nur", "oder", "sich", "sie", "sind", "so",
    "über", "um", "und", "vom", "von", "vor", "war", "werden", "wie", "wir", "wird", "zu", "zum", "zur",
    "au", "aux", "avec", "ce", "ces", "cette", "dans", "de", "du", "elle", "en", "est", "et", "il", "ils", "je", "la", "le", "les", "leur",
    "mais", "ne", "nous", "on", "ont", "ou", "par", "pas", "plus", "pour", "qu", "que", "qui", "sa", "se", "ses", "son", "sont", "sur", "un", "une", "vous",
    "al", "como", "con", "del", "el", "ella", "entre", "era", "esta", "este", "ha", "hay", "las", "lo", "los", "más", "muy", "o", "para",
    "pero", "por", "ser", "sin", "sobre", "su", "sus", "también", "una", "uno", "y", "ya",
])

MAX_LINK_SHARE = 0.5
SHORT_WORDS, LONG_WORDS = 12, 30
LOW_DENSITY, HIGH_DENSITY = 0.15, 0.3

#: Letters of a block that says something about its page, letters that a character of a script without spaces stands for, and the
#: share of listed stop words below which a page is taken to be in another language.
LONG_SIZE, WIDE, FOREIGN_DENSITY = 80, 3, 0.05

GOOD, BAD, OPEN = 1, -1, 0

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|$))", re.S | re.I)
#: Attributes of an anchor that only names a place.
_ANCHOR = re.compile(r"(?i)(?!.*\bhref\b)(?=.*\b(?:name|id)\s*=).*", re.S)
_PART = re.compile(r"[A-Za-z]+")
_WORDS = re.compile(r"\w+")
# Thai, Lao, Khmer, Burmese, Japanese and Chinese letters.
_WIDE_LETTERS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_CLOSERS: dict[str, re.Pattern] = {}


@dataclass
class Block:
    text: str
    words: int
    stop_words: int
    link_share: float
    heading: bool
    outside: bool
    inside: bool
    label: int = OPEN
    #: What decided the label: place, landmark, links, density, size or neighbours.
    rule: str = "neighbours"

    @property
    def size(self) -> int:
        """Letters of the text; one of a script without spaces counts as a short word of WIDE."""
        return len(self.text.replace(" ", "")) + (WIDE - 1) * len(_WIDE_LETTERS.findall(self.text))


def _marked(name: str, attributes: str, within_article: bool) -> tuple[bool, bool]:
    """Whether an element's attributes put it outside or inside an article."""
    out = within = False
    for key, *values in _NAMED.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "role":
            out |= value in OUTSIDE_ROLES
            within |= value in INSIDE_ROLES
        elif key == "hidden" or key == "aria-hidden":
            out |= value in ("", "true", "hidden")
        elif name not in ("body", "html"):
            parts = set(_PART.findall(value))
            out |= bool(parts & MARKS) and not parts & FRAMES and not (within_article and parts & MARKS <= HEADLINES)
    return out, within


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, with character references decoded and white space squeezed; empty ones are left out."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []
    out = within = 0
    pieces: list[str] = []
    links: list[str] = []
    anchors = 0
    heading = False

    def flush():
        nonlocal pieces, links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                words = _WORDS.findall(text.lower())
                linked = len("".join(html.unescape("".join(links)).split()))
                found.append(Block(
                    text, len(text.split()), sum(w in STOP_WORDS for w in words), linked / max(1, len(text.replace(" ", ""))),
                    heading, out > 0, within > 0,
                ))
            pieces, links = [], []

    def text(value):
        if value:
            pieces.append(value)
            if anchors:
                links.append(value)

    def close(count):
        nonlocal out, within, anchors
        for _name, was_out, was_in, was_link in (stack.pop() for _ in range(count)):
            out -= was_out
            within -= was_in
            anchors -= was_link

    at = 0
    while (tag := _TAG.search(page, at)) is not None:
        text(page[at : tag.start()])
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if tag[1]:
            depth = next((i for i, x in enumerate(reversed(stack)) if x[0] == name), None)
            if name in BLOCKS:
                flush()
                # An unclosed inline element does not keep a block open; a stray end of a block ends the text before it.
            if depth is not None and (name in BLOCKS or not any(x[0] in BLOCKS for x in stack[len(stack) - depth :])):
                close(depth + 1)
            heading = any(x[0] in HEADINGS for x in stack)
            continue
        if name in ("br", "img", "wbr") or name in VOID and name != "hr":
            text(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            flush()
            if name == "hr":
                continue
            # A paragraph, item, cell or option ends where the next block of its kind begins.
            if name in ("li", "option", "tr", "td", "th", "dt", "dd"):
                same = next((i for i, x in enumerate(reversed(stack)) if x[0] in ("ul", "ol", "table", "select", "dl", name)), None)
                if same is not None and stack[-1 - same][0] == name:
                    close(same + 1)
            open_p = next((i for i, x in enumerate(reversed(stack)) if x[0] in BLOCKS), None)
            if open_p is not None and stack[-1 - open_p][0] == "p":
                close(open_p + 1)
        if name in RAW:
            # What these hold is not text of the page.
            closer = _CLOSERS.setdefault(name, re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I))
            if tag[3].endswith("/"):
                continue
            end = closer.search(page, at)
            if end or name in ENDLESS:
                at = end.end() if end else len(page)
                continue
            flush()
        if tag[3].endswith("/") and name not in BLOCKS:
            continue
        out_here, in_here = _marked(name, tag[3], within > 0)
        # A header inside an article holds its headline.
        out_here |= name in OUTSIDE or name in RAW or name == "header" and not within
        in_here |= name in INSIDE and not out_here
        if name == "a" and stack and stack[-1][0] == "a":
            close(1)  # links do not nest
        link = name == "a" and not _ANCHOR.fullmatch(tag[3])
        stack.append((name, out_here, in_here, link))
        out += out_here
        within += in_here
        anchors += link
        heading = any(x[0] in HEADINGS for x in stack)
    text(page[at:])
    flush()
    return found


def _first_label(block: Block, landmark: bool, foreign: bool) -> tuple[int, str]:
    """Label and rule of a block. `landmark`: articles decide. `foreign`: stop words say nothing, size decides."""
    density = block.stop_words / max(1, block.words)
    if block.outside:
        return BAD, "place"
    if landmark and block.inside:
        return (GOOD, "landmark") if block.link_share <= MAX_LINK_SHARE or block.heading else (OPEN, "neighbours")
    if landmark:
        return BAD, "landmark"
    if block.link_share > MAX_LINK_SHARE:
        return BAD, "links"
    if foreign:
        return (GOOD, "size") if block.size >= LONG_SIZE and not block.heading else (OPEN, "neighbours")
    if block.words < SHORT_WORDS or block.heading:
        return OPEN, "neighbours"
    if density >= HIGH_DENSITY or density >= LOW_DENSITY and block.words >= LONG_WORDS:
        return GOOD, "density"
    return (OPEN, "neighbours") if density >= LOW_DENSITY else (BAD, "density")


def _kinds(blocks: list[Block]) -> tuple[bool, bool]:
    """Whether articles decide on the page, and whether its language is none of the listed ones.

    Articles decide if they hold at least half of the text of few links outside menus and the like.
    """
    text = [b for b in blocks if not b.outside and b.link_share <= MAX_LINK_SHARE]
    held, whole = sum(b.size for b in text if b.inside), sum(b.size for b in text)
    some = any(b.inside and not b.outside for b in blocks)
    long = [b for b in text if b.size >= LONG_SIZE]
    foreign = bool(long) and sum(b.stop_words for b in long) < FOREIGN_DENSITY * sum(max(b.words, b.size / 8) for b in long)
    return some and 2 * held >= whole, foreign


def labelled(page: str) -> list[Block]:
    """Blocks with their final labels, GOOD or BAD."""
    blocks = blocks_of(page)
    landmark, foreign = _kinds(blocks)
    for b in blocks:
        b.label, b.rule = _first_label(b, landmark, foreign)
    if not any(b.label == GOOD for b in blocks):
        # An article that is all links is still one.
        for b in blocks:
            b.label = GOOD if b.inside and b.label == OPEN else b.label
    first = [b.label for b in blocks]
    before, last = [], BAD
    for label in first:
        last = label or last
        before.append(last)
    after, following = [], BAD
    for label in reversed(first):
        following = label or following
        after.append(following)
    after.reverse()
    for i, b in enumerate(blocks):
        if first[i] == OPEN:
            # Between two that agree their label; else good beside running text with stop words, and a heading goes with what follows it.
            if before[i] == after[i]:
                b.label = before[i]
            elif b.heading:
                b.label = after[i]
            elif foreign:
                b.label = GOOD if 2 * b.size >= LONG_SIZE else BAD
            else:
                b.label = GOOD if b.stop_words / max(1, b.words) >= HIGH_DENSITY or b.words >= SHORT_WORDS else BAD
    return blocks


def main_text(page: str | None) -> str:
    """The good blocks of a page, joined by an empty line; empty if there are none."""
    return "\n\n".join(b.text for b in labelled(page or "") if b.label == GOOD)


def extract(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """`pages` with its html column replaced by the main text.

    Null or empty html, and pages without a good block: an empty text. Long pages are read whole, one at a time.
    Ids, urls and other columns pass through as they are, repeated rows too; a column already named like `into` is
    replaced. Empty table: no rows.
    """
    kept = [c for c in pages.columns if c not in (html_column, into)]
    page, made = unused("html", kept), unused("text", kept)

    def work(values: list[bytes | None]) -> dict[str, pa.Array]:
        return {made: pa.array([main_text((v or b"").decode("utf-8", "replace")) for v in values], pa.string())}

    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_column).cast("binary").alias(page))
    return map_texts(rows, page, f"{made} string", work).withColumnRenamed(made, into)
