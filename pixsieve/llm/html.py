"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one classifies each block on its own by length, link density and
stop-word density (the stop words are the most frequent words of the page's language, learned from all pages): good, bad,
or short and undecided. Length counts words, and characters in scripts without spaces; where a language has no stop words
to tell, length and links decide. Pass two lets undecided blocks inherit the label of the nearest decided neighbour in their
container; headings look ahead first. Containers that never hold main text (navigation, footers, forms, blocks whose class
or id says nothing but advert, menu, comments and the like) decide their blocks at once, an article or main element leans to
good. A class that names such a part among other things (legal-guide, share-price) is a hint: it takes that leaning away.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixsieve.llm.common import stored, table, whole_text

# Fixed values of the HTML standard: elements that hold no text, elements that end a block, elements without an end tag.
SILENT = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "select", "option", "canvas", "audio", "video", "noembed", "noframes", "xmp"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose text is never main text.
OUTSIDE = {"nav", "footer", "aside", "form", "menu", "head", "button", "dialog", "fieldset", "search"}
#: Words of a class, id or role that mark an element as not part of the article.
MARKED = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr "
    "notice notices alert alerts disclaimer legal copyright menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toc footer header masthead "
    "topbar sidebar side rail aside widget widgets related recommended recommendations share sharing social subscribe subscription newsletter signup login search "
    "comment comments comms disqus reply replies respond discussion reviews complementary contentinfo toolbar skip tags taboola outbrain paywall".split()
)
#: Words that beside a marked one leave its meaning as it is: places, sizes, parts of a layout, who wrote it.
NEUTRAL = set(
    "box block section container wrapper wrap inner outer area body content list item items entry row col column grid panel pane card unit slot group zone module "
    "main left right top bottom center middle page site global primary secondary small large big wide full fixed sticky mobile desktop text title link links btn button "
    "icon icons image img user users reader readers visitor post posts article articles news story stories thread count form bar tab tabs trail strip region div span "
    "ul li a p n s x new old all more first last default custom dark light js theme".split()
)
#: First words of names that tell about neighbours.
BESIDE = {"has", "with", "no", "without", "js", "not"}
#: Words that beside "header" still name the page's own.
PAGE_HEAD = {"header", "site", "page", "main", "top", "global", "container", "wrapper", ""}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Words in a block from which it can decide by itself; densities that make it main text or boilerplate.
SHORT_WORDS = 10
LINK_DENSITY = 0.5
STOP_HIGH, STOP_LOW = 0.25, 0.05
#: A declared language: two or three letters, so that there are no more of them than such codes.
LANGUAGE = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", re.I)
#: Characters of scripts that are written without spaces (Thai, Lao, Burmese, Khmer, kana, Han); two count as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


class Block:
    __slots__ = ("parts", "linked", "outside", "inside", "heading", "hinted", "label", "container")

    def __init__(self, outside: bool, inside: bool, heading: bool, hinted: bool, container: int):
        self.parts, self.linked, self.outside, self.inside, self.heading, self.hinted = [], 0, outside, inside, heading, hinted
        self.label, self.container = None, container


def marks(attributes: str, inside: bool) -> bool | None:
    """True if class, id or role name nothing but a part that is not the article, or the element is hidden; None if they name
    one among other words.

    A name like has-sidebar says what stands beside the element; a header inside an article is the article's own.
    """
    hint = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            if HIDDEN.search(value):
                return True
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value.lower() == "true":
                return True
        else:
            names = (re.split(r"[^a-z]+", x) for x in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split())
            for x in names:
                own = MARKED.intersection(x) - ({"header"} if inside or not PAGE_HEAD.issuperset(x) else set())
                if own and x[0] not in BESIDE and "with" not in x:
                    if all(w in MARKED or w in NEUTRAL or not w for w in x):
                        return True
                    hint = True
    return None if hint else False


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with their text parts, in page order. Broken and cut-off markup closes what it leaves open."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, outside, inside an article, hinted, container
    outside = inside = heading = hinted = False
    container = links = 0
    current: Block | None = None
    at, containers = 0, 0

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            if not piece.strip():
                return
            current = Block(outside, inside, heading, hinted, container)
            out.append(current)
        current.parts.append(piece)
        if links:
            current.linked += sum(map(len, piece.split()))

    while True:
        m = TOKEN.search(page, at)
        text(html.unescape(page[at : m.start() if m else len(page)]))
        if m is None:
            return out
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SILENT and not closing:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            current = None
            links = 0 if not closing else links
        elif tag == "br" and current is not None:
            current.parts.append(" ")
        if tag in VOID:
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in HEADING:
            heading = not closing
        if closing:
            if any(x[0] == tag for x in stack):
                while stack:
                    name, outside, inside, hinted, container = stack.pop()
                    if name == tag:
                        break
        elif tag in OUTSIDE or tag in ("article", "main", "header", "section", "div", "ul", "ol", "table", "tr", "td", "body", "span", "p", "li", "dl", "blockquote", "figure", "details", "b", "strong", "i", "em"):
            if tag in ("p", "li") and stack and stack[-1][0] == tag:  # an open one ends by itself
                _, outside, inside, hinted, container = stack.pop()
            stack.append((tag, outside, inside, hinted, container))
            if tag in ("article", "main") and not outside:
                inside = True
            marked = marks(attributes, inside) if attributes and tag not in ("body", "article", "main") else False
            if tag in OUTSIDE or (tag == "header" and not inside) or marked:
                if not outside:
                    current = None
                outside = True
            elif marked is None:
                current, hinted = None, True
            if tag in ("article", "main", "section", "div", "aside", "td"):
                containers += 1
                container = containers


def classify(block: Block, words: list[str], stops: frozenset[str]) -> bool | None:
    """Pass one: True good, False bad, None undecided.

    stops are the language's; without any, or in scripts without spaces, length and links decide.
    """
    if block.outside:
        return False
    length = sum(map(len, words))
    if block.linked > LINK_DENSITY * max(1, length):
        return False
    unspaced = sum(len(UNSPACED.findall(w)) for w in words if not w.isascii())
    if max(len(words), unspaced / 2) < SHORT_WORDS:
        return None
    if not stops or unspaced > length / 2:
        return None if block.hinted and not block.inside else True
    density = sum(w.strip(".,;:!?\"'()").lower() in stops for w in words) / len(words)
    leaning = block.inside and not block.hinted
    if density >= STOP_HIGH:
        return True
    if density < STOP_LOW and not leaning:
        return False
    return True if leaning else None


def settle(blocks: list[Block]) -> None:
    """Pass two: undecided blocks take the label of the nearest decided neighbour in their own part of the page.

    Blocks outside the article by their container don't count as neighbours of blocks inside one. Of two equally near
    neighbours the following one decides for headings, a good one for others. Without any neighbour an article element
    makes a block good, and bad stands elsewhere.
    """
    first = [b.label for b in blocks]
    left: list[int | None] = []
    right: list[int | None] = [None] * len(blocks)

    def passes(neighbour: Block, block: Block) -> bool:
        return not neighbour.outside and neighbour.inside == block.inside

    last: dict[bool, int] = {}
    for k, b in enumerate(blocks):
        left.append(last.get(b.inside))
        if first[k] is not None and passes(b, b):
            last[b.inside] = k
    last = {}
    for k in range(len(blocks) - 1, -1, -1):
        right[k] = last.get(blocks[k].inside)
        if first[k] is not None and passes(blocks[k], blocks[k]):
            last[blocks[k].inside] = k
    for k, b in enumerate(blocks):
        if b.label is not None:
            continue
        a, c = left[k], right[k]
        if a is None and c is None:
            b.label = b.inside
        elif a is None or (c is not None and (b.heading or c - k < k - a)):
            b.label = first[c]
        elif c is None or k - a < c - k:
            b.label = first[a]
        else:
            b.label = first[a] or first[c]


def main_text(page: str, stops: frozenset[str]) -> str:
    """The article of one page: good blocks, white space as one space, joined by line ends."""
    blocks, texts = [], []
    for b in blocks_of(page):
        words = "".join(b.parts).split()
        if words:
            b.label = classify(b, words, stops)
            blocks.append(b)
            texts.append(" ".join(words))
    settle(blocks)
    return "\n".join(t for b, t in zip(blocks, texts, strict=True) if b.label)


def language(page: str) -> str:
    """The language that the page declares, empty without."""
    m = LANGUAGE.search(page)
    return m[1].lower() if m else ""


def stop_words(pages: DataFrame, html_col: str = "html", share: float = 0.004, held_words: int = 200_000) -> dict[str, frozenset[str]]:
    """Per declared language the words that surely make up `share` of all its words: at most 1 / share of them.

    Surely: by three standard deviations and three words more than the share asks for, so that in a language of few words no
    word passes by chance, and in one of many the share alone decides. Counts are exact: a task that holds many words
    sends them on and begins anew.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        found: Counter = Counter()

        def sent() -> pa.RecordBatch:
            keys = list(found)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

        for batch in batches:
            for page in batch.column(0).to_pylist():
                lang = language(page)
                words = re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", page).lower())
                for w, n in Counter(words).items():
                    found[lang, w] += n
                found[lang, None] += len(words)
                if len(found) > held_words:
                    yield sent()
        yield sent()

    counts = pages.select(whole_text(html_col)).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "page-words")
    totals = counts.where("word IS NULL").select(F.col("lang").alias("l"), F.col("n").alias("total"))
    least = share * F.col("total") + 3 * F.sqrt(share * F.col("total")) + 3
    often = counts.where("word IS NOT NULL").join(totals, F.col("lang") == F.col("l")).where(F.col("n") >= least)
    # at most 1 / share words a language, and no more languages than codes of three letters
    found: dict[str, set[str]] = {}
    for lang, word in often.select("lang", "word").collect():
        found.setdefault(lang, set()).add(word)
    return {k: frozenset(v) for k, v in found.items()}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (the article, empty if none), n_chars.

    A null page counts as empty, null ids and urls pass through, repeated rows stay, an empty table gives no rows, other
    columns are not read. A page without a declared language is judged by the stop words of all languages, one in a language
    without learned stop words by length and links.
    """
    stops = stop_words(pages, html_col)
    stops = {**stops, "": frozenset().union(*stops.values())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, stops.get(language(p), frozenset())) if p else "" for p in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), whole_text(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}
