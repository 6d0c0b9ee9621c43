"""Main text of web pages: two passes of rules over blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import column, small_batches

# Frequent words of the languages that pages are expected in.
STOP_WORDS = {
    "en": "the of and to a in is it that for on are as with was be by this at or from an not have but they which you all were when there can has more if will one about would so what their who",
    "fr": "le la les de des du un une et est en que qui dans pour par sur pas au aux avec ce il elle ne se plus son sa ses ou mais nous vous ils cette être avoir sont leur été comme",
    "de": "der die das und in zu den ist von mit sich des auf für nicht ein eine dem es im als auch an wie nach bei aus um am sind noch war nur einer einen oder wird hat aber wenn",
    "es": "el la los las de del y en que a un una es por con no se para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay",
}
STOPS = [frozenset(words.split()) for words in STOP_WORDS.values()]

# Thresholds of the first pass, in characters and shares.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.30, 0.32
MOST_LINKS = 0.2

BLOCK_TAGS = frozenset(
    "address article blockquote body caption center col colgroup dd details dialog div dl dt fieldset figcaption figure "
    "h1 h2 h3 h4 h5 h6 hr html legend li main ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements whose content is no text at all, and elements that hold no part of an article.
RAW_TAGS = frozenset(["script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"])
ASIDE_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "template", "svg", "object", "head"])
ASIDE_NAMES = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disqus|"
    r"footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|related|reply|replies|respond|search|"
    r"share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])"
)
ROLES = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "toolbar"])
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|</[^>]*+(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    within: bool  # inside an article or main element
    label: str = ""


def beside(tag: str, attributes: str, within: bool) -> bool:
    """Whether an element stands beside the article by its tag or its names."""
    if tag in ASIDE_TAGS:
        return not (tag == "header" and within)
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if (name == "role" and value.lower() in ROLES) or (name in ("class", "id") and ASIDE_NAMES.search(value)):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, without what markup alone shows to be no article."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    within = links = 0
    dropped, depth = "", 0  # the element being left out, and how deep it is nested in itself
    at = 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            inside = len(" ".join(html.unescape(" ".join(linked)).split()))
            blocks.append(Block(text, inside, within > 0))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        if text and not dropped:
            parts.append(text)
            if links:
                linked.append(text)

    while (m := MARKUP.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        end, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not end and tag in RAW_TAGS:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = stop.start() if stop else len(page)
            continue
        if dropped:
            if tag == dropped:
                depth += -1 if end else 1
            # An article ends what was left unclosed before it.
            if depth == 0 or (tag in ("article", "main", "body") and not end and not within):
                dropped, depth = "", 0
            if dropped or end:
                continue
        if not end and tag not in VOID_TAGS and not attributes.rstrip().endswith("/") and beside(tag, attributes, within > 0):
            close()
            dropped, depth = tag, 1
            continue
        if tag == "a":
            links = 0 if end else 1
        elif tag == "br":
            add(" ")
        elif tag in BLOCK_TAGS:
            close()
            links = 0
            if tag in ("article", "main"):
                within = max(0, within + (-1 if end else 1))
    # A tag that the end of the page cuts off is no text.
    add(page[at:])
    close()
    return blocks


def stop_share(text: str) -> float:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return max(sum(w in stops for w in words) for stops in STOPS) / len(words) if words else 0.0


def first_label(block: Block, known: bool = True) -> str:
    """good, near (probably good), short (open) or bad, from the block alone. On a page in
    an unknown language, where stop words tell nothing, length and links decide."""
    size = len(block.text)
    if block.linked > MOST_LINKS * size:
        return "bad"
    if "©" in block.text and not block.within:
        return "bad"
    if size < SHORT:
        return "bad" if block.linked and not block.within else "short"
    share = stop_share(block.text) if known else STOPS_HIGH
    if share >= STOPS_HIGH:
        return "good" if size > LONG else "near"
    if share >= STOPS_LOW:
        return "near"
    # Inside an article, tables and odd prose are left to their neighbours.
    return "short" if block.within else "bad"


def settle(blocks: list[Block]) -> None:
    """Second pass: open blocks take the label of the nearest decided block.

    Near-good blocks count as decided. Between two blocks at the same distance, and
    where nothing is decided, blocks of an article are kept and others are not; a
    heading or line at the edge of the article thus stays with it. Distances are
    counted inside the article and outside of it separately.
    """
    # The language is known if any longer block has some share of stop words.
    known = any(len(b.text) >= SHORT and stop_share(b.text) >= STOPS_LOW for b in blocks)
    for within in (True, False):
        group = [b for b in blocks if b.within == within]
        decided: list[tuple[int, str]] = []
        for i, b in enumerate(group):
            label = first_label(b, known)
            b.label = "good" if label == "near" else label
        before: list[tuple[int, str] | None] = []
        last = None
        for i, b in enumerate(group):
            before.append(last)
            if b.label != "short":
                last = (i, b.label)
        following = None
        for i in range(len(group) - 1, -1, -1):
            b = group[i]
            if b.label != "short":
                following = (i, b.label)
                continue
            decided = [x for x in (before[i], following) if x]
            nearest = min((abs(x[0] - i) for x in decided), default=0)
            labels = {x[1] for x in decided if abs(x[0] - i) == nearest}
            if len(labels) == 1:
                b.label = f"open {labels.pop()}"
            else:
                b.label = "open good" if within else "open bad"


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    settle(blocks)
    return "\n\n".join(b.text for b in blocks if b.label.endswith("good"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: ``id, url, text, n_chars``.

    A null or empty page has the text ''. Character references are decoded, white space
    inside a block is one space, blocks are joined by an empty line. Truncated and badly
    nested markup is read as far as it goes. Null keys and urls and repeated rows are
    kept; other columns are ignored. Each page is read by itself, in time that follows
    its length.
    """
    df = pages.select(
        column(key).cast("long").alias("id"), column(url).cast("string").alias("url"), column(page).cast("string").alias("html")
    )
    found = df.mapInArrow(_extract, "id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
