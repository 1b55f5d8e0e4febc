"""Main-text extraction from HTML by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one decides blocks by link density, length and stop-word density:
linked blocks are out, unless they are long and full of stop words, and so are long blocks without stop words; blocks with
enough of them are in; short and middling ones stay open. Pass two gives each open block the label of its nearest decided
neighbour, the better one if two are as near. With no decided block at all everything stays.

What a page marks as something else (navigation, headers and footers of the page, sidebars, forms, notices, adverts,
comments of readers) is left out beforehand, and where the page marks an article, that is where blocks come from. The
rules hold inside it too, but as nothing else of an article may be lost, want of stop words leaves its blocks open there
instead of deciding against them, and links decide only against blocks without any stop word and against runs of three
or more short linked blocks with neither prose nor a heading beside them: a linked heading, a list of references under its
heading or after a paragraph, and a short paragraph with a link stay open. Inside an article only containers are left out
by a mark, and only if a name in their class or role is as a whole that of a foreign part (``related``, ``share-buttons``, not
``related-work``); headings, paragraphs and inline elements stay, and so does a section whose id merely names its subject.

The stop words are found, not listed: those of the page's language are the most frequent words of all pages with that
``lang`` attribute; pages without one are a group of their own, and so is a language of few pages. Null and empty pages,
and pages without text, give an empty text; an empty table gives no rows. Tags with an unbalanced quote end at the next
``>``. Very long pages are read in time linear in their length. Rows are independent, so repeated rows give repeated
results, and only the named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.textkit import small_batches

# Element names of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_DROPPED = frozenset("script style noscript template svg iframe object embed applet canvas audio video select option datalist textarea button head title nav aside footer form dialog menu".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"p"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?=[\s/>]|\Z)(?:(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|(?P<loose>[^>]*+)(?:>|\Z))", re.S
)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in _RAW}
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
#: Parts of class, id and role values that mark something other than the article.
_MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|menu\w*|nav\w*|breadcrumbs?|sidebar\w*|side|aside|footer|masthead|site-?header|page-?header|topbar|toolbar|cookies?|consent|gdpr|notices?|notification\w*|alert\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login|comments?|comment-\w+|commentlist|replies|reply|respond|disqus|discussion|share|sharing|social|related|recommend\w*|pagination|pager|copyright|legal|disclaimer|widget\w*|search|contentinfo|complementary|navigation)(?:$|[\s_-]|\d)", re.I)
#: Inside an article a name counts as a whole: a foreign part, with a word before or after it that says whose or what shape it is.
_PARTS = "ads?|advert(?:s|isement|isements)?|adsense|banners?|sponsor(?:ed|s)?|promos?|promotion|menus?|nav|navbar|navigation|breadcrumbs?|sidebars?|aside|footer|masthead|toolbar|topbar|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|comments?|commentlist|replies|respond|disqus|share|sharing|social|related|recommended|recommendations|pagination|pager|widgets?|contentinfo|complementary|search"
_WHOSE = "site|page|post|article|user|reader|main|cookie|share|sharing|social|email|ad|google|legal|reply|side|top|bottom|left|right"
_SHAPE = "box|banner|bar|list|section|block|container|wrapper|area|form|links?|buttons?|icons?|popup|signup|widget|notice|posts|articles|stories|slot|unit|menu|panel|message|thread|item|body|text|inner|content"
_FOREIGN = re.compile(rf"(?:^|\s)(?:(?:{_WHOSE})[-_])?(?:{_PARTS})(?:[-_](?:{_SHAPE}))*(?:[-_]?\d+)?(?=\s|$)", re.I)
#: What may stand in a page's head; anything else ends it.
_IN_HEAD = frozenset("title meta link base style script noscript template".split())
#: Inside an article, the ids that can't be the name of one of its own sections, and the elements whose marks count.
_FOREIGN_ID = re.compile(r"(?:comments|commentlist|disqus_thread|respond|sidebar|newsletter|breadcrumbs?|pagination|pager|ads?|adsense|advert\w*)$", re.I)
_CONTAINERS = frozenset("div section ul ol aside".split())
_WORD = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"\s+")

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text needs no stop words.
_WORDLESS = frozenset("pre table td th tr figcaption dt dd math address".split())
#: What ``learn_stop_words`` leaves out before it counts words.
_NO_TEXT = re.compile(r"<(script|style|textarea|title|noscript|iframe|template|svg)\b.*?(?:</\1\b[^>]*+(?:>|\Z)|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_ANY_TAG = re.compile(r"</?[A-Za-z!?][^>]*+(?:>|\Z)")


class Block:
    __slots__ = ("in_article", "link_chars", "tag", "text")

    def __init__(self, tag: str, in_article: bool):
        self.tag, self.in_article, self.text, self.link_chars = tag, in_article, "", 0


def _dropped(name: str, rest: str, inside_article: bool) -> bool:
    if name in _DROPPED or name == "header" and not inside_article:
        return True
    if not rest:
        return False
    own: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(rest):
        own.setdefault(key.lower(), "".join(values))
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(own.get("style", "")):
        return True
    if name in ("body", "html", "article", "main") or name in HEADINGS:
        return False
    if inside_article:
        return name in _CONTAINERS and (any(_FOREIGN.search(own.get(k, "")) for k in ("class", "role")) or bool(_FOREIGN_ID.match(own.get("id", ""))))
    return any(_MARKS.search(own.get(k, "")) for k in ("class", "id", "role", "aria-label"))


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without empty ones and without those inside left-out parts."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool]] = []
    parts: list[str] = []
    state = {"dropped": 0, "article": 0, "link": 0}
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            tag = next((n for n, _ in reversed(stack) if n in _BLOCK), "body")
            block = Block(tag, state["article"] > 0)
            block.text, block.link_chars = text, min(linked, len(text))
            blocks.append(block)
        linked = 0

    def leave() -> str:
        name, dropped = stack.pop()
        state["dropped"] -= dropped
        state["article"] -= name in ("article", "main")
        state["link"] -= name == "a"
        return name

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not state["dropped"]:
            parts.append(text)
            if state["link"]:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"] and not state["dropped"]:
                parts.append(html.escape(m["cdata"]))
            continue
        name = name.lower()
        if m["end"]:
            if name in _BLOCK:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            # An inline end tag closes nothing beyond the block it stands in.
            if depth is not None and (name in _BLOCK or not any(n in _BLOCK and n != "p" for n, _ in stack[depth + 1 :])):
                while len(stack) > depth:
                    leave()
            continue
        rest = m["rest"] or m["loose"] or ""
        if stack and stack[-1][0] == "head" and name not in _IN_HEAD:
            leave()
        if name in _RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        while len(stack) > i:
                            leave()
                        break
                    if stack[i][0] in _BLOCK:
                        break
            elif name in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                leave()
        if name == "br":
            parts.append(" ")
        if name in _VOID or rest.endswith("/"):
            continue
        dropped = _dropped(name, rest, state["article"] > 0)
        stack.append((name, dropped))
        state["dropped"] += dropped
        state["article"] += name in ("article", "main")
        state["link"] += name == "a"
    flush()
    return blocks


def classify(blocks: list[Block], stop_words: frozenset[str], short: int = 70, long: int = 200, low: float = 0.08, high: float = 0.20, max_links: float = 0.3, run: int = 3) -> list[bool]:
    """True for blocks of the main text. ``short`` and ``long`` are code points; ``low`` and ``high`` shares of stop words; ``run`` is the least number of linked blocks that links decide against inside an article."""
    labels: list[bool | None] = []
    menus = [i for i, b in enumerate(blocks) if b.in_article and len(b.text) < short and b.link_chars > max_links * len(b.text) and b.tag not in HEADINGS]
    for b in blocks:
        linked = b.link_chars > max_links * len(b.text)
        if len(b.text) < short or b.tag in HEADINGS and linked:
            labels.append(False if linked and not b.in_article and b.tag not in HEADINGS else None)
            continue
        words = _WORD.findall(b.text.lower())
        density = sum(w in stop_words for w in words) / len(words) if words else 0.0
        if linked:
            labels.append(True if density >= high and len(b.text) >= long else None if b.in_article and density > 0 else False)
        elif density >= high or density >= low and len(b.text) >= long:
            labels.append(True)
        elif density >= low or len(b.text) < long or b.in_article or b.tag in _WORDLESS:
            labels.append(None)
        else:
            labels.append(False)

    def holds(i: int) -> bool:
        """Whether a block is prose, or a heading, so that linked blocks beside it belong to the article."""
        if not 0 <= i < len(blocks):
            return False
        b = blocks[i]
        return labels[i] is True or b.tag in HEADINGS or len(b.text) >= long and b.link_chars <= max_links * len(b.text)

    first = 0
    for at, i in enumerate(menus):
        if at + 1 < len(menus) and menus[at + 1] == i + 1:
            continue
        own = menus[first : at + 1]
        first = at + 1
        if len(own) >= run and not holds(own[0] - 1) and not holds(own[-1] + 1):
            for j in own:
                labels[j] = False

    if True not in labels:
        # Nothing speaks for any block: an article keeps what nothing speaks against.
        labels = [True if x is None and b.in_article else x for x, b in zip(labels, blocks, strict=True)]

    def reach(order: range) -> list[tuple[float, bool]]:
        """For each block the distance and label of the last decided one in this order."""
        out, far, label = [(math.inf, True)] * len(labels), math.inf, True
        for i in order:
            far, label = (0, labels[i]) if labels[i] is not None else (far + 1, label)
            out[i] = far, label
        return out

    # Of neighbours as near as each other, one that is in decides.
    pairs = zip(reach(range(len(labels))), reach(range(len(labels) - 1, -1, -1)), strict=True)
    return [min(x, y, key=lambda z: (z[0], not z[1]))[1] for x, y in pairs]


def main_text(page: str | None, stop_words: dict[str, frozenset[str]]) -> str:
    if not page:
        return ""
    lang = _LANG.search(page)
    blocks = page_blocks(page)
    if any(b.in_article for b in blocks):
        blocks = [b for b in blocks if b.in_article]
    kept = classify(blocks, stop_words.get(lang[1].lower() if lang else "", stop_words.get("", frozenset())))
    return " ".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def learn_stop_words(pages: DataFrame, page: str = "html", size: int = 60) -> dict[str, frozenset[str]]:
    """The ``size`` most frequent words by ``lang`` attribute, counted over the visible text of all pages.

    A language is named by two or three letters, so there are at most 18,252 of them, and pages without a name under "".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in small_batches(batches):
            for value in batch.column(0).to_pylist():
                lang = _LANG.search(value or "")
                name = lang[1].lower() if lang else ""
                text = html.unescape(_ANY_TAG.sub(" ", _NO_TEXT.sub(" ", value or "")))
                seen.setdefault(name, Counter()).update(_WORD.findall(text.lower()))
            if sum(map(len, seen.values())) > 500_000:
                yield packed(seen)
                seen = {}
        yield packed(seen)

    def packed(seen: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    counts = pages.select(F.col(page)).mapInArrow(run, "lang string, word string, n long")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    ranked = counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    out: dict[str, set[str]] = {}
    for r in ranked.select("lang", "word").toLocalIterator():
        out.setdefault(r["lang"], set()).add(r["word"])
    return {k: frozenset(v) for k, v in out.items()}


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html", stop_words: dict[str, frozenset[str]] | None = None) -> DataFrame:
    """Per row: the ``keep`` columns, ``text`` (empty if there is none) and ``n_chars``, its code points."""
    frozen = pages.sparkSession.sparkContext.broadcast(stop_words if stop_words is not None else learn_stop_words(pages, page))
    rows = pages.select(*keep, F.col(page).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [main_text(x, frozen.value) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
