"""Main text of web pages: what stands for menus, adverts and the like goes by role, and what recurs on a host by count."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.exprs import let
from memlake.llm.base import narrow, no_items
from memlake.operators.skew import broadcast_if_small
from memlake.session import cut_lineage

#: A subtree is template if at least this many different pages of its host hold it, and this share of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.05

# Fixed values of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset(
    "body br caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
#: A start tag of the first ends an open element of the second, up to the third.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Single entries may well be equal on many pages; the list or table around them is counted as a whole.
ENTRIES = frozenset("li dt dd tr td th thead tbody tfoot caption figcaption option optgroup legend summary br hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never template inside an article.
PROSE = HEADINGS | {"p", "blockquote", "pre"}

# Fixed values of the roles that don't belong to an article.
OUT_TAGS = frozenset("head nav footer aside form menu dialog search button select fieldset input "
                     "audio video canvas map datalist output progress meter".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                      "toolbar tooltip status".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners promo promos promotion "
    "sponsor sponsored sponsors sidebar sidebars widget widgets cookie cookies consent gdpr notice notices "
    "notification newsletter subscribe subscription signup signin login register popup modal overlay toast "
    "comment comments commentlist respond disqus discussion reply replies reactions related recommended "
    "recommendations teaser teasers share sharing social breadcrumb breadcrumbs nav navbar navigation menu menus "
    "topbar pagination pager footer masthead toolbar paywall hidden copyright disclaimer rating ratings reviews "
    "tagcloud".split()
)
#: Names of a place or a shape: a role may stand in front of them ("sidebar-left").
PLACES = frozenset(
    "left right top bottom main inner outer first last primary secondary bar box area wrap wrapper container content "
    "section block list item items slot unit button buttons links link form panel row column col title header footer "
    "widget widgets area zone holder".split()
)
#: Names with one of these tell a state of the element, not its role.
STATES = frozenset("open closed has no with without enabled disabled off on single".split())
#: ``header`` goes unless it is the article's own.
OWN_HEADER = frozenset("article entry post content story title".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|noframes|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _role(parts: list[str]) -> bool:
    """Whether a name of several parts is a role: by its last part, or by its first one before places and numbers."""
    return parts[-1] in OUT_NAMES or parts[0] in OUT_NAMES and all(p in PLACES or p.isdigit() for p in parts[1:])


def _out(tag: str, attrs: str) -> str:
    """Why an element is no part of an article: ``sure`` by its tag or role, by a whole ``name``, by a ``part`` of one."""
    if tag in OUT_TAGS:
        return "sure"
    found, parts_seen, own = "", set(), False
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if attrs[m.start() - 1 : m.start()] not in ("", " ", "\t", "\n", "\r", "\f", "/", '"', "'"):
                continue
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return "sure"
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "sure"
            if name == "role" and value.lower() in OUT_ROLES:
                return "sure"
            if name in ("class", "id"):
                for one in value.split():
                    parts = [p for p in _SPLIT.split(_CAMEL.sub("-", one).lower()) if p]
                    parts_seen.update(parts)
                    own |= bool(parts) and parts[-1] == "header"
                    if len(parts) == 1 and parts[0] in OUT_NAMES:
                        found = "name"
                    # An article may say that it has comments; only a name that says no more makes it one.
                    elif len(parts) > 1 and tag != "article" and not STATES & set(parts) and _role(parts):
                        found = found or "part"
    if tag in ("html", "body", "main"):
        return ""
    if tag == "header" or own:
        return "" if parts_seen & OWN_HEADER else "sure" if tag == "header" else "part"
    return found


class _Element:
    """An open or closed element. ``first`` and ``end``: the blocks inside it; ``said``: characters it holds, those
    that a name takes out among them; ``size``: characters of its blocks."""

    __slots__ = ("tag", "out", "sure", "why", "parent", "parts", "hash", "said", "size", "first", "end", "article", "main")

    def __init__(self, tag: str, parent: _Element | None, why: str, first: int) -> None:
        self.tag, self.parent, self.why, self.first, self.end = tag, parent, why, first, first
        self.parts, self.hash, self.said, self.size = [], 0, 0, 0
        self.out = bool(why) or parent is not None and parent.out
        self.sure = why == "sure" or parent is not None and parent.sure
        self.article = tag == "article" or parent is not None and parent.article
        self.main = tag == "main" or parent is not None and parent.main


def _read(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, _Element]], list[_Element]]:
    """Blocks of text with the element they stand in, and all elements in order, the first of which is the page.

    Elements whose number is ``spared`` are not taken out for their names. Every character and every element is looked
    at a bounded number of times, however deep they are nested.
    """
    root = _Element("", None, "", 0)
    stack, elements, opened = [root], [root], Counter()
    blocks: list[tuple[str, _Element]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                blocks.append((words, stack[-1]))
                stack[-1].size += len(words)

    def close() -> None:
        element = stack.pop()
        opened[element.tag] -= 1
        digest = hashlib.blake2b(f"{element.tag}\0{chr(1).join(element.parts)}".encode("utf-8", "replace"), digest_size=8)
        element.hash = int.from_bytes(digest.digest(), "big", signed=True)
        element.parts, element.end = [], len(blocks)
        parent = stack[-1]
        parent.parts.append(digest.hexdigest())
        parent.said += element.said
        parent.size += element.size

    def close_to(tags, limits=()) -> None:
        """Close the nearest open element of ``tags``, unless one of ``limits`` lies before it."""
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    close()
                return
            if stack[k].tag in limits:
                return

    def say(some: str) -> None:
        if some and not some.isspace():
            stack[-1].parts.append(some.strip())
            if not stack[-1].sure:
                stack[-1].said += len(some.strip())
        if some and not stack[-1].out:
            text.append(some)

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if block:
            flush()
        if m["end"]:
            if tag not in VOID:
                close_to((tag,), () if block else BLOCKS)
            continue
        if tag in ENDS_P:
            close_to(("p",), ("table", "td", "th", "button", "caption", "object", "article", "section", "div"))
        if tag in SIBLINGS:
            close_to(*SIBLINGS[tag])
        if tag not in VOID:
            why = _out(tag, m["attrs"])
            if why != "sure" and len(elements) in spared:
                why = ""
            # Text that is still open began before this element.
            element = _Element(tag, stack[-1], why, len(blocks) + bool(text))
            elements.append(element)
            stack.append(element)
            opened[tag] += 1
    say(page[at:])
    flush()
    while len(stack) > 1:
        close()
    root.end = len(blocks)
    return blocks, elements


def parse(page: str | None) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Blocks of a page's article in order, and its subtrees: hash, first block and the block after the last.

    A block is text between block tags or line breaks. What is out by tag or role goes, and so does what is out by a
    name, but no part of a name takes out half of the page's text, and no names at all take out all of it. If article
    elements, or else a main element, hold half of the text that is left or more, only their blocks come back, with the
    headings and paragraphs of the main element that lead into the article. Subtrees are hashed over tags and text
    from the leaves up. Single entries of lists and tables, inside an article its paragraphs and headings too, and
    whatever holds half of the text are no subtrees that could be template.
    """
    page = page or ""
    blocks, elements = _read(page, frozenset())
    if any(e.why == "part" and 2 * e.said >= elements[0].said > 0 for e in elements):
        large = frozenset(i for i, e in enumerate(elements) if e.why == "part" and 2 * e.said >= elements[0].said)
        blocks, elements = _read(page, large)
    if not blocks and elements[0].said:
        blocks, elements = _read(page, frozenset(range(len(elements))))
    total = sum(len(words) for words, _ in blocks)
    chosen = ""
    for container in ("article", "main"):
        if 2 * sum(len(words) for words, e in blocks if getattr(e, container)) >= total > 0:
            chosen = container
            break
    if chosen:
        kept = [getattr(e, chosen) for _, e in blocks]
        if chosen == "article":
            for i in range(kept.index(True)):
                e = blocks[i][1]
                kept[i] = e.main and (e.tag in HEADINGS or e.tag == "p")
    else:
        kept = [True] * len(blocks)
    place = [0, *accumulate(map(int, kept))]
    half = sum(len(words) for (words, _), k in zip(blocks, kept) if k) / 2
    marks = []
    for e in elements[1:]:
        inside = not chosen or getattr(e.parent, chosen)
        counted = (e.tag in BLOCKS and e.tag not in ENTRIES or "-" in e.tag) and not (chosen and e.tag in PROSE)
        if inside and counted and not e.out and e.size < half and place[min(e.first, e.end)] < place[e.end]:
            marks.append((e.hash, place[e.first], place[e.end]))
    return [words for (words, _), k in zip(blocks, kept) if k], marks


_PARSED = "page_id {kind}, url string, blocks array<string>, marks array<struct<hash:long,first:int,end:int>>"
_MARKS = pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))


def _parsed(batches):
    for batch in batches:
        found = [parse(page) for page in batch.column("html").to_pylist()]
        marks = [[{"hash": h, "first": a, "end": b} for h, a, b in m] for _, m in found]
        columns = [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.list_(pa.string())), pa.array(marks, _MARKS)]
        yield pa.record_batch(columns, names=["page_id", "url", "blocks", "marks"])


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
              least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """The article of every page: page_id, url and text, one row per input row.

    Elements that are no part of an article by tag, role or name are left out while parsing. The subtrees that
    remain are hashed and counted per host; those on ``least_pages`` different pages and ``least_share`` of the
    host's different pages or more are template and deleted. Copies of a page count once, so that nothing goes because
    a page was copied. Counts are combined before the shuffle, so a host of any size is counted by many tasks; the
    template list of a host has a few entries at most for each page's subtree.

    Character references are decoded, white space in a block becomes one blank, blocks are joined by one.
    Null and empty pages: empty text. A null url belongs to no host, so only roles apply. Ids and repeated
    rows don't matter; empty tables give no rows; other columns are ignored.
    """
    rows = narrow(pages, page_id=id, url=url, html=html)
    kind = rows.schema["page_id"].dataType.simpleString()
    parsed = cut_lineage(rows.mapInArrow(_parsed, _PARSED.format(kind=kind)))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    hosted = parsed.withColumn("host", F.when(host != "", host))
    hashes = F.array_distinct(F.transform("marks", lambda m: m["hash"]))
    known = hosted.where(F.col("host").isNotNull()).select("host", hashes.alias("hashes"), F.xxhash64("blocks").alias("page"))
    different = known.dropDuplicates(["host", "page"])
    # A mark of null counts the pages of the host.
    counted = different.select("host", F.explode(F.array_append("hashes", F.lit(None).cast("long"))).alias("mark"))
    counts = cut_lineage(counted.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("mark").isNull() | (F.col("n") >= least_pages)))
    size = counts.where(F.col("mark").isNull()).select("host", F.col("n").alias("pages"))
    template = (
        counts.where(F.col("mark").isNotNull()).join(size, "host")
        .where(F.col("n") >= F.col("pages") * F.lit(least_share))
        .groupBy("host").agg(F.collect_list("mark").alias("template"))
    )
    joined = hosted.join(broadcast_if_small(cut_lineage(template)), "host", "left")
    template = F.coalesce(F.col("template"), no_items("bigint"))
    gone = F.filter("marks", lambda m: F.array_contains(template, m["hash"]))
    kept = let(gone, lambda ranges: F.filter(
        "blocks", lambda _, i: ~F.exists(ranges, lambda m: (m["first"] <= i) & (i < m["end"]))))
    text = F.when(F.col("template").isNull(), F.array_join("blocks", " ")).otherwise(F.array_join(kept, " "))
    return joined.select("page_id", "url", text.alias("text"))
