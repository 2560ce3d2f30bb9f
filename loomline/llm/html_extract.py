"""Main text of web pages by consensus of their host.

Each page's containers are scored by the text of all blocks in them, links counting against it and
boilerplate not at all; so a container with the heading, the lead and the sections beats any one of
them, and of containers with the same text the innermost is taken. An article or main element with
half of the best score goes first. A page votes for the path of its best container: tags and classes
from the root down, with digits generalised. The votes are counted per host in Spark, and every page
is extracted with the path of its own that most pages of its host voted for.

Tags and class names only suggest what is boilerplate. Where a marked element holds most of a page's text that
is neither link nor control nor comment, and what is outside of all marked ones is little, the mark is wrong and goes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

#: Tags whose content is no text of the page: of some all up to their end, or that of the page, of the others only if they end.
RAW, SILENT = "script|style|textarea|title", "noscript|template|svg|math|iframe|object|canvas|head"
#: Tags that begin and end blocks and are followed in the tree; all others are inline.
CONTAINERS = frozenset("html body div article section main td th center blockquote figure details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table thead tbody tfoot tr caption figcaption address summary hr nav header footer aside form fieldset menu dialog button select option label".split())
#: Tags that are boilerplate, and words of which a class, id or role that marks it is made up, with words that say nothing.
CONTROLS = frozenset("label button option select".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button select option label fieldset".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar aside header footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login"
    " comment comments discussion disqus replies respond share sharing social related recommended widget toolbar pagination pager search form".split()
)
#: Words for what readers write, which is no article however long it is.
READERS_WORDS = frozenset("comment comments discussion disqus replies respond".split())
NEUTRAL_WORDS = frozenset("site page main top bottom left right box bar list area section container wrapper wrap block inner slot button buttons posts articles links link item items n".split())
#: What an open tag of the key ends, up to the tags that keep it in.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(?:svg|math)(?=[\s/>])[^>]*/>|<({SILENT})(?=[\s/>])[^>]*>(?:.*?</\2\s*>)?|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"""|<([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<[a-zA-Z/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Share of the best score that an article or main element, or a path of the host, must have to go before the best container.
ENOUGH = 0.5
#: What a marked element must hold to lose its mark: a share of the page's prose, and characters of it. What may then be
#: outside of all marked ones. Tags that never lose it.
HELD, LEAST, OUTSIDE = 0.5, 100, 0.02
SURE = CONTROLS | frozenset("nav footer menu".split())


@dataclass(slots=True)
class Node:
    tag: str
    path: str
    parent: Node | None
    start: int
    marked: bool = False
    readers: bool = False
    end: int = -1
    score: int = 0

    def boilerplate(self) -> bool:
        node: Node | None = self
        while node is not None and not node.marked:
            node = node.parent
        return node is not None


@dataclass(slots=True)
class Page:
    """Blocks of text in page order, with the element that they stand in and the part of them that is no link, and the containers over them."""

    blocks: list[tuple[str, Node, int]] = field(default_factory=list)
    containers: list[Node] = field(default_factory=list)
    marked: list[Node] = field(default_factory=list)


def marks_boilerplate(name: str) -> bool:
    """Whether a whole class, id or role is made up of words for boilerplate."""
    words = {"n" if x.isdigit() else x.lower() for x in WORD.findall(name)}
    return not words.isdisjoint(BOILERPLATE_WORDS) and words <= BOILERPLATE_WORDS | NEUTRAL_WORDS


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """The element's step of a path, whether it is marked as boilerplate by itself, and whether readers wrote it.
    An article's own header is not marked."""
    step, bad, readers = tag, tag in BOILERPLATE_TAGS and not (tag == "header" and in_article), False
    for m in ATTRIBUTE.finditer(attributes or ""):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            step += "".join("." + re.sub(r"\d+", "N", x.lower()) for x in sorted(value.split()))
        if name in ("class", "id", "role"):
            if tag not in ("html", "body", "main", "article"):
                marks = [x for x in value.split() if marks_boilerplate(x)]
                bad |= bool(marks)
                readers |= any(w.lower() in READERS_WORDS for x in marks for w in WORD.findall(x))
        else:
            bad |= name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower()
    return step, bad, readers


def parse(source: str) -> Page:
    page, stack, text = Page(), [Node("", "", None, 0)], []
    page.containers.append(stack[0])
    linked, in_link = 0, False
    ends = {tag: [m.start() for m in re.finditer(rf"</{tag}[\s>]", source, re.I)] for tag in CONTROLS if f"<{tag}" in source.lower()}

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                page.blocks.append((block, stack[-1], len(block) - 2 * linked))
        linked = 0

    def close(depth: int) -> None:
        for node in stack[depth:]:
            node.end = len(page.blocks)
        del stack[depth:]

    at = 0
    for m in TOKEN.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
            linked += in_link * (m.start() - at)
        at = m.end()
        tag = (m[3] or m[4] or "").lower()
        if tag == "a":
            in_link = m[4] is not None
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            if m[3]:
                found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if found:
                    close(found)
                continue
            in_link = False
            if tag in CONTROLS and not (ends[tag] and ends[tag][-1] >= at):
                # never closed: it says nothing about what follows
                continue
            if stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                close(len(stack) - 1)
            if tag in ENDS:
                ended, within = ENDS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in within:
                        break
                    if stack[i].tag in ended.split():
                        close(i)
                        break
            if tag != "hr":
                step, bad, readers = _marks(tag, m[5], any(x.tag == "article" for x in stack))
                node = Node(tag, f"{stack[-1].path}/{step}" if tag in CONTAINERS else stack[-1].path, stack[-1], len(page.blocks), bad, readers)
                stack.append(node)
                if bad:
                    page.marked.append(node)
                if tag in CONTAINERS:
                    page.containers.append(node)
    if at < len(source):
        text.append(source[at:])
    flush()
    close(0)
    unmark(page)
    page.containers = [x for x in page.containers if not x.boilerplate()]
    for _, node, prose in page.blocks:
        if not node.boilerplate():
            while node is not None:
                node.score += prose
                node = node.parent
    return page


def unmark(page: Page) -> None:
    """Takes the mark from elements that hold most of a page's prose, where next to nothing is outside of all marked ones
    and no article or main element there has a text."""
    if not any(x.end > x.start for x in page.marked):
        return
    held: dict[int, int] = {}
    outside = whole = 0
    for _, node, prose in page.blocks:
        over: list[Node] = []
        named = False
        while node is not None:
            if node.marked:
                over.append(node)
            named |= node.tag in ("article", "main")
            node = node.parent
        if named and not over:
            return
        if prose <= 0 or any(x.readers or x.tag in SURE for x in over):
            continue
        whole += prose
        outside += prose * (not over)
        for x in over:
            held[id(x)] = held.get(id(x), 0) + prose
    for node in page.marked if outside < OUTSIDE * whole else []:
        if held.get(id(node), 0) >= max(LEAST, HELD * whole) and not node.readers and node.tag not in SURE:
            node.marked = False


def best_container(page: Page) -> Node:
    """The container with the best score, the innermost of equal ones; an article or main element that comes near goes first."""
    best = max(page.containers, key=lambda x: (x.score, x.start, len(x.path)))
    named = [x for x in page.containers if x.tag in ("article", "main") and x.score > 0 and x.score >= ENOUGH * best.score]
    return max(named, key=lambda x: (x.score, x.start, len(x.path)), default=best)


def best_path(page: Page) -> str | None:
    best = best_container(page)
    return best.path if best.score > 0 else None


def text_of(page: Page, chosen: Node) -> str:
    """What is no boilerplate in a container; of an article also in those beside it with the same path."""
    beside = [x for x in page.containers if x.parent is chosen.parent and x.path == chosen.path] if chosen.tag == "article" else [chosen]
    return " ".join(block for x in beside for block, node, _ in page.blocks[x.start : x.end] if not node.boilerplate())


def candidates(source: str) -> tuple[list[str], list[str], str, str | None]:
    """The paths of a page's containers that have enough of its text, in order, with the text of each; the text that is
    taken without votes, and the path that the page votes for. A page without a container that is more than links has no
    candidates, and all its text that is not boilerplate."""
    page = parse(source)
    best = best_container(page)
    if best.score <= 0:
        return [], [], text_of(page, page.containers[0]), None
    of: dict[str, Node] = {}
    for node in page.containers:
        if node.score >= ENOUGH * best.score and (node.path not in of or node.score > of[node.path].score):
            of[node.path] = node
    paths = sorted(of)
    return paths, [text_of(page, of[x]) for x in paths], text_of(page, best), best.path


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(found, r"^www\.", "")


READ = "url string, host string, paths array<string>, which array<int>, texts array<string>, own int, vote string"


def read_pages(pages: DataFrame) -> DataFrame:
    """Each page with its candidates: paths, which of texts (told apart) each has, the text that is taken without votes, and its vote."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for source in batch.column(3):
                paths, texts, own, vote = candidates(source.as_py() or "")
                distinct = list(dict.fromkeys([own, *texts]))
                found.append((paths, [distinct.index(x) for x in texts], distinct, 0, vote))
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.string())
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=["page_id", "url", "host", "paths", "which", "texts", "own", "vote"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(work, f"page_id {pages.schema['page_id'].dataType.simpleString()}, {READ}")


def host_paths(read: DataFrame) -> DataFrame:
    """(host, paths, winner): for each list of candidate paths on a host the one with the most votes there, two at least;
    ties go to the first. Votes and lists are summed in the tasks before they are dealt out, and a list has as many paths
    as a page has containers, however many templates its host has."""
    votes = read.where("vote is not null").groupBy("host", F.col("vote").alias("path")).agg(F.count(F.lit(1)).alias("votes")).where("votes > 1")
    lists = read.where("vote is not null").select("host", "paths").distinct()
    met = lists.select("host", "paths", F.posexplode("paths").alias("place", "path")).join(votes, ["host", "path"])
    return met.groupBy("host", "paths").agg(F.max_by("path", F.struct("votes", -F.col("place"))).alias("winner"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host for each row of pages (page_id, url, html).

    A null or empty html, or one without text, has an empty text. Pages without a url are one host.
    Rows are not told apart by page_id: nulls and repeated rows stay, and each votes. Pages of any
    length are read as a whole. Other columns are not read; an empty table gives an empty result.
    """
    with storage.Scratch(pages.sparkSession, "pages") as scratch:
        # each page is parsed once
        read = scratch.write(read_pages(pages), "read", compression="zstd")
        # written first: Spark then knows its size, and broadcasts it or splits the pages of a hot host
        winners = scratch.write(host_paths(read), "winners")
        place = F.array_position("paths", F.col("winner")).cast("int")
        which = F.coalesce(F.try_element_at("which", F.when(place > 0, place)), "own")
        found = read.join(winners, ["host", "paths"], "left").withColumn("text", F.element_at("texts", which + 1))
        return scratch.keep(found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host"), "extracted", compression="zstd")
