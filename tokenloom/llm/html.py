"""Operator 1: main text of web pages by consensus host paths.

1. Each page's containers (body, main, article, section, div, td, ...) are
   scored by the running text below them; nested text counts less per level
   and link text counts against it.  The best container's generalised path
   (tags with digit-free classes) is the page's vote.
2. Spark sums the votes per (host, path), combined map-side, so a host with a
   third of all pages adds a few rows per task, and the path with most votes
   wins its host.
3. Every page is read again and all containers on its host's winning path are
   extracted.  A page without that path falls back to its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are left out inside a container too, by element, ARIA role
and class or id words.  Such a word is evidence only: it doesn't count beside a
word of state (``has-sidebar``, ``comments-open``), and an element that holds
more running text than the page has elsewhere, with its heading or with next to
nothing outside, is content whatever its class.

A page is read once from left to right, scores run from inner to outer
containers, and paths are kept as hash chains, so the work is linear also on
unclosed tags, open quotes and deep nesting.

Defined results: null html or html without text gives an empty text; a null
URL or one without host votes in the host ``''``; unclosed and stray tags
follow the usual recovery (paragraphs close each other, unknown end tags are
ignored, an unclosed comment or script runs to the end, ``<`` without a later
``>`` is text; where quotes never close, tags end at the next ``>`` from there
on).  Very long pages are read whole.  Ties between paths go to more text, then to
the smaller path.  Repeated rows are extracted each, extra columns are not looked
at, an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise, text_slices

# HTML element classes.
RAW = frozenset("script style noscript template textarea iframe title svg math object select".split())
SKIP_TAGS = frozenset("head nav footer aside form button dialog menu audio video canvas fieldset label legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body main article section div td th center".split())
BLOCKS = frozenset(
    "address blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main article section ol p pre summary table tbody td tfoot th thead tr ul "
    "nav footer aside form dialog menu head".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu".split())
# Class or id words that mark page furniture.
SKIP_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notification alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer "
    "comment comments commentlist replies reply respond discussion disqus related recommended recommendations "
    "share sharing social newsletter subscribe subscription signup popup modal overlay widget toolbar pagination "
    "pager login search copyright".split())
# Words beside which a furniture word tells a state, or names a piece of running text.
STATE_WORDS = frozenset(
    "has have no not with without open opened closed enabled disabled allow allowed term terms".split())
COMMENT_WORDS = frozenset("comment comments commentlist replies reply respond discussion disqus".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
BODY_WORDS = frozenset("article content entry post story text body main".split())
TAG_WEIGHT = {"article": 2.0, "main": 1.5, "section": 1.1, "body": 0.8}
DECAY = 0.7          # per container level between a text and the scored container

RUNNING = 60         # characters outside links that make a block running text

OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)|[!?/])")
QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = re.compile(r"class|id|role|hidden|style", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An open or closed container: its step and parent, the hash of its path, its score."""

    __slots__ = ("parent", "step", "key", "tag", "score", "length")

    def __init__(self, parent, step, tag):
        self.parent, self.step, self.tag, self.score, self.length = parent, step, tag, 0.0, 0
        self.key = hash((parent.key, step)) if parent else 0

    def path(self) -> str:
        steps, node = [], self
        while node.parent is not None:
            steps.append(node.step)
            node = node.parent
        return ">".join(reversed(steps))


def path_key(path: str) -> int:
    key = 0
    for step in path.split(">") if path else ():
        key = hash((key, step))
    return key


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag or '', whether an end tag, attributes); comments, raw elements
    and declarations have no tag.  The text after the last markup comes with tag ''."""
    at = done = 0       # text from ``done`` on is not given out yet
    quotes = True
    while (at := page.find("<", at)) >= 0:
        m = OPEN.match(page, at)
        if m is None:
            at += 1
            continue
        if m["comment"]:
            stop = page.find("-->", m.end())
            yield page[done:at], "", False, ""
            at = done = len(page) if stop < 0 else stop + 3
            continue
        stop = page.find(">", m.end())
        if stop < 0:
            break
        if quotes and m["tag"] and ("\"" in (head := page[m.end():stop]) or "'" in head):
            whole = QUOTED.match(page, m.end())
            if whole:
                stop = whole.end() - 1
            else:
                quotes = False
        tag = (m["tag"] or "").lower()
        if tag in RAW and not m["end"]:
            close = RAW_END[tag].search(page, stop + 1)
            yield page[done:at], "", False, ""
            at = done = close.end() if close else len(page)
            continue
        yield page[done:at], tag, bool(m["end"]), page[m.end():stop] if tag else ""
        at = done = stop + 1
    yield page[done:], "", False, ""


def _describe(tag: str, attrs: str) -> tuple[str, str, str]:
    """(generalised step, why the element is skipped for sure or '', what its words say or '')."""
    step, why, said = tag, "tag" if tag in SKIP_TAGS else "", ""
    if not NAMES.search(attrs):
        return step, why, said
    found: set[str] = set()
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            why = why or "hidden"
        elif name == "style" and INVISIBLE.search(value):
            why = why or "hidden"
        elif name == "role" and value.lower() in SKIP_ROLES:
            why = why or "role"
        elif name in ("class", "id"):
            for part in value.split():
                words = WORD.findall(CAMEL.sub(" ", part).lower())
                if STATE_WORDS.isdisjoint(words):
                    found.update(words)
            if name == "class" and WORD.search(value.lower()):
                kept = sorted({re.sub(r"[\d>]+", "", x).lower() for x in value.split()} - {""})
                step = tag + "".join("." + x for x in kept)
    if tag not in ("body", "html"):
        if found & COMMENT_WORDS:
            said = "comments"
        elif found & SKIP_WORDS:
            said = "words"
        elif found & HEADER_WORDS and not found & BODY_WORDS:
            said = "header"
    return step, why, said


class Suspects:
    """Elements whose class or id words name furniture, with the evidence of their content."""

    def __init__(self) -> None:
        self.outer: list[int] = []
        self.said: list[str] = []
        self.headed: list[bool] = []
        self.article = False                            # whether an article or main stands outside them

    def add(self, outer: int, said: str) -> int:
        self.outer.append(outer)
        self.said.append(said)
        self.headed.append(False)
        return len(self.outer) - 1

    def content(self, blocks) -> list[bool]:
        """Whether each is content after all, outer ones first."""
        running = [0] * (len(self.outer) + 1)           # the last one: under no suspect
        outside = 0
        for _, text, linked, suspect in blocks:
            plain = len(text) - linked
            if suspect < 0:
                outside += plain
            if plain >= RUNNING and plain > linked:
                running[suspect] += plain
        whole, headed = running[:-1], list(self.headed)     # with what is inside, but for comments
        for k, outer in reversed(list(enumerate(self.outer))):
            if outer >= 0 and self.said[k] != "comments":
                whole[outer] += whole[k]
                headed[outer] |= headed[k]
        elsewhere, out = running[-1], []
        for k, outer in enumerate(self.outer):
            alone = not self.article and self.said[k] != "comments" and whole[k] > 10 * outside
            good = (outer < 0 or out[outer]) and whole[k] > elsewhere and (headed[k] or alone)
            out.append(good)
            if good:
                elsewhere += running[k]
                outside += running[k]
        return out


def read_page(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """Text blocks in page order as (container, text, link characters), and all containers."""
    root = Node(None, "", "html")
    nodes, blocks, suspects = [root], [], Suspects()
    # (tag, container, why skipped for sure, innermost suspect or -1), and how often each tag is open
    stack: list[tuple[str, Node, str, int]] = [("#", root, "", -1)]
    opened: dict[str, int] = defaultdict(int)
    parts: list[str] = []
    links = 0
    in_link = False

    def flush() -> None:
        nonlocal links
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append((stack[-1][1], text, min(links, len(text)), stack[-1][3]))
        links = 0

    def push(tag: str, holder: Node, why: str, suspect: int) -> None:
        stack.append((tag, holder, why, suspect))
        opened[tag] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for before, tag, end, attrs in tokens(page):
        if before and not stack[-1][2]:
            parts.append(before)
            if in_link:
                links += len(before)
        if not tag:
            continue
        if tag == "a":
            in_link = not end
            continue
        if tag == "br":
            if not stack[-1][2]:
                parts.append(" ")
            continue
        if tag not in BLOCKS and tag not in SKIP_TAGS:
            if tag in VOID or attrs.endswith("/"):
                continue
            _, holder, outer, suspect = stack[-1]
            if end:
                if opened[tag]:
                    if stack[-1][0] != tag:
                        flush()
                    while pop() != tag:
                        pass
            elif outer and stack[-1][0] == tag:
                push(tag, holder, outer, suspect)      # so that the inner end tag doesn't end the outer element
            elif attrs:
                _, why, said = _describe(tag, attrs)   # an inline element may be furniture too
                if why or said:
                    push(tag, holder, outer or why or said, suspect)
            continue
        flush()
        if end:
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if tag == "hr":
            continue
        while stack[-1][0] == "p":                 # a block ends an open paragraph
            pop()
        if tag in ("li", "td", "th", "tr", "dt", "dd") and stack[-1][0] == tag:
            pop()
        if tag == "body" and stack[-1][0] == "head":   # head without an end tag
            pop()
        step, why, said = _describe(tag, attrs)
        _, holder, outer, suspect = stack[-1]
        if tag == "header" and not opened["article"] and not opened["main"]:
            why = why or "header"
        if tag in ("h1", "main") and suspect >= 0:
            suspects.headed[suspect] = True
        if tag in ("article", "main") and not why and not said:
            if outer == "header":
                outer = ""
            if suspect >= 0 and suspects.said[suspect] != "comments":
                suspect = -1                            # unclosed furniture doesn't swallow the article
            suspects.article = suspects.article or (suspect < 0 and not outer)
        if said and not outer and not why:
            suspect = suspects.add(suspect, said)
        if tag in CONTAINERS:
            holder = Node(holder, step, tag)
            nodes.append(holder)
        push(tag, holder, outer or why, suspect)
    flush()
    content = suspects.content(blocks)
    return [b[:3] for b in blocks if b[3] < 0 or content[b[3]]], nodes


def best_container(blocks, nodes) -> Node | None:
    """Highest score; of equals the one with more text, then the smaller path."""
    for node, text, linked in blocks:
        node.score += len(text) - 2.0 * linked
        node.length += len(text)
    for node in reversed(nodes):                       # inner ones before outer ones
        if node.parent is not None:
            node.parent.score += DECAY * node.score
            node.parent.length += node.length
    scored = [n for n in nodes if n.length]
    if not scored:
        return None
    rank = [(-n.score * TAG_WEIGHT.get(n.tag, 1.0), -n.length) for n in scored]
    first = min(rank)
    ties = {n.key: n for n, r in zip(scored, rank) if r == first}
    return min(ties.values(), key=Node.path) if len(ties) > 1 else next(iter(ties.values()))


def container_text(blocks, picks: set[int]) -> str:
    """Text of the blocks inside the picked containers (ids of nodes)."""
    inside: dict[int, bool] = {}
    out = []
    for node, text, _ in blocks:
        way = []
        while node is not None and id(node) not in inside and id(node) not in picks:
            way.append(id(node))
            node = node.parent
        found = node is not None and inside.get(id(node), True)
        inside.update(dict.fromkeys(way, found))
        if found:
            out.append(text)
    return "\n".join(out)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for part in text_slices(batch, "html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                best = best_container(*read_page(page))
                if best is not None:
                    v = votes[host, best.path()]
                    v[0] += 1
                    v[1] += best.length
        if len(votes) > 50_000:
            yield _vote_rows(votes)
            votes.clear()
    yield _vote_rows(votes)


def _vote_rows(votes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()),
         pa.array([v[0] for v in votes.values()], pa.int64()), pa.array([v[1] for v in votes.values()], pa.int64())],
        names=["host", "path", "votes", "length"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "html"):
            texts, paths = [], []
            for page, path in zip(part.column("html").to_pylist(), part.column("path").to_pylist()):
                blocks, nodes = read_page(page)
                key = path_key(path) if path is not None else None
                text = container_text(blocks, {id(n) for n in nodes if n.key == key})
                if not text:
                    best = best_container(blocks, nodes)
                    path = best.path() if best else None
                    text = container_text(blocks, {id(n) for n in nodes if n.key == best.key}) if best else ""
                texts.append(text)
                paths.append(path)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())],
                names=["page_id", "url", "text", "n_chars", "path"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host -> path: the winner of each host's vote."""
    votes = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")) \
        .mapInArrow(_vote, "host string, path string, votes long, length long") \
        .groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("length").alias("length"))
    return votes.groupBy("host").agg(F.min_by(
        "path", F.struct(-F.col("votes"), -F.col("length"), F.col("path"))).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) and the path that was used."""
    paths = materialise(host_paths(pages), "host-paths")
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
                          host_of(F.col("url")).alias("host"))
    return source.join(paths, "host", "left").select("page_id", "url", "html", "path") \
        .mapInArrow(_extract, "page_id long, url string, text string, n_chars long, path string")


def op1(pages: DataFrame) -> DataFrame:
    return extract(pages)
