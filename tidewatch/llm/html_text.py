"""HTML extraction by consensus host paths.

Every page scores its containers by the running text directly inside them; its best container, named by
the tags and classes that lead to it (digits generalised), is its vote. Spark counts the votes of each
host, and every page is read again with its host's winning path. What is boilerplate without a plain name is voted
on, too: an element outside articles, or one in an article with a class such as notice or share, goes where
its host repeats the same text in it on different pages.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, table
from .url_filter import host_of

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: The attributes of a tag up to its end, quotes in pairs; possessive, so that it never goes back.
_ATTRS = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+""")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
ENDS_P = BLOCK - frozenset("body html caption tbody tfoot thead tr".split())
#: An opening tag ends an open element of these kinds, unless one of the bounds comes first.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Never part of the main text. Forms are judged once the whole page is known.
BOILER_TAGS = frozenset("nav footer aside script style noscript template iframe svg canvas button select textarea input dialog menu head title object embed audio video map xmp noembed noframes".split())
#: Roles of menus, page headers and footers, side parts, searches and dialogs.
BOILER_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog".split())
#: Whole classes or ids of adverts, reader comments, menus and sidebars: boilerplate in an article, too.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adbox ad-box adslot ad-slot sponsored comments comment-list commentlist comments-area reader-comments disqus_thread respond sidebar navbar breadcrumb breadcrumbs".split()
)
#: Words that, as a whole class or id or as the last word of one (site-footer), mark boilerplate outside articles.
#: In an article, whose subject they may be, they only put an element to the vote.
DOUBTFUL = frozenset(
    "sponsor promo promotion banner menu nav navigation topbar masthead footer header cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments widget popup modal overlay pagination pager toolbar search sidebar ad ads advert adverts advertisement copyright paywall".split()
)
_CONTAINERS = frozenset("article main section div td body center".split())
_STORY = frozenset(("article", "main"))
_P_BOUNDS = _CONTAINERS | {"li", "table", "button"}
#: Elements that are kept as open ones; others only say that text is inline.
_HELD = BLOCK | BOILER_TAGS | {"a", "td", "th"}


def _named(attrs: str) -> tuple[str, list[str], str]:
    """The class part of a path, and the lower-case classes and ids, and the role."""
    path, names, role = "", [], ""
    for kind, value in _NAMES.findall(attrs):
        value, kind = value.strip("\"'").lower(), kind.lower()
        if kind == "role":
            role = value.strip()
            continue
        names += value.split()
        if kind == "class":
            path = "".join("." + re.sub(r"\d+", "N", c) for c in sorted(value.replace("/", "|").split()))
    return path, names, role


def _doubtful(name: str) -> bool:
    return name in DOUBTFUL or re.split(r"[_-]", name)[-1] in DOUBTFUL


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


class _Open(NamedTuple):
    """An open element: its path, the path of the nearest container, whether it is boilerplate or in an article, the path to vote on, its form."""

    tag: str
    path: int
    holder: int
    boiler: bool
    story: bool
    doubt: int
    form: int


class _Block(NamedTuple):
    """A block of text: where it stands, its nearest container, characters in links, whether it is running text, the path to vote on, its form."""

    path: int
    holder: int
    text: str
    linked: int
    running: bool
    doubt: int
    form: int


class Page:
    """The blocks of text of a page outside plain boilerplate, in page order, and the paths of its elements.

    Paths are numbers; each has a parent with a smaller one and a label of a tag and its classes. Elements of one path share its number.
    """

    def __init__(self, html: str):
        self.parents, self.labels = [0], [""]
        self.numbers: dict[tuple[int, str], int] = {}
        self.blocks: list[_Block] = []
        self._forms: list[tuple[int, bool]] = []  # of each form: the one around it, whether an article is in it
        self._read(html)
        self._judge_forms()

    def __bool__(self) -> bool:
        return bool(self.blocks)

    def _path(self, parent: int, label: str) -> int:
        number = self.numbers.get((parent, label))
        if number is None:
            number = self.numbers[parent, label] = len(self.parents)
            self.parents.append(parent)
            self.labels.append(label)
        return number

    def name(self, path: int) -> str:
        parts = []
        while path:
            parts.append(self.labels[path])
            path = self.parents[path]
        return "".join(f"/{p}" for p in reversed(parts))

    def find(self, name: str) -> int:
        """The number of a path by its name; -1 where the page has none."""
        at = 0
        for label in name.split("/")[1:]:
            at = self.numbers.get((at, label), -1)
            if at < 0:
                break
        return at

    def keys(self) -> list[int]:
        """A 64-bit key of each path, which follows from its labels: pages name their paths by it where names could be long."""
        out = [0]
        for i in range(1, len(self.parents)):
            out.append(xxhash.xxh3_64_intdigest(f"{out[self.parents[i]]}/{self.labels[i]}".encode("utf-8", "surrogatepass")) - (1 << 63))
        return out

    def below(self, paths: set[int]) -> list[bool]:
        """For each path, whether it is one of these or below one."""
        out = [0 in paths]
        for i in range(1, len(self.parents)):
            out.append(out[self.parents[i]] or i in paths)
        return out

    def _read(self, html: str) -> None:
        stack = [_Open("", 0, 0, False, False, 0, -1)]
        count: dict[str, int] = defaultdict(int)  # open elements by tag
        text: list[str] = []
        links = linked = inline = 0
        running, owner = False, stack[0]

        def flush() -> None:
            nonlocal linked, running, inline
            if text:
                s = " ".join(unescape("".join(text)).split())
                if s:
                    doubt = owner.doubt or (0 if owner.story else owner.holder)
                    self.blocks.append(_Block(owner.path, owner.holder, s, min(linked, len(s)), running, doubt, owner.form))
                text.clear()
            linked, running, inline = 0, False, 0

        def add(s: str) -> None:
            nonlocal owner, linked, running
            top = stack[-1]
            if top.boiler:
                return
            if not text:
                owner = top
            text.append(s)
            if links:
                linked += len(s)
            running = running or inline > 0 or (top.tag not in _CONTAINERS and top.tag != "")

        def pop(n: int) -> None:
            nonlocal links
            while len(stack) > n:
                tag = stack.pop().tag
                count[tag] -= 1
                links -= tag == "a"

        def close(tags, bounds) -> None:
            """End the nearest open element of some tags, unless a bound comes first."""
            if sum(map(count.__getitem__, tags)):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in tags:
                        flush()
                        pop(i)
                        return
                    if stack[i].tag in bounds:
                        return

        pos, end, last, broken = 0, len(html), html.rfind(">"), -1
        while pos < end:
            at = html.find("<", pos)
            if at < 0 or at > last:  # no tag can end from here on
                rest = html.find("<!--", max(at, pos))
                add(html[pos : rest if rest >= 0 else end])
                break
            if at > pos:
                add(html[pos:at])
            if html.startswith("<!--", at):
                pos = html.find("-->", at + 4) + 3
                if pos < 3:
                    break
                continue
            if html[at + 1 : at + 2] in ("!", "?"):
                pos = html.find(">", at) + 1
                continue
            closing = html.startswith("/", at + 1)
            named = _NAME.match(html, at + 1 + closing)
            if named is None:
                add("<")
                pos = at + 1
                continue
            tag, pos = named.group().lower(), named.end()
            if closing:
                pos = html.find(">", pos) + 1 or end
                if tag in BLOCK:
                    flush()
                    close((tag,), ())
                elif count[tag] > 0:
                    close((tag,), BLOCK)  # a stray inline end tag does not close blocks
                else:
                    inline = max(0, inline - 1)
                continue
            begin, pos = pos, -1
            if begin > broken:
                stop = _ATTRS.match(html, begin).end()
                if stop < end and html[stop] == ">":
                    pos = stop
                else:
                    broken = stop  # a quote that never ends: up to it, tags end at the next bracket
            if pos < 0:
                pos = html.find(">", begin)
                if pos < 0:
                    add(html[at:])
                    break
            attrs, pos = html[begin:pos], pos + 1
            if tag in ENDS_P:
                close(("p",), _P_BOUNDS)
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            if tag in BLOCK:
                flush()
            elif tag in ("br", "td", "th", "img") and text:
                text.append(" ")
            if tag in VOID or attrs.endswith("/") and tag in ("path", "circle", "rect", "use"):
                continue
            top = stack[-1]
            classes, names, role = _named(attrs) if attrs else ("", [], "")
            page_part = tag in ("html", "body") or tag in _STORY
            boiler = top.boiler or tag in BOILER_TAGS or (tag == "header" and not top.story)
            doubt = top.doubt
            if not boiler and not page_part and (names or role):
                boiler = role in BOILER_ROLES or (role == "banner" and not top.story) or any(n in MARKED for n in names)
                if not boiler and any(_doubtful(n) for n in names):
                    boiler, doubt = not top.story, -1
            if tag not in _HELD and not boiler and doubt != -1:
                inline += 1
                continue
            path = self._path(top.path, tag if page_part else tag + classes)
            form = top.form
            if tag == "form":
                self._forms.append((form, False))
                form = len(self._forms) - 1
            if tag in _STORY:
                inside = form
                while inside >= 0 and not self._forms[inside][1]:
                    self._forms[inside] = (self._forms[inside][0], True)
                    inside = self._forms[inside][0]
            holder = path if tag in _CONTAINERS else top.holder
            stack.append(_Open(tag, path, holder, boiler, top.story or tag in _STORY, path if doubt == -1 else doubt, form))
            count[tag] += 1
            links += tag == "a"
            if tag in RAW:
                found = _end_of(tag).search(html, pos)
                pos = html.find(">", found.end()) + 1 or end if found else end
                pop(len(stack) - 1)
        flush()

    def _judge_forms(self) -> None:
        """Drop the text of forms, but for those around an article and those that hold most of a page's running text."""
        if not self._forms:
            return
        held: Counter[int] = Counter()
        for b in self.blocks:
            held[b.form] += len(b.text) - b.linked if b.running else 0
        kept = {-1}
        for i, (around, story) in enumerate(self._forms):  # those around come first
            if around in kept and (story or held[i] >= max(FORM_LEAST, held[-1] + 1)):
                kept.add(i)
        self.blocks = [b for b in self.blocks if b.form in kept]


#: A form around so many characters of running text, more than outside it, is the page itself.
FORM_LEAST = 200
#: Running text right in the body beside the best container is of the article from so many characters on.
BESIDE_LEAST = 20


def blocks_of(html: str) -> Page:
    return Page(html)


def container_scores(page: Page) -> dict[int, float]:
    """Running text outside links counts for the container that holds it and half for the one around it."""
    scores: dict[int, float] = defaultdict(float)
    for b in page.blocks:
        worth = (len(b.text) - b.linked) * (1.0 if b.running else 0.5)
        scores[b.holder] += worth * (1.5 if page.labels[b.holder] in _STORY else 1.0)
        scores[page.parents[b.holder]] += worth / 2
    return scores


def held_text(page: Page) -> list[int]:
    """Characters of running text outside links at or below each path."""
    held = [0] * len(page.parents)
    for b in page.blocks:
        held[b.path] += len(b.text) - b.linked if b.running else 0
    for i in range(len(held) - 1, 0, -1):
        held[page.parents[i]] += held[i]
    return held


def best_path(page: Page) -> tuple[str, float]:
    """The path of a page's main text and its score.

    The best container gives way to the nearest article or main around it, or, without one, to the
    lowest element around it that holds what it has beside it, too: a lead beside a story is of the article, in the body as well.
    """
    scores = container_scores(page)
    path, score = max(scores.items(), key=lambda x: (x[1], -x[0]), default=(0, 0.0))
    around = path
    while around:
        if page.labels[around] in _STORY:
            return page.name(around), score
        around = page.parents[around]
    held = held_text(page)
    while (up := page.parents[path]) and page.labels[path] not in ("body", "html"):
        if held[up] < held[path] + (BESIDE_LEAST if page.labels[up] in ("body", "html") else 1):
            break
        path = up
    return page.name(path), score


#: A page is read by its own path where that holds so many times the running text of the host's, and so many characters.
OWN_TIMES, OWN_LEAST = 2, 140


def text_at(page: Page, path: str, repeated: list[int] | None = None) -> str:
    """The blocks at or below a path, in page order, one to a line, but for those at or below paths with repeated keys."""
    at = page.find(path)
    if at < 0:
        return ""
    inside = page.below({at})
    found = [b for b in page.blocks if inside[b.path]]
    if repeated:
        keys = set(repeated)
        without = page.below({i for i, k in enumerate(page.keys()) if i and k in keys})
        found = [b for b in found if not without[b.path]] or found
    return "\n".join(b.text for b in found)


def doubts(page: Page) -> dict[int, int]:
    """A hash of the text of each element that is put to the vote, by its path's key."""
    texts: dict[int, xxhash.xxh3_64] = {}
    for b in page.blocks:
        if b.doubt:
            texts.setdefault(b.doubt, xxhash.xxh3_64()).update(f"{b.text}\n".encode("utf-8", "surrogatepass"))
    keys = page.keys() if texts else []
    return {keys[p]: h.intdigest() - (1 << 63) for p, h in texts.items()}


#: What hosts have voted for is broadcast up to so many bytes; more is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: A path is repeated where at least so many different pages of a host have it, with half as many different texts at most.
REPEATED_PAGES = 3


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, repeated): the path that most pages of a host vote for (ties go to the larger score, then text), and the keys
    of the paths whose text its pages repeat. Copies of a page are one page for the latter."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            votes: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0, 0.0])
            doubtful: list[tuple] = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = blocks_of(html or "")
                path, score = best_path(page)
                if path:
                    v = votes[host, path]
                    v[0] += 1
                    v[1] += score
                if found := doubts(page):
                    copy = xxhash.xxh3_64_intdigest(html.encode("utf-8", "surrogatepass")) - (1 << 63)
                    doubtful += [(host, None, 0, 0.0, key, copy, text) for key, text in found.items()]
            rows = [(h, p, n, s, None, None, None) for (h, p), (n, s) in votes.items()] + doubtful
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "path", "votes", "score", "key", "page", "text"])

    found = stored(pages.select("host", "html").mapInArrow(vote, "host string, path string, votes long, score double, key long, page long, text long"))
    votes = found.where("key IS NULL").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum(F.round("score")).alias("score"))
    best = votes.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("top")).select("host", F.col("top.path").alias("path"))
    texts = found.where("key IS NOT NULL").groupBy("host", "key", "page").agg(F.min("text").alias("text"))
    texts = texts.groupBy("host", "key", "text").agg(F.count(F.lit(1)).alias("pages"))  # a text on many pages is summed here
    alike = texts.groupBy("host", "key").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("texts"))
    alike = alike.where((F.col("pages") >= REPEATED_PAGES) & (2 * F.col("texts") <= F.col("pages")))
    return best.join(alike.groupBy("host").agg(F.collect_list("key").alias("repeated")), "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars, path (the winning one), one row a page.

    A null or empty page has an empty text. A page without a block under its host's winning path is read
    with its own best container, and so is one whose own container holds OWN_TIMES as much running text. Pages without a host vote
    together under an empty host. Repeated rows each come back; other columns of the input are not carried. A tag that never ends
    is text; a page is read in time and memory proportional to its length.
    """
    held = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    paths = stored(host_paths(held))
    size = F.octet_length("host") + F.octet_length("path") + 8 * F.coalesce(F.size("repeated"), F.lit(0)) + 64
    small = (paths.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    joined = held.join(F.broadcast(paths) if small else paths, "host", "left").select("page_id", "url", "html", "path", "repeated")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts, used = [], []
            for html, path, repeated in zip(*(batch.column(c).to_pylist() for c in ("html", "path", "repeated")), strict=True):
                page = blocks_of(html or "")
                text = text_at(page, path, repeated) if path else ""
                own = best_path(page)[0]
                if own != path:
                    sizes = held_text(page)
                    there = sizes[page.find(path)] if path and page.find(path) >= 0 else 0
                    if (not text and page) or (path and sizes[page.find(own)] >= max(OWN_LEAST, OWN_TIMES * there)):
                        path, text = own, text_at(page, own, repeated)
                texts.append(text)
                used.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long, path string")


def op8_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
