"""Main text of web pages by wrapper inference.

Pages of one host come from one template. All pages of each host are aligned one after
another into a wrapper, a union-free regular expression over tokens: neighbouring groups
of the same tag fold into a repeated group; tags that only one side has become
optional groups; texts that differ become slots. The wrapper tells which group
holds the article: the deepest group that holds most of the slots' text once menus,
forms and the like are set aside; a tag made for articles decides only between groups
that hold equally much, and on a page that stands alone. Each page is then read with
its host's wrapper; a page that does not have the wrapper's group gets a wrapper of
its own.

Inference shuffles patterns of pages, with a digest for each text. Those of a host are
dealt by the page's hash to groups of about ``FAN``, whose patterns merge, and so do the
groups' in rounds, so a host with a third of all pages is spread over tasks like any other;
copies of a page count once. A wrapper grows with the kinds of groups in its host's pages,
not with their number. The pages meet their wrapper in a join without a hint, which Spark
may broadcast or split.

Text rules: character references are decoded, white space within a block becomes
one space, empty blocks go, and blocks are joined by a line feed. Null and empty
pages, and pages without an article's text, give an empty text. Pages cut off in
the middle give what is there. Groups may be nested to any depth: nothing here
calls itself. Null urls have the empty host. Repeated rows and
ids are read row by row.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwash.llm.scratch import written
from ledgerwash.llm.urlfilter import host_of

FAN = 256
MOST = 0.6  # of the slots' text, that a group must hold to be the article's

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var br wbr img".split())
ASIDE = frozenset("nav aside footer form button select dialog menu head script style noscript template iframe svg object canvas".split())
ARTICLE = ("article", "main")
MARKED = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments comment-list consent cookie "
                   "cookies disqus disclaimer footer header menu modal nav navbar navigation newsletter notice notices pagination popup "
                   "promo promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe "
                   "toolbar widget".split())
# A start tag of the first closes an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)"
                     r"((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Group:
    """A tag with what it holds. In a wrapper also: whether it may be absent
    (``optional``) or stand several times (``repeated``). A text is a group without
    a tag; ``text`` is None once it is a slot, and ``size`` is its length."""

    tag: str
    names: frozenset = frozenset()
    inner: list[Group] = field(default_factory=list)
    text: str | None = None
    size: int = 0
    optional: bool = False
    repeated: bool = False

    @property
    def key(self) -> str:
        return self.tag + "".join(sorted(f".{n}" for n in self.names))

    @property
    def aside(self) -> bool:
        return self.tag in ASIDE or (self.tag not in ("", "body", "html", *ARTICLE) and not self.names.isdisjoint(MARKED))


def tokens(page: str) -> Iterator[tuple[str, str, frozenset]]:
    """("open" or "close" or "text", tag or text, words of class, id and role)."""
    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            rest = page[at:stop]
            if not m and (cut := rest.rfind("<")) >= 0 and rest[cut + 1:cut + 2] in ("", "/"):
                rest = rest[:cut]  # the page ends within a tag
            yield "text", rest, frozenset()
        if not m:
            return
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                yield "close", tag, frozenset()
                continue
            words = " ".join(a or b or c for _, a, b, c in _NAMES.findall(m[3]))
            yield "open", tag, frozenset(words.lower().split())
            if tag in RAW and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
                yield "close", tag, frozenset()


def _unnested(steps: Callable[..., Generator]) -> Callable:
    """A recursive function that yields its inner calls (generators), run without nesting."""
    @functools.wraps(steps)
    def run(*args):
        calls, value = [steps(*args)], None
        while calls:
            try:
                calls.append(calls[-1].send(value))
                value = None
            except StopIteration as end:
                calls.pop()
                value = end.value
        return value
    run.steps = steps
    return run


def tree(page: str) -> Group:
    """The page's groups. Inline tags only pass their text on; a block that starts
    within a paragraph ends it."""
    top = Group("")
    stack = [top]
    places: dict[str, list[int]] = {}  # of each tag's open groups in the stack, so that no look-up walks a deep one

    def close(tags: set, within: set) -> None:
        last = lambda some: max((places[t][-1] for t in some if places.get(t)), default=0)
        i = last(tags)
        if i and i >= last(within):
            for group in stack[i:]:
                places[group.tag].pop()
            del stack[i:]

    for kind, what, names in tokens(page):
        if kind == "text":
            stack[-1].inner.append(Group("", text=what, size=len(what.strip())))
        elif kind == "open":
            if what in INLINE and names.isdisjoint(MARKED):
                if what == "br":
                    stack[-1].inner.append(Group("", text=" "))
                continue
            if what not in INLINE:
                close({"p"}, {"div", "article", "section", "li", "td", "blockquote", "body"})
            if what in CLOSES:
                close(CLOSES[what], {"ul", "ol", "dl", "table", "select", "div"})
            group = Group(what, names)
            stack[-1].inner.append(group)
            if what not in VOID:
                places.setdefault(what, []).append(len(stack))
                stack.append(group)
        else:
            close({what}, set())
    return top


@_unnested
def folded(group: Group) -> Generator:
    """The group as a pattern: each run of groups with one key is one repeated
    group, and neighbouring texts are one slot or text."""
    out: list[Group] = []
    for child in group.inner:
        if not child.tag and not (child.text or "").strip():
            continue
        new = child if not child.tag else (yield folded.steps(child))
        if out and out[-1].key == new.key:
            out[-1] = yield merged.steps(out[-1], new)
            out[-1].repeated = bool(new.tag)
        else:
            out.append(new)
    return Group(group.tag, group.names, out)


@_unnested
def merged(a: Group, b: Group) -> Generator:
    """The smallest pattern of this kind that covers both; keys are equal."""
    if not a.tag and not a.inner and not b.inner:
        same = a.text is not None and a.text == b.text
        return Group("", text=a.text if same else None, size=a.size + b.size, optional=a.optional or b.optional)
    return Group(a.tag, a.names, (yield _aligned(a.inner, b.inner)), None, 0, a.optional or b.optional, a.repeated or b.repeated)


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the longest common subsequences of ``x`` and each end of ``y``, the lengths
    (``y`` from j on, for each j). One row of the table at a time."""
    row = np.zeros(len(y) + 1, np.int64)
    for key in x[::-1]:
        more = np.maximum(row[:-1], (y == key) * (row[1:] + 1))
        row[:-1] = np.maximum.accumulate(more[::-1])[::-1]
    return row


def common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places: Hirschberg's division, in memory
    linear in both lists however long they are."""
    out, left = [], [(0, len(x), 0, len(y))]
    while left:
        a, b, c, d = left.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if b - a == 1:
            same = np.flatnonzero(y[c:d] == x[a])
            out += [(a, c + int(same[0]))] if len(same) else []
            continue
        middle = (a + b) // 2
        ahead = _lengths(x[a:middle][::-1], y[c:d][::-1])[::-1]
        cut = c + int(np.argmax(ahead + _lengths(x[middle:b], y[c:d])))
        left += [(a, middle, c, cut), (middle, b, cut, d)]
    return sorted(out)


def _aligned(a: list[Group], b: list[Group]) -> Generator:
    """Both lists in one: groups of a longest common subsequence of keys merge,
    and the mismatches between them become optional."""
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(g.key, len(numbers)) for g in side], np.int64) for side in (a, b))
    out, i, j = [], 0, 0
    for at, to in [*common(x, y), (len(a), len(b))]:
        out += [Group(g.tag, g.names, g.inner, g.text, g.size, True, g.repeated) for g in (*a[i:at], *b[j:to])]
        if at < len(a):
            out.append((yield merged.steps(a[at], b[to])))
        i, j = at + 1, to + 1
    return out


def infer(pages: list[str]) -> Group:
    wrapper = folded(tree(pages[0]))
    for page in pages[1:]:
        wrapper = merged(wrapper, folded(tree(page)))
    return wrapper


def _outwards(top: Group) -> list[Group]:
    """The groups of a tree, each after those that it holds."""
    out, left = [], [top]
    while left:
        out.append(left.pop())
        left += out[-1].inner
    return out[::-1]


def _slots(wrapper: Group, one_page: bool) -> dict[int, int]:
    """Characters in slots of each group (by ``id``), menus and the like aside; a text
    that all pages share counts only if there is nothing else. All texts of one page
    are slots."""
    held: dict[int, int] = {}
    for group in _outwards(wrapper):
        own = group.size if not group.tag and (one_page or group.text is None) else 0
        held[id(group)] = 0 if group.aside else own + sum(held[id(c)] for c in group.inner)
    return held


def _tagged(wrapper: Group, held: dict[int, int]) -> list[str] | None:
    """Keys to the group with most text of those whose tag is made for articles."""
    for tag in ARTICLE:
        leads: set[int] = set()  # groups that are one of the tag or hold one
        for group in _outwards(wrapper):
            if not group.aside and (group.tag == tag or any(id(c) in leads for c in group.inner)):
                leads.add(id(group))
        path, group = [], wrapper
        while id(group) in leads and (group is wrapper or group.tag != tag):
            group = max((c for c in group.inner if id(c) in leads), key=lambda c: held[id(c)])
            path.append(group.key)
        if path:
            return path
    return None


def article_path(wrapper: Group, one_page: bool) -> list[str] | None:
    """Keys from the top to the article's group, or None if there is no text: the deepest
    group that holds most of the slots' text, one that stands once in its group. Of
    groups that hold equally much, the one whose tag is made for articles. One page alone
    has no slots that tell anything: there such a tag, if any, comes first."""
    held = _slots(wrapper, one_page)
    rank = lambda group: (held[id(group)], group.tag in ARTICLE)
    if one_page and (tagged := _tagged(wrapper, held)):
        return tagged
    path, total = [], held[id(wrapper)]
    if not total:
        return None
    group = wrapper
    while True:
        inner = max((c for c in group.inner if c.tag), key=rank, default=None)
        if inner is None or inner.repeated or held[id(inner)] < MOST * total:
            return path
        # A group of text alone is a block of the article, unless there is no other text beside it.
        if held[id(inner)] < held[id(group)] and not any(c.tag for c in inner.inner):
            return path
        if group.tag in ARTICLE and held[id(inner)] == held[id(group)]:
            return path
        group = inner
        path.append(group.key)


def _blocks(group: Group, out: list[list[str]]) -> None:
    left: list[Group | None] = group.inner[::-1]
    while left:
        child = left.pop()
        if child is None:  # a block ends
            out.append([])
        elif not child.tag:
            out[-1].append(child.text or "")
        elif not child.aside and child.tag != "title":
            if child.tag not in INLINE:
                out.append([])
                left.append(None)
            left += child.inner[::-1]


def _at(group: Group, path: list[str]) -> list[Group]:
    found = [group]
    for key in path:
        found = [c for g in found for c in g.inner if c.tag and c.key == key]
    return found


def main_text(page: str, path: list[str] | None) -> str:
    """Text of a page whose article stands at ``path`` (or is looked for)."""
    page_tree = tree(page)
    places = _at(page_tree, path) if path is not None else []
    if not places:
        own = article_path(folded(page_tree), True)
        places = _at(page_tree, own) if own is not None else []
    out: list[list[str]] = [[]]
    for place in places:
        _blocks(place, out)
        out.append([])
    texts = (" ".join(html.unescape("".join(b)).split()) for b in out)
    return "\n".join(t for t in texts if t)


def packed(wrapper: Group) -> str:
    """A pattern as JSON, each group before those that it holds, however deep."""
    out, left = [], [wrapper]
    while left:
        group = left.pop()
        out.append([group.tag, sorted(group.names), group.text, group.size, group.optional, group.repeated, len(group.inner)])
        left += group.inner[::-1]
    return json.dumps(out)


def unpacked(pattern: str) -> Group:
    top, left = Group(""), []  # with each open group, how many it still lacks
    for tag, names, text, size, optional, repeated, inner in json.loads(pattern):
        group = Group(tag, frozenset(names), [], text, size, optional, repeated)
        while left and not left[-1][1]:
            left.pop()
        if left:
            left[-1][0].inner.append(group)
            left[-1][1] -= 1
        else:
            top = group
        left.append([group, inner])
    return top


@F.arrow_udf(T.StringType())
def _pattern(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each page's own pattern. Its texts are only compared, so digests stand for them."""
    def of(page: str) -> str:
        pattern = folded(tree(page))
        for group in _outwards(pattern):
            if group.text is not None:
                group.text = hashlib.blake2b(group.text.encode(), digest_size=16).hexdigest()
        return packed(pattern)

    for pages in batches:
        yield pa.array([of(p.as_py()) for p in pages], pa.string())


def _merged_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by host and part, the patterns of each as one; ``n``: of how many pages."""
    key, wrapper, n = None, None, 0
    done: list[tuple] = []
    for frame in frames:
        for host, part, pattern, more in zip(frame["host"], frame["part"], frame["pattern"], frame["n"], strict=True):
            new = unpacked(pattern)
            if key == (host, part):
                wrapper, n = merged(wrapper, new), n + more
                continue
            if key is not None:
                done.append((*key, packed(wrapper), n))
            key, wrapper, n = (host, part), new, more
        yield pd.DataFrame(done, columns=["host", "part", "pattern", "n"])
        done = []
    if key is not None:
        yield pd.DataFrame([(*key, packed(wrapper), n)], columns=["host", "part", "pattern", "n"])


@F.arrow_udf(T.StringType())
def _path(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for patterns, pages in batches:
        yield pa.array([json.dumps(article_path(unpacked(p.as_py()), n.as_py() == 1))
                        for p, n in zip(patterns, pages, strict=True)], pa.string())


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, path) for each host with a page that is not empty, from columns host
    and page; path is JSON. Every page is seen."""
    spark = pages.sparkSession
    some = pages.where(F.length("page") > 0)
    most = some.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    parts = -(-most // FAN)
    # Copies are reduced before the shuffle.
    rows = some.select("host", F.md5(F.col("page").cast("binary")).alias("mark"), _pattern("page").alias("pattern")).groupBy("host", "mark").agg(
        F.min("pattern").alias("pattern")).select(
        "host", F.pmod(F.xxhash64("mark"), F.lit(parts)).alias("part"), "mark", "pattern", F.lit(1).cast("long").alias("n"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # By number: the work lies in the rows, and AQE would merge tasks by their few bytes.
        rows = rows.repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "mark").drop("mark").mapInPandas(
            _merged_groups, "host string, part long, pattern string, n long")
        if parts == 1:
            return written(rows.select("host", _path("pattern", "n").alias("path")), "wrappers")
        parts = -(-parts // FAN)
        rows = rows.select("host", F.pmod("part", F.lit(parts)).alias("part"), F.col("part").alias("mark"), "pattern", "n")


@F.arrow_udf(T.StringType())
def _main_text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pages, paths in batches:
        yield pa.array([main_text(p.as_py() or "", json.loads(w.as_py() or "null"))
                        for p, w in zip(pages, paths, strict=True)], pa.string())


def extracted(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with its columns (but for the page's source and any
    named text or n_chars), the main text, and its code points."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    hosted = pages.select(F.struct(*kept).alias("row"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("page"))
    read = hosted.join(wrappers(hosted), "host", "left")
    return read.select("row.*", _main_text(F.col("page"), F.col("path")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
