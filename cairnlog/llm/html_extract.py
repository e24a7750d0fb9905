"""Main text of web pages by consensus on each host's container paths.

First pass: every page's containers are scored by the prose directly inside them, and the page
votes for the path of its best one. A path is the chain of tags with their classes, digits
generalised. Votes are summed by (host, path) with partial sums in the map stage; the path with
most votes wins the host, and so do others with a good share of them, as a host may have several
templates. Second pass: a page whose own best container is on a winning path gives that path's
containers, any other those of the first winning path that it has, and one without any its own best
container. Pages are never shuffled as long as the table of winners is small enough to broadcast
(BROADCAST_HOSTS rows, counted first); beyond that they are joined with it on the host, which
adaptive execution splits where a host is hot.

Inside the container, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out, by tag, role and whole words of class and id. What looks like one of
these but holds the article doesn't count as one: an element that only its tag or class marks is
opened where the page has no article outside of such elements and one inside, or no other prose. No
page that has prose gives an empty text. Blocks of text are trimmed, with white space as one space,
and joined by a newline in page order. Work is in proportion to the page's length.

Defined results: a null html is an empty one, an empty text comes out of a page without prose; a
null or odd url has the empty host; repeated rows are extracted each; an unclosed or cut page is read
as far as it goes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlog.llm.common import small_batches, written

#: The table of winning paths is broadcast up to this many hosts.
BROADCAST_HOSTS = 200_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|object|select|title)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article blockquote body center div main section td".split())
PROSE = frozenset("p pre li dd dt h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
#: Marks of an element: what may hold an article after all, reader comments, and what never does.
PLAIN, SOFT, COMMENT, HARD = range(4)
HARD_TAGS = frozenset("nav button input label dialog menu head noscript template".split())
SOFT_TAGS = frozenset("aside footer form".split())
HARD_ROLES = frozenset("navigation search dialog alertdialog menu menubar toolbar".split())
SOFT_ROLES = frozenset("banner contentinfo complementary form alert note".split())
#: Whole words of a class or id that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot masthead topbar header site-header "
    "sidebar sidebars aside rail widget widgets related recommended recommendations trending popular more-stories "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner banners adsbygoogle "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay toast disclaimer paywall "
    "newsletter subscribe subscription signup login signin form search searchbox share sharing social skip hidden".split()
)
COMMENTS = frozenset("comment comments commentlist discussion disqus respond responses reply replies reviews feedback".split())
#: What an article's own class may be marked with, besides comments.
ARTICLE_MARKS = frozenset("ad ads advert sponsored promo promoted related recommended teaser".split())
#: What a class or id calls an article.
CONTENT = frozenset("content article post entry story main text".split())
#: A class or id that tells what a container has or lacks, not what it is.
TELLS = re.compile(r"(?:no|has|with|without|is|not)[-_].*|.*[-_](?:open|closed|enabled|disabled|on|off|true|false|layout|page)|.*[-_]free(?:[-_].*)?")
WORD = re.compile(r"[a-z]+")
LONG_PATH = 1000
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")
#: What an open element is closed by, besides its own end.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "tr": {"tr"}}
HELD_BY = {"p": {"div", "article", "section", "td", "blockquote", "li"}, "li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"},
           "td": {"table"}, "th": {"table"}, "tr": {"table"}}


class Element:
    __slots__ = ("tag", "path", "up", "mark", "above", "inside", "content", "parts", "score", "heading")

    def __init__(self, tag: str, step: str, up: Element | None, mark: int, content: bool):
        self.tag, self.up, self.mark, self.content = tag, up, mark, content
        self.above = max(mark, up.above) if up else mark  # the strongest mark from here upwards
        self.inside = tag in ("article", "main") or up is not None and up.inside
        above = up.path if up else ""
        # a very long path goes on from its digest, so that deeply nested pages stay cheap
        above = above if len(above) < LONG_PATH else md5(above.encode()).hexdigest()
        self.path = f"{above}>{step}" if up else step
        self.parts: list = []  # strings, elements, and None for a block's edge
        self.score = 0.0
        self.heading = 0  # 1: an h2, 2: an h1


def _words(value: str) -> set[str]:
    """Whole words of a class or id list, each name also as a whole."""
    names = [n for n in value.lower().split() if not TELLS.fullmatch(n)]
    return {*names, *(w for n in names for w in WORD.findall(n))}


def _step(tag: str, attrs: dict[str, str]) -> str:
    names = sorted({DIGITS.sub("#", c) for c in attrs.get("class", "").lower().split()})
    return ".".join([tag, *names])


def _mark(tag: str, attrs: dict[str, str], words: set[str], inside: bool) -> int:
    role = attrs.get("role", "").lower()
    if tag in HARD_TAGS or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or role in HARD_ROLES:
        return HARD
    if "style" in attrs and re.search(r"display\s*:\s*none", attrs["style"], re.I):
        return HARD
    if tag in ("html", "body", "main"):
        return PLAIN
    if tag == "article":
        return COMMENT if not COMMENTS.isdisjoint(words) else SOFT if not ARTICLE_MARKS.isdisjoint(words) else PLAIN
    if not COMMENTS.isdisjoint(words):
        return COMMENT
    if tag == "header":  # an article's own header has its title
        return PLAIN if inside else SOFT
    return SOFT if tag in SOFT_TAGS or role in SOFT_ROLES or not MARKS.isdisjoint(words) else PLAIN


class _Open:
    """The open elements of a page, and at which depths those of each tag are, so that no search walks up the tree."""

    def __init__(self, root: Element):
        self.stack, self.depths, self.blocks = [root], {}, []

    def push(self, e: Element) -> None:
        if e.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.depths.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)

    def cut(self, depth: int) -> None:
        """Close all elements from this depth on."""
        while len(self.stack) > max(1, depth):
            self.depths[self.stack.pop().tag].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def last(self, tags) -> int:
        """The depth of the innermost open element of these tags; 0 if there is none."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)


#: What closes an element of each tag, by the tag that comes: the tags that it closes and those that keep it from going on up.
CLOSES = {t: frozenset(c for c, by in CLOSED_BY.items() if t in by) for t in BLOCKS}
KEEPS = {t: frozenset(HELD_BY.get(t, ())) | CONTAINERS for t in BLOCKS}


def parse(page: str | None) -> tuple[Element, list[Element]]:
    """The page's tree below a root, and its containers in page order."""
    root = Element("html", "html", None, PLAIN, False)
    up, containers, done = _Open(root), [], 0
    page = page or ""

    def text(s: str) -> None:
        if s and not s.isspace():
            up.stack[-1].parts.append(html.unescape(s))
        elif s:
            up.stack[-1].parts.append(" ")

    for m in TOKEN.finditer(page):
        if m.start() > done:
            text(page[done : m.start()])
        done = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m["close"]:
            at = up.last((tag,))
            if at and (tag in BLOCKS or not up.blocks or up.blocks[-1] < at):  # an inline end tag doesn't close a block
                up.cut(at)
            elif tag in BLOCKS:
                up.stack[-1].parts.append(None)
            continue
        if tag == "br":
            up.stack[-1].parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                up.stack[-1].parts.append(None)
            continue
        if tag == "html":
            continue
        attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTR.findall(m["attrs"])} if m["attrs"] else {}
        if tag == "body":
            up.cut(1)
        elif tag in BLOCKS:
            at = up.last(CLOSES[tag])
            if at and at >= up.last(KEEPS[tag]):
                up.cut(at)
        at = up.stack[-1]
        words = _words(attrs.get("class", "")) | _words(attrs.get("id", "")) if attrs else set()
        new = Element(tag, _step(tag, attrs), at, _mark(tag, attrs, words, at.inside), not CONTENT.isdisjoint(words))
        at.parts.append(new)
        if (tag in CONTAINERS or new.mark) and new.above < HARD:
            containers.append(new)
        if not m["attrs"].endswith("/"):
            up.push(new)
    if done < len(page):
        text(page[done:])
    return root, containers


def _blocks(e: Element, mark: int, out: list[str], line: list[str]) -> None:
    """The texts of e's blocks; the last, which may go on, stays in `line`. A stack, as pages may nest deeply."""
    todo = [(e, iter(e.parts))]
    while todo:
        now, parts = todo[-1]
        for p in parts:
            if isinstance(p, str):
                line.append(p)
            elif p is None:
                _end(out, line)
            elif p.mark < mark:
                if p.tag in BLOCKS:
                    _end(out, line)
                todo.append((p, iter(p.parts)))
                break
        else:
            todo.pop()
            if now.tag in BLOCKS:
                _end(out, line)


def _end(out: list[str], line: list[str]) -> None:
    text = SPACE.sub(" ", "".join(line)).strip()
    if text:
        out.append(text)
    line.clear()


def text_of(e: Element, mark: int = SOFT) -> str:
    """The blocks of e, without elements in it that have this mark or a stronger one."""
    out: list[str] = []
    line: list[str] = []
    _blocks(e, mark, out, line)
    _end(out, line)
    return "\n".join(out)


def _measure(root: Element, mark: int) -> None:
    """Scores: each block of prose counts its characters outside of links for the nearest container."""
    todo = [(root, None, None, False)]
    while todo:
        e, holder, prose, linked = todo.pop()
        if e.mark >= mark:
            continue
        if e.tag in CONTAINERS or e.mark:
            holder, prose = e, None
            e.score, e.heading = 0.0, 0
        elif e.tag in PROSE:
            prose = e
            if e.tag in ("h1", "h2") and holder is not None:
                holder.heading = max(holder.heading, 2 if e.tag == "h1" else 1)
        linked = linked or e.tag == "a"
        for p in e.parts:
            if isinstance(p, Element):
                todo.append((p, holder, prose, linked))
            elif p and holder is not None:
                n = len(p.strip())
                holder.score += (-n if linked else n if prose is not None else 0.5 * n)


def best(root: Element, containers: list[Element], mark: int = SOFT) -> Element | None:
    """The container with most prose of its own; wrapped articles count as one, with their title.

    Only containers that no mark of this strength is on or above count. Where marked ones count too, articles by their
    tag come first, then what has a title or is called an article.
    """
    _measure(root, mark)
    containers = [c for c in containers if c.above < mark]
    sums: dict[int, float] = {}
    for c in containers:  # prose two levels up counts in part, so sections of one article add up
        up, weight = c, 1.0
        for _ in range(3):
            if up is None or up.tag in ("html",):
                break
            if up.tag in CONTAINERS or up.mark:
                sums[id(up)] = sums.get(id(up), 0.0) + weight * max(0.0, c.score)
                weight *= 0.6
            if up.mark:  # what is marked is no part of what is around it
                break
            up = up.up
    claim = lambda c: 0 if mark == SOFT else 2 if c.inside else int(c.heading == 2 or c.content)
    found = max((c for c in containers if sums.get(id(c), 0) > 0), key=lambda c: (claim(c), sums[id(c)]), default=None)
    if found is None:
        return None
    if found.inside:
        e, article = found, None
        while e is not None and e.tag != "body":
            if e.tag in ("article", "main") and (article is None or e.tag == "article"):
                article = e
            e = e.up
        return article
    if not found.heading and found.up is not None and found.up.tag in CONTAINERS - {"body"} and found.up.heading:
        return found.up
    return found


def main_part(root: Element, containers: list[Element]) -> Element | None:
    """The page's own best container, if need be inside of what tags and classes mark as something else."""
    shut = best(root, containers)
    if shut is not None and shut.inside:
        return shut
    titled = any(c.heading == 2 for c in containers if c.above < SOFT)
    opened = best(root, containers, COMMENT)
    if opened is None or opened is shut or opened.above < SOFT:
        return shut
    if shut is None or opened.inside and (not titled or opened.heading == 2):
        return opened
    e = opened
    while e is not None and e.above >= SOFT:  # what it is marked by is also called an article, and the rest has no title
        if e.content and not titled:
            return opened
        e = e.up
    return shut


def extract(page: str | None, paths: list[str] | None) -> str:
    """The main text, from the containers on a winning path of the host if the page has any, else from its own best one."""
    if not page:
        return ""
    root, containers = parse(page)
    own = main_part(root, containers)
    paths = paths or []
    for path in [own.path] if own is not None and own.path in paths else paths:
        on = [c for c in containers if c.path == path and c.above < COMMENT]
        on = [c for c in on if c.above < SOFT] or on
        # an article in several containers of one kind; equal paths are equally deep, so none holds another
        if found := "\n".join(t for t in map(text_of, on) if t):
            return found
    for e in (own, root):
        if e is not None and (found := text_of(e)):
            return found
    for mark in (COMMENT, HARD, HARD + 1):
        own = best(root, containers, mark)
        if found := text_of(own or root, mark) or text_of(root, mark):
            return found
    return ""


def host(url: Column) -> Column:
    return F.coalesce(
        F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")
    )


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): how many of the host's pages have their best container on the path."""
    small_batches(pages.sparkSession)
    rows = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))

    def run(batches):
        for b in batches:
            count: Counter = Counter()
            for h, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                found = main_part(*parse(page)) if page else None
                if found is not None:
                    count[h, found.path] += 1
            keys = list(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(count.values()), pa.int64())],
                ["host", "path", "votes"],
            )

    return rows.mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


#: Besides the first, paths with so many of the host's votes win too, which are ten at most.
LEAST_SHARE, LEAST_VOTES = 0.1, 2


def winners(pages: DataFrame) -> DataFrame:
    """(host, paths): the path with most votes (of equals the longer one, then the first in order), then others with a good share."""
    voted = written(votes(pages), "votes")
    order = F.struct("votes", F.length("path").alias("n"), "path")
    sums = voted.groupBy("host").agg(F.sum("votes").alias("all"), F.max(order).alias("top"))
    enough = (F.col("votes") >= F.greatest(F.lit(LEAST_VOTES), F.lit(LEAST_SHARE) * F.col("all"))) | (F.col("path") == F.col("top.path"))
    kept = voted.join(sums, "host").where(enough)
    ranked = kept.groupBy("host").agg(F.sort_array(F.collect_list(order), False).alias("p"))
    return ranked.select("host", F.col("p.path").alias("paths"))


def main_text(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    paths = written(winners(pages), "paths").withColumnRenamed("host", "_host")
    few = paths.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("_at"))
    rows = rows.join(F.broadcast(paths) if few else paths, F.col("_at") == F.col("_host"), "left")
    rows = rows.select("page_id", "url", "html", "paths")

    def run(batches):
        for b in batches:
            texts = [extract(h, p) for h, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    fields = [rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return rows.mapInArrow(run, T.StructType(fields))
