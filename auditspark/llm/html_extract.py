"""Main text of web pages: site templates are found by counting subtrees per host.

Every page is parsed into a tree. The hashes of its block subtrees (tag, marks and
text, from the leaves up) are counted per host in Spark, inside and outside articles; a
subtree in at least ``MANY`` different articles of a host, however large the host, is
the site's template and is deleted. Copies of an article count once, and near copies not at
all: an article is evidence for a subtree if at least ``OWN`` of its other text is in
blocks that do not recur. What a site puts into its articles stands at the same place
in them, a line that only happens to recur does not: inside articles a template is what at
least ``PLACED`` of those that hold it hold at one place among its neighbours, counted
from the first or from the last. There lists and tables are judged whole, and headings
with the section they stand in. What elements and class names mark as menus,
notices, adverts, forms, comments and the like is deleted too; inside an article only
elements of these kinds and classes that name one of them outright count, so that no
other part of it is lost for its class. The blocks of the article, or of what is left
of the body where a page has none, are the text.

Scale: the counts travel as (host, hash) rows with partial sums, so a host with a third
of all pages is no hot spot; no host's templates are ever gathered: they are joined
back by (host, hash), and a page receives only its own.

Edge cases: null or empty html gives empty text; a null url is a host of its own; broken
markup is read as browsers do (open paragraphs end at the next block, what is not a tag
is text); repeated rows are pages of their own but count once as evidence; character
references are decoded once.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as B
from .storage import Scratch, with_columns_free

#: Different articles of a host that make a subtree a template.
MANY = 10
#: Share of an article's other text that does not recur, for it to be evidence.
OWN = 0.5
#: Share of the articles with a subtree that have it at one place.
PLACED = 0.5

# HTML element names by role.
_RAW = frozenset("script style noscript template textarea title iframe select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_SKIP_INSIDE = frozenset("head nav footer aside form button menu dialog label fieldset desc metadata".split()) | _RAW
_SKIP = _SKIP_INSIDE | {"header"}
#: Judged with what they are parts of, inside an article.
_PARTS = frozenset("li dt dd tr td th tbody thead tfoot caption option optgroup legend h1 h2 h3 h4 h5 h6 hgroup".split())
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
#: Words in class, id or role that mark what is not the article.
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|nav|navigation|navbar|menu|breadcrumbs?|header|masthead|footer|foot"
    r"|sidebar|side|aside|complementary|widgets?|comments?|commentlist|respond|replies|reply|disqus|social|share|sharing|related|recommended|newsletter|subscribe|subscription|signup"
    r"|login|search|form|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|paywall|pagination|pager|toolbar|skip|hidden|sr-only|copyright|legal|disclaimer|contentinfo)(?:$|[\s_\d-])",
    re.I,
)
#: Whole class names, ids and roles that mark what does not belong to the article it stands in.
_MARKED_INSIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored ad-box ad-slot ad-banner comment comments commentlist comment-list comments-area reader-comments respond replies disqus_thread"
    " nav navigation navbar menu breadcrumb breadcrumbs sidebar footer notice notices cookie-notice cookie-banner cookie-consent newsletter-form".split()
)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """``skip`` says that the element is none of a page's text, ``alien`` that it is none of the article's it stands in."""

    __slots__ = ("alien", "children", "hash", "marks", "skip", "tag")

    def __init__(self, tag: str, marks: str = "", skip: bool = False, alien: bool = False):
        self.tag, self.marks, self.skip, self.alien = tag, marks, skip, alien
        self.children: list[Node | str] = []
        self.hash = 0


def _open(stack: list[Node], tag: str, attributes: str) -> None:
    if tag in _ENDS_P:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in _BLOCK:
                break
    if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag or {stack[i].tag, tag} <= {"dd", "dt"} or {stack[i].tag, tag} <= {"td", "th"}:
                del stack[i:]
                break
            if stack[i].tag in ("ul", "ol", "dl", "select", "table", "tbody", "thead", "tfoot", "menu"):
                break
            if tag in ("td", "th") and stack[i].tag == "tr":
                break
    marks = " ".join(m[2] or m[3] or m[4] or "" for m in _MARKS.finditer(attributes)) if attributes else ""
    hidden = bool(attributes and _HIDDEN.search(attributes))
    skip = hidden or tag in _SKIP or bool(marks and tag not in ("html", "body", "main") and _MARKED.search(marks))
    alien = hidden or tag in _SKIP_INSIDE or bool(marks and not _MARKED_INSIDE.isdisjoint(marks.lower().split()))
    node = Node(tag, marks, skip, alien)
    stack[-1].children.append(node)
    if tag not in _VOID and not attributes.endswith("/"):
        stack.append(node)


def parse(text: str) -> Node:
    root = Node("#")
    stack, at, low = [root], 0, text.lower()
    for m in iter(lambda: _TAG.search(text, at), None):
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                # A closing tag of an inline element does not close blocks.
                if stack[i].tag in _BLOCK and tag not in _BLOCK:
                    break
        elif tag in _RAW:
            stack[-1].children.append(Node(tag, "", True, True))
            end = low.find(f"</{tag}", at) if not (m[3] or m[6] or "").endswith("/") else at
            if end < 0:
                end = len(text)
            if end > at:
                close = text.find(">", end)
                at = len(text) if close < 0 else close + 1
        else:
            _open(stack, tag, m[3] or m[6] or "")
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def _hash(node: Node, found: list[Node]) -> int:
    """Hashes the subtree; block subtrees with text or children go to ``found``."""
    stack = [(node, False)]
    while stack:
        n, ready = stack.pop()
        if not ready:
            stack.append((n, True))
            stack.extend((c, False) for c in n.children if not isinstance(c, str))
            continue
        parts = [n.tag, n.marks]
        for c in n.children:
            if isinstance(c, str):
                if c := _SPACE.sub(" ", c).strip():
                    parts.append(c)
            else:
                parts.append(f"\x00{c.hash}")
        n.hash = xxhash.xxh3_64_intdigest("\x01".join(parts)) - (1 << 63)
        if n.tag in _BLOCK and n.tag not in ("html", "body") and len(parts) > 2:
            found.append(n)
    return node.hash


def _kept_articles(root: Node) -> list[Node]:
    """The outermost article elements that nothing marks as something else, or main elements.

    If all stand in marked wrappers ("with-sidebar"), those do not count as marked.
    """
    for wanted, through in (("article", False), ("main", False), ("article", True), ("main", True)):
        found, stack = [], [root]
        while stack:
            n = stack.pop()
            if n.skip and (n.tag in _SKIP or n.tag == wanted or not through):
                continue
            if n.tag == wanted or (wanted == "main" and n.marks and "main" in n.marks.lower().split()):
                found.append(n)
                continue
            stack.extend(c for c in reversed(n.children) if not isinstance(c, str))
        if found:
            return found
    return []


def _lengths(top: Node, units: set[int], article: bool) -> dict[int, tuple[int, int]]:
    """By id of the nodes whose text is kept: characters, and those in no unit below the node."""
    out: dict[int, tuple[int, int]] = {}
    stack = [(top, False)]
    while stack:
        n, ready = stack.pop()
        below = [c for c in n.children if not isinstance(c, str) and not (c.alien if article else c.skip)]
        if not ready:
            stack.append((n, True))
            stack.extend((c, False) for c in below)
            continue
        own = sum(len(_SPACE.sub(" ", c).strip()) for c in n.children if isinstance(c, str))
        out[id(n)] = (own + sum(out[id(c)][0] for c in below), own + sum(out[id(c)][1] for c in below if id(c) not in units))
    return out


def page_subtrees(text: str) -> dict[tuple[int, int], tuple[int, int, int, int, int]]:
    """By (subtree, content it stands in) characters of the content, the subtree, and the subtree alone, and its places from the first and the last of its neighbours.

    The content is the hash of the article, or of the page without one. Subtrees that are not in the text have no characters,
    and those outside articles no place.
    """
    root = parse(text)
    found: list[Node] = []
    _hash(root, found)
    articles = _kept_articles(root)
    inside: dict[int, Node] = {}
    place: dict[int, tuple[int, int]] = {}
    for a in articles:
        stack = [a]
        while stack:
            n = stack.pop()
            inside[id(n)] = a
            below = [c for c in n.children if not isinstance(c, str)]
            place |= {id(c): (i, len(below) - 1 - i) for i, c in enumerate(below)}
            stack.extend(below)
    whole = xxhash.xxh3_64_intdigest(repr([a.hash for a in articles])) - (1 << 63) if articles else root.hash
    tops = {id(a) for a in articles}
    found = [n for n in found if id(n) not in tops and not (id(n) in inside and n.tag in _PARTS)]
    units = {id(n) for n in found}
    lengths: dict[int, tuple[int, int]] = {}
    totals: dict[int, int] = {}
    for a in articles or [root]:
        got = _lengths(a, units, bool(articles))
        totals[a.hash] = totals.get(a.hash, 0) + got[id(a)][0]
        lengths |= got
    out: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    for n in found:
        a = inside.get(id(n), None if articles else root)
        content = a.hash if a else whole
        one, alone = lengths.get(id(n), (0, 0))
        _, s, d, *at = out.get((n.hash, content), (0, 0, 0, *place.get(id(n), (0, 0))))
        out[n.hash, content] = (totals[content] if a else 0, s + one, d + alone, *at)
    return out


def main_text(text: str, templates: set[int]) -> str:
    """The article's blocks, joined by blank lines."""
    root = parse(text)
    if templates:
        _hash(root, [])
    articles = _kept_articles(root)
    inside, kept = bool(articles), _PARTS if articles else frozenset()
    articles = articles or [root]
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            if block := _SPACE.sub(" ", html.unescape("".join(held))).strip():
                blocks.append(block)
            held.clear()

    for article in articles:
        stack: list[Node | str | None] = [article]
        while stack:
            n = stack.pop()
            if n is None:
                close()
            elif isinstance(n, str):
                held.append(n)
            elif n.tag == "br":
                held.append(" ")
            elif n is not article and ((n.alien if inside else n.skip) or (templates and n.hash in templates and n.tag in _BLOCK and n.tag not in kept)):
                if n.tag in _BLOCK:
                    close()
                else:
                    held.append(" ")
            else:
                if n.tag in _BLOCK:
                    close()
                    stack.append(None)
                stack.extend(reversed(n.children))
        close()
    return "\n\n".join(blocks)


def _host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def templates(pages: DataFrame) -> DataFrame:
    """(k, templates): for the pages of (k, url, html) that have any, their template hashes."""

    def run(batches):
        for batch in B.small_batches(batches):
            found = []
            for k, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = page_subtrees(text) if text else {}
                host = _host(url)
                found.extend((k, host, h, content, *n) for (h, content), n in own.items())
            types = (pa.int64(), pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=["k", "host", "h", "content", "total", "chars", "alone", "first", "last"])

    scratch = Scratch(pages.sparkSession, "subtrees")
    rows = pages.mapInArrow(run, "k long, host string, h long, content long, total long, chars long, alone long, first int, last int")
    rows = scratch.save(rows.withColumn("host", F.xxhash64("host")))

    def recurring(df: DataFrame) -> DataFrame:
        return df.groupBy("host", "h").agg(F.count_distinct("content").alias("n")).where(F.col("n") >= MANY).select("host", "h")

    held = rows.join(recurring(rows), ["host", "h"], "left_semi")
    held = scratch.save(held.groupBy("k", "host").agg(F.collect_set(F.struct("h", "content", "total", "chars", "alone", "first", "last")).alias("found")))
    scratch.drop(rows)

    def evidence(x):
        # The content's text that is in no common subtree, against all of it outside this one.
        shared = F.aggregate(F.filter("found", lambda y: y["content"] == x["content"]), F.lit(0).cast("long"), lambda n, y: n + y["alone"])
        return (x["chars"] == 0) | (x["total"] - shared >= OWN * (x["total"] - x["chars"]))

    seen = held.select("host", F.explode(F.filter("found", evidence)).alias("x")).select("host", "x.h", "x.content", "x.first", "x.last")
    seen = scratch.save(seen.distinct())

    def placed(at: str) -> DataFrame:
        return seen.groupBy("host", "h", at).agg(F.count_distinct("content").alias("c")).groupBy("host", "h").agg(F.max("c").alias(f"by_{at}"))

    counts = seen.groupBy("host", "h").agg(F.count_distinct("content").alias("n")).where(F.col("n") >= MANY)
    counts = counts.join(placed("first"), ["host", "h"]).join(placed("last"), ["host", "h"])
    common = scratch.save(counts.where(F.greatest("by_first", "by_last") >= PLACED * F.col("n")).select("host", "h"))
    rows = held.select("k", "host", F.explode("found.h").alias("h"))
    return scratch.save(rows.join(common, ["host", "h"], "left_semi").groupBy("k").agg(F.collect_set("h").alias("templates")))


def extracted(spark: SparkSession, pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every page with text and n_chars."""
    keep = [k for k in keep if k not in ("text", "n_chars")]
    given = with_columns_free(pages, "k", "templates")
    key = F.xxhash64("url", "html").alias("k")
    found = templates(given.select(key, F.col("url").cast("string"), F.col("html").cast("string")))
    rows = given.select(*keep, key, F.col("html").cast("string").alias("_html")).join(found.hint("merge"), "k", "left").select(*keep, "_html", "templates")
    n = len(keep)

    def run(batches):
        for batch in B.small_batches(batches):
            texts = [main_text(t, set(x or ())) if t else "" for t, x in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join([*(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep), "text string, n_chars long"])
    return rows.mapInArrow(run, schema)
