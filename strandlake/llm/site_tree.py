"""HTML extraction with a site style tree.

The pages of a host are merged by their elements' paths. For each path the tree
knows how many pages have it, how its presentation (the sequence of child
elements) varies and how evenly each block of text recurs. An element's
importance combines the entropy of its presentation with how little its
content recurs. Its role is the prior: what is in an article goes only where
it recurs almost everywhere, what stands beside one stays only where it hardly
ever recurs, a menu or an advert never stays.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.lineage import stash
from strandlake.llm import text as tx
from strandlake.llm.store import bounded


#: Comments, declarations and tags. Quotes count only where they begin a value, and one that is not closed is as any other character. A tag always matches; where it reaches the end of the page, its last group is empty.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\s/>=]++|[\s/]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)?)*+)(>?)""", re.S)
#: The same without quotes, from the first tag on that only ends where they are not minded.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>?)", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>|\Z", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "select", "object")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("ul ol dl table article section div main body aside nav form blockquote".split())
#: Elements, and words of class, id and role, that are no part of an article.
_ASIDE_TAGS = frozenset("nav footer aside form button dialog menu".split())
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer contentinfo complementary comment comments disqus respond replies reply share sharing social related recommended widget pagination pager login search copyright".split()
)
_HEAD_WORDS = frozenset("header masthead topbar".split())
#: Words that say nothing beside one of those; any other makes a name such as has-sidebar or related-work mean something else.
_NEUTRAL = frozenset(
    "area article articles bar block blocks body bottom box btn button buttons card center col column container content contents desktop div entry first fixed form global group grid header holder icon icons id image img inline inner "
    "item items js label large last latest layout left level line link links list lists main media menu message mini mobile module more new outer page pane panel placeholder post posts primary region right row secondary section side site slot small space sticky "
    "text title toggle tool tools top ui unit view wrap wrapper zone".split()
)
_MAIN = frozenset("article main".split())
#: What replies to an article may be longer than it.
_REPLIES = frozenset("comment comments disqus respond replies reply".split())
#: Blocks go where their importance is known to be below this; those beside an article also where their path's is not known, or below OPEN.
OPEN = 0.4
LEASTS = {"main": 0.1, "": 0.25, "beside": 0.75}
#: Elements that a path tells of at most.
DEEP = 100
#: A path that fewer pages of a host share tells nothing; twice as many must share one inside an article.
PAGES = 4
#: Rows of the tree that go to every task at most, about 150 bytes each there.
BROADCAST = 200_000


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


@dataclass
class _Element:
    tag: str
    path: str
    named: str = ""
    above: _Element | None = None
    #: Whether an article or main part is in it, its characters of text (those of menus and replies left out), and its role, set at the end of the page.
    holds: bool = False
    size: int = 0
    role: str = ""
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """Blocks (path, role, text) in page order, and (path, role, children) of every element that has any."""

    blocks: list[tuple[str, str, str]]
    elements: list[tuple[str, str, str]]


@lru_cache(100_000)
def _named(values: str) -> str:
    """What an element's class, id and role make it: replies, aside, head, or nothing."""
    found = set()
    for name in values.lower().split():
        parts = set(_PART.findall(name))
        for kind, words in (("replies", _REPLIES), ("aside", _ASIDE_WORDS), ("head", _HEAD_WORDS)):
            if parts & words and not any(len(p) > 2 and not p.isdigit() and p not in _NEUTRAL and p not in _ASIDE_WORDS and p not in _HEAD_WORDS for p in parts):
                found.add(kind)
    return next((kind for kind in ("replies", "aside", "head") if kind in found), "")


def _role(e: _Element, within: int) -> str:
    """Role of an element whose parent has its own; ``within`` is the text of the article that holds it, or of a page without one.

    Words, a form or a header make nothing aside that is or holds an article;
    nor do words and forms, those of replies apart, where they hold half of the text.
    """
    above = e.above.role
    if above == "aside" or e.tag in _ASIDE_TAGS and e.tag != "form":
        return "aside"
    if e.tag in ("html", "body") or e.tag in _MAIN or e.holds:
        return "main" if e.tag in _MAIN else above
    if e.named == "replies" or (e.tag == "form" or e.named == "aside") and not 0 < within <= 2 * e.size:
        return "aside"
    if above != "main" and (e.tag == "header" or e.named == "head"):
        return "aside"
    return above


def _set_roles(every: list[_Element]) -> None:
    """Roles of a page's elements, parents first; the first one is the root."""
    for e in reversed(every[1:]):
        e.above.holds |= e.holds or e.tag in _MAIN
        if e.holds or e.tag in ("html", "body") or e.tag == "form" or not (e.tag in _ASIDE_TAGS or e.named == "replies"):
            e.above.size += e.size
    within = {id(every[0]): 0 if every[0].holds else every[0].size}
    for e in every[1:]:
        e.role = _role(e, within[id(e.above)])
        within[id(e)] = e.size if e.tag in _MAIN else within[id(e.above)]


def _values(attributes: str) -> str:
    """Values of class, id and role, one space between any two."""
    return " ".join(" ".join((v[1] or v[2] or v[3] or "").replace("/", "-").split()) for v in _NAMED.finditer(attributes))


def _ends(html: str, tag: str) -> dict[int, int]:
    """Where each inline element that begins at a place ends, those of its kind inside it counted; one that never ends is left out."""
    begun, out = [], {}
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(html):
        if not m[1]:
            begun.append(m.start())
        elif begun:
            out[begun.pop()] = m.end()
    return out


def parse(html: str) -> Page:
    """Blocks of a page's text. Elements left open end with what holds them; scripts, styles and comments have no text."""
    root = _Element("", "")
    every, blocks, elements = [root], [], []
    stack, buffer, at, n, token = [root], [], 0, len(html), _TOKEN
    opened: dict[str, list[int]] = {}
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                top = stack[-1]
                top.size += len(text)
                blocks.append((top, text))

    def close() -> None:
        e = stack.pop()
        opened[e.tag].pop()
        if e.children:
            elements.append(e)

    def last(tags: tuple[str, ...] | frozenset[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def close_to(tags: tuple[str, ...], stop: frozenset[str]) -> None:
        k = last(tags)
        if k and k >= last(stop):
            while len(stack) > k:
                close()

    while at < n:
        m = token.search(html, at)
        if m is not None and m[4] == "" and token is _TOKEN:
            token = _PLAIN
            continue
        if m is None or m[4] == "":
            buffer.append(html[at:])
            break
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in _INLINE:
            if tag == "br":
                buffer.append(" ")
            if not m[1] and tag not in _VOID and m[3] and _named(_values(m[3])) in ("replies", "aside"):
                if tag not in ends:
                    ends[tag] = _ends(html, tag)
                at = ends[tag].get(m.start(), at)
            continue
        flush()
        if m[1]:
            close_to((tag,), frozenset() if tag in _HOLDS else _HOLDS)
            continue
        if tag in _RAW:
            at = _RAW[tag].search(html, at).end()
            continue
        if tag in _VOID:
            continue
        close_to(("p",), _HOLDS)
        if tag in _CLOSES:
            close_to(_CLOSES[tag], frozenset(("ul", "ol", "dl", "table")))
        above = stack[-1]
        values = _values(m[3]) if m[3] else ""
        above.children.append(tag)
        # what lies deeper has the path of the element at that depth
        path = f"{above.path}/{tag}{'.' if values else ''}{values.lower()}" if len(stack) <= DEEP else above.path
        opened.setdefault(tag, []).append(len(stack))
        stack.append(_Element(tag, path, _named(values), above))
        every.append(stack[-1])
    flush()
    while len(stack) > 1:
        close()
    _set_roles(every)
    if any(e.role == "main" for e, _ in blocks):
        for e in every:
            e.role = e.role or "beside"
    return Page([(e.path, e.role, text) for e, text in blocks], [(e.path, e.role, " ".join(e.children)) for e in elements])


def _host(url: str | None) -> str:
    """Host of an address, lower-cased; none for a null or other text."""
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _branch(role: str, path: str, text: str | None = None) -> int:
    """Number of a path in a role, or of a text on it."""
    return _number(f"{role}\n{path}" if text is None else f"{role}\n{path}\n{text}")


_FACTS = "host string, path string, role string, kind string, value long, branch long"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page adds to the tree: its paths, their children and the blocks under them, each once."""
    for batch in tx.released(batches):
        rows = []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page, host = parse(html or ""), _host(url)
            facts = {(p, r, "page", 0, _branch(r, p)) for p, r, _ in (*page.elements, *page.blocks)}
            facts |= {(p, r, "style", _number(c), 0) for p, r, c in page.elements} | {(p, r, "text", _number(t), _branch(r, p, t)) for p, r, t in page.blocks}
            rows += [(host, *f) for f in facts]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["host", "path", "role", "kind", "value", "branch"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["host", "path", "role", "kind", "value", "branch"])


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, role, kind, value, branch, n, m, importance): every presentation and block of every path of a host, with the pages that have it, n of m.

    A block on n of m pages, spread evenly, has the entropy log n / log m and
    the importance one less it; a path's presentation has the entropy of its
    variants, to the base m. A null or empty page adds nothing, a null or odd
    url counts as one host, repeated rows count as often as they come, other
    columns are not read, and an empty table gives an empty tree.
    """
    facts = bounded(pages).select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(_facts, _FACTS)
    counted = stash(facts.groupBy("host", "path", "role", "kind", "value", "branch").agg(F.count("*").alias("n")), "tree")
    nodes = counted.where("kind = 'page'").select("host", "path", "role", "branch", F.col("n").alias("m"))
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    base = F.ln(F.greatest(F.col("m"), F.lit(2)))
    # a row for each path: broadcast where few enough, so that no task has all texts of a path
    few = nodes.drop("branch")
    parts = counted.where("kind <> 'page'").join(F.broadcast(few) if few.limit(BROADCAST + 1).count() <= BROADCAST else few, ["host", "path", "role"])
    single = F.when(F.col("kind") == "text", 1 - F.ln("n") / base)
    variant = F.when(F.col("kind") == "style", -(F.col("n") / F.col("m")) * F.ln(F.col("n") / F.col("m")) / base)
    sums = parts.groupBy("host", "path", "role").agg(F.sum(variant).alias("_styles"), (F.sum(F.col("n") * single) / F.sum(F.when(F.col("kind") == "text", F.col("n")))).alias("_texts"))
    whole = nodes.join(sums, ["host", "path", "role"], "left").select("host", "path", "role", F.lit("node").alias("kind"), F.lit(0).cast("long").alias("value"), "branch", F.col("m").alias("n"), "m", held(F.coalesce((F.col("_styles") + F.col("_texts")) / 2, "_texts", F.lit(1.0))).alias("importance"))
    return whole.unionByName(parts.where("kind = 'text'").select("host", "path", "role", "kind", "value", "branch", "n", "m", held(single).alias("importance")))


def branches(page: Page) -> set[int]:
    """Numbers of what the tree may tell of a page: its texts, and its paths with those above them."""
    out = {_branch(role, path, text) for path, role, text in page.blocks if role != "aside"}
    for path, role in {(path, role) for path, role, _ in page.blocks if role in ("", "beside")}:
        out |= {_branch(role, p) for p in _above(path)}
    return out


def _above(path: str) -> list[str]:
    """A path and those above it."""
    return [path[:k] for k in [*(y.start() for y in re.finditer("/", path)), len(path)] if k]


def keep(page: Page, verdicts: set[int]) -> str:
    """Text of a page's blocks, less the branches of low importance.

    ``verdicts`` has the numbers of texts of low importance, and of paths: of
    low importance, or, beside an article, of high. A page all of whose article
    recurs is a copy: it keeps it.
    """
    low = [_branch(role, path, text) in verdicts for path, role, text in page.blocks] if verdicts else [False] * len(page.blocks)
    copy = all(x for x, (_, role, _) in zip(low, page.blocks, strict=True) if role == "main")
    kept = []
    for x, (path, role, text) in zip(low, page.blocks, strict=True):
        if role == "aside" or (x and not (role == "main" and copy)):
            continue
        if role == "beside" and _branch(role, path) not in verdicts:
            continue
        if role == "" and verdicts and any(_branch(role, p) in verdicts for p in _above(path)):
            continue
        kept.append(text)
    return "\n".join(kept)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, host, branch): what the tree is asked of each page."""
    for batch in tx.released(batches):
        rows = []
        for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            host = _host(url)
            rows += [(page, host, b) for b in branches(parse(html or ""))]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["page", "host", "branch"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["page", "host", "branch"])


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html but with text, the main text of the whole page, and n_chars, its code points.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line feed. A null or empty page has an empty
    text; a null or odd url counts as one host; repeated rows are each
    extracted; clashing columns are replaced; an empty table stays empty.

    The tree's rows that decide against a role's prior go to every task where
    they are few; else each page asks for its own branches by a join on
    (host, branch), and no page or task holds those of a whole host.
    """
    tree = style_tree(pages, url_col, html_col)
    least = F.coalesce(*[F.when(F.col("role") == r, F.lit(x)) for r, x in LEASTS.items()])
    node, below = F.col("kind") == "node", F.col("importance") < least
    known = F.col("m") >= F.when(F.col("role") == "main", 2 * PAGES).otherwise(PAGES)
    tells = F.when(node, ((F.col("role") == "") & below) | ((F.col("role") == "beside") & (F.col("importance") >= OPEN))).otherwise(below)
    low = stash(tree.where(known & tells).select("host", "branch"), "low")
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    out = [c for c in kept if c != html_col]
    rows = bounded(pages).select(*out, F.col(html_col).cast("string").alias("_html"), F.col(url_col).cast("string").alias("_url"))
    schema = T.StructType([*pages.select(*out).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    n, shared = len(out), None
    if low.limit(BROADCAST + 1).count() <= BROADCAST:
        by_host = defaultdict(set)
        for r in low.collect():
            by_host[r["host"]].add(r["branch"])
        shared = pages.sparkSession.sparkContext.broadcast(dict(by_host))
        rows = rows.withColumn("_low", F.lit(None).cast("array<long>"))
    else:
        page = F.xxhash64("_url", "_html")
        asked = rows.select(page.alias("page"), "_url", "_html").mapInArrow(_asked, "page long, host string, branch long")
        told = asked.join(low, ["host", "branch"]).groupBy(F.col("page").alias("_page")).agg(F.collect_set("branch").alias("_low"))
        rows = rows.withColumn("_page", page).join(told, "_page", "left").select(*out, "_html", "_url", "_low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: set[int] = set()
        for batch in tx.released(batches):
            texts = []
            for html, url, own in zip(*(batch.column(k).to_pylist() for k in (n, n + 1, n + 2)), strict=True):
                texts.append(keep(parse(html or ""), set(own or ()) if shared is None else shared.value.get(_host(url), none)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*out, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
