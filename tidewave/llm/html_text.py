"""Main text of web pages by site style trees.

Operator 8. The pages of a host are merged into one style tree: its nodes are paths of elements with their classes (whole tokens), and each node
knows on how many pages it is, which styles (sequences of child elements) it has there, and on how many pages each text
directly in it appears. A node's presentation importance is the entropy of its styles, its content importance is 1 minus the
mean entropy of its texts over the pages (a text on every page tells nothing), both with the number of pages as the base of
the logarithm; together they are its importance. Branches of low importance are cut from each page. Pages of one host with the same
body count once, so mirrored pages don't make their text look like a frame: the body is the set of texts of at least LONG characters
that names don't cut, or of all texts that names don't cut where none is as long. Of pages with one body, the one whose blocks come
first in order counts. Counts of one text on many bodies are summed on each machine first, so a host with a third of all pages is no
heavier than its different texts.

All blocks of all pages are counted, whatever their names. On hosts with LEAST_PAGES different bodies or more, a block is cut if its text
stands on nearly all pages that have its node (importance under LEAST_TEXT), or if its node is of low importance; paragraphs and
headings directly in an article are cut by the first only. Texts on nearly all pages stay where they are most of a page's text:
then the pages are copies of one another. What the trees keep is checked by names, which alone decide on hosts with fewer pages:
elements that never are main text (navigation, footers, scripts ...) and those with a class, id or role that names such a part are
cut. A name is a token whose words all name such parts or say where and what shape they are (comments, ad-slot, site-footer, cookieConsent;
not has-sidebar or post-header). A few words also name what an article holds (legal, social, notice): on paragraphs, sections and the like in
an article they cut nothing. Elements that aren't displayed (hidden, display: none) are cut. A name cuts no element that holds an article or
main, unless the articles outside such elements have more text, and without articles outside none that holds most of the page's text.
Forms go by the same rule. Text outside articles is text like other text.

Texts: character references decoded, white space inside a block to one space, trimmed, blocks in page order joined by one space.
Null or empty html, and pages without main text, give an empty text. Pages without a url are one host. Repeated rows give
repeated rows. Other columns are ignored. Unclosed elements and cut-off pages are read as far as they go.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import cut

LEAST_PAGES = 8
#: Characters of a text by which bodies are told apart: dates, counters and the like are shorter.
LONG = 80
#: Nodes of lower importance are cut; CONTENT is the weight of content against presentation.
LEAST_IMPORTANCE, CONTENT = 0.35, 0.9
#: Texts of lower importance (1 - ln pages with it / ln pages with its node) are cut.
LEAST_TEXT = 0.05
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others part blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text.
NEVER = frozenset("head script style noscript template nav footer aside button select option textarea iframe object svg canvas audio video dialog menu".split())
#: Words in a class, id or role that name a part beside the main text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words that say where such a part is, or its shape.
AROUND_WORDS = frozenset(
    "area areas article bar bars block body bottom box boxes btn button buttons cell col column container content desktop entry feed fixed floating form frame global group holder icon icons inline inner item items label left link links list lists main mobile outer overlay page panel post posts primary right row secondary section site slot slots sticky text thread title top unit user users wrap wrapper zone".split()
)
#: Words of side parts that also name parts of an article, and the words beside which they do.
MILD_WORDS, OWN_WORDS = frozenset("banner footer header legal notice notices social".split()), frozenset("article block body content entry item items list page post posts section text title".split())
#: Elements that hold an article's text where a mild word is their class.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre section figure figcaption ul ol li dl dt dd table td th".split())
#: Elements whose text is prose where they stand directly in an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tr td th figure figcaption br hr".split())
#: Elements that a class can't make a side part: their classes describe the page.
WHOLE = frozenset(["html", "body", "main"])
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Attributes up to the end of a tag: a quote opens a value only behind an equals sign, as browsers read it.
_REST = r"(?>=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=])*+"
#: Comments, raw text, declarations and odd end tags, tags, and a tag that the page's end cuts off: browsers show none of it.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe)(?=[\s/>])(?P<rest>{_REST})>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<[!?][^>]*>|</[^a-zA-Z][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>{_REST})(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|\bstyle\s*=\s*[\"']?[^\"'>]*display\s*:\s*none", re.I)


@functools.lru_cache(maxsize=1 << 16)
def side_name(token: str) -> int:
    """Whether a token of a class, id or role names a side part: 2, 1 if mildly, 0 if not."""
    words = WORD.findall(HUMP.sub("-", token).lower())
    side = [w for w in words if w in ASIDE_WORDS]
    others = [w for w in words if w not in ASIDE_WORDS]
    if not side or not AROUND_WORDS.issuperset(others):
        return 0
    if MILD_WORDS.issuperset(side):
        return 0 if not OWN_WORDS.isdisjoint(others) else 1
    return 2


@dataclass
class Element:
    """An element: its name, its step in the path, its parent, whether its tag or its class names a side part, whether it is in an
    article, or directly prose there; characters of text in it, and of those in articles no class names."""

    name: str
    path: str
    parent: Element | None
    part: bool
    named: bool
    article: bool
    prose: bool
    children: list[str] = field(default_factory=list)
    size: int = 0
    told: int = 0
    cut: bool = False


@dataclass
class Block:
    """A run of text: its node, whether it is prose directly in an article, whether names cut it, and the text."""

    path: str
    prose: bool
    cut: bool
    text: str


def rule(elements: list[Element]) -> None:
    """Settle which elements names cut: elements are in page order, the first is the page."""
    clean = 0
    for e in elements[1:]:
        e.part = e.part or e.parent.part
    for e in reversed(elements[1:]):
        if not e.part:
            if e.name in ("article", "main") and not e.named:
                e.told = e.size
            e.parent.size += e.size
            e.parent.told += e.told
    boxed = {id(elements[0]): False}
    for e in elements[1:]:
        boxed[id(e)] = inside = boxed[id(e.parent)] or e.named
        if e.name in ("article", "main") and not e.part and not inside and not (e.parent.article):
            clean += e.told
    for e in elements[1:]:
        holds = clean < e.told or (not clean and (2 * e.size > elements[0].size or e.name == "article"))
        e.cut = e.parent.cut or e.part or (e.named and not holds)


def parse(page: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """The blocks of a page, and the style (child elements) of each element that is not inline."""
    stack = [Element("", "", None, False, False, False, False)]
    elements = [stack[0]]
    runs: list[tuple[Element, str]] = []
    styles: list[tuple[str, str]] = []
    pending: list[str] = []
    place = stack[0]

    def flush() -> None:
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                runs.append((place, text))
                place.size += len(text)

    def close(to: int) -> None:
        nonlocal place
        while len(stack) > to:
            gone = stack.pop()
            if gone.name not in INLINE:
                flush()
                styles.append((gone.path, ",".join(k for i, k in enumerate(gone.children) if i == 0 or gone.children[i - 1] != k)))
        place = next(e for e in reversed(stack) if e.name not in INLINE)

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            pending.append(page[at : token.start()])
        at = token.end()
        if token["raw"] or not token["name"]:
            continue  # comments, declarations and raw text hold nothing that is shown here
        name = token["name"].lower()
        if token["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
            continue
        if name in INLINE:
            if name not in VOID:
                stack.append(Element(name, place.path, place, place.part, False, place.article, place.prose))
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if name in ENDS_P or name == "li":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == ("li" if name == "li" else "p"):
                    close(k)
                    break
                if stack[k].name not in INLINE:
                    break
        flush()
        marks = " ".join(v for m in ATTRIBUTE.finditer(token["attributes"]) for v in m.groups()[1:] if v) if token["attributes"] else ""
        words = set(WORD.findall(marks.lower()))
        # classes by whole tokens; ids and the classes of a whole page are often numbers of it
        classes = {t for m in ATTRIBUTE.finditer(token["attributes"]) if m[1].lower() == "class" for v in m.groups()[1:] if v for t in v.split()} if marks and name not in WHOLE else set()
        step = name + ("." + ".".join(sorted(classes)) if classes else "")
        place.children.append(step)
        strength = max(map(side_name, marks.split()), default=0) if marks and name not in WHOLE else 0
        named = name == "form" or strength > (1 if place.article and name in TEXTUAL else 0)
        hidden = bool(token["attributes"]) and name not in WHOLE and HIDDEN.search(token["attributes"]) is not None
        prose = name in ("article", "main") or (place.prose and name in PROSE and not words)
        place = Element(name, f"{place.path}/{step}", place, name in NEVER or hidden or (name == "header" and not place.article), named, place.article or name in ("article", "main"), prose)
        elements.append(place)
        stack.append(place)
        if token["attributes"].endswith("/") and name == "svg":
            close(len(stack) - 1)
    pending.append(page[at:])
    flush()
    close(1)
    rule(elements)
    return [Block(e.path, e.article and e.prose, e.cut, text) for e, text in runs], styles


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


def key(what: str) -> int:
    """A 64-bit hash: nodes and texts are counted by it, however long they are."""
    return int.from_bytes(blake2b(what.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def style_trees(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, node, importance, pages) of the nodes on LEAST_PAGES pages or more, and (host, node, what, importance) of their texts."""

    kind = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("what", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, styles = parse(page or "")
                if not blocks:
                    continue
                nodes = {b.path: key(b.path) for b in blocks}
                whats = {b.text: key(b.text) for b in blocks}
                seen = {(nodes[b.path], 0, whats[b.text]) for b in blocks}
                seen.update((nodes[path], 1, key(style)) for path, style in styles if path in nodes)
                seen.update((node, 2, 0) for node in nodes.values())
                mine = {whats[b.text] for b in blocks if not b.cut and len(b.text) >= LONG} or {whats[b.text] for b in blocks if not b.cut}
                at, rows = (host, key(",".join(map(str, sorted(mine))))), sorted(seen)
                if at not in best or rows < best[at]:
                    best[at] = rows
            if best:
                flat = [r for rows in best.values() for r in rows]
                offsets = list(accumulate((len(rows) for rows in best.values()), initial=0))
                node, sort, what = zip(*flat, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(sort, pa.int32()), pa.array(what, pa.int64())], fields=list(kind)))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([k for _, k in best], pa.int64()), lists], ["host", "body", "seen"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, body long, seen array<struct<node: long, kind: int, what: long>>")
    bodies = rows.groupBy("host", "body").agg(F.min("seen").alias("seen"))
    counts = bodies.select("host", F.explode("seen").alias("s")).groupBy("host", "s.node", "s.kind", "s.what").agg(F.count("*").alias("n"))
    counts = cut(counts, "style-counts")
    x = F.col("n").cast("double")
    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("pages"),
        F.avg(F.when(F.col("kind") == 0, F.log(x))).alias("mean_log"),
        F.sum(F.when(F.col("kind") == 1, x * F.log(x))).alias("style_log"),
        F.sum(F.when(F.col("kind") == 1, x)).alias("style_n"),
    )
    nodes = nodes.where(F.col("pages") >= LEAST_PAGES)
    base = F.log(F.col("pages").cast("double"))
    content = F.lit(1.0) - F.least(F.col("mean_log") / base, F.lit(1.0))
    look = (F.log("style_n") - F.col("style_log") / F.col("style_n")) / base
    both = F.lit(CONTENT) * F.coalesce(content, F.lit(0.0)) + F.lit(1 - CONTENT) * F.coalesce(look, F.lit(0.0))
    # only a text on at least this many pages can be under LEAST_TEXT: few rows meet the nodes
    often = counts.where((F.col("kind") == 0) & (x >= LEAST_PAGES ** (1 - LEAST_TEXT)))
    texts = often.join(nodes.select("host", "node", "pages"), ["host", "node"]).select("host", "node", "what", (F.lit(1.0) - F.log(x) / base).alias("importance"))
    return nodes.select("host", "node", both.alias("importance"), "pages"), texts


def kept_blocks(blocks: list[Block], low: set[int], everywhere: set[tuple[int, int]]) -> list[Block]:
    """The main text of a page: what its host's tree keeps, checked by names."""
    if low or everywhere:
        nodes = [key(b.path) for b in blocks]
        stay = [(b, n) for b, n in zip(blocks, nodes, strict=True) if b.prose or n not in low]
        rare = [b for b, n in stay if (n, key(b.text)) not in everywhere]
        named = sum(len(b.text) for b, _ in stay if not b.cut)
        copies = 2 * sum(len(b.text) for b in rare if not b.cut) < named
        blocks = [b for b, _ in stay] if copies else rare
    return [b for b in blocks if not b.cut]


def main_text(pages: DataFrame, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))
    nodes, texts = style_trees(pages)
    noise = nodes.where(F.col("importance") < least_importance).select("host", "node", F.lit(None).cast("long").alias("what"))
    noise = noise.unionByName(texts.where(F.col("importance") < LEAST_TEXT).select("host", "node", "what"))
    noise = noise.groupBy("host").agg(F.collect_list(F.when(F.col("what").isNull(), F.col("node"))).alias("noise"), F.collect_list(F.when(F.col("what").isNotNull(), F.struct("node", "what"))).alias("everywhere"))
    noise = cut(noise, "style-trees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, low, everywhere in zip(*(batch.column(k).to_pylist() for k in ("html", "noise", "everywhere")), strict=True):
                blocks, _ = parse(page)
                kept = kept_blocks(blocks, set(low or ()), {(e["node"], e["what"]) for e in everywhere or ()})
                texts.append(" ".join(b.text for b in kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = pages.join(noise, "host", "left").select("page_id", "url", "html", "noise", "everywhere")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
