"""Main text of web pages by a site style tree.

After Yi, Liu and Li ("Eliminating Noisy Information in Web Pages for Data Mining", KDD 2003): the
pages of a host are merged into one tree. A block element is known by its path of tags, classes and
ids (digits set to ``#``); inline elements belong to their block. On a page a node has a style, the
sequence of its child blocks, and contents: the sentences of its text and its link targets.

- Importance of a content is ``exp(-H)``, with H the entropy of its distribution over pages, that is
  one over the number of pages that hold it at this node. H mixes the count on the host, by
  ``n / (n + HOST_PAGES)`` of the node's n pages there, with the count over all hosts: adverts and
  legal lines are shared by sites, and small sites repeat too little to tell.
- Content importance of a node is the mean importance of its contents, weighed by words, mixed in the
  same way with that of the node on all hosts. Composite importance averages it over the node and its
  descendants, weighing each level by ``DECAY``.
- A node that few pages hold leans on its parent: that counts as ``PARENT_PAGES`` pages. What mark-up
  declares (navigation, page head or foot, sidebar, notice, advert) counts as ``ROLE_PAGES`` pages of
  no importance. Both are outweighed as pages come in; neither decides on a table of some size.
- Presentation importance is the entropy of a node's styles (base: number of pages). It lifts what
  content leaves, the more the more styles there are: ``(1 - DECAY ** styles)``.

Nodes below ``threshold`` are cut from each page, with the branches that hold nothing else; the rest
is its main text. Scripts, styles, the head, mark-up comments, form controls, dialogs and reader
comments never are text, by definition of the result.

Counts are aggregations on (host, node, style) and (node, content, host), combined before the shuffle,
so a host with a third of all pages stays divided. The cut nodes reach the pages as a broadcast set of
8 bytes each, ``MAX_BROADCAST`` at most; if there are more, each page is joined with its own cut nodes.

Defined results: null html is empty text; pages without a host in their url form one site; a page of
which nothing would be left keeps what has no declared role; repeated rows each get a row; empty
tables give empty results; further columns play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

#: Ancestors of a node that its importance reaches; what lies above weighs less than DECAY ** LEVELS.
LEVELS = 32
DECAY = 0.9
THRESHOLD = 0.5
HOST_PAGES = 30
PARENT_PAGES = 8
ROLE_PAGES = 60
MAX_BROADCAST = 1_000_000
#: Pages that a worker parses at once.
PAGE_ROWS = 200

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NEVER_TAGS = set("form button select dialog object canvas head".split())
NEVER_ROLES = set("form search dialog alertdialog".split())
COMMENT_WORDS = set("comment comments commentlist disqus respond replies reply".split())
ROLE_TAGS = set("nav aside footer header menu".split())
ROLES = set("navigation banner contentinfo complementary alert menu menubar".split())
ROLE_WORDS = set(
    "ad ads advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "breadcrumb breadcrumbs sidebar menu nav navbar navigation footer related recommended share sharing social newsletter subscribe signup login search widget pagination pager toolbar "
    "header masthead topbar".split()
)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
DIGITS = re.compile(r"\d+")
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\s*[·•—»\n]\s*")


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Node:
    """One path of a page: all block elements that share it."""

    chain: list[int]  # LEVELS nearest ancestors and the node itself
    role: bool  # declared by mark-up, here or above
    children: list[str] = field(default_factory=list)
    contents: dict[int, int] = field(default_factory=dict)  # words of each


@dataclass
class Page:
    """Paths of a page, and its text pieces as (block, path, declared role, text) in page order."""

    nodes: dict[int, Node]
    pieces: list[tuple[int, int, bool, str]]


def parse(source: str | None) -> Page:
    nodes: dict[int, Node] = {0: Node([], False)}
    pieces: list[tuple[int, int, bool, str]] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, path, declared role, never text
    signs: dict[tuple[int, str], int] = {}
    block = 0
    source = source or ""
    at, end = 0, len(source)
    while at < end:
        m = TOKEN.match(source, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            _, path, role, never = stack[-1]
            if never or text[0] == "<" and len(text) > 1:
                continue
            if text.strip():
                text = entities.unescape(text)
                pieces.append((block, path, role, text))
                contents = nodes[path].contents
                for sentence in SENTENCE.split(text):
                    words = sentence.split()
                    if words:
                        contents[_hash(" ".join(words))] = len(words)
            elif pieces and pieces[-1][0] == block:
                pieces.append((block, path, role, " "))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag not in INLINE:
                block += 1
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag not in INLINE:
            block += 1
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        elif tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SIBLINGS[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES[tag]:
                    break
        raw = m[3] or m[6]
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(raw)} if raw else {}
        _, above, role, never = stack[-1]
        parent = nodes[above]
        if attributes.get("href") and not never:
            parent.contents[_hash("href " + attributes["href"])] = 1
        path = above
        if tag not in INLINE and tag not in VOID:
            names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
            declared = (attributes.get("role") or "").lower()
            sign = tag + ("." + DIGITS.sub("#", " ".join(sorted(names.split()))) if names else "") + (f"[{declared}]" if declared else "")
            words = {w.lower() for w in NAMES.findall(names)} if names else set()
            whole = tag in ("html", "body", "main")
            never = never or tag in NEVER_TAGS or declared in NEVER_ROLES or bool(words & COMMENT_WORDS) and not whole
            role = role or tag in ROLE_TAGS or declared in ROLES or bool(words & ROLE_WORDS) and not whole
            if not never:
                parent.children.append(sign)
                path = signs.get((above, sign))
                if path is None:
                    path = signs[above, sign] = _hash(f"{above}/{sign}")
                if path not in nodes:
                    nodes[path] = Node([*parent.chain[-LEVELS:], path], role)
        if tag not in VOID and not (raw or "").endswith("/"):
            stack.append((tag, path, role, never))
    return Page(nodes, pieces)


def join_blocks(pieces: list[tuple[int, str]]) -> str:
    """Pieces of a block run on; white space becomes one space; blocks are joined by one space."""
    out: list[str] = []
    last = None
    for block, text in pieces:
        if block == last:
            out[-1] += text
        else:
            out.append(text)
            last = block
    return " ".join(filter(None, (" ".join(b.split()) for b in out)))


def main_text(page: Page, cut: set[int]) -> str:
    """The page's text without that of the nodes in ``cut``."""
    text = join_blocks([(b, t) for b, p, _, t in page.pieces if p not in cut])
    return text or join_blocks([(b, t) for b, _, role, t in page.pieces if not role])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_key() -> Column:
    """Equal for pages of a host with equal html."""
    return F.xxhash64("host", "html")


def prepared(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))


def page_nodes(pages: DataFrame) -> DataFrame:
    """``(host, page, node, chain, role, style, contents)``: a row for each page and path."""
    columns = {"host": pa.string(), "page": pa.int64(), "node": pa.int64(), "chain": pa.list_(pa.int64()), "role": pa.bool_(), "style": pa.int64(), "contents": pa.list_(pa.struct([("c", pa.int64()), ("w", pa.int32())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PAGE_ROWS):
            rows: list[tuple] = []
            for host, key, source in zip(*(c.to_pylist() for c in batch.columns)):
                for path, n in parse(source).nodes.items():
                    if path:
                        rows.append((host, key, path, n.chain, n.role, _hash(" ".join(n.children)), [{"c": c, "w": w} for c, w in n.contents.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(columns), columns.values())], names=list(columns))

    schema = "host string, page long, node long, chain array<long>, role boolean, style long, contents array<struct<c: long, w: int>>"
    return prepared(pages).select("host", page_key().alias("page"), "html").mapInArrow(run, schema)


def site_style_tree(rows: DataFrame) -> DataFrame:
    """``(host, node, chain, pages, words, role, content, presentation, styles, composite, importance)`` of
    every node, from ``page_nodes``."""
    key = ["host", "node"]
    merged = rows.groupBy(*key).agg(F.count("*").alias("pages"), F.max("chain").alias("chain"), F.avg(F.col("role").cast("double")).alias("role"))
    everywhere = merged.groupBy("node").agg(F.sum("pages").alias("pages_all"))
    n, t = F.col("n"), F.col("_t")
    styles = rows.groupBy(*key, "style").agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum("n").alias("_t"), F.sum(n * F.log("n")).alias("_s"), F.count("*").alias("styles"))
    counts = rows.select(*key, F.explode("contents").alias("x")).groupBy("node", "x.c", "host").agg(F.count("*").alias("n"), F.sum("x.w").alias("w"))
    counts = materialize(counts, "html-contents")
    shared = counts.groupBy("node", "c").agg(F.sum("n").alias("n_all"))
    own = F.col("pages") / (F.col("pages") + HOST_PAGES)
    alike = counts.join(shared, ["node", "c"]).groupBy(*key, "n", "n_all").agg(F.sum("w").alias("w"))  # few rows a node
    contents = (
        alike.join(merged.select(*key, "pages"), key)
        .groupBy(*key).agg(F.sum("w").alias("words"), F.sum(F.col("w") * F.exp(-own * F.log("n") - (1 - own) * F.log("n_all"))).alias("_i"))
    )
    typical = contents.groupBy("node").agg((F.sum("_i") / F.sum("words")).alias("_typical"))
    mean = own * F.col("_i") / F.col("words") + (1 - own) * F.col("_typical")
    nodes = merged.join(styles, key).join(contents, key, "left").join(everywhere, "node").join(typical, "node", "left").select(
        *key, "chain", "pages", "pages_all", "role", "styles", F.coalesce("words", F.lit(0)).alias("words"), mean.alias("content"),
        F.when(F.col("pages") > 1, (F.log(t) - F.col("_s") / t) / F.log("pages")).otherwise(0.0).alias("presentation"),
    )
    nodes = materialize(nodes, "html-tree")
    ups = nodes.where("words > 0").select("host", "content", "words", F.posexplode(F.reverse("chain")).alias("up", "node"))
    weight = F.col("words") * F.pow(F.lit(DECAY), F.col("up"))
    composite = ups.groupBy(*key).agg((F.sum(F.col("content") * weight) / F.sum(weight)).alias("composite"))
    tree = nodes.join(composite, key)  # nodes without any text below have nothing to cut
    above = composite.select("host", F.col("node").alias("_up"), F.col("composite").alias("_above"))
    parent = F.when(F.size("chain") > 1, F.element_at("chain", -2))
    tree = tree.withColumn("_up", parent).join(above, ["host", "_up"], "left")
    pages = F.col("pages_all")
    held = pages * F.col("composite") + PARENT_PAGES * F.coalesce("_above", "composite")
    leaning = held / (pages + PARENT_PAGES + ROLE_PAGES * F.col("role"))
    lift = (1 - F.pow(F.lit(DECAY), F.col("styles"))) * F.col("presentation")
    return tree.withColumn("importance", leaning + (1 - leaning) * lift).drop("_up", "_above")


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, url, text)`` of every page row."""
    nodes = materialize(page_nodes(pages), "html-nodes")
    low = materialize(site_style_tree(nodes).where(F.col("importance") < threshold).select("host", "node"), "html-cut")
    rows = prepared(pages)
    types = dict(pages.dtypes)
    schema = f"page_id {types['page_id']}, url {types['url']}, text string"

    def done(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    if low.count() <= MAX_BROADCAST:
        found = np.array([r.k for r in low.select(F.xxhash64("host").bitwiseXOR(F.col("node")).alias("k")).collect()], np.int64)  # MAX_BROADCAST at most
        shared = pages.sparkSession.sparkContext.broadcast(np.unique(found))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = shared.value
            for batch in slices(batches, PAGE_ROWS):
                texts = []
                for host, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    page = parse(source)
                    paths = np.fromiter(page.nodes, np.int64, len(page.nodes))
                    mine = paths ^ np.int64(host)
                    at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
                    texts.append(main_text(page, set(paths[keys[at] == mine].tolist()) if len(keys) else set()))
                yield done(batch, texts)

        return rows.select("page_id", "url", F.xxhash64("host").alias("host"), "html").mapInArrow(run, schema)

    cut = nodes.select("host", "node", "page").join(low, ["host", "node"]).groupBy("page").agg(F.collect_set("node").alias("cut"))  # of one page: its own nodes at most

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PAGE_ROWS):
            yield done(batch, [main_text(parse(source), set(nodes or ())) for source, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())])

    return rows.withColumn("page", page_key()).join(cut, "page", "left").select("page_id", "url", "html", "cut").mapInArrow(run_joined, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
