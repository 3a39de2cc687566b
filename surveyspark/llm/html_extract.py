"""Main text of web pages by a site style tree.

The pages of one host are laid over each other. An element of the tree is reached by its path of styles, a
style being the sequence of an element's children (tags with classes, and text). For every element the pages
give counts: how many use each style (presentation), and in how many each piece of text of a leaf stands
(content). The importance of an element is the entropy of its styles, or one less the mean entropy of its
pieces over the pages: what every page repeats is worth little, what differs is worth much. The composite
importance mixes an element's own with that of its children, the more styles it has the more its own counts.
A branch is unimportant if neither its top nor anything below reaches ``THRESHOLD``. Two trees are kept,
one of each host and one of all pages, so that hosts with few pages are judged as well; a branch that is
unimportant in either goes. Pages count once per title and first heading, so copies of an article repeat
nothing, and an element must stand on ``SUPPORT`` of them. What a page itself declares to be its main content
(``article``, ``main``) never goes by importance. After the trees, elements that are never part of an
article by their tag, role or class (menus, forms, scripts, comments, ...) go, inside the article too.

Distribution. Each page emits (element, feature, page identity) numbers, counted with map-side combining;
nothing is keyed by host alone, so a host with a third of all pages is spread over all tasks. Importance is
summed level by level over the distinct elements. The topmost unimportant branches of a host, one short list,
are joined to its pages; Spark broadcasts that table below its size threshold and otherwise joins by sorting, where
adaptive execution splits a hot host. The html itself is read twice and parsed twice rather than stored again.

Odd input. A null or empty html gives an empty text. Pages without a host in their url
form a site of their own. Repeated rows and ids are pages of their own. Blocks deeper than 40 levels are judged
with their ancestor there, and their text stays. Extra columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import staged
from surveyspark.llm.html_tree import Node, parse

THRESHOLD = 0.7     #: composite importance below which a branch is noise
GAMMA = 0.9         #: weight of the children of an element with one style
SUPPORT = 5         #: distinct pages (title and first heading) an element needs to be judged
SEEN = 200_000      #: elements whose place a task remembers having told

CONTENT, STYLE, PLACE, TWIN = 0, 1, 2, 3
PIECE = re.compile(r"(?<=[.!?])\s+|\s*[·|•]\s*")
ALL_PAGES = 7       #: root of the tree of all pages


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def host() -> F.Column:
    """The host of ``url`` in lower case, empty if it has none."""
    found = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def labels(node: Node) -> list[str]:
    return ["#text" if isinstance(c, str) else c.label for c in node.children]


def children(node: Node, place: int):
    """(child, its element number) for every child of the element ``place``; also the style's number."""
    style = _hash(place, *labels(node))
    return style, [(c, _hash(style, i)) for i, c in enumerate(node.children)]


def first_heading(node: Node) -> str:
    for c in node.children:
        if isinstance(c, Node):
            found = " ".join(t for t in c.children if isinstance(t, str)) if c.tag == "h1" else first_heading(c)
            if found:
                return found
    return ""


def facts(root: Node, identity: int, host_root: int, told: set):
    """(kind, element, feature, detail) of a page, for its host's tree and for that of all pages."""

    def walk(node, own, twin, depth):
        if isinstance(node, str):
            pieces = {0} | {_hash(piece) for piece in PIECE.split(node)}
            for place in (own, twin):
                for piece in pieces:
                    yield CONTENT, place, piece, identity
            return
        if node.landmark:
            return
        style, below = children(node, own)
        style_all, below_all = children(node, twin)
        yield STYLE, own, style, identity
        yield STYLE, twin, style_all, identity
        k = len(node.children)
        for (child, place), (_, place_all) in zip(below, below_all):
            kept = isinstance(child, Node) and child.holds
            key = (place, place_all, kept)
            if key not in told:
                if len(told) >= SEEN:
                    told.clear()
                told.add(key)
                detail = (depth + 1) << 33 | min(k, (1 << 32) - 1) << 1 | int(kept)
                yield PLACE, place_all, twin, detail
                yield PLACE, place, own, detail
                yield TWIN, place, place_all, host_root
            yield from walk(child, place, place_all, depth + 1)

    yield from walk(root, host_root, ALL_PAGES, 0)


def observe(batches):
    """Batches of (html, site) -> the facts of their pages."""
    told: set = set()
    for batch in batches:
        out: list[tuple] = []
        for html, site in zip(batch.column("html"), batch.column("site").to_pylist()):
            root, title = parse(html.as_py())
            out += facts(root, _hash(title, first_heading(root)), site, told)
            if len(out) > 100_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = np.array(out, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["kind", "node", "feature", "detail"])


def counted(pages: DataFrame) -> DataFrame:
    """Distinct facts, counted over the page identities (staged): kind, node, feature, n, detail."""
    seen = pages.filter("html is not null and html <> ''").select("html", "site").mapInArrow(
        observe, "kind long, node long, feature long, detail long").distinct()
    return staged(seen.groupBy("kind", "node", "feature").agg(F.count(F.lit(1)).alias("n"), F.max("detail").alias("detail")),
                  "site-facts")


def own_importance(cells: DataFrame) -> DataFrame:
    """node, pages, styles, own: the entropy of an element's styles, or of its pieces of text.

    Styles: -sum p log_m p. Pieces: one less the mean of log_m(pages of the piece), each piece
    standing on its pages with equal shares. An element of one page is worth 1.
    """
    kind, n = F.col("kind"), F.col("n").cast("double")
    marked = F.max(F.when((kind == CONTENT) & (F.col("feature") == 0), n))
    piece = (kind == CONTENT) & (F.col("feature") != 0)
    got = cells.filter(kind.isin(CONTENT, STYLE)).groupBy("node").agg(
        marked.alias("leaf_pages"),
        F.avg(F.when(piece, F.log(n))).alias("piece_log"),
        F.sum(F.when(kind == STYLE, n)).alias("style_pages"),
        F.count_if(kind == STYLE).alias("styles"),
        F.sum(F.when(kind == STYLE, n * F.log(n))).alias("n_log_n"))
    m = F.coalesce("leaf_pages", "style_pages")
    content = 1 - F.coalesce("piece_log", F.lit(0.0)) / F.log(m)
    presentation = (F.log(m) - F.col("n_log_n") / m) / F.log(m)
    own = F.when(m <= 1, 1.0).when(F.col("leaf_pages").isNotNull(), content).otherwise(presentation)
    return got.select("node", m.alias("pages"), "styles", own.alias("own"))


def unimportant(cells: DataFrame) -> DataFrame:
    """The elements below which nothing matters: node, parent (both trees)."""
    detail = F.col("detail")
    places = cells.filter(F.col("kind") == PLACE).groupBy("node").agg(
        F.max("feature").alias("parent"), F.max(F.shiftright(detail, 33)).alias("depth"),
        F.max(F.shiftright(detail, 1).bitwiseAND(F.lit((1 << 32) - 1))).alias("siblings"),
        F.max(detail.bitwiseAND(F.lit(1))).alias("kept"))
    nodes = staged(places.join(own_importance(cells), "node", "left").withColumn("pages", F.coalesce("pages", F.lit(0.0))), "site-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    spark, done, below = cells.sparkSession, None, None
    for depth in range(int(deepest), 0, -1):
        level = nodes.filter(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("mean", F.lit(None).cast("double")).withColumn("peak", F.lit(None).cast("double"))
        else:
            weight = F.greatest(F.col("pages"), F.lit(1.0)) / F.col("siblings")
            up = below.groupBy("parent").agg((F.sum(weight * F.col("importance")) / F.sum(weight)).alias("mean"), F.max("peak").alias("peak"))
            level = level.join(up.withColumnRenamed("parent", "node"), "node", "left")
        share = F.pow(F.lit(GAMMA), F.coalesce("styles", F.lit(0)))
        mixed = F.when(F.col("mean").isNotNull(), (1 - share) * F.coalesce("own", F.lit(0.0)) + share * F.col("mean")).otherwise(F.coalesce("own", F.lit(0.0)))
        mixed = F.when(F.col("kept") == 1, 1.0).when(F.col("pages") < SUPPORT, F.greatest(mixed, F.lit(THRESHOLD))).otherwise(mixed)
        level = level.withColumn("importance", mixed).withColumn("peak", F.greatest("importance", F.coalesce("peak", F.lit(0.0))))
        below = staged(level.select("node", "parent", "pages", "siblings", "importance", "peak"), "site-level")
        low = below.filter(F.col("peak") < THRESHOLD).select("node", "parent")
        done = low if done is None else done.unionByName(low)
    return done if done is not None else spark.createDataFrame([], "node long, parent long")


def branches(cells: DataFrame) -> DataFrame:
    """site, low: the topmost unimportant elements of each host, named as in the host's tree or in that of all pages."""
    low = unimportant(cells)
    top = low.join(low.select(F.col("node").alias("parent")), "parent", "left_anti").select("node")
    twins = cells.filter(F.col("kind") == TWIN).select("node", F.col("feature").alias("twin"), F.col("detail").alias("site"))
    mine = twins.join(top, "node", "left_semi").select("site", "node")
    shared = twins.join(top.withColumnRenamed("node", "twin"), "twin", "left_semi").select("site", "node")
    of_host = mine.unionByName(shared).distinct().groupBy("site").agg(F.collect_list("node").alias("low"))
    return staged(of_host, "site-branches")


def main_text(root: Node, low: frozenset, place: int) -> tuple[str, int, int]:
    """The text that stays, and how many branches went by importance and by rule."""
    blocks: list[str] = []
    gone = [0, 0]

    def walk(node, place):
        _, below = children(node, place) if place is not None and low else (0, [(c, None) for c in node.children])
        for child, at in below:
            if at is not None and at in low:
                gone[0] += 1
            elif isinstance(child, str):
                blocks.append(child)
            elif child.dropped:
                gone[1] += 1
            else:
                walk(child, None if child.landmark else at)

    walk(root, place)
    return "\n".join(blocks), gone[0], gone[1]


def extracted(keep: list[str]):
    def run(batches):
        for batch in batches:
            texts, low_branches, rule_branches = [], [], []
            low_of = [(s, frozenset(v or ())) for s, v in zip(batch.column("site").to_pylist(), batch.column("low").to_pylist())]
            for html, (site, low) in zip(batch.column("html"), low_of):
                root, _ = parse(html.as_py() or "")
                text, by_low, by_rule = main_text(root, low, site)
                texts.append(text)
                low_branches.append(by_low)
                rule_branches.append(by_rule)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(low_branches, pa.int64()), pa.array(rule_branches, pa.int64())],
                [*keep, "text", "n_chars", "n_low", "n_rule"])
    return run


def extract(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, n_low and n_rule (branches that went)."""
    rows = pages.select("page_id", "url", "html").withColumn("site", F.xxhash64(host()))
    low = branches(counted(rows))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.join(low, "site", "left").mapInArrow(
        extracted(["page_id", "url"]), f"{kinds}, text string, n_chars long, n_low long, n_rule long")
