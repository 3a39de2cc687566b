"""N-gram Jaccard join: MinHash banding, then verification on the full n-gram sets.

1. Each whole text becomes the set of 64-bit hashes of its lower-cased ``N`` word n-grams, a MinHash
   signature and one hash per band; bands and rows are chosen for ``TARGET_RECALL`` at the threshold.
2. Texts with the same set are one node, so copies are never paired. Band hashes are shuffled and
   every node is tied to the smallest node of each band group; connected components of these ties
   hold every candidate pair.
3. The sets of the tied nodes meet in units: small components share a unit, a large one is cut into
   blocks of about ``BLOCK`` nodes and each pair of blocks is a unit. A unit counts all its
   intersections and returns per node its number of links and the root of its linked group, never
   the pairs. So every pair inside a component is verified exactly, whatever its size, and no task
   holds more than two blocks.
4. Components of the verified links are the classes.

``n_links`` counts the other documents (copies included) whose similarity reaches the threshold.

Defined results: texts of fewer than ``N`` words have one n-gram of all their words; null, empty or
blank texts have none, link to nothing and are classes of their own; a class takes its smallest
``doc_id`` (null only if all its ids are null); where unrelated texts share a ``doc_id`` that names
several classes, one class keeps it and the others take a negative number made from their texts;
repeated rows are documents of their own; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import lean, mix64, slices, staged, texts_of
from surveyspark.llm.components import connected_components

N = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
MAX_HASHES = 288
BLOCK = 512
#: n-grams in more nodes of a unit than this are counted by matrix product, the rest pair by pair
DENSE = 32
HEAVY = 2_000
#: places of rows that are broadcast at most
SMALL = 500_000


def choose_bands(threshold: float, recall: float = TARGET_RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach ``recall`` at ``threshold`` within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def ngram_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sorted distinct n-gram hashes of each text, one text after the other."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    row = pc.list_parent_indices(words).to_numpy()
    flat = pc.list_flatten(words)
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    flat, row = flat.filter(pa.array(keep)), row[keep]
    packed = flat.dictionary_encode()
    digest = np.array([xxhash.xxh3_64_intdigest(w) for w in packed.dictionary.to_pylist()], np.uint64)
    h = digest[packed.indices.to_numpy()] if len(packed) else np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    # a text of fewer than n words has one n-gram, which the number of its words also marks
    width = np.minimum(count, n)
    grams = np.where(count > 0, count - width + 1, 0)
    owner = np.repeat(np.arange(len(texts)), grams)
    start = np.repeat(first - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    value = mix64(width[owner].astype(np.uint64))
    for j in range(n):
        inside = j < width[owner]
        value = np.where(inside, mix64(value ^ h[np.minimum(start + j, max(0, len(h) - 1))]) if len(h) else value, value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


def band_hashes(values: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hashes of the signatures; rows of empty sets are not to be used."""
    starts = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes > 0)
    out = np.zeros((len(sizes), bands), np.uint64)
    if not len(full):
        return out
    rng = np.random.default_rng(20)
    mult = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    x = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    for band in range(bands):
        h = np.full(len(full), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            z = x * mult[k] + add[k]
            z ^= z >> np.uint32(15)
            h = mix64(h ^ np.minimum.reduceat(z * mult[-1 - k], starts[full]).astype(np.uint64))
        out[full, band] = h
    return out


def _node_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number per set: a hash of its sorted hashes."""
    ends = np.cumsum(sizes)
    data = values.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(data[8 * (e - s):8 * e]) for e, s in zip(ends, sizes)], np.uint64)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row: a hash of its file's name and its number there.

    A frame that isn't read from files is written first.
    """
    if {"llm_file", "llm_row"} <= set(docs.columns):
        return docs
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias("llm_file"), F.col("_metadata.row_index").alias("llm_row"))
    except AnalysisException:
        return located(staged(docs, "join-docs"))


def at_places(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of located rows with places.

    Up to ``SMALL`` places are broadcast, so that the rows and their texts don't move; beyond that bound both sides are shuffled.
    """
    few = F.broadcast(places) if places.limit(SMALL + 1).count() <= SMALL else places
    return rows.join(few, ["llm_file", "llm_row"], how)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, llm_file, llm_row, node, n_grams, bands) of located rows: null node for texts without words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, sizes = ngram_sets(texts_of(part), n)
                empty = pa.array(sizes == 0)
                codes = band_hashes(values, sizes, bands, rows).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, bands, dtype=np.int32)), pa.array(codes.ravel()))
                node = pa.array(_node_of(values, sizes).astype(np.int64), mask=np.asarray(sizes == 0))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), node, pa.array(sizes.astype(np.int32)), pc.if_else(empty, pa.scalar(None, lists.type), lists)],
                    names=[*kept, "node", "n_grams", "bands"])

    kept = ["doc_id", "text_hash", "llm_file", "llm_row"]
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "llm_file", "llm_row", "text").mapInArrow(
        lean(run), "doc_id long, text_hash long, llm_file long, llm_row long, node long, n_grams int, bands array<long>")


def _sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(node, grams binary) of each text that has words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, sizes = ngram_sets(texts_of(part), n)
                ends = np.cumsum(sizes)
                pick = np.flatnonzero(sizes > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_node_of(values, sizes)[pick].astype(np.int64)),
                     pa.array([values[ends[i] - sizes[i]:ends[i]].tobytes() for i in pick], pa.binary())],
                    names=["node", "grams"])

    return docs.select("text").mapInArrow(lean(run), "node long, grams binary")


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each linked group, by repeated minima over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _intersections(values: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """(m, m) sizes of the intersections of the sets, upper triangle."""
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
    df = np.diff(np.append(starts, len(values)))
    each = np.repeat(df, df)
    out = np.zeros(m * m, np.int64)
    some = (each > 1) & (each <= DENSE)
    v, o = values[some], owner[some]
    for lag in range(1, DENSE):
        same = np.flatnonzero(v[lag:] == v[:-lag]) if lag < len(v) else []
        if not len(same):
            break
        out += np.bincount(o[same] * m + o[same + lag], minlength=m * m)
    out = out.reshape(m, m)
    dense = each > DENSE
    v, o = values[dense], owner[dense]
    if len(v):
        column = np.cumsum(np.append(False, v[1:] != v[:-1]))
        for a in range(0, int(column[-1]) + 1, 4096):
            own = (column >= a) & (column < a + 4096)
            block = np.zeros((m, 4096), np.float32)
            block[o[own], column[own] - a] = 1
            out += np.triu(block @ block.T, 1).astype(np.int64)
    return out


def _verify(table: pa.Table, threshold: float) -> pa.Table:
    """Links inside one unit: per node their number (copies included) and the root of its group."""
    table = table.combine_chunks().sort_by("node")
    node, comp = table["node"].to_numpy(), table["comp"].to_numpy()
    block, copies = table["block"].to_numpy(), table["copies"].to_numpy()
    cross = table["cross"].to_numpy(zero_copy_only=False)
    grams = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
    sizes = np.array([len(g) for g in grams])
    m = len(node)
    both = _intersections(np.concatenate(grams), np.repeat(np.arange(m), sizes), m)
    i, j = np.nonzero(both)
    same = both[i, j]
    linked = (same * (1 + threshold) >= threshold * (sizes[i] + sizes[j]) - 1e-9) & (comp[i] == comp[j])
    linked &= (block[i] != block[j]) | ~cross[i]
    i, j = i[linked], j[linked]
    links = np.bincount(i, weights=copies[j], minlength=m) + np.bincount(j, weights=copies[i], minlength=m)
    return pa.table({"node": node, "root": node[_roots(m, i, j)], "links": links.astype(np.int64)})


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_grams) for each row of ``docs`` (doc_id, text)."""
    return _classes(docs, n, threshold, recall).select("doc_id", "class_id", "n_links", "n_grams")


def _classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """The result of :func:`jaccard_join` with ``text_hash``, the row's place, and ``label``, the node that stands for the class."""
    bands, rows = choose_bands(threshold, recall)
    docs = located(docs)
    sig = staged(signatures(docs, n, bands, rows), "join-signatures")
    nodes = staged(sig.filter(F.col("node").isNotNull()).groupBy("node")
                   .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"),
                        F.min(F.struct("llm_file", "llm_row")).alias("place")), "join-nodes")
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter(F.col("lo") != F.col("hi"))
    ties = staged(keyed.join(shared.select("band", "lo"), "band").select("node", "lo").distinct(), "join-ties")
    if ties.isEmpty():
        return _per_document(sig, _named(nodes.select("node", F.col("node").alias("label"), "copies", F.col("first_id").alias("class_id"),
                                                      (F.col("copies") - 1).alias("n_links"))))
    comps = connected_components(ties, "node", "lo").withColumnRenamed("label", "comp")
    sized = comps.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    tied = staged(comps.join(sized, "comp").join(nodes.select("node", "copies", "place"), "node"), "join-tied")
    total = tied.count()
    # one document of each tied node
    sets = _sets_of(at_places(docs.select("llm_file", "llm_row", "text"), tied.select("place.*"), "left_semi"), n)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    small = F.pmod(F.xxhash64("comp"), F.lit(max(1, -(-total // BLOCK))))
    dealt = (tied.drop("place").join(sets, "node").withColumn("block", own).withColumn("other", other)
             .select(F.when(F.col("blocks") == 1, small).otherwise(F.col("comp")).alias("unit"),
                     (F.col("blocks") > 1).alias("large"),
                     F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"),
                     (F.col("block") != F.col("other")).alias("cross"), "comp", "node", "copies", "block", "grams"))
    # a unit (i, j) with i < j holds both blocks and counts the pairs between them; (i, i) those inside
    found = staged(dealt.groupBy("unit", "large", "bi", "bj").applyInArrow(
        lambda t: _verify(t, threshold), "node long, root long, links long"), "join-links")
    classes = connected_components(found.filter(F.col("node") != F.col("root")), "node", "root") if not found.filter(
        F.col("node") != F.col("root")).isEmpty() else found.select("node", F.col("node").alias("label")).distinct()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(nodes.select("node", "first_id"), "node")
    names = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    facts = (nodes.select("node", "first_id", "copies").join(links, "node", "left")
             .join(classes.join(names, "label").select("node", "label", "class_id"), "node", "left")
             .select("node", F.coalesce("label", "node").alias("label"), "copies", F.coalesce("class_id", "first_id").alias("class_id"),
                     (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")))
    return _per_document(sig, _named(staged(facts, "join-facts")))


def _own_number(label) -> Column:
    return label.bitwiseOR(F.lit(-1 << 63))


def _named(facts: DataFrame) -> DataFrame:
    """``facts`` with class ids that no two classes share."""
    shared = (facts.filter(F.col("class_id").isNotNull()).groupBy("class_id")
              .agg(F.min("label").alias("owner"), F.max("label").alias("last")).filter(F.col("owner") != F.col("last")).drop("last"))
    taken = F.col("owner").isNotNull() & (F.col("label") != F.col("owner"))
    return staged(facts.join(shared, "class_id", "left").withColumn("class_id", F.when(taken, _own_number(F.col("label"))).otherwise(F.col("class_id")))
                  .drop("owner"), "join-named")


def _per_document(sig: DataFrame, facts: DataFrame) -> DataFrame:
    """Each document with its node's class and links.

    Nodes that hold at least 1 / ``HEAVY`` of the documents - at most ``HEAVY`` of them - are
    broadcast, so a text with very many copies isn't shuffled to one task.
    """
    columns = "doc_id", "text_hash", "llm_file", "llm_row", "label", "class_id", "n_links", "n_grams"
    heavy = facts.filter(F.col("copies") * HEAVY >= sig.count()).drop("copies")
    taken = facts.filter(F.col("class_id").isNotNull()).select(F.col("class_id").alias("doc_id"), F.lit(True).alias("taken")).distinct()
    alone = sig.filter(F.col("node").isNull()).join(taken, "doc_id", "left").select(
        "doc_id", "text_hash", "llm_file", "llm_row", F.col("node").alias("label"),
        F.when(F.col("taken"), _own_number(F.xxhash64("doc_id", "text_hash"))).otherwise(F.col("doc_id")).alias("class_id"),
        F.lit(0).cast("long").alias("n_links"), "n_grams")
    of_heavy = sig.join(F.broadcast(heavy), "node").select(*columns)
    rest = sig.join(F.broadcast(heavy.select("node")), "node", "left_anti").join(facts.drop("copies"), "node").select(*columns)
    return of_heavy.unionByName(rest).unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id stays, with all its columns.

    Of rows that repeat this id, one with the smallest hash of its text stays, the first place on a
    tie, so a class keeps exactly one row; documents without words (once per id and text) or
    without an id all stay. The rows that go are told by their places: the texts of the others aren't grouped or sorted.
    """
    rows = located(docs)
    found = _classes(rows).filter(F.col("doc_id").isNotNull())
    wordless = F.col("label").isNull()
    found = staged(found.select("label", F.when(wordless, F.col("doc_id")).alias("own_id"), F.when(wordless, F.col("text_hash")).alias("own_hash"),
                                "doc_id", "text_hash", "llm_file", "llm_row"), "join-found")
    first = F.min(F.struct("doc_id", "text_hash", "llm_file", "llm_row")).alias("first")
    stay = found.groupBy("label", "own_id", "own_hash").agg(first).select("first.llm_file", "first.llm_row")
    gone = staged(found.select("llm_file", "llm_row").join(stay, ["llm_file", "llm_row"], "left_anti"), "join-gone")
    return at_places(rows, gone, "left_anti").select(*docs.columns)
