"""Approximate nearest neighbours by a forest of random-projection trees.

Fit: on a bounded sample (``SAMPLE_ROWS`` rows by hash order) each tree splits at the median of a
projection on the difference of two random rows, down to leaves that hold about ``LEAF`` rows of
the whole table. Index: every row is routed through every tree. Search: one priority queue per
query, shared by all trees, pops the node with the least sum of squared wrong-side margins and
collects leaves until enough are found; rows and queries then meet per leaf, where the leaf's rows are
reranked by the exact double-precision inner product; duplicates between trees are merged.

How many leaves are enough is measured on the table itself (:func:`measure`): ``PROBES`` queries by hash
order get their exact neighbours from one pass over all rows, and the trees tell after how many leaves
each neighbour is met. The fewest leaves, ``SEARCH_LEAVES`` at least, whose recall less two standard
errors reaches ``RECALL`` are searched. As many leaves as one tree has hold every row once when they are
one tree's, so from there on the search takes all leaves of one tree and is exact.

A query's best ``k + 1`` of ``FLOOR_ROWS`` sample rows are hits of their own, and leaves give only rows
that are no worse than the last of them, so the hits of many leaves stay few.

Maximum inner product is reduced to angles by one extra component sqrt(M^2 - |x|^2), M the
largest norm; it is used for routing only, never for scores.

Skew: equal vectors are one indexed row that carries its ``k + 1`` smallest ids (all that a top-k
with ties to smaller ids can need); a leaf with many rows or many queries is dealt in blocks of at
most ``BLOCK`` rows by ``BLOCK`` queries, so no row is dropped and no task takes a whole hot leaf.

Defined results: vectors that are null, zero or hold null or non-finite components take no part;
repeated ids count once (the smallest vector stands); ties go to the smaller id; an empty table
gives an empty result.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import finite_vectors, staged, unique_by_id

SAMPLE_ROWS = 65_536
LEAF = 1024
TREES = 10
SEARCH_LEAVES = 70
RECALL = 0.9
PROBES = 200
FLOOR_ROWS = 16_384
BLOCK = 4096
#: float64 sums in another order differ by less than this share of the vectors' lengths
ROUNDING = 1e-12

log = logging.getLogger(__name__)


class Forest:
    """Split planes of all trees, level by level: node i of a tree has children 2i+1 and 2i+2."""

    def __init__(self, planes: np.ndarray, cuts: np.ndarray, depth: int, top_norm: float):
        self.planes, self.cuts, self.depth, self.top_norm = planes, cuts, depth, top_norm

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int, top_norm: float, seed: int = 17) -> "Forest":
        x = augment(sample, top_norm)
        nodes = (1 << depth) - 1
        planes = np.zeros((trees, nodes, x.shape[1]), np.float32)
        cuts = np.zeros((trees, nodes), np.float32)
        rng = np.random.default_rng(seed)
        for t in range(trees):
            members = {0: np.arange(len(x))}
            for node in range(nodes):
                own = members.pop(node)
                if len(own) >= 2:
                    a, b = rng.choice(own, 2, replace=False)
                    normal = x[a] - x[b]
                else:
                    normal = rng.standard_normal(x.shape[1])
                size = np.linalg.norm(normal)
                normal = (normal / size if size > 0 else rng.standard_normal(x.shape[1])).astype(np.float32)
                side = (x[own].astype(np.float32) @ normal) if len(own) else np.zeros(0, np.float32)
                cut = np.float32(np.median(side)) if len(own) else np.float32(0)
                planes[t, node], cuts[t, node] = normal, cut
                if 2 * node + 1 < nodes:
                    members[2 * node + 1], members[2 * node + 2] = own[side <= cut], own[side > cut]
        return cls(planes, cuts, depth, top_norm)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row in each tree: (rows, trees)."""
        out = np.empty((len(x), len(self.planes)), np.int32)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.planes[t, node])
                node = 2 * node + 1 + (side > self.cuts[t, node])
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def costs(self, x: np.ndarray) -> np.ndarray:
        """Sum of squared wrong-side margins down to each leaf: (queries, trees x leaves), tree by tree."""
        cost = np.zeros((len(x), len(self.planes), 1))
        for level in range(self.depth):
            own = slice((1 << level) - 1, (2 << level) - 1)
            m = np.einsum("tnd,qd->qtn", self.planes[:, own], x, optimize=True) - self.cuts[:, own]
            wrong = cost + m.astype(np.float64) ** 2
            cost = np.stack([np.where(m <= 0, cost, wrong), np.where(m > 0, cost, wrong)], axis=-1).reshape(len(x), len(self.planes), -1)
        return cost.reshape(len(x), -1)

    def search(self, x: np.ndarray, n_leaves: int) -> np.ndarray:
        """For each query the numbers (tree x leaves + leaf) of the leaves that the shared queue pops first."""
        if n_leaves >= 1 << self.depth:
            return np.tile(np.arange(1 << self.depth), (len(x), 1))
        step = max(1, (1 << 21) // (len(self.planes) << self.depth))
        first = [np.argpartition(self.costs(x[a:a + step]), n_leaves - 1, axis=1)[:, :n_leaves] for a in range(0, len(x), step)]
        return np.concatenate([np.zeros((0, n_leaves), np.int64), *first])

    def met_after(self, query: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaves until each row is met, place of every leaf in the queue) for one query."""
        order = np.argsort(self.costs(query[None])[0], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(1, len(order) + 1)
        return place[self.leaves(rows) + (np.arange(len(self.planes)) << self.depth)].min(axis=1), place


def augment(x: np.ndarray, top_norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, top_norm * top_norm - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], axis=1)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """List column as a (rows, dim) array; shorter vectors are padded with zeros."""
    lens = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lens) and (lens == dim).all():
        return flat.reshape(len(lens), dim)
    out = np.zeros((len(lens), dim))
    start = 0
    for i, n in enumerate(lens):
        out[i, :n] = flat[start:start + n]
        start += n
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Queries only need a direction: scaled to length 1 and given a zero last component."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([x / np.where(size > 0, size, 1), np.zeros((len(x), 1))], axis=1).astype(np.float32)


def _top(scores: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` best scores; of equal ones at the cut the first."""
    pos = np.arange(len(scores))
    if len(scores) > keep:
        cut = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        above = pos[scores > cut]
        pos = np.concatenate([above, pos[scores == cut][:keep - len(above)]])
    return pos


def measure(base: DataFrame, asked: DataFrame, forest: Forest, dim: int, k: int, recall: float = RECALL,
            probes: int = PROBES) -> dict[str, float]:
    """Leaves to search, with the recall and the share of rows scored that they give on the probes.

    ``asked``: (rep, vec) of the queries. Recall counts the ``k`` nearest distinct vectors other than
    the query's own, by brute force over all rows.
    """
    spark = base.sparkSession
    chosen = asked.orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(probes).toArrow()
    own, q = chosen["rep"].to_numpy(), _matrix(chosen["vec"].combine_chunks(), dim)
    sent = spark.sparkContext.broadcast(q)

    def scan(batches):
        best = None
        for b in batches:
            x, reps = _matrix(b["vec"], dim), b["rep"].to_numpy()
            scores = sent.value @ x.T
            found = []
            for i in range(len(scores)):
                s, r, v = scores[i], reps, x
                pos = _top(s, k + 1)
                s, r, v = s[pos], r[pos], v[pos]
                if best is not None:
                    s, r, v = (np.concatenate(z) for z in zip(best[i], (s, r, v)))
                    pos = _top(s, k + 1)
                    s, r, v = s[pos], r[pos], v[pos]
                found.append((s, r, v))
            best = found
        for i, (s, r, v) in enumerate(best or []):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(s), i), pa.int32()), pa.array(r), pa.array(s), pa.array(list(v), pa.list_(pa.float64()))],
                names=["q", "rep", "score", "vec"])

    near = base.select("rep", "vec").mapInArrow(scan, "q int, rep long, score double, vec array<double>")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "rep")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).orderBy("q", "place").toArrow()
    of, reps = near["q"].to_numpy(), near["rep"].to_numpy()
    whole, units = 1 << forest.depth, _unit(q)
    met = []
    for i in range(len(q)):
        true = near.filter(pa.array((of == i) & (reps != own[i]))).slice(0, k)
        if len(true):
            x = augment(_matrix(true["vec"].combine_chunks(), dim), forest.top_norm).astype(np.float32)
            met.append(forest.met_after(units[i], x)[0])

    def reached(n: int) -> np.ndarray:
        return np.array([(m <= n).mean() if n < whole else 1.0 for m in met])

    def enough(n: int) -> bool:
        at = reached(n)
        return n >= whole or not len(at) or at.mean() - 2 * at.std() / np.sqrt(len(at)) >= recall

    low, high = 1, whole
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid + 1, high)
    leaves = min(whole, max(SEARCH_LEAVES, low))
    # rows met by the leaves of a few probes, counted on a bounded hash sample of the rows
    share = 1.0
    if leaves < whole:
        some = base.orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(10_000).select("vec").toArrow()["vec"].combine_chunks()
        x = augment(_matrix(some, dim), forest.top_norm).astype(np.float32)
        share = float(np.mean([(forest.met_after(u, x)[0] <= leaves).mean() for u in units[:20]]))
    got = reached(leaves)
    return {"leaves": leaves, "recall": float(got.mean()) if len(got) else 1.0, "share": share, "probes": len(met)}


def nearest(df: DataFrame, id_col: str, vec_col: str, k: int = 20, every: int = 20, trees: int = TREES,
            search_leaves: int | None = None, leaf: int = LEAF, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Queries: rows whose id is divisible by ``every``; candidates: every row but the query's own id.

    ``search_leaves`` is measured if not given.
    """
    spark = df.sparkSession
    usable = finite_vectors(df, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    rows = unique_by_id(usable, "vec_id", "vec")
    is_query = F.col("vec_id") % every == 0
    place = Window.partitionBy("vec").orderBy("vec_id")
    # the k+1 smallest ids of each distinct vector; the query ids of a vector join back later
    groups = (rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1)
              .groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
              .withColumn("rep", F.element_at("ids", 1)))
    base = staged(groups.select("rep", "ids", "vec"), "ann-rows")
    query_ids = staged(rows.filter(is_query).join(base.select("rep", "vec"), "vec")
                       .select("rep", F.col("vec_id").alias("query_id")), "ann-queries")
    facts = base.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.max(F.aggregate(
        "vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("sq")).first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], out_schema)
    n, dim, top = facts["n"], facts["dim"], float(np.sqrt(facts["sq"]))
    drawn = (base.select("vec", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep")
             .limit(sample_rows).select("rep", "vec").toArrow())
    sample = drawn["vec"].combine_chunks()
    depth = int(max(0, np.ceil(np.log2(max(1, n) / leaf)), 0))
    depth = min(depth, int(np.log2(max(1, len(sample)) / 8 + 1)))
    grown = Forest.fit(_matrix(sample, dim), depth, trees, top)
    forest = spark.sparkContext.broadcast(grown)
    asking = staged(base.join(query_ids.select("rep").distinct(), "rep", "left_semi").select("rep", "vec"), "ann-asking")
    if search_leaves is None:
        seen = measure(base, asking, grown, dim, k)
        search_leaves = int(seen["leaves"])
        log.warning("ann_forest: %d rows, %d of %d leaves searched, recall %.3f on %d queries, %.3f of the rows scored",
                    n, search_leaves, trees << depth, seen["recall"], seen["probes"], seen["share"])
    # rows in order of rep, so that ties at a cut go to the smaller one
    few = drawn.slice(0, FLOOR_ROWS).sort_by("rep")
    head = spark.sparkContext.broadcast((few["rep"].to_numpy(), _matrix(few["vec"].combine_chunks(), dim)))
    # whole trees meet every row, so the others are not built
    used = 1 if search_leaves >= 1 << depth else trees

    def start(batches):
        reps, x = head.value
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                q = _matrix(part["vec"], dim)
                scores = q @ x.T
                pos = [_top(s, k + 1) for s in scores]
                exact = [(x[p] * v).sum(axis=1) for p, v in zip(pos, q)]
                least = [e.min() - ROUNDING * top * np.linalg.norm(v) if len(e) > k else -np.inf for e, v in zip(exact, q)]
                yield pa.RecordBatch.from_arrays(
                    [part["rep"], part["vec"], pa.array(least, pa.float64()), pa.array([reps[p] for p in pos], pa.list_(pa.int64())),
                     pa.array(exact, pa.list_(pa.float64()))], names=["rep", "vec", "least", "hits", "scores"])

    def route(batches):
        for b in batches:
            x = augment(_matrix(b["vec"], dim), top).astype(np.float32)
            leaves = forest.value.leaves(x)
            idx = np.repeat(np.arange(len(x)), used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(used, dtype=np.int32), len(x))), pa.array(leaves[:, :used].ravel()),
                 b["rep"].take(pa.array(idx)), b["vec"].take(pa.array(idx))], names=["tree", "leaf", "rep", "vec"])

    def visit(batches):
        for b in batches:
            # a few queries at a time, since each is copied to all its leaves
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = forest.value.search(_unit(_matrix(part["vec"], dim)), search_leaves)
                idx = pa.array(np.repeat(np.arange(len(found)), found.shape[1]))
                flat = found.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array((flat >> depth).astype(np.int32)), pa.array((flat & ((1 << depth) - 1)).astype(np.int32)),
                     part["rep"].take(idx), part["vec"].take(idx), part["least"].take(idx)],
                    names=["tree", "leaf", "rep", "vec", "least"])

    vec_type = base.schema["vec"].dataType.simpleString()
    schema = f"tree int, leaf int, rep long, vec {vec_type}"
    indexed = base.select("rep", "vec").mapInArrow(route, schema)
    begun = staged(asking.mapInArrow(start, f"rep long, vec {vec_type}, least double, hits array<long>, scores array<double>"), "ann-head")
    asked = begun.select("rep", "vec", "least").mapInArrow(visit, f"{schema}, least double")

    def splits(side, name):
        return side.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    # one row per leaf: at most trees x 2^depth rows, bounded by the sample
    parts = staged(splits(indexed, "rp").join(splits(asked, "qp"), ["tree", "leaf"]), "ann-parts")

    def dealt(side, own, other):
        block = F.pmod(F.xxhash64("rep"), F.col(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return side.join(parts, ["tree", "leaf"]).select("tree", "leaf", block.alias(own), copies.alias(other), *side.columns[2:])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        reps, qreps = left["rep"].to_numpy(), right["rep"].to_numpy()
        keep = k + 1
        out_q, out_r, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(reps) and len(qreps):
            rows_x = _matrix(left["vec"].combine_chunks(), dim)
            order = np.argsort(reps, kind="stable")
            reps, rows_x = reps[order], rows_x[order]
            for a in range(0, len(qreps), 256):
                q = qreps[a:a + 256]
                qx = _matrix(right["vec"].combine_chunks().slice(a, 256), dim)
                scores = qx @ rows_x.T
                least = right["least"].to_numpy()[a:a + 256]
                for i in range(len(q)):
                    pos = np.flatnonzero(scores[i] >= least[i])
                    pos = pos[_top(scores[i][pos], keep)]
                    out_q.append(np.full(len(pos), q[i]))
                    out_r.append(reps[pos])
                    out_s.append((rows_x[pos] * qx[i]).sum(axis=1))
        return pa.table({"q_rep": np.concatenate(out_q), "rep": np.concatenate(out_r), "score": np.concatenate(out_s)})

    keys = ["tree", "leaf", "rp", "qp"]
    found = (dealt(indexed, "rp", "qp").groupBy(*keys).cogroup(dealt(asked, "qp", "rp").groupBy(*keys))
             .applyInArrow(lambda l, r: meet(l, r), "q_rep long, rep long, score double"))
    begin = begun.select(F.col("rep").alias("q_rep"), F.explode(F.arrays_zip("hits", "scores")).alias("h"))
    found = found.unionByName(begin.select("q_rep", F.col("h.hits").alias("rep"), F.col("h.scores").alias("score")))
    merged = found.groupBy("q_rep", "rep").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q_rep").orderBy(F.col("score").desc(), F.col("rep"))
    # k+1 distinct vectors always cover the k best rows after the query's own id is left out
    merged = merged.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    per_vector = (merged.join(base.select("rep", "ids"), "rep")
                  .select("q_rep", "score", F.explode("ids").alias("vec_id")))
    by_id = Window.partitionBy("q_rep").orderBy(F.col("score").desc(), F.col("vec_id"))
    lists = (per_vector.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1)
             .groupBy("q_rep").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("hits")))
    hits = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return (query_ids.join(lists, query_ids["rep"] == lists["q_rep"])
            .select("query_id", F.posexplode(hits).alias("p", "h"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"),
                    F.col("h.score").alias("score")))
