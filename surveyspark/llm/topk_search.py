"""Exact top-k search over sparse integer rows, term at a time.

Candidates are dealt into groups that fit a task's memory, and every query travels once to each group.
A task packs its candidates into buckets of about ``CHUNK`` rows of postings (term -> row numbers and
weights), then meets them with its queries, a block at a time: every query term scatters ``query weight
x posting weight`` into a dense array of scores (terms that a quarter of the bucket's rows hold do so
together, in one product of their query weights and laid out postings), a selection keeps the best ``k``
of the group, and a window merges the groups. Nothing is pruned, so the result is exact. Every pair of a
query and a candidate is scored, so the work grows with the product of their numbers; what travels
grows with the queries times the groups, and no record holds more than a bucket.

Defined results: rows without an id or a usable vector take no part; an id that repeats counts
once (the smallest vector stands); a query never finds its own id; ties go to the smaller id; fewer
than ``k`` candidates give them all; vectors of different lengths meet on their common terms.
Sums are signed 64-bit integers; components beyond +-2**40 are clamped there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import finite_vectors, lean, staged, unique_by_id

CHUNK = 4096
QUERY_BLOCK = 512
CHUNK_TERMS = 1 << 19       #: nonzero components of a bucket
GROUP_TERMS = 1 << 23       #: nonzero components of the candidates that a task holds
CLAMP = float(1 << 40)
_PACKED = ("ids", "rows", "terms", "weights")
RECORD = pa.schema([("bucket", pa.int64()), *((f"{side}{c}", pa.binary()) for side in ("", "q_") for c in _PACKED)])


def sparse_rows(df: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """(vec_id, terms array<int>, weights array<long>): nonzero floor(scale * component)."""
    vec = unique_by_id(finite_vectors(df, id_col, vec_col), "vec_id", "vec")
    floored = F.transform("vec", lambda x: F.floor(
        F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), x.cast("double") * F.lit(scale)))).cast("long"))
    pairs = F.filter(F.transform(F.col("q"), lambda w, i: F.struct(i.cast("int").alias("t"), w.alias("w"))),
                     lambda s: s["w"] != 0)
    return (vec.select("vec_id", floored.alias("q")).select("vec_id", pairs.alias("p"))
            .select("vec_id", F.col("p.t").alias("terms"), F.col("p.w").alias("weights")))


def _pack(table: pa.Table) -> pa.Table:
    """Rows of one bucket as postings: entries sorted by term, then by row."""
    table = table.combine_chunks().sort_by("vec_id")
    terms = table["terms"].combine_chunks()
    lens = np.diff(terms.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    t = terms.flatten().to_numpy()
    w = table["weights"].combine_chunks().flatten().to_numpy()
    order = np.argsort(t, kind="stable")
    return pa.table({
        "bucket": pa.array([table["bucket"][0].as_py()], pa.int64()),
        "ids": [table["vec_id"].to_numpy().astype(np.int64).tobytes()],
        "rows": [rows[order].tobytes()], "terms": [t[order].astype(np.int32).tobytes()],
        "weights": [w[order].astype(np.int64).tobytes()]})


def _postings(r: dict) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    ids = np.frombuffer(r["ids"], np.int64)
    rows, terms = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["terms"], np.int32)
    weights = np.frombuffer(r["weights"], np.int64)
    values, starts = np.unique(terms, return_index=True)
    ends = np.append(starts[1:], len(terms))
    return ids, {int(v): (rows[a:b], weights[a:b]) for v, a, b in zip(values, starts, ends)}


def _frequent(postings, n_rows: int) -> tuple[list[int], np.ndarray]:
    """The terms that at least a quarter of the rows hold, and their weights laid out as term x row."""
    terms = [t for t, (idx, _) in postings.items() if 4 * len(idx) >= n_rows]
    dense = np.zeros((len(terms), n_rows), np.int64)
    for row, t in zip(dense, terms):
        row[postings[t][0]] = postings[t][1]
    return terms, dense


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers: in doubles where no sum can leave their exact range, else in 64-bit integers."""
    # an empty side has the product 0
    reach = (np.abs(a).max(axis=0, initial=0).astype(float) * np.abs(b).max(axis=1, initial=0)).sum()
    if reach < 2.0 ** 52:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def _accumulate(queries, n_queries: int, postings, n_rows: int, frequent=None) -> np.ndarray:
    """Scores of a block of queries: the frequent terms' postings in one product, every other term scattered by itself."""
    terms, dense = frequent or _frequent(postings, n_rows)
    by_term = np.zeros((n_queries, len(terms)), np.int64)
    for j, term in enumerate(terms):
        if term in queries:
            by_term[queries[term][0], j] = queries[term][1]
    scores = _product(by_term, dense)
    for term in queries.keys() & (postings.keys() - set(terms)):
        (qi, qw), (idx, w) = queries[term], postings[term]
        scores[np.ix_(qi, idx)] += np.multiply.outer(qw, w)
    return scores


def _select(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best allowed entries; positions rise with the id, so ties go left."""
    pos = np.flatnonzero(allowed)
    if len(pos) > k:
        s = scores[pos]
        cut = np.partition(s, len(s) - k)[len(s) - k]
        above = pos[s > cut]
        pos = np.concatenate([above, pos[s == cut][:k - len(above)]])
    return pos[np.lexsort((pos, -scores[pos]))]


def _best(scores: np.ndarray, ids: np.ndarray, qids: np.ndarray, k: int) -> list[np.ndarray]:
    """:func:`_select` for every query of a block; a first cut leaves each only the entries that can be among its k best."""
    at = np.minimum(np.searchsorted(ids, qids), len(ids) - 1)
    own = ids[at] == qids
    if len(ids) <= k + 1:
        return [_select(s, ids != q, k) for s, q in zip(scores, qids)]
    # with its own row a query may hold one of the k + 1 best places
    cut = np.partition(scores, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
    qi, pos = np.nonzero(scores >= cut[:, None])
    near = np.split(pos, np.cumsum(np.bincount(qi, minlength=len(qids)))[:-1])
    return [p[_select(s[p], p != a if o else np.ones(len(p), bool), k)] for p, s, a, o in zip(near, scores, at, own)]


class _Bucket:
    """Candidates of one bucket, the frequent terms laid out and the others as postings."""

    def __init__(self, ids: np.ndarray, postings: dict):
        self.ids, self.frequent = ids, _frequent(postings, len(ids))
        rare = postings.keys() - set(self.frequent[0])
        self.postings = {t: tuple(x.copy() for x in postings[t]) for t in rare}     # the packed record goes

    def near(self, qids: np.ndarray, queries: dict, k: int, floor: np.ndarray | None):
        """(position of the query, its best candidates here, their scores); only those that reach ``floor`` where it is known."""
        scores = _accumulate(queries, len(qids), self.postings, len(self.ids), self.frequent)
        if floor is None:
            for i, best in enumerate(_best(scores, self.ids, qids, k)):
                yield i, self.ids[best], scores[i][best]
            return
        qi, pos = np.nonzero(scores >= floor[:, None])
        edges = np.flatnonzero(np.diff(qi, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(qi))):
            i, p = qi[a], pos[a:b]
            best = p[_select(scores[i][p], self.ids[p] != qids[i], k)]
            yield i, self.ids[best], scores[i][best]


def _nearest(held: list[_Bucket], qids: np.ndarray, queries: dict, k: int):
    """The ``k`` best of all buckets for each query: candidates and scores."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qids)
    floor = np.full(len(qids), np.iinfo(np.int64).min)
    for n, bucket in enumerate(held):
        for i, ids, scores in bucket.near(qids, queries, k, floor if n else None):
            ids, scores = np.concatenate([found[i][0], ids]), np.concatenate([found[i][1], scores])
            order = np.lexsort((ids, -scores))[:k]
            found[i] = ids[order], scores[order]
            if len(order) == k:
                floor[i] = found[i][1][-1]
    return found


def _search(batches, k: int):
    """Records that add a bucket to their group, search in its buckets with a block of queries, or do both in this order."""
    last, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != last:
                last, held = r["bucket"], []
            if r["ids"] is not None:
                held.append(_Bucket(*_postings(r)))
            if r["q_ids"] is None or not held:
                continue
            qids, queries = _postings({c: r[f"q_{c}"] for c in _PACKED})
            found = _nearest(held, qids, queries, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids, [len(x) for x, _ in found]), pa.int64()),
                 *(pa.array(np.concatenate(x), pa.int64()) for x in zip(*found))],
                names=["query_id", "vec_id", "score"])


def _records(batches, chunk: int, block: int):
    """Rows sorted by group, candidates first, as records of ``chunk`` candidates or ``block`` queries."""
    key, held, n = None, [], 0

    def record():
        packed = _pack(pa.concat_tables(held)).to_pylist()[0]
        return pa.RecordBatch.from_pylist([{"bucket": key[0], **{("q_" if key[1] else "") + c: packed[c] for c in _PACKED}}], RECORD)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        group, is_query = table["bucket"].to_numpy(), table["is_query"].to_numpy()
        edges = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(is_query.astype(int), prepend=-1) != 0))
        for a, b in zip(edges, np.append(edges[1:], len(group))):
            if key != (group[a], is_query[a]):
                if n:
                    yield record()
                key, held, n = (int(group[a]), bool(is_query[a])), [], 0
            while a < b:
                take = min(b - a, (block if key[1] else chunk) - n)
                held.append(table.slice(a, take))
                a, n = a + take, n + take
                if n == (block if key[1] else chunk):
                    yield record()
                    held, n = [], 0
    if n:
        yield record()


def topk_search(queries: DataFrame, candidates: DataFrame, k: int, n_candidates: int, n_terms: float) -> DataFrame:
    """``queries``/``candidates``: rows of :func:`sparse_rows`; the number of candidates and their mean number of terms
    only size the groups and buckets."""
    chunk, block = max(1, min(CHUNK, int(CHUNK_TERMS / max(1.0, n_terms)))), QUERY_BLOCK
    at_once = candidates.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(n_candidates * n_terms / GROUP_TERMS), min(at_once, -(-n_candidates // chunk)))
    here = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    rows = candidates.select(here.alias("bucket"), F.lit(False).alias("is_query"), "vec_id", "terms", "weights").unionByName(
        queries.select(everywhere.alias("bucket"), F.lit(True).alias("is_query"), "vec_id", "terms", "weights"))
    found = rows.repartitionById(groups, "bucket").sortWithinPartitions("bucket", "is_query").mapInArrow(
        lean(lambda batches: _search(_records(batches, chunk, block), k)), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def topk_of_table(df: DataFrame, id_col: str, vec_col: str, k: int = 5, every: int = 50,
                  scale: float = 256.0) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates are all other rows."""
    rows = staged(sparse_rows(df, id_col, vec_col, scale), "vectors")
    n, terms = rows.agg(F.count(F.lit(1)), F.avg(F.size("terms"))).first()
    return topk_search(rows.filter(F.col("vec_id") % every == 0), rows, k, n, float(terms or 0.0))
