"""Language-model scoring by Katz backoff over words, bigrams on unigrams.

Tokens: texts with A-Z lower-cased, cut at ASCII white space, then one end; the first token's
context is a begin mark. Learning reads every document that is not held out.

Model: ``p1(w) = d1(c) c / N``; what discounting frees is the probability of the unknown word.
``p(w | v) = d2(c(vw)) c(vw) / c(v)`` for a seen pair, else ``alpha(v) p1(w)`` with
``alpha(v) = (1 - sum d2 c(vw) / c(v)) / (1 - sum p1(w))`` over the words seen after v, so every
context sums to 1 exactly. d is Good-Turing's for counts up to ``K`` (absolute discounting where the
counts of counts don't give one between 0 and 1); larger counts keep 1 - ``EPSILON`` of theirs, so
that no backoff weight is 0. An unseen context backs off with weight 1.

Jobs:
1. The unigram table (word, c) by a partial and a final count. Words with at least 1 / ``HOT`` of all
   tokens - at most ``HOT`` of them - are broadcast with their counts.
2. Token pairs, counted per document, are dealt by their second word; pairs of a hot second word by
   the whole pair, so no word fills a bucket. A bucket counts its pairs and words and evaluates every
   pair of every document against them: a seen pair gives its discounted count, an unseen one its
   unigram probability and a question to the context's bucket. It stores partial sums of documents
   and of contexts (the backoff table's rows) as a table partitioned by kind.
3. Context buckets add up their partial sums, solve alpha and answer the questions.
4. Document buckets add up.
Discounts need counts of counts, so partial sums hold the number of pairs per small count.

Words are compared by 64-bit hashes (hot words by number) in steps 2 to 4.

Defined results: null text is empty (one end token); rows that repeat are documents of their own; a
null id is not held out; other columns are ignored; without a learnable document N is 0 and the model
gives the unknown word probability 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.blobs import joined, rows_by_bucket
from surveyspark.llm.common import mix64, shuffle_width, shared_path, shuffle_cleanup, slices, staged, texts_of

K = 5
EPSILON = 1e-3
HOT = 20_000
PAIRS_PER_BUCKET = 2_000_000
DOCS_PER_BUCKET = 8_192
BEGIN, END, FIRST_HOT = 0, 1, 2
HASHED = np.uint64(1 << 63)
SLICE = 3 << 20
BLOB = "kind string, bucket long, data binary"


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words, number of words of each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    row, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(keep)), np.bincount(row[keep], minlength=len(texts))


def unigrams(docs: DataFrame) -> DataFrame:
    """(word, c) over the documents that are not held out; the row '' counts ends, so documents."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                part = part.filter(pc.invert(part.column(part.schema.get_field_index("held"))))
                words, _ = words_of(texts_of(part))
                found = words.value_counts()
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([found.field(0), pa.array([""], pa.string())]),
                     pa.concat_arrays([found.field(1), pa.array([part.num_rows], pa.int64())])], names=["word", "c"])

    return docs.select("text", "held").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).filter(F.col("c") > 0)


def discounts(n: list[int]) -> np.ndarray:
    """d_1..d_K from the counts of counts n_1..n_{K+1}."""
    out = np.array([(r - 0.5) / r for r in range(1, K + 1)])
    if n[0] > 0:
        cut = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] > 0 and cut < 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut)
                if 0 < d < 1:
                    out[r - 1] = d
    return out


class Unigram:
    """What every task knows of the unigram level: hot words, totals and discounts."""

    def __init__(self, hot: dict[str, int], hot_counts: np.ndarray, ends: int, total: int, big: int, n: list[int]):
        self.hot, self.ends, self.total = hot, ends, total
        self.counts = np.concatenate([[ends, ends], hot_counts]).astype(np.int64)  # by number; begin is a context only
        self.d = discounts(n)
        free = big * EPSILON + sum(r * (1 - self.d[r - 1]) * n[r - 1] for r in range(1, K + 1))
        #: the probability of the unknown word: what the discounts free
        self.unknown = free / total if total else 1.0

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(counts > K, counts * (1 - EPSILON), counts * np.append(0.0, self.d)[np.minimum(counts, K)])


def _keys(words: pa.Array, hot: dict[str, int]) -> np.ndarray:
    packed = words.dictionary_encode()
    keys = np.array([hot[w] if w in hot else xxhash.xxh3_64_intdigest(w) | (1 << 63) for w in packed.dictionary.to_pylist()], np.uint64)
    return keys[packed.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix64(keys + np.uint64(1)) % np.uint64(n)).astype(np.int64)


def pairs(docs: DataFrame, model, n_buckets: int, n_doc_buckets: int) -> DataFrame:
    """Blobs of (second, first, document, times, learned) by bucket, and of the documents' facts."""

    def deal(batches):
        uni, task, row = model.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n = part.num_rows
                words, sizes = words_of(texts_of(part))
                ends = np.cumsum(sizes + 1)
                second = np.full(int(ends[-1]), END, np.uint64)
                inner = np.ones(len(second), bool)
                inner[ends - 1] = False
                second[inner] = _keys(words, uni.hot)
                first = np.empty_like(second)
                first[1:] = second[:-1]
                first[np.append(0, ends[:-1])] = BEGIN
                owner = np.repeat(np.arange(n), sizes + 1)
                order = np.lexsort((first, second, owner))
                s, f, o = second[order], first[order], owner[order]
                new = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (f[1:] != f[:-1]) | (o[1:] != o[:-1])))
                times = np.diff(np.append(new, len(s))).astype(np.uint32)
                s, f, o = s[new], f[new], o[new]
                uid = (np.int64(task) << 33) + row + np.arange(n)
                held = part.column(part.schema.get_field_index("held")).to_numpy(zero_copy_only=False)
                row += n
                by_pair = s < HASHED
                key = np.where(by_pair, s * np.uint64(0x9E3779B97F4A7C15) + f, s)
                order = np.lexsort((f, s))
                out = [("p", b, data) for b, data in rows_by_bucket(
                    _bucket(key, n_buckets)[order], s[order], f[order], uid[o][order], times[order], ~held[o][order])]
                ids = part.column(part.schema.get_field_index("doc_id"))
                out += [("i", b, data) for b, data in rows_by_bucket(
                    _doc_bucket(uid, n_doc_buckets), uid, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                    held, (sizes + 1).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=BLOB_ARROW)

    return docs.select("doc_id", "held", "text").mapInArrow(deal, BLOB)


BLOB_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("data", pa.binary())])


def _doc_bucket(uid: np.ndarray, n: int) -> np.ndarray:
    return _bucket(uid.astype(np.uint64), n)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, group number of each row) of equal runs."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _evaluate(table: pa.Table, uni: Unigram, n_buckets: int, n_doc_buckets: int) -> pa.Table:
    """One bucket of pairs: partial sums of documents (d) and contexts (v), questions (q), counts of counts (n)."""
    second, first, uid, times, learned = joined(
        table["data"].to_pylist(), [np.uint64, np.uint64, np.int64, np.uint32, np.bool_])
    order = np.lexsort((first, second))
    second, first, uid, times, learned = (x[order] for x in (second, first, uid, times.astype(np.int64), learned))
    starts, pair = _groups(second, first)
    c_pair = np.add.reduceat(times * learned, starts)
    word_starts, word = _groups(second[starts])
    c_word = np.add.reduceat(c_pair, word_starts)
    keys = second[starts][word_starts]
    numbered = keys < HASHED
    c_word[numbered] = uni.counts[keys[numbered].astype(np.int64)]
    c_word = c_word[word]                      # per pair
    out = [("n", 0, rows) for _, rows in rows_by_bucket(
        np.zeros(K + 1, np.int64), np.array([(c_pair == r).sum() for r in range(1, K + 2)], np.int64))]

    # documents: one row per document of this bucket
    cp, cw = c_pair[pair], c_word[pair]
    seen, known = cp > 0, cw > 0
    log_w = np.log10(np.maximum(cw, 1))
    base = times * np.log10(cw + 0.1)
    score = np.where(cp > K, times * np.log10(np.maximum(cp, 1) * (1 - EPSILON)), 0.0)
    score += np.where(~seen, times * np.log10(np.where(known, uni.kept(cw) / max(1, uni.total), uni.unknown)), 0.0)
    score -= np.where(known & (second != END), times * log_w, 0.0)
    if len(uid):
        by_doc = np.argsort(uid, kind="stable")
        doc_starts, _ = _groups(uid[by_doc])
        docs = uid[by_doc][doc_starts]
        # one column at a time: each is as long as the bucket
        add_up = lambda x: np.add.reduceat(x[by_doc], doc_starts)
        base, score, known = add_up(base), add_up(score), add_up(times * known).astype(np.uint32)
        small = [add_up(times * (cp == r)).astype(np.uint32) for r in range(1, K + 1)]
        out += [("d", b, data) for b, data in rows_by_bucket(
            _doc_bucket(docs, n_doc_buckets), docs, base, score, known, *small)]
        del by_doc, doc_starts, docs, base, score, known, small

    # contexts: one row per first word of the learned pairs
    ask = np.flatnonzero(~seen)
    own = np.flatnonzero(c_pair > 0)
    context, cp, cw = first[starts][own], c_pair[own], c_word[own]
    order = np.argsort(context, kind="stable")
    context, cp, cw = context[order], cp[order], cw[order]
    run, _ = _groups(context)
    if len(run):
        sums = [np.add.reduceat(x, run) for x in (
            np.where(cp > K, cp, 0), np.where(cw > K, cw, 0), *((cp == r).astype(np.int64) for r in range(1, K + 1)),
            *((cw == r).astype(np.int64) for r in range(1, K + 1)))]
        out += [("v", b, data) for b, data in rows_by_bucket(
            _bucket(context[run], n_buckets), context[run], sums[0], sums[1], *(x.astype(np.uint32) for x in sums[2:]))]
    if len(ask):
        out += [("q", b, data) for b, data in rows_by_bucket(
            _bucket(first[ask], n_buckets), first[ask], uid[ask], times[ask].astype(np.uint32))]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), BLOB_ARROW.types)], schema=BLOB_ARROW)


V_KINDS = [np.uint64, np.int64, np.int64, *[np.uint32] * (2 * K)]
D_KINDS = [np.int64, np.float64, np.float64, np.uint32, *[np.uint32] * K]


def _answer(table: pa.Table, uni: Unigram, d2: np.ndarray, n_doc_buckets: int) -> pa.Table:
    """One bucket of contexts: alpha of each, and log10(alpha * c) for every question."""
    kinds, data = np.array(table["kind"].to_pylist(), object), table["data"].to_pylist()
    cols = joined([x for x, k in zip(data, kinds) if k == "v"], V_KINDS)
    asked, uid, times = joined([x for x, k in zip(data, kinds) if k == "q"], [np.uint64, np.int64, np.uint32])
    out: list = []
    if len(asked):
        order = np.argsort(cols[0], kind="stable")
        cols = [c[order] for c in cols]
        run, _ = _groups(cols[0])
        value = np.zeros(len(asked))
        if len(run):
            context = cols[0][run]
            sums = [np.add.reduceat(c.astype(np.int64), run) for c in cols[1:]]
            r = np.arange(1, K + 1)
            pairs_, words_ = np.array(sums[2:2 + K]), np.array(sums[2 + K:])
            count = sums[0] + (r[:, None] * pairs_).sum(axis=0)
            left = sums[0] * EPSILON + (r[:, None] * (1 - d2[:, None]) * pairs_).sum(axis=0)
            inside = (sums[1] * (1 - EPSILON) + (r[:, None] * uni.d[:, None] * words_).sum(axis=0)) / uni.total
            # alpha * c(v) = (c - kept) / (1 - sum of p1)
            weight = np.log10(left) - np.log10(1 - inside)
            at = np.minimum(np.searchsorted(context, asked), len(context) - 1)
            value = np.where(context[at] == asked, weight[at], 0.0)
        out = [("a", b, x) for b, x in rows_by_bucket(_doc_bucket(uid, n_doc_buckets), uid, value * times)]
    if not out:
        return BLOB_ARROW.empty_table()
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), BLOB_ARROW.types)], schema=BLOB_ARROW)


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finish(table: pa.Table, uni: Unigram, d2: np.ndarray, n_words: int) -> pa.Table:
    """One bucket of documents: facts, partial sums and answers added up."""
    kinds, data = np.array(table["kind"].to_pylist(), object), table["data"].to_pylist()
    of = lambda k, types: joined([x for x, y in zip(data, kinds) if y == k], types)
    uid, doc_id, null, held, n_tokens = of("i", [np.int64, np.int64, np.bool_, np.bool_, np.int64])
    order = np.argsort(uid)
    uid, doc_id, null, held, n_tokens = (x[order] for x in (uid, doc_id, null, held, n_tokens))
    cols = of("d", D_KINDS)
    at = np.searchsorted(uid, cols[0])
    add = lambda x: np.bincount(at, weights=x, minlength=len(uid))
    score = add(cols[2])
    for r in range(1, K + 1):
        score += add(cols[3 + r]) * np.log10(r * d2[r - 1])
    asked, value = of("a", [np.int64, np.float64])
    score += np.bincount(np.searchsorted(uid, asked), weights=value, minlength=len(uid))
    score -= np.log10(max(1, uni.ends))
    base = add(cols[1]) - n_tokens * np.log10(uni.total + 0.1 * (n_words + 1))
    return pa.Table.from_arrays([pa.array(doc_id, mask=null), pa.array(held), pa.array(n_tokens), pa.array(add(cols[3]).astype(np.int64)),
                                 pa.array(np.full(len(uid), uni.total, np.int64)), pa.array(base), pa.array(score)], schema=RESULT)


def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    words = staged(unigrams(docs), "katz-unigrams")
    small = [F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, K + 2)]
    facts = words.agg(F.sum("c").alias("total"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == "", F.col("c"))).alias("ends"),
                      F.sum(F.when(F.col("c") > K, F.col("c"))).alias("big"), *small).first()
    total, ends, n = facts["total"] or 0, facts["ends"] or 0, [facts[f"n{r}"] for r in range(1, K + 2)]
    # counts sum to the total, so at most HOT words reach this share
    hot = words.filter((F.col("c") * HOT >= total) & (F.col("word") != "")).toArrow()
    names = hot["word"].to_pylist()
    uni = Unigram({w: FIRST_HOT + i for i, w in enumerate(names)}, hot["c"].to_numpy(), ends, total, facts["big"] or 0, n)
    model = spark.sparkContext.broadcast(uni)
    n_docs = docs.count()
    n_buckets = max(shuffle_width(spark), -(-total // PAIRS_PER_BUCKET))
    n_doc_buckets = max(1, min(n_buckets, shuffle_width(spark)), -(-n_docs // DOCS_PER_BUCKET))
    dealt = pairs(docs, model, n_buckets, n_doc_buckets)

    def evaluate(key, table):
        if key[0].as_py() == "i":
            return table.select(["kind", "bucket", "data"])
        return _evaluate(table, model.value, n_buckets, n_doc_buckets)

    path = shared_path(spark, "katz-sums")
    with shuffle_cleanup(spark):
        # the blobs are compressed already
        (dealt.groupBy("kind", "bucket").applyInArrow(evaluate, BLOB)
         .write.option("compression", "uncompressed").partitionBy("kind").parquet(path))
    sums = spark.read.schema("bucket long, data binary, kind string").parquet(path).select("kind", "bucket", "data")
    counted = sums.filter(F.col("kind") == "n").select("data")

    def add_up(batches):
        for batch in batches:
            if batch.num_rows:
                both = np.add.reduce([joined([x], [np.int64])[0] for x in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, K + 2)), pa.array(both)], names=["r", "n"])

    n2 = dict.fromkeys(range(1, K + 2), 0) | {r["r"]: r["n"] for r in counted.mapInArrow(add_up, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()}
    d2 = discounts([n2[r] for r in range(1, K + 2)])
    answers = (sums.filter(F.col("kind").isin("v", "q")).groupBy("bucket")
               .applyInArrow(lambda t: _answer(t, model.value, d2, n_doc_buckets), BLOB))
    return (sums.filter(F.col("kind").isin("i", "d")).union(answers).groupBy("bucket")
            .applyInArrow(lambda t: _finish(t, model.value, d2, facts["v"]), "doc_id long, held_out boolean, n_tokens long, "
                          "n_known long, train_tokens long, base_score double, score double"))
