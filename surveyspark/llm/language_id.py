"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of byte counts up to order ``ORDER``. The code length of a byte
is that of PPM with escape method C under frozen counts: in the longest context seen in the tree
the byte costs -log2(c / (T + D)) if it was seen there, else an escape -log2(D / (T + D)) and one
order less; below order 0 every byte costs 8 bits. A text starts after ``ORDER`` line feeds. The
language with the shortest code for the whole text wins.

Learning reads a bounded sample: about ``TRAIN_DOCS`` documents of each language, chosen by a hash
of the id, whole texts. The trees are broadcast; their size is bounded by that sample. Prediction
is a map over the rows: no shuffle, so no key can be hot.

``score`` is the winner's share of the per-byte likelihoods, 2**-(bits/byte), between 0 and 1.

Defined results: null, empty or letterless text gives ``und`` and score 0, as does a table without
a learnable row; rows with a null id are predicted but not learned from; ties go to the smaller
language name; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import lean, release_memory, slices, texts_of

ORDER = 3
TRAIN_DOCS = 4000
UNDETERMINED = "und"
#: bytes of text that a worker codes at a time (a longer text alone)
SLICE = 1 << 20
LETTER = regex.compile(r"\p{L}")
#: the pipeline drops a text that needs more than this many times the bits per byte which all but a hundredth of
#: its language's held-out documents need, and SLACK bits more
EXCESS, ALL_BUT, SLACK = 1.5, 0.99, 400.0


def held_out(id_col: str = "doc_id"):
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def byte_codes(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): per byte its context and itself as one number, and where each text starts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64,
                            count=len(texts) + texts.offset + 1)[texts.offset:].astype(np.int64)
    lens = np.diff(offsets)
    n = int(offsets[-1] - offsets[0])
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(lens), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    position = np.arange(n, dtype=np.int64) - np.repeat(starts, lens)
    codes = raw.astype(np.uint32)
    for back in range(1, order + 1):
        prev = np.full(n, 10, np.uint32)
        prev[back:] = raw[:-back]
        prev[position < back] = 10
        codes |= prev << np.uint32(8 * back)
    return codes, starts


class Trees:
    """Counts of all languages; ``costs`` gives bits per (code, language)."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.langs, self.order = langs, order
        self.levels = [[self._level(codes, n, k) for k in range(order + 1)] for codes, n in counts]
        self.known = np.unique(np.concatenate([c for c, _ in counts])) if counts else np.zeros(0, np.uint32)
        self.known_costs = self._compute(self.known)

    @staticmethod
    def _level(codes, n, k):
        gram = codes.astype(np.uint64) & np.uint64((1 << 8 * (k + 1)) - 1)
        grams, where = np.unique(gram, return_inverse=True)
        count = np.bincount(where, weights=n)
        contexts, where = np.unique(grams >> np.uint64(8) if k else np.zeros(len(grams), np.uint64), return_inverse=True)
        # the context of code b_k..b_1 b_0 is b_k..b_1
        return grams, count, contexts, np.bincount(where, weights=count), np.bincount(where).astype(float)

    @staticmethod
    def _find(keys, values):
        if not len(keys):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return at, keys[at] == values

    def _compute(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), len(self.langs)))
        codes = codes.astype(np.uint64)
        for j, levels in enumerate(self.levels):
            open_, bits = np.ones(len(codes), bool), np.zeros(len(codes))
            for k in range(self.order, -1, -1):
                grams, count, contexts, total, distinct = levels[k]
                gram = codes & np.uint64((1 << 8 * (k + 1)) - 1)
                at, seen = self._find(contexts, gram >> np.uint64(8) if k else np.zeros(len(codes), np.uint64))
                hit_at, hit = self._find(grams, gram)
                if len(contexts):
                    whole = total[at] + distinct[at]
                    bits += np.where(open_ & hit, np.log2(whole / count[hit_at]), 0.0)
                    bits += np.where(open_ & seen & ~hit, np.log2(whole / distinct[at]), 0.0)
                open_ &= ~hit
            out[:, j] = bits + 8.0 * open_
        return out

    def costs(self, codes: np.ndarray) -> np.ndarray:
        at, hit = self._find(self.known, codes)
        out = self.known_costs[at] if len(self.known) else np.zeros((len(codes), len(self.langs)))
        if not hit.all():
            out[~hit] = self._compute(codes[~hit])
        return out

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each whole text in each language."""
        codes, starts = byte_codes(texts, self.order)
        out = np.zeros((len(texts), len(self.langs)))
        if not len(codes):
            return out
        packed = pa.array(codes).dictionary_encode()
        costs = self.costs(packed.dictionary.to_numpy())
        index = packed.indices.to_numpy()
        ends = np.append(starts[1:], len(codes))
        full = np.flatnonzero(ends > starts)
        for j in range(len(self.langs)):
            out[full, j] = np.add.reduceat(costs[index, j], starts[full])
        return out


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          train_docs: int = TRAIN_DOCS, order: int = ORDER) -> Trees:
    """Trees from about ``train_docs`` learnable documents of each language."""
    usable = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
                       & ~held_out(id_col))
    # one tree per language is the model itself, so its names fit the driver
    sizes = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Trees([], [], order)
    langs = sorted(sizes)
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col(lang_col) == lang, F.lit(min(10**6, 10**6 * train_docs // sizes[lang] + 1))).otherwise(share)
    sample = usable.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(10**6)) < share)

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                names = np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), object)
                texts = texts_of(part)
                for lang in np.unique(names):
                    codes, _ = byte_codes(texts.filter(pa.array(names == lang)), order)
                    counted = pa.array(codes).value_counts()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(counted), pa.string()), counted.field(0).cast(pa.int64()),
                         counted.field(1)], names=["lang", "code", "n"])

    counted = (sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
               .mapInArrow(lean(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
               .toArrow())
    names = np.array(counted["lang"].to_pylist(), object)
    codes, n = counted["code"].to_numpy().astype(np.uint32), counted["n"].to_numpy()
    parts = []
    for lang in langs:
        own = names == lang
        rank = np.argsort(codes[own])
        parts.append((codes[own][rank], n[own][rank]))
    return Trees(langs, parts, order)


def predict(df: DataFrame, trees: Trees, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score", bits_out: str | None = None) -> DataFrame:
    """``df`` with the language and its score (and the bits of its code); every other column passes through.

    Only the text goes to Python and only the result comes back; the row itself stays in the JVM.
    """
    model = df.sparkSession.sparkContext.broadcast(trees)

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = model.value
        try:
            for column in columns:
                batch = pa.RecordBatch.from_arrays([column], ["text"])
                parts = [_judged(texts_of(part), trees) for part in slices(batch, "text", SLICE)]
                yield pa.concat_arrays(parts) if parts else _judged(pa.array([], pa.string()), trees)
        finally:
            release_memory()

    found = F.arrow_udf(judge, "struct<lang:string,score:double,bits:double>").asNondeterministic()
    out = df.drop(lang_out, score_out).withColumn("llm_judged", found(F.col(text_col)))
    out = out.withColumns({lang_out: F.col("llm_judged.lang"), score_out: F.col("llm_judged.score")})
    return (out.withColumn(bits_out, F.col("llm_judged.bits")) if bits_out else out).drop("llm_judged")


def _judged(texts: pa.Array, trees: Trees) -> pa.StructArray:
    """Language, score and bits of each text."""
    has = np.array([LETTER.search(x) is not None for x in texts.to_pylist()], bool) & bool(trees.langs)
    n = len(texts)
    share, lang, bits = np.zeros(n), np.full(n, UNDETERMINED, object), np.zeros(n)
    if trees.langs and n:
        lengths = trees.code_lengths(texts)
        sizes = np.maximum(1, pc.binary_length(texts).to_numpy(zero_copy_only=False))
        rate = lengths / sizes[:, None]
        bits = np.where(has, lengths.min(axis=1), 0.0)
        share = np.where(has, 1.0 / np.exp2(rate.min(axis=1, keepdims=True) - rate).sum(axis=1), 0.0)
        lang = np.where(has, np.array(trees.langs, object)[lengths.argmin(axis=1)], UNDETERMINED)
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(bits, pa.float64())],
                                      ["lang", "score", "bits"])


def usual_rates(docs: DataFrame, trees: Trees) -> dict[str, float]:
    """Per language the bits a byte that all but a hundredth of its labelled held-out documents need (one row a language)."""
    rows = docs.filter(held_out() & F.col("lang").isin(trees.langs) & (F.length("text") > 0)).select("lang", "text")
    rate = F.col("llm_bits") / F.octet_length("text")
    found = (predict(rows, trees, bits_out="llm_bits").filter(F.col("lang_pred") == F.col("lang"))
             .groupBy("lang").agg(F.percentile_approx(rate, ALL_BUT, 10_000).alias("rate")).collect())
    return {r["lang"]: r["rate"] for r in found}


def keep_known(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents without a determined language go, and those that no learned language explains.

    A text goes if its code is longer than ``EXCESS`` times what its language's own
    held-out documents need for as many bytes, and ``SLACK`` bits more, so that
    short texts stay. A language without held-out documents rejects nothing, and
    a table without a learnable row keeps all its rows.
    """
    trees = learn(docs)
    if not trees.langs:
        return docs
    usual = usual_rates(docs, trees)
    found = predict(docs, trees, lang_out="llm_lang", score_out="llm_score", bits_out="llm_bits")
    limit = F.lit(None).cast("double")
    for lang, rate in usual.items():
        limit = F.when(F.col("llm_lang") == lang, EXCESS * rate * F.octet_length("text") + SLACK).otherwise(limit)
    known = (F.col("llm_lang") != UNDETERMINED) & (limit.isNull() | (F.col("llm_bits") <= limit))
    return found.filter(known).select(*docs.columns)
