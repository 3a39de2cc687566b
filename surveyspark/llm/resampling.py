"""Target-distribution importance resampling with hashed n-gram features and line deduplication.

Every text is cut at newlines, which are separators, so no word crosses a cut. The distinct lines of all
documents are found once, with their number of occurrences; the features inside a line are hashed once and
counted times its occurrences. N-grams that cross a newline belong to no line: they are made per document
and added separately (with single words there are none). A bucket's gain is the scaled log ratio of its
smoothed share in the target texts to its share in the corpus; a document's weight is the sum of the gains
of its features. Adding seeded Gumbel noise and taking the highest scores draws without replacement.

Distribution. Lines are grouped by their text with map-side partial counts, so a line that a third of all
documents holds is one row per task before the shuffle. Lines travel once as text and then as a 16-byte
digest. Lines above a ten-thousandth of all lines (hence fewer than 10,000) are joined by broadcast; the
others by digest. The global order comes from ordered ranges with prefix sums: no task sorts everything.

Odd input. A null or empty text has no features: n_features and weight 0, and a score from the noise alone.
A null id takes the empty string into its noise. Repeated rows are documents of their own, with equal
scores; after equal ids the row's position in the input decides. An empty corpus gives no rows; an empty
target has T = 0. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import shuffle_width, staged

BUCKETS = 10_000        #: hash buckets of the features
MIN_WORDS = 20          #: documents with fewer words are not drawn
PERCENT = 10            #: share of the documents with enough words that is drawn
SEED = 2024             #: names the noise
SCALE = 1000            #: gains and noise are whole thousandths
HOT = 10_000            #: a line above this fraction of all lines is joined by broadcast
RANGE_ROWS = 200_000    #: rows of one ordered range
KNOWN = 500_000         #: words whose bucket a task remembers at a time

#: byte table: ASCII letters and digits stay (A-Z lower-cased), other ASCII separates, the rest are word bytes
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The lower-cased words of one UTF-8 text."""
    return text.translate(FOLD).split()


class Hashed(dict):
    """Feature -> bucket, remembered up to a bound."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % BUCKETS
        return found


def ngrams(found: list[bytes], n: int) -> list[bytes]:
    """All runs of 1 to ``n`` words, joined by one space."""
    out = list(found)
    for k in range(2, n + 1):
        out += [b" ".join(found[i:i + k]) for i in range(len(found) - k + 1)]
    return out


def crossing(text: bytes, n: int) -> list[bytes]:
    """The runs of 2 to ``n`` words of a text that lie in more than one line."""
    found, line_of = [], []
    for i, line in enumerate(text.split(b"\n")):
        w = words(line)
        found += w
        line_of += [i] * len(w)
    return [b" ".join(found[i:i + k]) for k in range(2, n + 1)
            for i in range(len(found) - k + 1) if line_of[i] != line_of[i + k - 1]]


def line_features(n: int):
    """Batches of (key, occ, line) -> (key, occ, n_words, buckets as packed 16-bit numbers)."""
    def run(batches):
        bucket = Hashed()
        for batch in batches:
            n_words, packed = [], []
            for line in batch.column("line").cast(pa.binary()):
                w = words(line.as_py())
                n_words.append(len(w))
                packed.append(np.array([bucket[f] for f in ngrams(w, n)], np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("occ"), pa.array(n_words, pa.int64()), pa.array(packed, pa.binary())],
                ["key", "occ", "n_words", "buckets"])
    return run


def cross_features(n: int):
    def run(batches):
        bucket = Hashed()
        for batch in batches:
            rows, packed = [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").cast(pa.binary())):
                found = crossing(text.as_py(), n)
                if found:
                    rows.append(row)
                    packed.append(np.array([bucket[f] for f in found], np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(packed, pa.binary())], ["row", "buckets"])
    return run


def unpacked(batch) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch in a row, and the number of each row's buckets."""
    col = batch.column("buckets")
    sizes = np.array([len(v.as_buffer()) // 2 for v in col], np.int64)
    return np.concatenate([np.frombuffer(v.as_buffer(), np.uint16) for v in col]) if len(col) else np.zeros(0, np.uint16), sizes


def tallied(batches):
    """(bucket, number) of a task's rows, each row counted as often as it occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        buckets, sizes = unpacked(batch)
        occ = np.repeat(batch.column("occ").to_numpy(zero_copy_only=False), sizes)
        np.add.at(total, buckets, occ)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])


def lines_of(docs: DataFrame, n: int) -> DataFrame:
    """The distinct lines of all texts: key, occ, n_words, buckets (staged)."""
    lines = (docs.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
             .groupBy("line").agg(F.count(F.lit(1)).alias("occ")))
    return staged(lines.select(F.unhex(F.md5("line")).alias("key"), "occ", "line")
                  .mapInArrow(line_features(n), "key binary, occ long, n_words long, buckets binary"), "resample-lines")


def cross_of(rows: DataFrame, n: int) -> DataFrame:
    """The n-grams of each row that cross a newline: row, buckets (staged); none with single words."""
    if n < 2:
        return rows.sparkSession.createDataFrame([], "row long, buckets binary")
    some = rows.select("row", "text").filter(F.col("text").contains("\n"))
    return staged(some.mapInArrow(cross_features(n), "row long, buckets binary"), "resample-cross")


def counts_of(lines: DataFrame, cross: DataFrame) -> np.ndarray:
    """Features of each bucket over all texts; at most ``BUCKETS`` rows reach the driver."""
    both = lines.select("occ", "buckets").unionByName(cross.select(F.lit(1).cast("long").alias("occ"), "buckets"))
    total = np.zeros(BUCKETS, np.int64)
    for r in both.mapInArrow(tallied, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of the smoothed target share to the smoothed corpus share, per bucket."""
    S, T = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(SCALE * math.log((float(t) + 1.0) * S / ((float(s) + 1.0) * T)))
                     for s, t in zip(corpus, target)], np.int64)


def weigher(gain: np.ndarray, keep: list[str]):
    """Batches with buckets -> the kept columns, n_features and the summed gain."""
    def run(batches):
        for batch in batches:
            buckets, sizes = unpacked(batch)
            sums = np.concatenate([[0], np.cumsum(gain[buckets])])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes], pa.int64())],
                [*keep, "n_features", "weight"])
    return run


def weigh(rows: DataFrame, lines: DataFrame, cross: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, doc_id, n_words, n_features, weight of every row."""
    parts = lines.select("key", "occ", "n_words", "buckets").mapInArrow(
        weigher(gain, ["key", "occ", "n_words"]), "key binary, occ long, n_words long, n_features long, weight long")
    parts = staged(parts, "resample-weights")
    total = parts.agg(F.sum("occ")).first()[0] or 0
    is_hot = F.col("occ") * HOT > F.lit(total)
    stats = F.struct("n_words", "n_features", "weight")
    hot = parts.filter(is_hot).select("key", stats.alias("hot"))
    cold = parts.filter(~is_hot).select(F.col("key").alias("cold_key"), stats.alias("cold"))
    cut = rows.select("row", "doc_id", F.explode_outer(F.split("text", "\n")).alias("line"))
    cut = cut.select("row", "doc_id", F.unhex(F.md5("line")).alias("key")).join(F.broadcast(hot), "key", "left")
    # rows that need no lookup get a key of their own, so that they spread instead of meeting
    cut = cut.withColumn("cold_key", F.when(F.col("hot").isNull() & F.col("key").isNotNull(), F.col("key"))
                         .otherwise(F.unhex(F.md5(F.concat(F.lit("row "), F.col("row"))))))
    found = cut.join(cold, "cold_key", "left").select("row", "doc_id", F.coalesce("hot", "cold").alias("s"))
    found = found.select("row", "doc_id", "s.n_words", "s.n_features", "s.weight")
    extra = cross.mapInArrow(weigher(gain, ["row"]), "row long, n_features long, weight long").select(
        "row", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("n_words"), "n_features", "weight")
    none = F.lit(0).cast("long")
    return found.unionByName(extra).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *(F.coalesce(F.sum(c), none).alias(c) for c in ("n_words", "n_features", "weight")))


def noise(doc_id) -> F.Column:
    """Gumbel noise of an id in whole thousandths."""
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``score`` and ``rank``: 1, 2, ... down the scores of the drawn rows, null for the others."""
    spark = weighed.sparkSession
    able = F.col("n_words") >= min_words
    rows = staged(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"))).withColumn("able", able), "resample-scored")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("able").alias("able")).first()
    take = size["able"] * percent // 100
    width = max(shuffle_width(spark), math.ceil(size["n"] / RANGE_ROWS))
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    ranged = staged(rows.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id()), "resample-ranged")
    held = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(held):
        starts.append((part, before))
        before += held[part]
    offset = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return (ranged.join(offset, "part", "left").withColumn("rank", at)
            .withColumn("rank", F.when(F.col("able") & (F.col("rank") <= take), F.col("rank")))
            .select("doc_id", "n_features", "weight", "score", "rank"))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) with its weight towards the texts of ``target`` and its rank if drawn."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    lines, cross = lines_of(docs, n), cross_of(rows, n)
    aims = target.select(F.monotonically_increasing_id().alias("row"), "text")
    aimed = counts_of(lines_of(target, n), cross_of(aims, n))
    return draw(weigh(rows, lines, cross, gains(counts_of(lines, cross), aimed)), percent, min_words)
