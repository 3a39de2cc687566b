"""Token ids in training order, written as fixed-stride binary shards.

1. Tokenise: whole texts become byte-level BPE ids, each text followed by the end id, and are packed
   without gaps into sequences of ``seq_len`` ids within an input partition (the last is padded with
   the end id). The packed blocks are written to the shared folder with their partition and position,
   so a sequence's number - its rank by (partition, position) - never changes again.
2. Order: a keyed Feistel network with cycle-walking permutes the numbers 0..N-1; the result is the
   sequence's slot, which every task computes for itself.
3. Write: slots are cut into ranges of ``rows_per_shard``; a range meets in one task and becomes one
   file of records of equal length, written by Spark's committer. A lost task is run again from the
   blocks.

Record: sequence number (int64), ids that are not padding (uint32), CRC-32 of the ids (uint32),
``seq_len`` ids (uint16), a line feed; little-endian. Slot s lies in shard ``s // rows_per_shard`` at
byte ``(s % rows_per_shard) * stride``, so reading can start at any slot.

Memory: a task holds one shard (``rows_per_shard * stride`` bytes) or one block. The driver sees one
number per input partition.

Defined results: null text is the empty text (one end id); repeated rows are texts of their own;
other columns are ignored; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm.blobs import joined, rows_by_bucket
from surveyspark.llm.common import mix64, shared_path, shuffle_cleanup, slices, texts_of

#: default path of the public vocabulary file; every function takes it as a parameter
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END_ID = 50256
#: the vocabulary's pattern and Unicode's white space (fixed values)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: the pattern never joins characters across these units, so they are encoded one by one
UNITS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SEQ_LEN = 1024
ROWS_PER_SHARD = 4096
BLOCK_ROWS = 1024
KNOWN_UNITS = 250_000
ROUNDS = 6
HEADER = "<qII"
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Byte-level BPE with a bounded memory of units: unit -> its ids as bytes."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}
        self.bpe = tiktoken.Encoding("shipped", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        units = UNITS.findall(text)
        if len(self.known) > KNOWN_UNITS:
            self.known = {}
        for unit in set(units).difference(self.known):
            self.known[unit] = np.array(self.bpe.encode_ordinary(unit), "<u2").tobytes()
        return b"".join(map(self.known.__getitem__, units))


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(SparkFiles.get(name))
    return _ENCODERS[name]


class Permutation:
    """A keyed bijection of 0..n-1: a Feistel network on the next power of 4, walked until inside."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.keys = mix64(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        mask, half = np.uint64((1 << self.half) - 1), np.uint64(self.half)
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        return (left << half) | right

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        x = self._once(numbers.astype(np.uint64), self.keys)
        while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[out] = self._once(x[out], self.keys)
        return x.astype(np.int64)

    def inverse(self, slots: np.ndarray) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        swap = lambda x: ((x & mask) << half) | (x >> half)
        back = lambda x: swap(self._once(swap(x), self.keys[::-1]))
        x = back(slots.astype(np.uint64))
        while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[out] = back(x[out])
        return x.astype(np.int64)


def stride_of(seq_len: int) -> int:
    return struct.calcsize(HEADER) + 2 * seq_len + 1


def token_blocks(docs: DataFrame, vocabulary: str, seq_len: int) -> DataFrame:
    """(part, first, n, used, ids): blocks of packed sequences; ``used`` is the ids of the last one."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    end = np.array([END_ID], "<u2").tobytes()
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("used", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        own, part, first = encoder(name), TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3)
        width = 2 * seq_len
        held = bytearray()

        def block(n, used):
            nonlocal first
            data = bytes(held[:n * width])
            del held[:n * width]
            first += n
            return pa.RecordBatch.from_pylist(
                [{"part": part, "first": first - n, "n": n, "used": used, "ids": squeeze.compress(data)}], schema)

        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                for text in texts_of(piece).to_pylist():
                    held += own.encode(text)
                    held += end
                    while len(held) >= BLOCK_ROWS * width:
                        yield block(BLOCK_ROWS, seq_len)
        if held:
            n = -(-len(held) // width)
            used = (len(held) - (n - 1) * width) // 2
            held += end * ((n * width - len(held)) // 2)
            yield block(n, used)

    return docs.select("text").mapInArrow(run, "part int, first long, n int, used int, ids binary")


def write_shards(docs: DataFrame, path: str, key: int = 2024, vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN,
                 rows_per_shard: int = ROWS_PER_SHARD) -> int:
    """Write ``docs`` (text) below ``path`` in training order; returns the number of sequences."""
    spark = docs.sparkSession
    with shuffle_cleanup(spark):
        token_blocks(docs, vocabulary, seq_len).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
        blocks = spark.read.schema("part int, first long, n int, used int, ids binary").parquet(f"{path}/blocks")
        # one row per input partition
        counts = blocks.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toArrow()
        parts, sizes = counts["part"].to_numpy(), counts["n"].to_numpy()
        total = int(sizes.sum())
        manifest = spark.range(1).select(F.lit(total).cast("long").alias("n_sequences"), F.lit(seq_len).alias("seq_len"),
                                         F.lit(rows_per_shard).alias("rows_per_shard"), F.lit(stride_of(seq_len)).alias("stride"),
                                         F.lit(key).cast("long").alias("key"))
        manifest.write.parquet(f"{path}/manifest")
        if not total:
            return 0
        base = spark.sparkContext.broadcast((parts, np.cumsum(sizes) - sizes))

        def deal(batches):
            order, (parts_, starts) = Permutation(total, key), base.value
            plain = zstandard.ZstdDecompressor()
            for batch in batches:
                for r in batch.to_pylist():
                    ids = np.frombuffer(plain.decompress(r["ids"]), np.dtype(f"V{2 * seq_len}"))
                    number = starts[np.searchsorted(parts_, r["part"])] + r["first"] + np.arange(r["n"])
                    used = np.full(r["n"], seq_len, np.uint32)
                    used[-1] = r["used"]
                    slot = order(number)
                    out = [(s, x, _squeezed(ids, own)) for s, x, own in _by_shard(slot // rows_per_shard, slot, number, used)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["shard", "head", "ids"])

        def assemble(table: pa.Table) -> pa.Table:
            plain = zstandard.ZstdDecompressor()
            slot, number, used = joined(table["head"].to_pylist(), [np.int64, np.int64, np.uint32])
            ids = b"".join(plain.decompress(x) for x in table["ids"].to_pylist())
            width = 2 * seq_len
            records = []
            for i in np.argsort(slot):
                data = ids[i * width:(i + 1) * width]
                records.append(struct.pack(HEADER, number[i], used[i], zlib.crc32(data)) + data)
            return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "value": pa.array([b"\n".join(records)], pa.binary())})

        # one row per shard; the text writer adds the last line feed
        (blocks.mapInArrow(deal, "shard long, head binary, ids binary").groupBy("shard").applyInArrow(assemble, "shard long, value binary")
         .select("shard", F.col("value").cast("string").alias("value"))
         .write.option("lineSep", "\n").partitionBy("shard").text(f"{path}/shards"))
    return total


def _by_shard(shard: np.ndarray, *columns: np.ndarray):
    at = {b: np.flatnonzero(shard == b) for b in np.unique(shard)}
    for b, data in rows_by_bucket(shard, *columns):
        yield b, data, at[b]


def _squeezed(ids: np.ndarray, own: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(ids[own].tobytes())


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, with_ids: bool = True) -> DataFrame:
    """Slots ``start`` to ``stop`` from the shards that hold them, each record checked against its CRC."""
    m = spark.read.parquet(f"{path}/manifest").first()
    stop = m["n_sequences"] if stop is None else min(stop, m["n_sequences"])
    seq_len, rows, stride = m["seq_len"], m["rows_per_shard"], m["stride"]
    columns = "slot long, shard long, byte_offset long, seq_id long, n_ids long, ids_crc32 long"
    schema = columns + (", ids array<int>" if with_ids else "")
    if stop <= start:
        return spark.createDataFrame([], schema)
    files = (spark.read.format("binaryFile").load(f"{path}/shards")
             .filter(F.col("shard").between(start // rows, (stop - 1) // rows)).select(F.col("shard").cast("long").alias("shard"), "content"))
    record = np.dtype([("seq_id", "<i8"), ("n_ids", "<u4"), ("crc", "<u4"), ("ids", f"V{2 * seq_len}"), ("end", "u1")])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if len(r["content"]) % stride:
                    raise ValueError(f"shard {r['shard']} is no whole number of records")
                found = np.frombuffer(r["content"], record)
                slot = r["shard"] * rows + np.arange(len(found))
                pick = np.flatnonzero((slot >= start) & (slot < stop))
                found, slot = found[pick], slot[pick]
                crc = np.array([zlib.crc32(x.tobytes()) for x in found["ids"]], np.int64)
                if (crc != found["crc"]).any() or (found["end"] != 10).any():
                    raise ValueError(f"shard {r['shard']} is damaged")
                out = [slot, np.full(len(slot), r["shard"]), pick * stride, found["seq_id"], found["n_ids"].astype(np.int64), crc]
                arrays = [pa.array(np.ascontiguousarray(x).astype(np.int64)) for x in out]
                if with_ids:
                    flat = np.frombuffer(found["ids"].tobytes(), "<u2").astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, seq_len, dtype=np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return files.mapInArrow(run, schema)


def materialise(docs: DataFrame, key: int = 2024, vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN,
                rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Write the shards into the shared folder and read back where every sequence lies."""
    path = shared_path(docs.sparkSession, "training-order")
    write_shards(docs, path, key, vocabulary, seq_len, rows_per_shard)
    return read_slots(docs.sparkSession, path, with_ids=False)
