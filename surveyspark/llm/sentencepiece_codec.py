"""SentencePiece encoding and decoding on the tokenizers library, with parity checked.

Whole texts are normalised and, for BPE models, cut before each run of word markers - exact while no
piece holds a marker behind another character, which is verified on the vocabulary; else texts stay
whole, as they do for unigram models. The
units that a worker has not met are encoded in one multithreaded batch, each unit is compared with the
sentencepiece library, and the ids of a text are the ids of its units in order. A unit whose ids
differ keeps the ids of the sentencepiece library and is counted in ``n_differ``, so the result
always equals the reference library's. Models whose normaliser rewrites text are compared text by
text instead. Decoding joins the pieces' bytes
of the rebuilt vocabulary.

The job is a map over the rows: no shuffle; memory follows a slice of about 2 MB of text or the
longest single text.

Defined results: null text encodes as the empty text, to no ids; other columns pass through;
columns named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.llm.common import slices, texts_of
from surveyspark.llm.sp_model import BYTE, MARK, SpModel

#: default path of the public model file; every function takes it as a parameter
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
THREADS = 2
#: units a worker remembers between slices; then it starts over
KNOWN_UNITS = 250_000
_BUILT: dict[str, "Codec"] = {}


class Codec:
    """One per Python worker: the rebuilt tokenizer and the sentencepiece library on the same bytes."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        self.model = SpModel(data)
        self.normalise = self.model.normaliser().normalize_str
        self.plain = not self.model.charsmap and not self.model.squeeze
        self.tokenizer = self.model.tokenizer()
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        # the reference adds the dummy prefix itself, so a unit is handed over without its first marker
        self.direct = self.plain and self.model.dummy_prefix
        self._forget()
        self.table = pa.array([bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode()
                               for p, t in zip(self.model.pieces, self.model.types)], pa.binary())

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if self.plain:
            text = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        else:
            text = self.normalise(text)
        return UNITS.findall(text) if self.model.splits_at_marks else [text]

    def _learn(self, units: list[str]) -> None:
        """Encode units that the table of known units lacks, compared with the reference one by one."""
        for at in range(0, len(units), 8192):
            some = units[at:at + 8192]
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            theirs = self.reference.encode([u[1:] for u in some], num_threads=self.threads) if self.direct else ours
            differs = [False] * len(some)
            if ours != theirs:
                differs = [len(u) > 1 and a != b for u, a, b in zip(some, ours, theirs)]
                ours = [b if d else a for a, b, d in zip(ours, theirs, differs)]
            sizes = list(map(len, ours))
            self.known.update(zip(some, range(len(self.sizes), len(self.sizes) + len(some))))
            self.starts.extend(accumulate(sizes[:-1], initial=len(self.flat)))
            self.sizes.extend(sizes)
            self.flat.extend(chain.from_iterable(ours))
            self.differs.extend(differs)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.differs = array("i"), array("q"), array("q"), array("b")

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text, and for each the number of units on which the two libraries differ."""
        if len(self.known) > KNOWN_UNITS:
            self._forget()
        split = [self.units(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        if new:
            self._learn(new)
        flat, starts, sizes, differs = (np.array(x) for x in (self.flat, self.starts, self.sizes, self.differs))
        out, bad = [], np.zeros(len(texts), np.int64)
        for k, units in enumerate(split):
            w = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            n = sizes[w] if len(w) else np.zeros(0, np.int64)
            first = np.repeat(starts[w] - (np.cumsum(n) - n), n) if len(w) else n
            out.append(flat[first + np.arange(int(n.sum()))].astype(np.int32) if len(w) else np.zeros(0, np.int32))
            bad[k] = differs[w].sum() if len(w) else 0
        if not self.direct:
            for k, b in enumerate(self.reference.encode(texts, num_threads=self.threads)):
                if b != out[k].tolist():
                    out[k], bad[k] = np.array(b, np.int32), 1
        return out, bad

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids. Each piece's bytes come from the rebuilt vocabulary and are joined by
        text; a join that isn't UTF-8 (byte pieces out of order) goes through the library's decoder."""
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.table.take(ids.values)), b"")
        out = []
        for i, raw in enumerate(joined.to_pylist()):
            try:
                text = raw.decode()
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(ids[i].as_py(), skip_special_tokens=False))
        return pa.array(out, pa.string())


def codec(name: str) -> Codec:
    """The worker's codec of a file that the driver shipped with ``addFile``."""
    if name not in _BUILT:
        with open(SparkFiles.get(name), "rb") as f:
            _BUILT[name] = Codec(f.read())
    return _BUILT[name]


def ship_model(spark, path: str) -> str:
    """Send the model file to every executor; its base name names it there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _passing(df: DataFrame, added: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name for f in added}
    keep = [c for c in df.columns if c not in names]
    return keep, T.StructType([df.schema[c] for c in keep] + added)


def encode(df: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` array<int> and ``n_differ`` (units on which the libraries disagreed)."""
    name = ship_model(df.sparkSession, model)
    keep, schema = _passing(df, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_differ", T.LongType())])

    def run(batches):
        own = codec(name)
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                ids, bad = own.encode(texts_of(part, text_col).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in keep]
                    + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.array(bad)],
                    names=[*keep, "ids", "n_differ"])

    return df.select(*keep).mapInArrow(run, schema)


def decode(df: DataFrame, model: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids in ``out_col``; null ids give the empty text."""
    name = ship_model(df.sparkSession, model)
    keep, schema = _passing(df, [T.StructField(out_col, T.StringType())])

    def run(batches):
        own = codec(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                col = part.column(part.schema.get_field_index(ids_col)).fill_null([])
                ids = pa.ListArray.from_arrays(pc.subtract(col.offsets, col.offsets[0]), col.flatten())
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in keep] + [own.decode(ids)], names=[*keep, out_col])

    return df.select(*keep).mapInArrow(run, schema)


def round_trip(df: DataFrame, model: str = MODEL) -> DataFrame:
    """Ids of every whole text, whether decoding gives the text back, and parity with the reference."""
    text = F.coalesce("text", F.lit(""))
    found = decode(encode(df, model), model)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.col("decoded") == text).alias("round_trip"), (F.col("n_differ") == 0).alias("parity"))


def encode_stage(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Pipeline stage: the documents' columns with ids, n_tokens, round_trip and parity."""
    columns = [c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip", "parity")]
    found = decode(encode(docs.select(*columns), model), model, out_col="llm_decoded")
    return found.select(*columns, "ids", F.size("ids").cast("long").alias("n_tokens"),
                        (F.col("llm_decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
                        (F.col("n_differ") == 0).alias("parity"))
