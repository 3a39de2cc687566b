"""Reads a SentencePiece model file and rebuilds it on the tokenizers library.

The protobuf is read field by field (pieces, scores and types; trainer and normaliser settings).
A unigram model becomes ``models.Unigram`` with its scores; a BPE model becomes ``models.BPE``, its
merges derived from the pieces in score order. Byte fallback, the precompiled character map, the
white-space rules and the U+2581 word marker are rebuilt from the settings.
"""

from __future__ import annotations

import re
import struct

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def wire_fields(buf: bytes):
    """(field number, value) pairs of one protobuf message: ints, or bytes for the other wire types."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"unknown wire type {kind}")
            size = varint()
        yield tag >> 3, buf[at:at + size]
        at += size


class SpModel:
    """The parsed file: what encoding and decoding need."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        trainer: dict = {}
        normaliser: dict = {}
        for field, value in wire_fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in wire_fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(kind)
            elif field == 2:
                trainer = dict(wire_fields(value))
            elif field == 3:
                normaliser = dict(wire_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_mark = bool(trainer.get(24, 0))
        self.unknown = self.types.index(UNKNOWN)
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.escape_spaces = bool(normaliser.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or self.suffix_mark or not self.escape_spaces:
            raise ValueError("only unigram and BPE models with a leading word marker are rebuilt")
        if USER in self.types:
            raise ValueError("models with user-defined symbols are not rebuilt")
        #: no piece has the marker behind another character, so words can be encoded apart (a unigram
        #: model breaks ties by sums over the whole text, so its texts stay whole)
        self.splits_at_marks = self.kind == BPE and not any(re.search(f"[^{MARK}]{MARK}", p) for p, t in zip(self.pieces, self.types) if t == NORMAL)

    def normaliser(self):
        from tokenizers import Regex, normalizers as N
        steps = [N.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [N.Replace(Regex(" {2,}"), " "), N.Replace(Regex(r"\A +| +\z"), "")]
        if self.dummy_prefix:
            steps.append(N.Prepend(MARK))
        return N.Sequence([*steps, N.Replace(" ", MARK)])

    def tokenizer(self):
        """The rebuilt model without its normaliser: it encodes normalised text."""
        from tokenizers import Tokenizer, decoders, models
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s in zip(self.pieces, self.scores)], unk_id=self.unknown,
                                   byte_fallback=self.byte_fallback)
        else:
            model = models.BPE({p: i for i, p in enumerate(self.pieces)}, self.merges(),
                               unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=self.byte_fallback)
        tok = Tokenizer(model)
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        tok.decoder = decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        return tok

    def merges(self) -> list[tuple[str, str]]:
        """Pairs whose joint is a piece, best joint first; equal joints by the ids of their halves."""
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        out = []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    out.append((-self.scores[i], i, ids[left], ids[right], left, right))
        return [(x[4], x[5]) for x in sorted(out)]
