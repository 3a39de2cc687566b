"""Columns of numbers packed into one binary value, so that a shuffle moves them compressed."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length: bytes of equal weight lie together, then everything is compressed."""
    head, body = [struct.pack("<Iq", len(columns), len(columns[0]))], []
    for c in columns:
        head.append(c.dtype.str[1:].encode())
        body.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return b"".join(head) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    n_columns, n = struct.unpack_from("<Iq", data)
    at = 12
    kinds = [np.dtype(data[at + 2 * i:at + 2 * i + 2].decode()) for i in range(n_columns)]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 2 * n_columns:]), np.uint8)
    out, start = [], 0
    for kind in kinds:
        size = kind.itemsize * n
        out.append(np.ascontiguousarray(raw[start:start + size].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        start += size
    return out


def joined(blobs: list[bytes], kinds: list) -> list[np.ndarray]:
    """The columns of all blobs, one after the other."""
    parts = [unpack(b) for b in blobs]
    if not parts:
        return [np.zeros(0, k) for k in kinds]
    return [np.concatenate(c) for c in zip(*parts)]


def rows_by_bucket(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, packed rows of that bucket) for every bucket that occurs; order inside is kept."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else []
    for a, b in zip(starts, np.append(starts[1:], len(sorted_)) if len(sorted_) else []):
        yield int(sorted_[a]), pack(*(c[order[a:b]] for c in columns))
