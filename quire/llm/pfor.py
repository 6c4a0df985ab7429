"""Patched frame-of-reference coding of token ids: numpy only, no Spark.

A chunk is, little-endian throughout:

    magic b"PFR1" | u32 bytes that follow | u32 documents | u64 ids | u32 blocks
    a document each: u8 1 if its id is null | i64 id | u32 number of ids
    a block each:    u64 place of its start, from the first block's
    a block each:    u32 minimum | u8 width | u16 count | u16 exceptions
                     count offsets from the minimum, ``width`` low bits each, packed
                     exceptions: u16 place, then u32 offset each

The width is the least one that holds the given percentile of a block's offsets; larger offsets are exceptions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"PFR1"
BLOCK = 2048
PERCENTILE = 0.98
_HEAD, _HEAD_SIZE = "<4sIIQI", struct.calcsize("<4sIIQI")
_BLOCK, _BLOCK_SIZE = "<IBHH", struct.calcsize("<IBHH")
_DOC = np.dtype([("null", "u1"), ("id", "<i8"), ("n", "<u4")])


def _width(offsets: np.ndarray, percentile: float) -> int:
    """Bits that hold the percentile of the offsets."""
    k = min(len(offsets) - 1, int(len(offsets) * percentile))
    return int(np.partition(offsets, k)[k]).bit_length()


def _kind(width: int) -> tuple[str, int]:
    """Narrowest of the integer types that hold the width, and its bytes."""
    return ("<u2", 2) if width <= 16 else ("<u4", 4)


def _pack(offsets: np.ndarray, width: int) -> bytes:
    kind, size = _kind(width)
    if width == 8 * size:  # whole bytes are packed as they are
        return offsets.astype(kind).tobytes()
    bits = np.unpackbits(offsets.astype(kind).view(np.uint8).reshape(-1, size), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def _unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    kind, size = _kind(width)
    if width == 8 * size:
        return np.frombuffer(data, kind, n).astype("<u4")
    bits = np.zeros((n, 8 * size), np.uint8)
    bits[:, :width] = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view(kind).reshape(-1).astype("<u4")


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    offsets = (ids - np.uint32(low)).astype(np.uint32)
    width = _width(offsets, percentile)
    places = np.nonzero(offsets >> np.uint32(width))[0] if width < 32 else np.empty(0, np.int64)
    head = struct.pack(_BLOCK, low, width, len(ids), len(places))
    return head + _pack(offsets, width) + places.astype("<u2").tobytes() + offsets[places].astype("<u4").tobytes()


def decode_block(data: memoryview, at: int) -> np.ndarray:
    low, width, n, n_out = struct.unpack_from(_BLOCK, data, at)
    at += _BLOCK_SIZE
    packed = -(-n * width // 8)
    offsets = _unpack(np.frombuffer(data, np.uint8, packed, at), n, width)
    if n_out:
        at += packed
        places = np.frombuffer(data, "<u2", n_out, at)
        offsets[places] = np.frombuffer(data, "<u4", n_out, at + 2 * n_out)
    return offsets + np.uint32(low)


def encode_chunk(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    blocks = [encode_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    docs = np.zeros(len(doc_ids), _DOC)
    docs["null"], docs["id"], docs["n"] = [d is None for d in doc_ids], [d or 0 for d in doc_ids], lengths
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
    body = docs.tobytes() + starts.tobytes() + b"".join(blocks)
    return struct.pack(_HEAD, MAGIC, len(body) + _HEAD_SIZE - 8, len(doc_ids), len(ids), len(blocks)) + body


class Chunk:
    """A chunk that is read in place; a document's ids need only its own blocks."""

    def __init__(self, data: memoryview, at: int = 0):
        magic, follows, n_docs, self.n_ids, n_blocks = struct.unpack_from(_HEAD, data, at)
        if magic != MAGIC:
            raise ValueError("not a chunk of packed token ids")
        self.end = at + 8 + follows
        self.docs = np.frombuffer(data, _DOC, n_docs, at + _HEAD_SIZE)
        at += _HEAD_SIZE + self.docs.nbytes
        self.starts = np.frombuffer(data, "<u8", n_blocks, at)
        self.first = at + self.starts.nbytes
        self.data = data
        self.offsets = np.concatenate([[0], np.cumsum(self.docs["n"], dtype=np.int64)])

    def block(self, i: int) -> np.ndarray:
        return decode_block(self.data, self.first + int(self.starts[i]))

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.starts))]) if len(self.starts) else np.empty(0, np.uint32)

    def document(self, k: int, block: int = BLOCK) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        if a == b:
            return np.empty(0, np.uint32)
        first, last = a // block, (b - 1) // block
        part = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return part[a - first * block : b - first * block]


def chunks(data: bytes) -> Iterator[Chunk]:
    """The chunks of a file: one newline byte stands after each."""
    view, at = memoryview(data), 0
    while at < len(view):
        chunk = Chunk(view, at)
        yield chunk
        at = chunk.end + 1
