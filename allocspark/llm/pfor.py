"""Patched frame-of-reference blocks for lists of token ids, in numpy.

A segment is one byte string::

    magic "PFR1" | block size u16 | width percentile u8 | 0 u8 | documents u32 | values u64 | blocks u32
    values of each document           u32 x documents
    start of each block in the body   u64 x blocks
    body, block after block:
        minimum u32 | width u8 | 0 u8 | exceptions u16
        value minus minimum, packed at ``width`` bits into 32-bit words (exceptions: 0)
        exceptions' places u16, padded to 4 bytes | exceptions' differences u32

All numbers are little-endian. The width of a block is the bits that the given percentile
of its differences needs; larger differences are exceptions. A last block is filled up
with its minimum.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK, PERCENTILE = b"PFR1", 256, 90
HEAD = struct.Struct("<4sHBBIQI")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of a multiple of 32 values to rows of 32-bit words."""
    lanes = values.reshape(len(values), -1, 32)
    out = np.zeros((*lanes.shape[:2], width), np.uint32)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        out[:, :, word] |= lanes[:, :, j] << np.uint32(shift)
        if shift + width > 32:
            out[:, :, word + 1] |= lanes[:, :, j] >> np.uint32(32 - shift)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(len(words), -1, width)
    out = np.empty((*lanes.shape[:2], 32), np.uint32)
    mask = np.uint32(2**width - 1 if width < 32 else 2**32 - 1)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        x = lanes[:, :, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | lanes[:, :, word + 1] << np.uint32(32 - shift)
        out[:, :, j] = x & mask
    return out.reshape(len(words), -1)


def pack(values: np.ndarray, lens: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """A segment of these 32-bit values, which belong to documents of these lengths."""
    n_blocks = -(-len(values) // block)
    grid = np.zeros(n_blocks * block, np.uint32)
    grid[: len(values)] = values
    if n_blocks:
        grid[len(values) :] = values[(n_blocks - 1) * block :].min()
    grid = grid.reshape(n_blocks, block)
    low = grid.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    need = _bits(diff)
    width = np.sort(need, axis=1)[:, -(-block * percentile // 100) - 1] if n_blocks else np.zeros(0, np.uint8)
    odd = need > width[:, None]
    packed: list[bytes] = [b""] * n_blocks
    kept = np.where(odd, np.uint32(0), diff)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            for r, words in zip(rows.tolist(), _pack(kept[rows], int(w)), strict=True):
                packed[r] = words.tobytes()
    body, starts, at = [], np.zeros(n_blocks, "<u8"), 0
    row, place = np.nonzero(odd)
    first = np.searchsorted(row, np.arange(n_blocks + 1))
    for b in range(n_blocks):
        here = slice(first[b], first[b + 1])
        n = first[b + 1] - first[b]
        piece = struct.pack("<IBBH", low[b], width[b], 0, n) + packed[b] + place[here].astype("<u2").tobytes() + b"\0\0" * (n % 2) + diff[b, place[here]].astype("<u4").tobytes()
        starts[b] = at
        at += len(piece)
        body.append(piece)
    return HEAD.pack(MAGIC, block, percentile, 0, len(lens), len(values), n_blocks) + lens.astype("<u4").tobytes() + starts.tobytes() + b"".join(body)


def lengths(segment: bytes) -> np.ndarray:
    """Values of each document, from the head alone."""
    magic, _, _, _, n_docs, _, _ = HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment")
    return np.frombuffer(segment, "<u4", n_docs, HEAD.size)


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values from place ``first`` to before ``last``; only their blocks are opened."""
    magic, block, _, _, n_docs, n_values, n_blocks = HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment")
    last = n_values if last is None else min(last, n_values)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(segment, "<u8", n_blocks, HEAD.size + 4 * n_docs).astype(np.int64)
    base = HEAD.size + 4 * n_docs + 8 * n_blocks
    a, z = first // block, -(-last // block)
    at = base + starts[a:z]
    data = np.frombuffer(segment, np.uint8)
    heads = data[at[:, None] + np.arange(8)].view([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("odd", "<u2")]).ravel()
    out = np.zeros((z - a, block), np.uint32)
    for w in np.unique(heads["width"]):
        if w:
            rows = np.flatnonzero(heads["width"] == w)
            out[rows] = _unpack(data[at[rows][:, None] + 8 + np.arange(block // 8 * int(w))].view("<u4"), int(w))
    for r in np.flatnonzero(heads["odd"]).tolist():
        n = int(heads["odd"][r])
        p = int(at[r]) + 8 + block // 8 * int(heads["width"][r])
        out[r, np.frombuffer(segment, "<u2", n, p)] = np.frombuffer(segment, "<u4", n, p + 2 * (n + n % 2))
    return (out + heads["low"][:, None]).ravel()[first - a * block : last - a * block]
