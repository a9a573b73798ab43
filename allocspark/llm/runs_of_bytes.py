"""Words of whole Arrow text columns as runs of bytes of a class, in numpy.

All word classes of the corpus operators tell bytes apart (a character beyond ASCII has only
bytes of 128 and more), so words are runs of bytes, found without a Python string for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .shingles import LOWER

#: Bytes of texts that are worked on at once (a longer single text is one pass of its own).
SLICE_BYTES = 4 << 20


def byte_class(*, but: str = "", only_letters: bool = False) -> np.ndarray:
    """Which of the 256 bytes belong to words: all but some, or Latin letters and all beyond ASCII."""
    out = np.ones(256, bool)
    if only_letters:
        out[:128] = [chr(b).isalpha() for b in range(128)]
    out[list(but.encode())] = False
    return out


@dataclass
class Words:
    """The words of some texts in order: where each begins and ends, its text, and its code in the vocabulary of distinct lower-cased words."""

    data: np.ndarray
    begins: np.ndarray  # of each text
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    code: np.ndarray
    vocabulary: pa.Array


def sliced(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes (A-Z in lower case) and beginnings of each slice of a string column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    buffer = column.buffers()[2]
    a = 0
    while a < len(column):
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        size = int(offsets[z] - offsets[a])
        raw = buffer[int(offsets[a]) : int(offsets[z])].to_pybytes() if size else b""
        yield a, z, np.frombuffer(raw.translate(LOWER), np.uint8), offsets[a : z + 1] - offsets[a]
        a = z


def words_of(data: np.ndarray, begins: np.ndarray, kind: np.ndarray) -> Words:
    """The words of texts laid end to end; none crosses the border of two texts. begins: of each text, and the end of the last."""
    inside = kind[data]
    fresh, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    fresh[begins], last[begins] = True, True
    fresh[1:-1] |= ~inside[:-1]
    last[1:-1] |= ~inside[1:]
    starts = np.flatnonzero(fresh[:-1] & inside)
    ends = np.flatnonzero(last[1:] & inside) + 1
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts))).astype(np.int32)
    whole = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    coded = whole.dictionary_encode()
    text = np.searchsorted(begins, starts, side="right") - 1
    return Words(data, begins, starts, ends, text, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def codes_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The code of each row's value, and the distinct values."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
