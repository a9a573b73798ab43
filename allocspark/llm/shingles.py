"""Hashes of words and of word shingles for whole batches of texts, in numpy.

Words are named by keyed digests of their bytes. A run draws its own key, so nobody can write
texts whose words or shingles collide; everything that follows is arithmetic on these names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64."""
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64))) for b in (BASE, inverse))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str], key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keyed hashes of all words of all texts in order, and the number of words of each text. Words: runs of non-blank characters, A-Z in lower case."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b"\n".join(raw) + b"\n").translate(LOWER), np.uint8)
    blank = SPACE[data]
    before = np.concatenate(([True], blank[:-1]))
    starts, ends = np.flatnonzero(before & ~blank), np.flatnonzero(blank & ~before)
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts))).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])]).dictionary_encode()
    names = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8, key=key).digest() for w in coded.dictionary.to_pylist()), "<u8")
    borders = np.cumsum([len(r) + 1 for r in raw])
    return names[coded.indices.to_numpy(zero_copy_only=False)], np.diff(np.concatenate(([0], np.searchsorted(starts, borders))))


def shingle_sets(texts: list[str], key: bytes, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the whole sequence is one where there are fewer words; none without words."""
    words, counts = word_hashes(texts, key)
    chained = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        chained = mix(chained * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - size + 1 + k] if len(chained) else chained)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            found = np.sort(chained[at : at + n - size + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif n:
            whole = hashlib.blake2b(words[at : at + n].tobytes() + bytes([n]), digest_size=8, key=key).digest()
            out.append(np.frombuffer(whole, "<u8").copy())
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


@functools.lru_cache(maxsize=4)
def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return tuple(draw.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def min_hashes(found: np.ndarray, k: int) -> np.ndarray:
    """k coordinates of 31 bits of a set that is not empty."""
    xor, times = _seeds(k)
    low = np.full(k, 2**63, np.uint64)
    for a in range(0, len(found), 1 << 14):
        low = np.minimum(low, (((found[a : a + (1 << 14), None] ^ xor) * times) >> np.uint64(33)).min(axis=0))
    return low.astype(np.int32)
