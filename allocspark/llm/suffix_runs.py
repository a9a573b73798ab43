"""Front-coded sorted runs of suffixes, their merge, and the repeats found in merged order.

A record is a place in a text (an anchor) with the bytes right of it (its suffix, as far as
any window of its reaches), the bytes left of it, and the range of offsets ``l`` for which
the window that starts ``l`` bytes before the anchor is the record's own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import zstandard

from .shingles import _powers, mix

LENGTH, KMER = 200, 32
SPAN = LENGTH - KMER + 1


def digest(key: bytes, *parts: bytes) -> int:
    """64 bits that name bytes, under a key that whoever wrote the bytes doesn't know."""
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8, key=key).digest(), "little")


def anchors(raw: list[bytes], key: bytes) -> tuple[np.ndarray, ...]:
    """Text number, place (in all texts laid end to end), least and largest l, fingerprint, and a keyed digest of the surroundings, of each anchor.

    A window's anchor is the k-mer of least hash in it, the leftmost of equal ones: it
    depends on the window's bytes alone, so equal windows have their anchors at the same l.
    An anchor's surroundings are the bytes that its windows cover together. Fingerprints only
    choose what is compared; equal digests say that surroundings are equal.
    """
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < LENGTH:
        return none
    power, inverse = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)))
    n = len(data) - KMER + 1
    h = mix((sums[KMER:] - sums[:-KMER]) * inverse[:n])
    low = np.uint64((1 << 26) - 1)
    m = (h & ~low) | (np.arange(n, dtype=np.uint64) & low)
    for step in (1, 2, 4, 8, 16, 32, 64):
        m = np.minimum(m[:-step], m[step:])
    rest = SPAN - 128
    m = np.minimum(m[: len(data) - LENGTH + 1], m[rest : rest + len(data) - LENGTH + 1])
    start = np.arange(len(m))
    at = start + (((m & low).astype(np.int64) - start) & int(low))
    doc = np.searchsorted(ends, start, side="right")
    fits = start + LENGTH <= ends[doc]
    start, at, doc = start[fits], at[fits], doc[fits]
    if not len(start):
        return none
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.append(first[1:], len(start)) - 1
    place, of = at[first], doc[first]
    most, least = place - start[first], place - start[last]
    a, z = place - most, place - least + LENGTH
    joined = data.tobytes()
    around = np.fromiter((digest(key, bytes((x, y)), joined[i:j]) for x, y, i, j in zip(least.tolist(), most.tolist(), a.tolist(), z.tolist(), strict=True)), np.uint64, len(a))
    return of, place, least, most, h[place], around


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    head = [len(arrays).to_bytes(1, "little"), *(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") for a in arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*head, *(a.tobytes() for a in arrays)]))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 1 + 12 * raw[0], []
    for k in range(raw[0]):
        head = raw[1 + 12 * k : 13 + 12 * k]
        out.append(np.frombuffer(raw, head[:4].decode().strip(), int.from_bytes(head[4:], "little"), at))
        at += out[-1].nbytes
    return out


@dataclass
class Records:
    right: list[bytes]
    left: list[bytes]  # reversed: nearest byte first
    least: np.ndarray
    most: np.ndarray
    place: np.ndarray

    def taken(self, order) -> Records:
        return Records([self.right[i] for i in order], [self.left[i] for i in order], self.least[order], self.most[order], self.place[order])


def matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.array([s.ljust(width, b"\0") for s in strings], f"S{width}").view(np.uint8).reshape(len(strings), width) if strings else np.zeros((0, width), np.uint8)


def neighbours(m: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it; 0 for the first."""
    if len(m) < 2:
        return np.zeros(len(m), np.int64)
    differs = m[1:] != m[:-1]
    return np.concatenate(([0], np.where(differs.any(axis=1), differs.argmax(axis=1), m.shape[1])))


def _front(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """What each string shares with the one before, its length, and the other bytes of all."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    shared = neighbours(matrix(strings, width))
    shared[1:] = np.minimum(shared[1:], np.minimum(lens[1:], lens[:-1]))
    return shared.astype(np.uint8), lens.astype(np.uint8), b"".join(x[c:] for x, c in zip(strings, shared.tolist(), strict=True))


def _unfronted(shared: np.ndarray, lens: np.ndarray, rest: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for c, size in zip(shared.tolist(), lens.tolist(), strict=True):
        before = before[:c] + rest[at : at + size - c]
        at += size - c
        out.append(before)
    return out


def coded(records: Records) -> bytes:
    """A sorted run: of each suffix, and of the bytes left of it, the length shared with the one before and the other bytes."""
    records = records.taken(sorted(range(len(records.right)), key=lambda i: (records.right[i], records.left[i])))
    sides = (_front(records.right, LENGTH), _front(records.left, SPAN))
    return packed(*(np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for side in sides for x in side), records.least.astype(np.uint8), records.most.astype(np.uint8), records.place.astype("<i8"))


def opened(run: bytes) -> tuple[Records, list[int]]:
    """A run's records and the lengths that neighbours share."""
    shared, lens, rest, left_shared, left_lens, left_rest, least, most, place = unpacked(run)
    right, left = _unfronted(shared, lens, rest.tobytes()), _unfronted(left_shared, left_lens, left_rest.tobytes())
    return Records(right, left, least.astype(np.int64), most.astype(np.int64), place), shared.tolist()


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """(run, place in it) of all strings in order, and what each shares with the one before.

    A tree of losers whose heads carry the prefix that they share with the last string out:
    of two heads the one that shares more is the smaller, and only equal ones are compared,
    from that length on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    at = [0] * k
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    shared = [0] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's length becomes what it shares with the winner."""
        a, b = head[x], head[y]
        if b is None or a is None:
            return (x, y) if b is None else (y, x)
        cx, cy = shared[x], shared[y]
        if cx != cy:
            return (x, y) if cx > cy else (y, x)
        c = common(a, b, cx)
        smaller = c == len(a) or (c < len(b) and a[c] < b[c])
        shared[y if smaller else x] = c
        return (x, y) if smaller else (y, x)

    losers = [0] * k
    level = list(range(k))
    first = k // 2
    while len(level) > 1:
        played = [play(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        for i, (_, y) in enumerate(played):
            losers[first + i] = y
        level = [x for x, _ in played]
        first //= 2
    top = level[0]
    order, lengths = [], []
    while head[top] is not None:
        order.append((top, at[top]))
        lengths.append(shared[top])
        strings, inner = runs[top]
        at[top] += 1
        if at[top] < len(strings):
            head[top], shared[top] = strings[at[top]], inner[at[top]]
        else:
            head[top] = None
        node = (k + top) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2
    return order, lengths


def repeats(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the run, start and end of the bytes covered by windows that occur more than once in these runs. All records of a k-mer must be in them."""
    found = [opened(r) for r in runs]
    order, lengths = merged([(r.right, shared) for r, shared in found])
    base = np.concatenate(([0], np.cumsum([len(r.right) for r, _ in found]))).astype(np.int64)
    index = np.array([base[r] + i for r, i in order], np.int64)
    join = lambda name: np.concatenate([getattr(r, name) for r, _ in found])[index]
    least, most, place = (join(n) for n in ("least", "most", "place"))
    run = np.array([r for r, _ in order], np.int64)
    left = [s for r, _ in found for s in r.left]
    behind = matrix([left[i] for i in index.tolist()], SPAN)
    n = len(index)
    by_left = np.argsort(behind.view(f"S{SPAN}").ravel(), kind="stable")
    left_shared = neighbours(behind[by_left])
    right_shared = np.array(lengths, np.int64)
    hit = np.zeros((n, SPAN + 2), bool)
    left_class = np.empty(n, np.int64)
    for back in range(SPAN):
        own = np.flatnonzero((least <= back) & (back <= most))
        if len(own) < 2:
            continue
        right_class = np.cumsum(right_shared < LENGTH - back)
        left_class[by_left] = np.cumsum(left_shared < back) if back else 0
        key = right_class[own] * (n + 1) + left_class[own]
        sort = np.argsort(key, kind="stable")
        same = key[sort][1:] == key[sort][:-1]
        twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        hit[own[sort[twice]], back + 1] = True
    edge = np.diff(hit.astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)  # runs of one row end in the order that they begin
    return run[row], place[row] - (end - 1), place[row] - first + LENGTH
