"""Byte-pair merges for many words at once, in numpy.

All words of a batch lie in one flat array of symbols. A round finds each word's lowest
pair rank (a segmented minimum), merges every leftmost occurrence of that pair at once,
and compacts the array; rounds go on until no word has a known pair. In a trained
vocabulary a merge never uncovers a pair of lower rank, so a round does what the
one-by-one queue of the libraries does (tests compare both).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

NONE = np.int32(2**31 - 1)
SHIFT = 21


class Merges:
    """Known pairs. ``tied``: from this rank on ranks count as equal, so only the leftmost pair of a word is merged in a round."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, tied: int | None = None):
        keys = (left.astype(np.int64) << SHIFT) | right
        # a hash table, each key at the first free place from its own on; at most a quarter of the places is taken
        self.bits = max(2, len(keys).bit_length() + 1)
        self.keys, self.ranks = np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE)
        rest, at = np.arange(len(keys)), self._place(keys)
        while len(rest):
            free = np.flatnonzero(self.keys[at] == -1)
            taken, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.keys[taken], self.ranks[taken] = keys[rest[own]], rank[rest[own]]
            left_over = np.ones(len(rest), bool)
            left_over[own] = False
            rest, at = rest[left_over], (at[left_over] + 1) & (1 << self.bits) - 1
        self.made = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.made[rank] = made
        self.tied = NONE if tied is None else np.int32(tied)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left.astype(np.int64) << SHIFT) | right
        at = self._place(want)
        there = self.keys[at]
        out = np.where(there == want, self.ranks[at], NONE)
        rest = np.flatnonzero((there != want) & (there != -1))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (1 << self.bits) - 1
            there, own = self.keys[at], want[rest]
            hit = there == own
            out[rest[hit]] = self.ranks[at[hit]]
            go_on = ~hit & (there != -1)
            rest, at = rest[go_on], at[go_on]
        return out

    def encode(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words and the words' lengths, before and after merging. Words are not empty."""
        n_words = len(lens)
        if not n_words:
            return sym, lens
        word = np.repeat(np.arange(n_words, dtype=np.int32), lens)
        sym = sym.astype(np.int32)
        pair = np.full(len(sym), NONE, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        pair[inner] = self.rank(sym[inner], sym[inner + 1])
        done_word, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.minimum.reduceat(pair, starts)
            size = np.diff(np.append(starts, len(sym)))
            of = np.repeat(low, size)
            if (finished := of == NONE).mean() > 0.25:
                done_word.append(word[finished])
                done_sym.append(sym[finished])
                live = ~finished
                word, sym, pair, of = word[live], sym[live], pair[live], of[live]
                if not len(sym):
                    break
            at = np.flatnonzero((pair == of) & (of != NONE) | (pair >= self.tied) & (of >= self.tied) & (pair != NONE))
            if not len(at):
                done_word.append(word)
                done_sym.append(sym)
                break
            # of a run of overlapping hits every second one is merged, from the left
            fresh = np.concatenate(([True], np.diff(at) > 1))
            run = np.flatnonzero(fresh)
            at = at[(np.arange(len(at)) - run[np.cumsum(fresh) - 1]) % 2 == 0]
            if (ties := pair[at] >= self.tied).any():
                first = np.concatenate(([True], word[at][1:] != word[at][:-1]))
                at = at[first | ~ties]
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            word, sym, pair = word[keep], sym[keep], pair[keep]
            touched = np.zeros(len(sym) + 1, bool)  # one more for the place before the first
            touched[new] = touched[new - 1] = True
            changed = np.flatnonzero(touched[:-1])
            pair[changed] = NONE
            inner = changed[changed < len(sym) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            pair[inner] = self.rank(sym[inner], sym[inner + 1])
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n_words)


class Cached:
    """Ids of units of text as little-endian 32-bit bytes. Units of up to ``longest`` characters are remembered, ``most`` of them."""

    def __init__(self, most: int = 250_000, longest: int = 64):
        self.most, self.longest, self.known = most, longest, {}

    def units(self, units: list[str]) -> list[bytes]:
        got = list(map(self.known.get, units))
        if None in got:
            missed = [i for i, g in enumerate(got) if g is None]
            new = list({units[i] for i in missed})
            if len(self.known) + len(new) > self.most:
                self.known = {}
            flat, lens = self.encode_units(new)
            data, ends = flat.astype("<i4").tobytes(), np.cumsum(lens) * 4
            fresh = {u: data[a:b] for u, a, b in zip(new, (ends - lens * 4).tolist(), ends.tolist(), strict=True)}
            for i in missed:
                got[i] = fresh[units[i]]
            self.known.update(fresh if max(map(len, new)) <= self.longest else {u: x for u, x in fresh.items() if len(u) <= self.longest})
        return got

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def split(self, text: str) -> list[str] | None:
        """The text's units; None: encode_whole() takes the text."""
        raise NotImplementedError

    def encode_whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        parts = [self.split(t) for t in texts]
        got = self.units([u for p in parts if p for u in p])
        out, at = [], 0
        for text, p in zip(texts, parts, strict=True):
            if p is None:
                out.append(np.asarray(self.encode_whole(text), "<i4").tobytes())
            else:
                out.append(b"".join(got[at : at + len(p)]))
                at += len(p)
        return out


def flat_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"), np.fromiter(map(len, words), np.int64, len(words))


class PieceModel(Cached):
    """A SentencePiece BPE model with byte fallback and no text normalisation."""

    def __init__(self, path: str, **more):
        from sentencepiece import sentencepiece_model_pb2 as pb

        super().__init__(**more)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        kinds = pb.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.size = len(model.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(re.search("[^▁]▁|.\n|\n.", p) for p in normal):
            raise ValueError("pieces that go on after a space or over a line break are not supported")
        scores = [p.score for p in model.pieces]
        lowest = min((scores[i] for i in normal.values()), default=0)
        order = sorted(normal, key=lambda p: (-scores[normal[p]], normal[p]))
        rank = {p: k for k, p in enumerate(order)}
        tied = next((k for k, p in enumerate(order) if scores[normal[p]] == lowest), None)
        rows = [(normal[p[:c]], normal[p[c:]], rank[p], normal[p]) for p in normal for c in range(1, len(p)) if p[:c] in normal and p[c:] in normal]
        self.merges = Merges(*np.array(rows, np.int64).T, tied=tied)
        self.ids = np.arange(0x110000, dtype=np.int32) + self.size  # a character without a piece, for now
        for p, i in normal.items():
            if len(p) == 1:
                self.ids[ord(p)] = i
        self.byte_ids = np.zeros(256, np.int32)
        self.surface: list[bytes] = [b""] * self.size
        self.is_byte, self.spaced = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.surface[i], self.is_byte[i] = i, bytes([value]), True
            elif p.type == kinds.NORMAL:
                self.surface[i], self.spaced[i] = p.piece.replace("▁", " ").encode(), p.piece[0] == "▁"
            elif p.type == kinds.UNKNOWN:
                self.surface[i] = model.trainer_spec.unk_surface.encode()

    def split(self, text: str) -> list[str]:
        """Units that start with spaces or a line break and hold none further on; no piece reaches over their borders."""
        if not text:
            return []
        text = text.replace("▁", " ")
        if "  " in text or " \n" in text or text[0] == " " or text[-1] == " ":
            return re.findall(" +[^ \n]*|\n[^ \n]*", " " + text)
        return text.replace("\n", " \n").split(" ")  # a unit that has neither space nor line break in front stands for one after a space

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, lens = flat_points([u.replace(" ", "▁") if u[:1] in (" ", "\n") and u else "▁" + u for u in units])
        sym, lens = self.merges.encode(self.ids[points], lens)
        if (odd := sym >= self.size).any():
            raw = [chr(c).encode("utf-8", "replace") for c in (sym[odd] - self.size).tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = list(map(len, raw))
            word = np.repeat(np.repeat(np.arange(len(lens)), lens), times)
            where = np.repeat(odd, times)
            sym = np.repeat(sym, times)
            sym[where] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            lens = np.bincount(word, minlength=len(lens))
        return sym, lens

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: pieces' surfaces, without the space that encoding put before the text; bytes that are not UTF-8 give U+FFFD each."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.spaced[next((i for i in ids if self.surface[i]), 0)]:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            pass
        out, run, start = [], bytearray(), True
        for i in ids:
            if self.is_byte[i]:
                run += self.surface[i]
                start = False
                continue
            out.append(loose(run))
            run.clear()
            piece = self.surface[i].decode()
            out.append(piece[1:] if start and self.spaced[i] else piece)
            start = start and not piece
        return "".join(out) + loose(run)


def loose(data: bytes) -> str:
    """UTF-8 where it holds, U+FFFD for each other byte."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


class LibraryWords(Cached):
    """The tokenizers library's ids, asked for each unit once: white space parts units and is dropped.

    Texts of Latin letters (below U+0250) are split; a text with another character, or with a
    special token's opening, goes to the library whole.
    """

    LIMIT = 0x250

    def __init__(self, path: str, **more):
        from tokenizers import Tokenizer

        super().__init__(**more)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.safe = [c for c in map(chr, range(self.LIMIT)) if not "\x1c" <= c <= "\x1f" and all(ord(x) < self.LIMIT for x in c.lower()) and c != "İ"]
        self.unsafe = re.compile(f"[^{re.escape(''.join(self.safe))}]")

    def split(self, text: str) -> list[str] | None:
        if (not text.isascii() or "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f")) and ("<|" in text or self.unsafe.search(text)):
            return None
        return text.split()

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch(units, add_special_tokens=False)]
        return np.array([i for f in found for i in f], np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def encode_whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


class WordModel(LibraryWords):
    """A lower-casing byte-level BPE with word ends, from a tokenizers file, with units merged in numpy."""

    def __init__(self, path: str, **more):
        import json

        super().__init__(path, **more)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["dropout"] or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only lower-casing BPE files with word ends are supported")
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([vocab[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], "".join))
        self.merges = Merges(left, right, np.arange(len(pairs)), made)
        # byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 onwards
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letter[b] + "</w>"] for b in range(256)], np.int32)
        kind = {c: unicodedata.category(c)[0] for c in self.safe}
        letters, numbers = (re.escape("".join(c for c in self.safe if kind[c] == k)) for k in "LN")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+|\n")  # units are laid end to end, a line break between two

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "\n".join(units).lower()
        chars = np.fromiter(map(len, self.words.findall(text)), np.int64)
        if not text.isascii():
            width = np.concatenate(([0], np.cumsum(1 + (flat_points([text])[0] >= 0x80))))  # no safe character takes three bytes
            chars = np.diff(width[np.cumsum(chars)], prepend=0)
        data = np.frombuffer(text.encode(), np.uint8)
        breaks = data[np.cumsum(chars) - chars] == 10
        data, lens, of = data[data != 10], chars[~breaks], np.cumsum(breaks)[~breaks]
        sym = self.inner[data]
        ends = np.cumsum(lens) - 1
        sym[ends] = self.last[data[ends]]
        sym, lens = self.merges.encode(sym, lens)
        return sym, np.bincount(of, weights=lens, minlength=len(units)).astype(np.int64)
