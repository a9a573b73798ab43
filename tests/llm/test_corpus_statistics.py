"""Operators 11 to 13 against plain Python over small tables with odd rows."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allocspark.llm import bucket_maps, collocations, lm_mixing, source_divergence


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def odd_rows(seed=3):
    r = random.Random(seed)
    words = ["the", "of", "Ärger", "naïve", "alpha", "beta", "gamma", "new", "york", "city", "日本", "x1y", "o'clock"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".\n", "; ", "\x0b", "-"]
    rows = []
    for i in range(160):
        n = r.randint(0, 60)
        text = "".join(r.choice(words[: 4 + i % 10]) + ("York City " if r.random() < 0.05 else "") + r.choice(marks) for _ in range(n))
        rows.append((i, text, r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", "c", None])))
    rows += [(200, None, "en", "only"), (201, "", "fr", "p"), (202, "", "fr", "q"), (203, "...", "", ""), (None, "the of alpha", "en", "b"), (204, "new york city " * 500, "en", "a"), (204, "the of", "en", "a")]
    return rows + rows[:5]


KIND = "doc_id bigint, text string, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(*x, i, None) for i, x in enumerate(rows)], KIND + ", n long, score double")


def divergences(rows):
    docs = [(x[2] or "", x[3] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(x[1]))) for x in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= 10}
        v = len(kept)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pair = [(o, sum(f(p(c, t), p(k, t)) for t in kept)) for o, k in counts.items() if o != s]
            term = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pair, None), ("term", term, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def test_divergences_by_brute_force(spark):
    rows = odd_rows()
    got = sorted(tuple(r) for r in source_divergence.divergences(frame(spark, rows)).collect())
    assert got == divergences(rows) and {x[2] for x in got} == {"pair", "term"}
    assert ("fr", "p", "pair", "q", 0, 1) in got
    assert source_divergence.divergences(frame(spark, rows).limit(0)).count() == 0


def test_shares_of_very_large_counts(spark):
    c, n, v = 9 * 10**17, 9 * 10**18, 10**12
    row = spark.createDataFrame([(c, n, v, 0)], "c long, n long, v long, z long").select(source_divergence.share(*(source_divergence.F.col(x) for x in "cnv")).alias("p"), source_divergence.share(*(source_divergence.F.col(x) for x in "zzz")).alias("none"), source_divergence.apart(source_divergence.F.lit(10**9 + 1).cast("long"), source_divergence.F.lit(1).cast("long")).alias("f")).first()
    assert (row.p, row.none, row.f) == (1 + 10**9 * (c + 2) // (n + 2 * v), None, (10**9) ** 2 // (10**9 + 2))


def collocated(rows, least=10, shown=2000):
    counts, total = {}, Counter()
    for x in rows:
        lang = x[2] if x[2] is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(x[1])):
            w = [y for y in re.split("[ \t]+", piece) if y]
            total[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in cand.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((" ".join(g), a, left, right, total[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(found[:shown])]
    return sorted(out)


@pytest.mark.parametrize("buckets", [1 << 18, 64])
def test_collocations_by_brute_force(spark, buckets):
    """Few buckets let everything through, and the result is the same."""
    rows = odd_rows(4)
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), buckets=buckets).collect())
    assert got == collocated(rows) and len(got) > 50 and any(" " in x[2] and x[2].count(" ") == 2 for x in got)
    assert collocations.collocations(frame(spark, rows).limit(0), buckets=buckets).count() == 0


def test_bucket_counts_never_fall_short():
    r = np.random.default_rng(1)
    own = bucket_maps.Buckets(1 << 17, 10)
    hashes = r.integers(0, 2**63, 5000, dtype=np.uint64)
    for _ in range(3):
        own.add(hashes, np.full(5000, 4))
    counts = np.zeros(1 << 17, np.int64)
    for part, data in own.parts():
        places, n = bucket_maps.unpacked(data)
        counts[part * bucket_maps.PART + places.astype(int)] = n
    assert (counts[hashes % np.uint64(1 << 17)] == 10).all() and (counts > 0).sum() <= 5000
    assert not bucket_maps.has(np.zeros(1 << 14, np.uint8), hashes).any() and bucket_maps.has(np.full(1 << 14, 255, np.uint8), hashes).all()


def test_hashes_of_phrases_agree():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "de"]), pa.array(["a", "a b", "a b ü"])], ["lang", "phrase"])
    a, b, u = (collocations.word_hashes([lang], [w]) for lang, w in (("de", "a"), ("de", "b"), ("de", "ü")))
    got = collocations.phrase_hashes(batch)
    assert got[2] == collocations.chained(collocations.chained(a, b), u)[0]
    en = collocations.word_hashes(["en", "en"], ["a", "b"])
    assert got[0] == en[0] and got[1] == collocations.chained(en[:1], en[1:])[0]


def test_base_scores_by_brute_force_and_better_ones_of_the_model(spark):
    r = random.Random(6)
    parts = ["th", "er", "on", "ti", "ea", "st", "in", "ou", "ly", "wh"]
    rows = odd_rows(5) + [(1000 + i, " ".join("".join(r.choices(parts, k=r.choice([1, 1, 2, 3]))) for _ in range(r.randint(0, 300))), "en", "a") for i in range(400)]
    docs = [(x[0], re.findall("[^ \t-\r]+", lower(x[1])) + ["\n"]) for x in rows]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    c = Counter(w for i, ws in docs if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in docs)
    got = lm_mixing.scored(frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    assert all(x.score < 0 for x in got)
    fresh = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id >= 1000]
    assert len(fresh) > 20 and sum(x.score for x in fresh) > 1.02 * sum(x.base_score for x in fresh)  # words drawn at random from a closed set: unigrams are as good as it gets
    assert lm_mixing.scored(frame(spark, rows).limit(0)).count() == 0


def test_the_model_is_a_distribution():
    """Codes fill the space of bits, and words of one byte have less than all of the probability."""
    code = lm_mixing.Code(np.bincount(np.frombuffer(b"aabbbc  ", np.uint8), minlength=256))
    assert np.isclose((2.0 ** -code.length).sum(), 1)
    r = np.random.default_rng(2)
    table = r.integers(-60, 60, lm_mixing.regions(1 << 10)[1]).astype(np.int8)
    total = 0.0
    for b in sorted(set(range(1, 128)) - set(range(65, 91)) - {9, 10, 11, 12, 13, 32}):  # words of one byte, each alone in its document
        text = lm_mixing.tokens(np.array([b], np.uint8), np.array([1]))
        cost = lm_mixing.mixed(text, lm_mixing.looked_up(text.vocabulary, code, 1 << 10, table, lm_mixing.beginning()[0]), table, 1 << 10, lm_mixing.beginning()[1], 1)[0]
        total += math.exp(-cost[0])
    assert 0 < total < 1
    shares = np.log(np.array([0.5, 0.5]))
    assert (lm_mixing.refined(shares, shares, np.array([0, 0])) < 1e-9).all()


def test_held_out_documents_score_better_than_by_unigrams(spark):
    got = [x for x in lm_mixing.query(spark, "/root/testdata/sf0.01").collect() if x.held_out]
    assert sum(x.score for x in got) > sum(x.base_score for x in got) and all(0 < x.bits_per_byte < 4 for x in got if x.n_tokens > 50)


def test_weights_learn_from_earlier_blocks_only():
    """What a document ends with changes no cost before it, whatever its length."""
    r = random.Random(1)
    words = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(700)) for _ in range(3)]
    table = np.random.default_rng(4).integers(-60, 60, lm_mixing.regions(1 << 12)[1]).astype(np.int8)
    code = lm_mixing.Code(np.ones(256, int))

    def costs(texts):
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        text = lm_mixing.tokens(raw, np.array([len(t.encode()) for t in texts]))
        return lm_mixing.mixed(text, lm_mixing.looked_up(text.vocabulary, code, 1 << 12, table, lm_mixing.beginning()[0]), table, 1 << 12, lm_mixing.beginning()[1], len(texts))[0], text.doc

    (a, doc), (b, other) = costs(words), costs([words[0] + " zeta zeta", words[1], words[2]])
    n = int((doc == 0).sum()) - 1
    assert np.allclose(a[:n], b[:n]) and np.allclose(a[doc == 1], b[other == 1])
    assert a[600:700].mean() != a[:100].mean()


def test_each_bit_moves_the_weights_of_its_gate_before_the_next_one():
    r = np.random.default_rng(9)
    lane = np.concatenate((r.integers(0, 40, 3000), np.full(500, 7), np.full(200, 3)))
    own, cross, bit = r.normal(0, 2, len(lane)).astype(np.float32), r.normal(0, 2, len(lane)).astype(np.float32), r.integers(0, 2, len(lane))
    weights = np.tile([1.0, 0.3], (41, 1))
    got = lm_mixing.learned(own, cross, bit, lane, weights)
    w, want = np.tile([1.0, 0.3], (41, 1)), []
    for x, z, y, k in zip(own, cross, bit, lane, strict=True):
        want.append(min(14, max(-14, w[k] @ [x, z])))
        w[k] += lm_mixing.LEARN * (y - 1 / (1 + math.exp(-want[-1]))) * np.array([x, z])
    assert np.allclose(got, want, atol=1e-3) and np.allclose(weights, w, atol=1e-3)


def test_words_are_asked_for_and_answered_by_buckets(spark):
    """What is moved is a row for each chunk and bucket, whatever number of distinct words there are; an answer holds counts alone."""
    r = random.Random(8)
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(200)), "en", "a") for i in range(100)]
    docs = frame(spark, rows).select("doc_id", lm_mixing.fold(F.col("doc_id")).alias("fold"), "text")
    chunks = lm_mixing.chunked(docs.coalesce(2), most=5000).cache()
    asked = lm_mixing.word_rows(chunks, 7)
    got = lm_mixing.word_counts(asked).collect()
    assert len(got) == asked.count() <= 7 * chunks.count() < 1000
    c = Counter(w for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10 != lm_mixing.HELD_OUT for w in [*t.split(), lm_mixing.END])
    assert (sum(x.n for x in got), sum(x.v for x in got)) == (sum(c.values()), len(c))
    told = {(x.chunk, x.bucket): lm_mixing.unpacked(x.data) for x in got}
    for chunk in chunks.collect():
        _, _, _, lens, raw = lm_mixing.unpacked(bytes(chunk.data))
        words = lm_mixing.tokens(raw, lens).vocabulary
        order, begin = lm_mixing.by_bucket(words, 7)
        for b in range(7):
            own = words.take(pa.array(order[begin[b] : begin[b + 1]])).to_pylist()
            assert not own or told[chunk.chunk, b][0].tolist() == [c[w] for w in own]


def test_mixing_keeps_few_bits_at_once():
    """The bits of a chunk's tokens are not all in memory at one time."""
    r = random.Random(5)
    words = [f"word{i}" for i in range(500)]
    texts = [" ".join(r.choices(words, k=150)).encode() for _ in range(1500)]
    text = lm_mixing.tokens(np.frombuffer(b"".join(texts), np.uint8), np.array(list(map(len, texts))))
    table = np.random.default_rng(4).integers(-60, 60, lm_mixing.regions(1 << 12)[1]).astype(np.int8)
    spelled = lm_mixing.looked_up(text.vocabulary, lm_mixing.Code(np.ones(256, int)), 1 << 12, table, lm_mixing.beginning()[0])
    tracemalloc.start()
    cost, _ = lm_mixing.mixed(text, spelled, table, 1 << 12, lm_mixing.beginning()[1], len(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(cost) == 1500 * 151 and peak < 90e6
