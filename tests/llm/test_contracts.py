"""The queries' digests and the pipeline's stages against plain Python over whole tables of odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from allocspark.llm import neardup, quality_rules, registry, secret_scan, sharding, shingles, toxicity

SPACE = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(r, n):
    return " ".join("".join(r.choices("aeioulmnrst", k=r.randint(2, 9))) for _ in range(n))


def corpus():
    r = random.Random(5)
    long = prose(r, 400)
    words = long.split()
    near = " ".join(words[:200] + ["changed"] + words[201:])
    key = "ghp_x7Kq2ZbV9mT4wLr8YsN1cJd5Hf3Gp6Ae0UiQ"
    rows = [
        (0, None), (1, ""), (2, long), (3, near), (4, long), (5, "few words only"), (6, "buy now now " * 60), (7, prose(r, 120) + f' Token = "{"ab12" * 8}" end'),
        (8, prose(r, 80) + " " + key + " " + prose(r, 40)), (9, prose(r, 30) + " " + " ".join(words[50:63]).upper() + " " + prose(r, 40)), (10, prose(r, 900) + " " + " ".join(words[50:63]) + "."),
        (11, prose(r, 100) + " AKIA" + "Q2" * 10 + " " + "0f" * 16 + "\n" + "Ünï 日本 " * 30), (12, prose(r, 60) + "\n\n\t" + "# $ % & " * 300), (None, prose(r, 70)), (13, "x" * 3000 + " " + prose(r, 3000)),
        (7, prose(random.Random(9), 90)),
    ]
    return rows + [(100 + i, prose(r, 60)) for i in range(12)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("sf"))
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{to}/documents.parquet")
    words = rows[2][1].split()
    spark.createDataFrame([("a,b", " ".join(words[50:63])), ("short", "no such words"), (None, None)], "item_id string, text string").write.parquet(f"{to}/benchmark.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(12)], "doc_id bigint, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return to


def text_of(rows):
    return {i: t for i, t in rows if i != 7}


def test_tokens_as_the_library(spark, sf):
    import public_tokenizers as P
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, t in corpus() for ids in [lib.encode(t or "")])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.queries()["op1_sentencepiece"](spark, sf).collect()) == want


def test_secret_digests(spark, sf):
    def spans(t):
        t = t or ""
        found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[1]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return sorted(found)

    texts = text_of(corpus())
    got = {r.doc_id: r for r in registry.queries()["op8_secrets"](spark, sf).collect() if r.doc_id != 7}
    for i, t in texts.items():
        base = spans(t)
        kinds = [k for _, _, k, _ in base]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in base).encode()).hexdigest()
        shown = [x for x in got[i].spans.split(",") if x]
        assert [x for x in shown if not x.startswith("net")] == [f"{k}:{s}:{e}" for s, _, k, e in base]
    at = texts[8].index("ghp_")
    assert got[8].spans == f"net:{at}:{at + 40}" and sum("net" in r.spans for r in got.values()) == 1


def test_recall_of_every_format():
    net = secret_scan.trained()
    held, y = secret_scan.findings(4000, 9)  # the set that chooses the threshold
    p = net.probabilities(np.stack([secret_scan.window(*f) for f in held]))
    assert (p[y > 0] >= net.threshold).mean() >= secret_scan.RECALL and (p[y == 0] >= net.threshold).mean() < 0.01
    for k in range(8):
        found, _ = secret_scan.findings(400, 77, k)
        assert (net.probabilities(np.stack([secret_scan.window(*f) for f in found])) >= net.threshold).mean() > 0.75, k


def test_shards_have_places_without_gaps(spark, sf):
    rows = registry.queries()["op6_sharding"](spark, sf).collect()
    texts = [t for _, t in corpus()]
    assert sorted((r["size"], r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(len(by.get(k, [])) for k in range(8)) <= 1
    one = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    placed = sharding.assign(one, 8)
    assert placed.count() == 1000 and placed.groupBy("shard").count().where("count = 125").count() == 8


def test_links_at_the_threshold_are_found(spark):
    """Pairs whose sets are just similar enough, and others just not."""
    r = random.Random(3)
    rows, want = [], {}
    for k in range(150):
        w = [f"p{k}w{i}" for i in range(120)]
        cut = r.randint(10, 20)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[cut:]) + f" q{k} z{k}")]
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows[-2:])
        want[2 * k + 1] = 2 * k if 100 * len(a & b) >= 75 * len(a | b) else 2 * k + 1
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: got[i] for i in want} == want and len(set(want.values())) > 100


def test_sets_without_company_have_no_partner(spark):
    """What the first filter takes away has fewer equal coordinates with any other set than a pair needs."""
    r = random.Random(4)
    base = prose(r, 200).split()
    texts = [" ".join(base[k:] + prose(r, k).split()) for k in range(0, 200, 10)] + [prose(r, 100) for _ in range(20)]
    sig = np.stack([shingles.min_hashes(s, neardup.K) for s in shingles.shingle_sets(texts, b"k")])
    sets = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sig)], "node bigint, sig array<int>")
    kept = {x.node for x in neardup.with_company(sets).collect()}
    for i in set(range(len(texts))) - kept:
        assert all((sig[i] == sig[j]).sum() < neardup.MATCH for j in range(len(texts)) if j != i)
    assert {0, 1} <= kept


def test_one_text_and_label_of_a_doc_id(spark):
    docs = spark.createDataFrame([(i, f"you vile troll {i}" if i % 2 else f"fine day {i}") for i in range(300)] * 3 + [(1, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(300)] + [(1, 0, 1), (2, None, None)], "doc_id bigint, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    bad, good, none = model.scores(["you vile troll", "fine day", ""])
    assert bad > 0.9 and good < 0.1 and 0 <= none <= 1
    assert quality_rules.learned(docs, labels) == []  # all fail by their length already
    assert toxicity.fit(docs, labels.where("toxic = 0")).scores(["x"]).tolist() == [0.0]


def brute_stages(rows, item):
    """What each stage keeps of (doc_id, text), by brute force; the learned rules keep all here."""
    def base_failed(t):
        w = re.findall(SPACE, t or "")
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {}
        for x in g:
            seen[x] = seen.get(x, 0) + 1
        repeated = {k for i, x in enumerate(g) if seen[x] > 1 for k in (i, i + 1, i + 2)}
        return len(w) < 50 or 100 * len(repeated) > 50 * len(w)

    kept = [(i, t) for i, t in rows if not base_failed(t)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in kept for w in [re.findall(SPACE, lower(t))]]
    out = []
    for k, (i, t) in enumerate(kept):
        similar = [kept[j][0] for j in range(len(kept)) if j != k and kept[j][0] is not None and 100 * len(sets[k] & sets[j]) >= 75 * len(sets[k] | sets[j])]
        if i is None or not similar or i <= min(similar):
            out.append((i, t))
    window = re.findall(PLAIN, lower(item))

    def contaminated(t):
        w = re.findall(PLAIN, lower(t))
        hit = {j for k in range(len(w) - 12) if w[k : k + 13] == window for j in range(k, k + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    return kept, out, [(i, t) for i, t in out if not contaminated(t)]


def test_stages_by_brute_force(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus()
    item = " ".join(rows[2][1].split()[50:63])
    quality, near, clean = brute_stages(rows, item)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    show = lambda df: sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in df.collect())
    plain = lambda x: sorted((-1 if i is None else i, t) for i, t in x)
    for (_, stage), want in zip(pipeline.STAGES[:3], (quality, near, clean), strict=False):
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and show(docs) == plain(want)
    assert len(quality) > len(near) > len(clean) > 10 and {3, 4, 9} & {i for i, _ in quality} and 9 not in {i for i, _ in clean} and 10 in {i for i, _ in clean}
    masked = {r.doc_id: r for r in pipeline.STAGES[3][1](spark, docs, sf).collect()}
    assert "ghp_" not in masked[8].text and "[SECRET]" in masked[8].text and masked[8].n_chars == len(masked[8].text)
    assert "AKIA" not in masked[11].text and masked[100].text == dict(rows)[100]


def test_whole_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers as P
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = corpus()
    _, _, clean = brute_stages(rows, " ".join(rows[2][1].split()[50:63]))
    got = pipeline.run(spark, sf).collect()
    assert len(got) == len(clean) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    texts = dict(rows)
    assert all(r.ids == lib.encode(texts[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id >= 100)


def test_texts_made_to_collide_under_a_fixed_polynomial(spark, tmp_path):
    """Differences whose sum vanishes under a published base modulo 2^64 once passed for equal bytes and equal words."""
    steps = (-4, -11, -6, -11, 9, 0, 4, 16, 12, 5, -4, 6, 4, 0)
    other = "".join(chr(ord("M") + d) for d in steps)
    r = random.Random(2)
    rows = []
    for k in range(4):
        pre, suf = ("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=250)) for _ in range(2))
        rows += [(2 * k, pre + "M" * 14 + suf), (2 * k + 1, pre + other + suf)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same = sum(d == 0 for d in steps[-1:])
    got = {x.doc_id: x.n_removed for x in registry.queries()["op5_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == {i: 500 + same for i, _ in rows}
    words = spark.createDataFrame([(1, "m" * 14), (2, "".join(chr(ord("m") + d) for d in steps)), (3, "m" * 14)], "doc_id bigint, text string")
    assert sorted((x.doc_id, x.component_id) for x in neardup.near_duplicates(words).collect()) == [(1, 1), (2, 2), (3, 1)]
