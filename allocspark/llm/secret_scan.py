r"""Secret scans (operator 8): fixed patterns, and a character convolutional network over every candidate.

Three kinds of patterns give the base spans: assignments to a password-like name, access
keys that begin with AKIA, and runs of 24 or more hexadecimal digits. Every other run of 16
or more token characters (or what base spans leave of it) that is not a plain word is a
candidate; the network sees its characters and those around it and adds the spans whose
probability reaches a threshold. A candidate too long for one look is also seen part by part,
overlapping from end to end, and its highest probability counts.

The network is small and lives in numpy: characters are embedded, two widths of
convolution are max-pooled over the candidate and its surroundings, one dense layer gives a
logit. It is trained on labelled findings: made-up secrets of many formats in code-like
and plain contexts, and look-alikes that are none (long words, paths, addresses, dates,
numbers, identifiers), all drawn from a fixed seed, with targets a little off 0 and 1, so
that scores stay apart. On findings that it hasn't seen, a temperature calibrates the
logits, and on others the threshold is the largest that keeps ``recall``.

Null and empty texts have no spans; texts are scanned whole; spans are in code points, end
exclusive. Repeated rows and null ids are scanned as they are.
"""

from __future__ import annotations

import functools
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import replaced, table, texts_of

#: Fixed patterns and the order of their kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "net")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
WORDLIKE = re.compile(r"[A-Za-z]?[a-z]{0,22}[.=-]*|[A-Z]{0,23}[.=-]*")
BEFORE, INSIDE, AFTER, LEAST = 20, 40, 8, 12
RECALL, SMOOTH = 0.97, 0.02


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the fixed patterns; matches that fail a length are dropped after they have been passed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters, without their base spans, that hold more than a word."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        a, z = m.span()
        while k < len(base) and base[k][2] <= a:
            k += 1
        parts, j = [], k
        while j < len(base) and base[j][0] < z:
            parts.append((a, base[j][0]))
            a, j = max(a, base[j][2]), j + 1
        out += [(b, e) for b, e in (*parts, (a, z)) if e - b >= LEAST and not WORDLIKE.fullmatch(text, b, e)]
    return out


def views(a: int, z: int) -> list[tuple[int, int]]:
    """What the network is shown of a candidate: all of it, and overlapping parts of a long one from end to end."""
    return [(a, z), *((b, min(z, b + INSIDE)) for b in range(a, z - INSIDE // 2, INSIDE // 2) if z - a > INSIDE)]


def window(text: str, a: int, z: int) -> np.ndarray:
    """Codes of the characters before, in (its two ends, if it is long) and after a candidate."""
    token = text[a:z] if z - a <= INSIDE else text[a : a + INSIDE // 2] + text[z - INSIDE // 2 : z]
    shown = text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0") + token.ljust(INSIDE, "\0") + text[z : z + AFTER].ljust(AFTER, "\0")
    return np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), "<u4").clip(0, 127).astype(np.int64)


@dataclass
class Network:
    """Embedding, two convolutions with maximum pooling, one dense layer."""

    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    @classmethod
    def new(cls, rng: np.random.Generator, size: int = 8, filters: int = 24) -> Network:
        widths = (3, 7)
        return cls(rng.normal(0, 0.3, (128, size)), [rng.normal(0, (2 / (w * size)) ** 0.5, (w * size, filters)) for w in widths], [np.zeros(filters) for _ in widths], rng.normal(0, 0.1, filters * len(widths) + 1))

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        e = self.embed[codes]
        pooled, kept = [], []
        for k, b in zip(self.kernels, self.biases, strict=True):
            w = len(k) // e.shape[2]
            patches = np.lib.stride_tricks.sliding_window_view(e, (w, e.shape[2]), axis=(1, 2))[:, :, 0].reshape(len(e), -1, len(k))
            z = patches @ k + b
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None], axis=1)[:, 0]
            pooled.append(np.maximum(top, 0))
            kept.append((w, patches, at, top))
        h = np.concatenate([*pooled, np.ones((len(e), 1))], axis=1)
        return h @ self.out, [h, kept]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        out = [1 / (1 + np.exp(-np.clip(self.forward(codes[a : a + 256])[0] / self.temperature, -40, 40))) for a in range(0, len(codes), 256)]
        return np.concatenate(out) if out else np.zeros(0)

    def step(self, codes: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        """One step of Adam on the logistic loss."""
        logit, (h, kept) = self.forward(codes)
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        grads = {"out": h.T @ d + 1e-4 * self.out, "embed": np.zeros_like(self.embed)}
        at = 0
        for i, (w, patches, where, top) in enumerate(kept):
            n = top.shape[1]
            g = d[:, None] * self.out[at : at + n] * (top > 0)
            at += n
            chosen = np.take_along_axis(patches, where[:, :, None], axis=1)
            grads[f"k{i}"], grads[f"b{i}"] = np.einsum("bn,bnk->kn", g, chosen), g.sum(axis=0)
            back = (g[:, :, None] * self.kernels[i].T).reshape(len(y), n, w, -1)
            np.add.at(grads["embed"], codes[np.arange(len(y))[:, None, None], where[:, :, None] + np.arange(w)], back)
        state["t"] = t = state.get("t", 0) + 1
        for name, g in grads.items():
            p = {"out": self.out, "embed": self.embed}.get(name) if name in ("out", "embed") else (self.kernels if name[0] == "k" else self.biases)[int(name[1:])]
            m, v = state.setdefault(name, [np.zeros_like(p), np.zeros_like(p)])
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)


def findings(n: int, seed: int, only: int | None = None) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n labelled findings: (text, start, end) and 1 for a secret. ``only``: secrets of one format."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choices(chars, k=n))
    alnum, low = string.ascii_letters + string.digits, string.ascii_lowercase
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "in", "ei", "cion", "eau", "sch", "lich", "ment", "de", "la", "re")) for _ in range(r.randint(1, 4)))
    secret = (
        lambda: r.choice(("ghp_", "gho_", "glpat-", "sk_live_", "sk-", "xoxb-", "npm_", "AIza", "")) + pick(alnum, r.randint(20, 44)),
        lambda: pick(alnum + "+/", r.choice((24, 32, 40, 64))) + r.choice(("", "=", "==")),
        lambda: f"eyJ{pick(alnum, 20)}.eyJ{pick(alnum + '_-', 40)}.{pick(alnum + '_-', 43)}",
        lambda: pick(string.ascii_uppercase + string.digits, r.randint(20, 32)),
        lambda: pick(alnum + "_-", r.randint(22, 48)),
        lambda: r.choice(("glpat-", "hvs.", "dop_v1_", "pat-", "key-")) + pick(alnum, r.randint(16, 30)),
        lambda: pick(alnum, r.randint(12, 16)) + r.choice(string.digits),
        lambda: pick(low, r.randint(24, 40)),
    )
    harmless = (
        lambda: r.choice("._-/").join(word() for _ in range(r.randint(4, 7))),
        lambda: "".join(word().title() for _ in range(r.randint(3, 6))) + r.choice(("", "2", "V1")),
        lambda: f"{word()}.{r.randint(1, 99)}-mail{r.randint(1, 9)}.example.com",
        lambda: f"/{word()}/{word()}/{word()}.{r.choice(('html', 'py', 'csv'))}",
        lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}-{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}",
        lambda: pick(string.digits, r.randint(16, 20)),
        lambda: r.choice("=-_.") * r.randint(16, 50),
        lambda: f"{r.randint(100, 255)}.{r.randint(100, 255)}.{r.randint(100, 255)}.{r.randint(100, 255)}",
        lambda: f"{word()}_{word()}_{word()}_{r.randint(1, 999)}_{word()}",
        lambda: pick(low, r.randint(2, 3)) + "-".join(word() for _ in range(4)) + str(r.randint(0, 9)),
        lambda: "".join(word() for _ in range(12))[: r.randint(24, 45)],
        lambda: (pick(low, r.randint(1, 4)) * 50)[: r.randint(24, 60)],
        lambda: f"{word()}{r.randint(1, 99)}{r.choice('.@_-')}{word()}{r.choice(('', str(r.randint(1, 2030))))}.{r.choice(('com', 'org', 'example'))}",
        lambda: f"{word().title()}{word().title()}.{word()}",
        lambda: f"{r.choice(('v', 'rev', 'RFC', 'ISO', 'EN-', 'page'))}{r.randint(1, 9999)}-{r.randint(1, 2030)}.{word()}",
    )
    out, y = [], []
    for _ in range(n):
        good = only is not None or r.random() < 0.5
        token = (secret[only] if only is not None else r.choice(secret if good else harmless))()
        before = r.choice((f"{word()} {word()} ", f"{word()}!! {word()}!! ", f"{word()}### {word()}*** ", f"{word()} | {word()} | ", f'{word()} = "', f"{word()}: ", "Authorization: Bearer ", f"{word()}.\n", f"{word()} ({word()} ", ""))
        before = before.upper() if r.random() < 0.3 else before
        out.append((before + token + r.choice((f" {word()} {word()}", f"!! {word().upper()}!!", f"### {word()}", f" | {word()}", '"\n', ".", f", {word()}", "")), len(before), len(before) + len(token)))
        y.append(good)
    return out, np.array(y, float)


@functools.lru_cache(maxsize=2)
def trained(n: int = 8000, seed: int = 7, recall: float = RECALL) -> Network:
    """Train, calibrate, and choose the threshold on three sets of findings of their own."""
    rng = np.random.default_rng(seed)
    codes = [(np.stack([window(*f) for f in found]), y) for found, y in (findings(n, seed), findings(n // 2, seed + 1), findings(n // 2, seed + 2))]
    net, state = Network.new(rng), {}
    x, y = codes[0]
    for epoch in range(4):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 64):
            net.step(x[order[a : a + 64]], SMOOTH + (1 - 2 * SMOOTH) * y[order[a : a + 64]], state, 0.004 / (1 + epoch))
    logit, held = net.forward(codes[1][0])[0], codes[1][1]
    loss = lambda t: np.logaddexp(0, np.where(held > 0, -logit, logit) / t).mean()
    net.temperature = float(min(np.geomspace(0.3, 5, 40), key=loss))
    p, held = net.probabilities(codes[2][0]), codes[2][1]
    net.threshold = float(np.quantile(p[held > 0], 1 - recall, method="lower"))
    return net


def scan_texts(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: (start, rank of kind, end)."""
    found = [base_spans(t) for t in texts]
    places = [(i, a, z, b, e) for i, t in enumerate(texts) for a, z in candidates(t, found[i]) for b, e in views(a, z)]
    hits = set()
    for k in range(0, len(places), 4096):
        part = places[k : k + 4096]
        p = net.probabilities(np.stack([window(texts[i], b, e) for i, _, _, b, e in part]))
        hits |= {x[:3] for x, hit in zip(part, p >= net.threshold, strict=True) if hit}
    for i, a, z in hits:
        found[i].append((a, 3, z))
    return [sorted(f) for f in found]


def scan(df: DataFrame, text: str = "text", out: str = "secrets", net: Network | None = None) -> DataFrame:
    """Add an array of (start, kind, end) to each row."""
    net = net or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                spans = scan_texts(texts_of(part.column(part.schema.get_field_index(text))), net)
                yield replaced(part, {out: pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in f] for f in spans], pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])))})

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())])
    return df.mapInArrow(run, T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(span))]))


def masked(df: DataFrame, text: str = "text", mask: str = "[SECRET]", net: Network | None = None) -> DataFrame:
    """``df`` with each span of its texts (overlapping ones together) replaced by a mask; null texts stay null."""
    net = net or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                column = part.column(part.schema.get_field_index(text))
                done = []
                for t, raw, f in zip(texts := texts_of(column), column.to_pylist(), scan_texts(texts, net), strict=True):
                    pieces, at = [], 0
                    for s, _, e in f:
                        if s >= at:
                            pieces += [t[at:s], mask]
                        at = max(at, e)
                    done.append(None if raw is None else "".join([*pieces, t[at:]]))
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()) if n == text else c for n, c in zip(part.schema.names, part.columns, strict=True)], part.schema.names)

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "net")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
