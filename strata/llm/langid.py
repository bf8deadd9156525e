"""Language identification with a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes; two gated recurrent layers read each
window from either side, and a softmax layer on both states labels every byte. A document's
probabilities are the mean over all of its bytes. Training is plain numpy: backpropagation through
time with Adam, from at most ``MAX_PER_LANG`` documents of each of ``MAX_LANGS`` languages and ``WINDOWS_PER_DOC``
windows of each (documented bounds of the fit; documents are taken in hash order). Prediction reads
every byte of every text and nothing but the text.

Defined results: null texts and texts without a letter are ``und`` with score 0; repeated rows each
get a prediction; if nothing can be learned (no labelled text), all are ``und``; an empty table gives
an empty result; further columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table

WINDOW = 96
HIDDEN = 8
PAD = 256  # input past a text's end: keeps the state as it is
MAX_PER_LANG = 800
MAX_LANGS = 200
WINDOWS_PER_DOC = 6
BATCH_WINDOWS = 4096
LETTER = re.compile(r"[^\W\d_]")
GATES = ("z", "r", "n")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, one row each, padded with ``PAD``; and the text of each."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = np.full(int(counts.sum()) * WINDOW, PAD, np.int16)
    at = 0
    for t, c in zip(texts, counts):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(c) * WINDOW
    return flat.reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights of both directions. ``f.z`` etc. are input tables (257 bytes x hidden), ``f.uz`` etc.
    the recurrent matrices, ``out`` and ``bias`` the softmax layer."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def start(cls, langs: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for d in "fb":
            for g in GATES:
                w[f"{d}.{g}"] = rng.normal(0, 0.3, (PAD + 1, HIDDEN))
                w[f"{d}.u{g}"] = rng.normal(0, 0.6 / np.sqrt(HIDDEN), (HIDDEN, HIDDEN))
        w["out"] = rng.normal(0, 0.3, (2 * HIDDEN, len(langs)))
        w["bias"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, x: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States of one direction at every position, (WINDOW, rows, HIDDEN)."""
        w = self.w
        tables = {g: w[f"{d}.{g}"].copy() for g in GATES}
        tables["z"][PAD] = 30.0
        uz, ur, un = (w[f"{d}.u{g}"] for g in GATES)
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        out = np.empty((x.shape[1], len(x), HIDDEN), np.float32)
        h = np.zeros((len(x), HIDDEN), np.float32)
        columns = np.ascontiguousarray(x.T)
        for t in steps:
            c = columns[t]
            z = sigmoid(tables["z"].take(c, axis=0) + h @ uz)
            r = sigmoid(tables["r"].take(c, axis=0) + h @ ur)
            q = h @ un
            n = np.tanh(tables["n"].take(c, axis=0) + r * q)
            if trace is not None:
                trace.append((t, h, z, r, q, n))
            h = n + z * (h - n)
            out[t] = h
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of every position, (WINDOW, rows, languages)."""
        logits = self.states(x, "f") @ self.w["out"][:HIDDEN] + (self.states(x, "b") @ self.w["out"][HIDDEN:] + self.w["bias"])
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Backpropagation through time of the mean cross entropy over all positions."""
        w = self.w
        traces: dict[str, list] = {"f": [], "b": []}
        states = {d: self.states(x, d, traces[d]) for d in "fb"}
        logits = states["f"] @ w["out"][:HIDDEN] + states["b"] @ w["out"][HIDDEN:] + w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        mask = (x.T != PAD).astype(np.float32)[:, :, None] / max(1, int((x != PAD).sum()))
        rows = np.arange(len(x))
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * mask[:, :, 0]).sum())
        error = p.copy()
        error[:, rows, y] -= 1
        error *= mask
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["bias"] = error.sum(axis=(0, 1))
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            g["out"][part] = np.tensordot(states[d], error, axes=((0, 1), (0, 1)))
            into = error @ w["out"][part].T
            uz, ur, un = (w[f"{d}.u{k}"] for k in GATES)
            later = np.zeros((len(x), HIDDEN), np.float32)
            for t, h, z, r, q, n in reversed(traces[d]):
                dh = into[t] + later
                dz = dh * (h - n) * z * (1 - z)
                dn = dh * (1 - z) * (1 - n * n)
                dq = dn * r
                dr = dn * q * r * (1 - r)
                later = dh * z + dz @ uz.T + dr @ ur.T + dq @ un.T
                for k, v in (("z", dz), ("r", dr), ("n", dn)):
                    np.add.at(g[f"{d}.{k}"], x[:, t], v)
                g[f"{d}.uz"] += h.T @ dz
                g[f"{d}.ur"] += h.T @ dr
                g[f"{d}.un"] += h.T @ dq
        return g, loss

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Mean probabilities of each text over its bytes; zeros for texts without bytes."""
        x, of = windows([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        total = np.zeros((len(texts), len(self.langs)))
        for i in range(0, len(x), BATCH_WINDOWS):
            part = x[i : i + BATCH_WINDOWS]
            probabilities = self.positions(part)
            short = part[:, -1] == PAD
            probabilities[:, short] *= (part[short].T != PAD)[:, :, None]
            np.add.at(total, of[i : i + BATCH_WINDOWS], probabilities.sum(axis=0, dtype=np.float64))
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def spread(text: str) -> np.ndarray:
    """At most ``WINDOWS_PER_DOC`` windows of a text, evenly spread."""
    x, _ = windows([text.encode("utf-8", "surrogatepass")])
    return x[np.linspace(0, len(x) - 1, WINDOWS_PER_DOC).astype(int)] if len(x) > WINDOWS_PER_DOC else x


def train(x: np.ndarray, langs: list[str], steps: int = 360, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Network:
    """Fits a network with Adam on windows and the language of each; languages are drawn alike."""
    names = sorted(set(langs))
    place = {n: i for i, n in enumerate(names)}
    y = np.array([place[v] for v in langs])
    net = Network.start(names, seed)
    rng = np.random.default_rng(seed)
    by = [np.flatnonzero(y == c) for c in range(len(names))]
    by = [b for b in by if len(b)]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(b, max(1, batch // len(by))) for b in by])
        g, _ = net.gradients(x[chosen], y[chosen])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        lr = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k, a in g.items():
            a = a * scale
            m[k] = 0.9 * m[k] + 0.1 * a
            v2[k] = 0.99 * v2[k] + 0.01 * a * a
            net.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def training_sample(docs: DataFrame, per_lang: int = MAX_PER_LANG) -> DataFrame:
    """``(doc_id, lang, place, bytes)``: the windows of at most ``per_lang`` documents of each of the
    ``MAX_LANGS`` most frequent languages, in hash order. They are cut where the texts are."""
    rows = docs.where("lang is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    # Hashes are spread evenly, so the first per_lang of n lie within the first 3 per_lang / n of their
    # range: a language with many rows is thinned to that before it meets in a window.
    sizes = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "lang").limit(MAX_LANGS))
    reach = F.least(F.lit(3.0 * per_lang + 100) / F.col("size"), F.lit(1.0)) * 2.0**64 - 2.0**63
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(sizes, "lang").where(F.col("h").cast("double") <= reach)
    ids = hashed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("doc_id").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple[int | None, str, int, bytes]] = []
            for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(doc, lang, i, w[w != PAD].astype(np.uint8).tobytes()) for i, w in enumerate(spread(text))]
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.binary()))], names=["doc_id", "lang", "place", "bytes"])

    chosen = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text")  # per_lang * MAX_LANGS ids at most
    return chosen.mapInArrow(cut, "doc_id long, lang string, place int, bytes binary")


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 12,000 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            known = shared.value is not None
            p = shared.value.documents(texts) if known else np.zeros((len(texts), 1))
            letters = np.array([bool(t) and bool(LETTER.search(t)) for t in texts], bool) & known
            best = p.argmax(axis=1) if len(texts) else np.empty(0, int)
            names = [shared.value.langs[b] if ok else "und" for b, ok in zip(best, letters)]
            score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0) if len(texts) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def fit(docs: DataFrame, per_lang: int = MAX_PER_LANG) -> Network | None:
    rows = training_sample(docs, per_lang).collect()  # WINDOWS_PER_DOC * per_lang * MAX_LANGS windows of WINDOW bytes at most
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.place, bytes(r.bytes)))
    if not rows:
        return None
    return train(windows([bytes(r.bytes) for r in rows])[0], [r.lang for r in rows])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out()))
    return predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
