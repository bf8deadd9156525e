"""Benchmark decontamination: edit distance over words, found by CGK embedding and bit sampling.

The CGK walk (Chakraborty, Goldenberg and Koucky, 2016) reads a sequence with a pointer: step j puts
out the word under the pointer and moves on by a random bit of (j, word). Two sequences at edit
distance k, walked with the same bits, differ in few places: after an edit the pointers drift apart
and meet again. So edit distance becomes Hamming distance, and sampling places of the walk is a
locality-sensitive hash for it; each repetition draws new bits and places.

An item of n words, of which k = ``int(max_edit * n)`` may be edited, is indexed from each of its first
2k + 1 words; a window of a document starts where two adjacent words are those of such a start. An
edit breaks two of these pairs at most, so one of them stands whatever the edits are and wherever they
lie, at the opening too. From there on the walk decides: ``SAMPLES`` places, one of them early, over a
window of the item's size (items are grouped into classes of nearly equal length, ``RATIO``). For each class
repetitions are added until edited copies of its items, with all k edits at random, at the opening, in
the middle or at the end, are hit with ``recall``, ``TRIALS`` copies of each form.

A hit is checked exactly: the smallest edit distance of the item to any run of words around the hit
(Sellers' algorithm), at most k.

The benchmark is the stated query set, read in blocks of ``BLOCK_ITEMS`` items: each block is
broadcast and passes over all documents. Words are runs of letters, digits and underscores of the
lower-cased text.

Defined results: null and empty texts hold no item; items without a word match nothing; repeated
documents and items each keep their rows; empty tables give an empty result; further columns play no
part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_caches, slices, table

#: Places of the walk in a key, besides the two words of the start.
SAMPLES = 2
RATIO = 1.4
TRIALS = 120
MIN_REPETITIONS, MAX_REPETITIONS = 8, 64
BLOCK_ITEMS = 20_000
CHUNK_CHARS = 1 << 20
WORD = re.compile(r"\w+")
PRIME = np.int64(1_000_003)
FILTER = 1 << 20


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys ^ (keys >> 20) ^ (keys >> 40)) & (FILTER - 1)


def pair_keys(words: np.ndarray) -> np.ndarray:
    """Key of each word and the one after it."""
    return words[:-1].astype(np.int64) * PRIME + words[1:]


def marked(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(FILTER, bool)
    out[slot(keys)] = True
    return out


class Walk:
    """One repetition for one class of item lengths: bits, sampled places and the keys of all starts."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, vocabulary: int, steps: int, rng: np.random.Generator):
        early = int(rng.integers(2, max(3, min(7, steps))))
        rest = rng.integers(2, max(3, steps), SAMPLES - 1)
        self.places = sorted({early, *rest.tolist()})
        self.bits = rng.integers(0, np.iinfo(np.uint64).max, (self.places[-1] // 64 + 1, vocabulary + 2), np.uint64)  # of 64 steps each
        self.filters: list[np.ndarray] = []
        keys, _ = self.run(flat, starts, True)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def run(self, words: np.ndarray, at: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the walks from ``at``, and which of them may equal an item's."""
        pointer = at.astype(np.int64)
        last = len(words) - 1
        key = words.take(pointer) * PRIME + words.take(np.minimum(pointer + 1, last))
        alive = np.arange(len(at))
        n = 0
        for j in range(self.places[-1] + 1):
            w = words.take(np.minimum(pointer, last))
            if j == self.places[n]:
                key = key * PRIME + w
                if learn:
                    self.filters.append(marked(key))
                else:
                    ok = self.filters[n].take(slot(key))
                    pointer, key, alive, w = pointer[ok], key[ok], alive[ok], w[ok]
                    if not len(alive):
                        break
                n += 1
                if n == len(self.places):
                    break
            pointer = pointer + ((self.bits[j >> 6].take(w) >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
        return key, alive

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place in at, indexed start)`` of every collision."""
        key, alive = self.run(words, at)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = high - low
        if not n.sum():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(alive, n), self.order[np.repeat(low, n) + offset]


FORMS = ("random", "opening", "middle", "end")


def edited(item: np.ndarray, k: int, form: str, vocabulary: int, rng: np.random.Generator) -> np.ndarray:
    """``item`` with k edits (words replaced, put in or left out), spread or next to each other."""
    words = item.tolist()
    n = len(words)
    first = {"random": 0, "opening": 0, "middle": (n - k) // 2, "end": n - k}[form]
    places = rng.choice(n, k, replace=False) if form == "random" else np.arange(first, first + k)
    for p in sorted(places.tolist(), reverse=True):
        kind = rng.integers(0, 3)
        new = int(rng.integers(0, vocabulary + 1))
        if kind == 0:
            words[p] = new
        elif kind == 1:
            words.insert(p, new)
        else:
            del words[p]
    return np.array(words, np.int64)


class Class:
    """Items of nearly equal length with their starts and enough walks over them."""

    def __init__(self, members: list[int], items: list[np.ndarray], most: list[int], vocabulary: int, recall: float, rng: np.random.Generator):
        gap = vocabulary + 1
        shortest = min(len(items[k]) - 2 * most[k] for k in members)
        steps = max(3, shortest)
        pad = np.full(2 * steps + 2, gap, np.int64)
        flat: list[np.ndarray] = []
        of, shift, at = [], [], []
        total = 0
        for k in members:
            for o in range(min(2 * most[k] + 1, max(1, len(items[k]) - 1))):
                of.append(k)
                shift.append(o)
                at.append(total + o)
            flat += [items[k].astype(np.int64), pad]
            total += len(items[k]) + len(pad)
        words, starts = np.concatenate(flat), np.array(at)
        self.of, self.shift = np.array(of), np.array(shift)
        self.pairs = marked(pair_keys(words)[starts])
        trials: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, where each copy begins, its item
        for form in FORMS:
            parts, begins, own = [pad], [len(pad)], []
            for i in range(max(1, TRIALS)):
                k = members[i % len(members)]
                parts += [edited(items[k], most[k], form, vocabulary, rng), rng.integers(0, vocabulary + 1, len(pad))]
                own.append(k)
                begins.append(begins[-1] + len(parts[-2]) + len(pad))
            trials.append((np.concatenate(parts), np.array(begins), np.array(own)))
        found = [np.zeros(TRIALS, bool) for _ in FORMS]
        self.walks: list[Walk] = []
        while len(self.walks) < MAX_REPETITIONS and (len(self.walks) < MIN_REPETITIONS or min(f.mean() for f in found) < recall):
            walk = Walk(words, starts, vocabulary, steps, rng)
            self.walks.append(walk)
            for f, (text, begins, own) in zip(found, trials):
                a, s = walk.hits(text, places := self.windows(text, np.arange(len(text) - 1)))
                copy = np.searchsorted(begins, places[a], side="right") - 1
                f[copy[self.of[s] == own[np.minimum(copy, len(own) - 1)]]] = True
        self.reached = min(f.mean() for f in found)

    def windows(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of ``at`` that start with a pair of an item's start."""
        if not len(at):
            return at
        return at[self.pairs.take(slot(words.take(at) * PRIME + words.take(at + 1)))]


def smallest_edits(item: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Smallest edit distance of ``item`` to any run of each row of ``around`` (rows padded with -1)."""
    n, width = around.shape
    ramp = np.arange(width + 1)
    row = np.zeros((n, width + 1), np.int64)
    for i, w in enumerate(item, 1):
        first = np.empty_like(row)
        first[:, 0] = i
        first[:, 1:] = np.minimum(row[:, :-1] + (around != w), row[:, 1:] + 1)
        row = np.minimum.accumulate(first - ramp, axis=1) + ramp
    return row.min(axis=1)


class Index:
    """Items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str | None]], max_edit: float, recall: float, seed: int = 5):
        found = [(i, WORD.findall((t or "").lower())) for i, t in items]
        found = [(i, w) for i, w in found if w]
        self.vocabulary: dict[str, int] = {}
        for _, w in found:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.items = [(i, np.array([self.vocabulary[x] for x in w], np.int32)) for i, w in found]
        self.most = [int(max_edit * len(w)) for _, w in self.items]
        self.size = len(self.vocabulary)
        rng = np.random.default_rng(seed)
        classes: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            classes.setdefault(0 if len(w) == 1 else 1 + int(math.log(len(w)) / math.log(RATIO)), []).append(k)
        arrays = [w for _, w in self.items]
        self.single: dict[int, list[int]] = {}  # items of one word have no pair: they are looked up
        for k in classes.pop(0, []):
            self.single.setdefault(int(arrays[k][0]), []).append(k)
        self.classes = [Class(members, arrays, self.most, self.size, recall, rng) for _, members in sorted(classes.items())]
        self.pairs = np.zeros(FILTER, bool)
        for c in self.classes:
            self.pairs |= c.pairs

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """``(text, item, edits, word)`` of the items found in each text; word is the place, counted
        in words, at which the item would start."""
        get = self.vocabulary.get
        parts, ends, total = [], [], 0
        gap = np.array([self.size + 1], np.int64)
        for t in texts:
            w = WORD.findall((t or "").lower())
            parts += [np.fromiter(map(get, w, repeat(0)), np.int64, len(w)), gap]
            total += len(w) + 1
            ends.append(total)
        if not total:
            return []
        words = np.concatenate(parts)
        ends_ = np.array(ends)
        near = np.flatnonzero(self.pairs.take(slot(pair_keys(words))))
        found = []  # item, place where it would start, place of the hit
        for c in self.classes:
            at = c.windows(words, near)
            for walk in c.walks if len(at) else ():
                a, s = walk.hits(words, at)
                if len(a):
                    found.append(np.stack([c.of[s], at[a] - c.shift[s], at[a]], axis=1))
        for w, members in self.single.items():
            at = np.flatnonzero(words == w)
            found += [np.stack([np.full(len(at), k), at, at], axis=1) for k in members if len(at)]
        if not found:
            return []
        out: dict[tuple[int, int], tuple[int, int]] = {}
        hits = np.unique(np.concatenate(found), axis=0)
        doc = np.searchsorted(ends_, hits[:, 2], side="right")
        for k in np.unique(hits[:, 0]):
            item, most = self.items[k][1], self.most[k]
            # a run checked from one place reaches as far as the slack: places within it are checked with it
            mine = np.flatnonzero(hits[:, 0] == k)
            kept: list[int] = []
            for i in mine[np.lexsort((hits[mine, 1], doc[mine]))].tolist():
                if not kept or doc[i] != doc[kept[-1]] or hits[i, 1] > hits[kept[-1], 1] + most:
                    kept.append(i)
            place, of = hits[kept, 1], doc[kept]
            cells = place[:, None] + np.arange(-most, len(item) + 2 * most + 1)
            low, high = np.concatenate([[0], ends_])[of], ends_[of] - 1
            around = np.where((cells >= low[:, None]) & (cells < high[:, None]), words[np.clip(cells, 0, total - 1)], -1)
            member = np.zeros(self.size + 2, bool)
            member[item] = True
            enough = (member[np.maximum(around, 0)] & (around > 0)).sum(axis=1) >= len(item) - most
            for i in range(0, int(enough.sum()), 2048):
                some = np.flatnonzero(enough)[i : i + 2048]
                for j, e in zip(some, smallest_edits(item, around[some])):
                    if e <= most:
                        key = (int(of[j]), int(k))
                        got = (int(e), int(place[j] - low[j]))
                        out[key] = min(out.get(key, got), got)
        return [(t, self.items[k][0], e, max(0, p)) for (t, k), (e, p) in sorted(out.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.2, recall: float = 0.98) -> DataFrame:
    """``(doc_id, key, item_id, edits, word)``: every item found in a document; ``key`` is a hash of the text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        index = Index(sorted(((r.item_id, r.text) for r in part.collect()), key=str), max_edit, recall)  # about BLOCK_ITEMS items
        found = _pass(rows, spark.sparkContext.broadcast(index))
        out = found if out is None else out.unionAll(found)
    return out


def _pass(rows: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in slices(batches):
            ids, texts, keys = (c.to_pylist() for c in batch.columns)
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars < CHUNK_CHARS):
                    chars += len(texts[b] or "")
                    b += 1
                got = shared.value.search(texts[a:b])
                if got:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[a + t] for t, *_ in got], pa.int64()), pa.array([keys[a + t] for t, *_ in got], pa.int64()),
                            *(pa.array([g[k] for g in got], pa.int64()) for k in (1, 2, 3)),
                        ],
                        names=["doc_id", "key", "item_id", "edits", "word"],
                    )
                a = b

    return rows.mapInArrow(run, "doc_id long, key long, item_id long, edits long, word long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    found = contaminated(docs, benchmark, **params).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_k"))
    return docs.join(found, on, "left_anti")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "edits", "word")
