"""SimHash near-duplicates found with covering locality-sensitive hashing.

A 64-bit fingerprint is the bitwise majority of the XXH64 values of a document's word shingles.
Covering hashing (Pagh, "Locality-sensitive Hashing without False Negatives", 2016): give every bit
position i a vector b(i) from {0,1}^(r+1) without zero, and let table v keep the bits with
<v, b(i)> = 1. For each set of r positions some v is orthogonal to all of their vectors, so two
fingerprints that differ in at most r bits agree in at least one of the 2^(r+1) - 1 tables: no pair
within the radius is missed.

Defined results: null, empty and blank texts have fingerprint zero and link with each other like
any other; fewer words than a shingle make one shingle of all words; repeated rows and repeated ids
each keep a row; an empty table gives an empty result; further columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_units, connected_components, forest_edges, materialize, per_unit, release_caches, slices, table

BITS = 64
#: Shingles whose bits are unpacked at once: bounds memory on very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not got:
        return 0
    if len(got) <= words:
        shingles = iter([b" ".join(got)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(got[i:] for i in range(words))))
        n = len(got) - words + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint's bits as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in slices(batches):
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def covering_masks(radius: int = 3, bits: int = BITS) -> list[int]:
    """The 2^(r+1) - 1 masks. If there are at least as many positions as nonzero vectors, b(i) runs
    through those in turn; else it draws different ones, and of some seeded draws that one stays whose
    smallest mask is largest, so that every table keeps about half of the bits."""
    top = 1 << (radius + 1)

    def masks(vectors: list[int]) -> list[int]:
        return [sum(1 << i for i, b in enumerate(vectors) if (v & b).bit_count() & 1) for v in range(1, top)]

    if bits >= top - 1:
        return masks([1 + i % (top - 1) for i in range(bits)])
    draws = [masks((np.random.default_rng(seed).permutation(top - 1)[:bits] + 1).tolist()) for seed in range(24)]
    return max(draws, key=lambda d: min(m.bit_count() for m in d))


def _tables(prints: int, radius: int) -> list[tuple[int, int, int]]:
    """``(table, fingerprint, mask)`` of all tables; masks as signed longs."""
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in covering_masks(radius)]
    return [(p * len(masks) + i, p, m) for p in range(prints) for i, m in enumerate(masks)]


def hamming_links(fps: DataFrame, radius: int = 3, differ: int | None = None, prints: int = 1, tables_at_once: int = 60) -> DataFrame:
    """``edges(a, b)`` over distinct rows ``fps(rep, fps array)`` that join everything within the radius
    in one of its ``prints`` fingerprints: each bucket gives spanning edges of its own verified links,
    not all of its pairs. With ``differ``, a link must also have sketches (array column ``sketch``) that
    differ in at most so many bits. Large families of tables are worked off in slices, which bounds the
    rows shuffled at once."""
    words = 2 if differ is not None else 0

    def link(unit: dict) -> dict | None:
        fp = unit["fp"].astype(np.int64).view(np.uint64)
        parts = [unit[f"s{k}"].astype(np.int64).view(np.uint64) for k in range(words)]
        near = np.empty((len(fp), len(fp)), bool)
        for i in range(0, len(fp), 128):  # a strip of pairs at once
            near[i : i + 128] = np.bitwise_count(fp[i : i + 128, None] ^ fp) <= radius
            if words:
                near[i : i + 128] &= sum(np.bitwise_count(p[i : i + 128, None] ^ p) for p in parts) <= differ
        left, right = forest_edges(near)
        if not len(left):
            return None
        return {"a": unit["rep"][left].astype(np.int64), "b": unit["rep"][right].astype(np.int64)}

    tables = _tables(prints, radius)
    out = None
    for first in range(0, len(tables), tables_at_once):
        part = F.array(*[
            F.struct(F.lit(t).cast("short").alias("t"), F.col("fps")[p].alias("fp"), F.col("fps")[p].bitwiseAND(F.lit(m)).alias("key")) for t, p, m in tables[first : first + tables_at_once]
        ])
        keyed = fps.select("rep", *[F.col("sketch")[k].alias(f"s{k}") for k in range(words)], F.explode(part).alias("x")).select(
            "rep", *[f"s{k}" for k in range(words)], "x.t", "x.fp", "x.key"
        )
        found = per_unit(bounded_units(keyed, ["t", "key"], "rep"), ["t", "key", "bi", "bj"], ["rep"], link, "a long, b long")
        if len(tables) > tables_at_once:
            found = materialize(found.distinct(), "simhash-slice")
        out = found if out is None else out.unionAll(found)
    return out


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row. Equal fingerprints collapse to their smallest id
    before any bucket is built, so exact copies cost one row, however many there are."""
    marked = materialize(fingerprints(docs, id_col, text_col, words), "simhash")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    links = hamming_links(fps.where("rep is not null").select("rep", F.array("fp").alias("fps")), radius)
    parts = connected_components(links, "simhash-links")
    placed = fps.join(parts, fps.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(placed, "fp").select("doc_id", "fp", "component_id")


#: Pipeline stage: ``PRINTS`` fingerprints of ``SYMBOLS`` minwise values each, covered to radius 2.
PRINTS = 4
SYMBOLS = 7
SKETCH_BITS = 128
PERMUTATIONS = np.random.default_rng(17).integers(1, 1 << 63, SKETCH_BITS, dtype=np.uint64) | np.uint64(1)
#: Rows of a block where whole shingle sets are compared: a unit holds two blocks at most.
SET_ROWS = 512


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; none for a blank text."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    shingles = [b" ".join(got)] if len(got) <= words else map(b" ".join, zip(*(got[i:] for i in range(words))))
    return np.unique(np.fromiter((digest(s, seed) for s in shingles), np.uint64))


@cache
def _kept_symbols(radius: int) -> list[np.ndarray]:
    """Places of the minwise values that each table keeps."""
    masks = covering_masks(radius, SYMBOLS)
    return [np.array([p * SYMBOLS + i for i in range(SYMBOLS) if m >> i & 1]) for p in range(PRINTS) for m in masks]


def set_marks(hashes: np.ndarray, radius: int = 2) -> tuple[int, np.ndarray, np.ndarray]:
    """Of a shingle set: a hash that equal sets share, the keys of all covering tables, and a one-bit
    minwise sketch. Minwise values of two sets are equal with probability J, sketch bits with
    (1 + J) / 2, wherever in the texts the differences lie."""
    low = np.full(SKETCH_BITS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK // 64):
        low = np.minimum(low, (hashes[i : i + CHUNK // 64, None] * PERMUTATIONS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[kept].tobytes(), t) for t, kept in enumerate(_kept_symbols(radius))]
    return xxhash.xxh64_intdigest(hashes.tobytes()), np.array(keys, np.uint64), np.packbits((low & np.uint64(1)).astype(np.uint8)).view(np.uint64)


def _differ(similarity: float) -> int:
    """Sketch bits in which a pair of the similarity differs, four deviations above the expected."""
    share = (1 - similarity) / 2
    return int(SKETCH_BITS * share + 4 * (SKETCH_BITS * share * (1 - share)) ** 0.5)


def _sketches_near(unit: dict, differ: int) -> np.ndarray:
    parts = [unit[f"s{k}"].astype(np.int64).view(np.uint64) for k in range(SKETCH_BITS // 64)]
    near = np.empty((len(parts[0]), len(parts[0])), bool)
    for i in range(0, len(near), 128):  # a strip of pairs at once
        near[i : i + 128] = sum(np.bitwise_count(p[i : i + 128, None] ^ p) for p in parts) <= differ
    return near


def set_links(near: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Spanning edges of the pairs of ``near`` whose sets have the Jaccard similarity, counted exactly.
    A row is compared only with rows that no link has reached yet."""
    open_ = np.ones(len(sets), bool)
    left: list[int] = []
    right: list[int] = []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        frontier = [root]
        while frontier:
            i = frontier.pop()
            own = sets[i]
            for j in np.flatnonzero(near[i] & open_).tolist():
                other = sets[j]
                small, large = (own, other) if len(own) <= len(other) else (other, own)
                if len(small) < similarity * len(large):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum()) if len(large) else 0
                if common >= similarity * (len(small) + len(large) - common):
                    open_[j] = False
                    frontier.append(j)
                    left.append(i)
                    right.append(j)
    return left, right


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """Keeps one document of each group of copies, that with the smallest id. Columns are those of
    ``docs``.

    A copy with a passage added, cut or replaced changes more bits of a majority fingerprint than
    covering tables reach. So a fingerprint here is ``SYMBOLS`` minwise values of the set of word
    shingles, and covering tables join all that differ in ``radius`` of them or fewer: at similarity 0.8
    that holds for 87 % of pairs in a print (some lie beyond the radius) and for 99.97 % in one of
    ``PRINTS``, for edits of any form. Links that also hold in a 128-bit sketch, with four deviations of
    slack, give candidate groups; in these every link is then counted exactly on the sets of shingle
    hashes. Rows alike in id and text are one document."""
    differ = _differ(similarity)
    wide = SKETCH_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        for batch in slices(batches):
            found = [set_marks(shingle_set(t, words), radius) for t in batch.column(1).to_pylist()]
            if not found:
                continue
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([f[k] for f in found]).view(np.int64)), len(found[0][k])).cast(pa.list_(pa.int64()))
                for k in (1, 2)
            ]
            sig = pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sig, *columns], names=["doc_id", "key", "sig", "keys", "sketch"])

    def candidates(unit: dict) -> dict | None:
        left, right = forest_edges(_sketches_near(unit, differ))
        return {"a": unit["sig"][left].astype(np.int64), "b": unit["sig"][right].astype(np.int64)} if len(left) else None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        seen: set[int] = set()  # repeated rows
        for batch in slices(batches):
            for i, sig in enumerate(batch.column(1).to_pylist()):
                if sig not in seen:
                    seen.add(sig)
                    own = pa.array([shingle_set(batch.column(4)[i].as_py(), words).view(np.int64)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(4)), own], names=["component", "sig", "s0", "s1", "hashes"])

    def exact(unit: dict) -> dict | None:
        whole = unit["hashes"]
        flat = whole.flatten().to_numpy().view(np.uint64)
        offsets = whole.offsets.to_numpy() - whole.offsets[0].as_py()
        left, right = set_links(_sketches_near(unit, differ), [flat[a:b] for a, b in zip(offsets, offsets[1:])], similarity)
        sig = unit["sig"].astype(np.int64)
        return {"a": sig[left], "b": sig[right]} if left else None

    spark = docs.sparkSession
    key = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    marked = materialize(rows.mapInArrow(run, "doc_id long, key long, sig long, keys array<long>, sketch array<long>"), "near-marks")
    distinct = materialize(marked.groupBy("sig", "keys", "sketch").agg(F.min(F.struct("doc_id", "key")).alias("one")), "near-distinct")
    short = [F.col("sketch")[k].alias(f"s{k}") for k in range(wide)]
    keyed = distinct.select("sig", *short, F.explode("keys").alias("t"))
    groups = materialize(connected_components(per_unit(bounded_units(keyed, ["t"], "sig"), ["t", "bi", "bj"], ["sig"], candidates, "a long, b long"), "near-candidates"), "near-groups")
    members = distinct.join(groups, distinct.sig == groups.node).select("component", "sig", *short, F.col("one.doc_id").alias("_d"), F.col("one.key").alias("_k"))
    whole = rows.join(members, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("component", "sig", "s0", "s1", "text")
    whole = materialize(whole.mapInArrow(sets, "component long, sig long, s0 long, s1 long, hashes array<long>"), "near-sets")
    links = per_unit(bounded_units(whole, ["component"], "sig", SET_ROWS), ["component", "bi", "bj"], ["sig"], exact, "a long, b long", ("hashes",))
    parts = connected_components(links, "near-links")
    # a null id comes after all others
    best = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    one = marked.select("doc_id", "key", "sig").join(parts, F.col("sig") == F.col("node"), "left").select("doc_id", "key", F.coalesce("component", "sig").alias("component"))
    one = materialize(one, "near-parts")
    kept = one.groupBy("component").agg(F.min(best).alias("best"))
    gone = (
        one.join(kept, "component").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))))
        .select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    )
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (key == F.col("_k")), "left_anti")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
