"""Embedding whitening by TSQR.

Vectors become whole numbers, each distinct one counts once, and rows are centred with exact sums. Each
partition reduces its centred rows to one triangular factor by QR, block by block; factors are merged in a
tree of QR steps, so that a task holds a few d x d factors at a time and the driver the last one. The SVD of
that factor gives the right singular vectors, which whiten the rows: R = U S V', so S^2 / n are the eigenvalues
of the covariance and V its eigenvectors, without the covariance being formed.

Defined results: rows whose vector is null or has null or non-finite entries are dropped; entries beyond the
range of a long are held at its ends; vectors of another length are a list of their own, with sums and
components of their own; a component without variance (by the rank of the last factor) has no rows, so a list
of equal vectors, of one vector or of empty vectors gives none; repeated rows and ids each get their rows;
a deviation that no long can hold is null; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SCALE = 256.0
COMPONENTS = 4
BLOCK_ENTRIES = 1 << 18  # of centred rows that one QR step takes in
MERGE_BYTES = 128 << 20  # of factors that one merge holds
FAN_IN = 16
_LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """What the list of one vector length gives."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a row for each
    trace: float
    error: float = 0.0


def whole_vectors(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """``(vec_id, dim, x)``: the rows that stay, x the entries' floors after scaling."""
    e = F.col("embedding")
    kept = e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    x = F.transform(e, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long"))
    return vectors.where(kept).select("vec_id", F.size("embedding").alias("dim"), x.alias("x"))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(at).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def exact_sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length, the number of vectors and their sums, exact: halves of 32 bits are added apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for dim, part in _by_dim(batch, 0):
                x = _matrix(part.column(1), dim)
                n, high, low = found.get(dim, (0, 0, 0))
                found[dim] = [n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
        for dim, (n, high, low) in found.items():
            places = np.arange(dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(places), pa.array(np.full(dim, n, np.int64)), pa.array(high), pa.array(low)], names=["dim", "place", "n", "high", "low"])

    parts = distinct.select("dim", "x").where("dim > 0").mapInArrow(add, "dim int, place int, n long, high long, low long")
    total = parts.groupBy("dim", "place").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    out: dict[int, tuple[int, list[int]]] = {}
    for r in total.orderBy("dim", "place").collect():  # a row for each length and dimension
        out.setdefault(r.dim, (r.n, []))[1].append((int(r.high) << 32) + int(r.low))
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: whole parts are taken off exactly, then what is left of the mean."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    if _most(x) + max(map(abs, whole), default=0) >= _LONG:
        return (x.astype(object) - np.array(whole, object)).astype(np.float64) - rest
    return (x - np.array(whole, np.int64)).astype(np.float64) - rest


def _most(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max())) if x.size else 0


def triangular(rows: np.ndarray) -> np.ndarray:
    """The factor R of the rows, d x d at most."""
    return np.linalg.qr(rows, mode="r")


def tsqr(distinct: DataFrame, lists: dict[int, tuple[int, list[int]]], fan_in: int = FAN_IN) -> dict[int, np.ndarray]:
    """R of the centred rows of each length."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in _by_dim(batch, 0):
                n, sums = lists[dim]
                step = max(dim, BLOCK_ENTRIES // dim)
                for at in range(0, part.num_rows, step):
                    rows = centred(_matrix(part.column(1).slice(at, step), dim), n, sums)
                    held[dim] = triangular(np.vstack([held[dim], rows]) if dim in held else rows)
        for dim, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["dim", "r"])

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        dim, node = key
        r = None
        for flat in part.sort_values("node")["r"]:
            rows = np.asarray(flat).reshape(-1, dim)
            r = rows if r is None else triangular(np.vstack([r, rows]))
        return pd.DataFrame({"dim": [dim], "node": [node], "r": [r.ravel()]})

    factors = distinct.select("dim", "x").where("dim > 0").mapInArrow(reduce, "dim int, r array<double>")
    factors = materialize(factors.withColumn("node", F.spark_partition_id().cast("long")).select("dim", "node", "r"), "whitening-factors")
    last = factors.agg(F.max("node")).first()[0] or 0
    widest = max(lists, default=1)
    fan = max(2, min(fan_in, MERGE_BYTES // (8 * widest * widest)))
    while last > 0:
        up = F.floor(F.col("node") / F.lit(fan)).cast("long")
        factors = factors.groupBy("dim", up.alias("up")).applyInPandas(merge, "dim int, node long, r array<double>")
        last //= fan
    return {r.dim: np.array(r.r).reshape(-1, r.dim) for r in factors.collect()}  # a factor for each length


def fit(distinct: DataFrame, components: int | None = COMPONENTS) -> dict[int, Whitening]:
    """Sums, eigenvalues and eigenvectors for each vector length in ``distinct(dim, x)``, at most ``components``
    (None: all), with the largest error of the whitened rows' covariance, measured on the rows."""
    lists = exact_sums(distinct)
    models = {}
    for dim, r in tsqr(distinct, lists).items():
        n, sums = lists[dim]
        _, s, v = np.linalg.svd(r, full_matrices=False)
        rank = int((s > s[0] * max(n, dim) * np.finfo(float).eps).sum()) if len(s) and s[0] > 0 else 0
        keep = min(rank, components or rank)
        v = v[:keep]
        v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
        models[dim] = Whitening(n, sums, s[:keep] ** 2 / n, v, float((s**2).sum() / n))
    errors = identity_errors(distinct, models)
    return {dim: Whitening(m.n, m.sums, m.values, m.vectors, m.trace, errors.get(dim, 0.0)) for dim, m in models.items()}


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.vectors.T / np.sqrt(model.values)


def identity_errors(distinct: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Largest absolute entry of the whitened rows' covariance minus the identity, for each length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in _by_dim(batch, 0):
                w = whitened(_matrix(part.column(1), dim), models[dim])
                w = np.hstack([w, np.ones((len(w), 1))])  # the last row and column are sums
                found[dim] = found.get(dim, 0) + w.T @ w
        for dim, m in found.items():
            flat = m.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), dim, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["dim", "place", "value"])

    used = [dim for dim, m in models.items() if len(m.values)]
    parts = distinct.select("dim", "x").where(F.col("dim").isin(used) if used else F.lit(False)).mapInArrow(add, "dim int, place int, value double")
    found: dict[int, list[float]] = {}
    for r in parts.groupBy("dim", "place").agg(F.sum("value").alias("value")).orderBy("dim", "place").collect():  # components squared
        found.setdefault(r.dim, []).append(r.value)
    out = {}
    for dim, flat in found.items():
        m = np.array(flat).reshape(len(models[dim].values) + 1, -1) / models[dim].n
        out[dim] = float(np.abs(m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1]) - np.eye(len(m) - 1)).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    most = max(map(abs, sums), default=0) + n * _most(x)
    if len(sums) * most * most < _LONG:
        far = n * x - np.array(sums, np.int64)
        return (far * far).sum(axis=1).tolist()
    far = n * x.astype(object) - np.array(sums, object)
    return [v if v < _LONG else None for v in (far * far).sum(axis=1)]


def whiten(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each row of
    ``rows(vec_id, dim, x)`` and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch, 1):
                model = models[dim]
                k = len(model.values)
                x = _matrix(part.column(2), dim)
                many = len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(many, model.n, np.int64)),
                        pa.array(np.repeat(np.array(deviations(x, model.n, model.sums), object), k), pa.int64()), pa.array(whitened(x, model).ravel()),
                        pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(many, model.error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = dict(rows.dtypes)["vec_id"]
    used = [dim for dim, m in models.items() if len(m.values)]
    return rows.where(F.col("dim").isin(used) if used else F.lit(False)).mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def embedding_whitening(vectors: DataFrame, components: int | None = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """Whitened rows of ``vectors(vec_id, embedding)``, fitted on its distinct vectors."""
    rows = whole_vectors(vectors, scale)
    distinct = materialize(rows.groupBy("x").agg(F.first("dim").alias("dim")).select("dim", "x"), "whitening-distinct")
    return whiten(rows, fit(distinct, components))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
