"""Shared pieces of the training-data operators: table access, shared-folder tables, connected
components by star contraction, and bounded work units for buckets of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.shared import drop_table, materialize, scratch, shared_dir

__all__ = ["bounded_units", "connected_components", "drop_table", "forest_edges", "materialize", "per_unit", "release_caches", "scratch", "shared_dir", "slices", "table", "worker_cache"]

#: Rows that one block of a hot bucket holds; a work unit holds two blocks at most.
BLOCK_ROWS = 1024

#: Rows of whole texts that a worker turns into Python strings at once. Spark itself bounds a batch by
#: its bytes (``spark.sql.execution.arrow.maxBytesPerBatch``).
TEXT_ROWS = 1000

_caches: dict[tuple, object] = {}


def worker_cache(key: tuple, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from one task of a stage to the next."""
    if key not in _caches:
        _caches[key] = make()
    return _caches[key]


def release_caches() -> None:
    """Called where a worker turns to other work: what an earlier stage cached there goes."""
    _caches.clear()


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches of a task in pieces of so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forest_edges(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of a symmetric boolean matrix: every row reachable from a lower one is tied
    to the lowest row of its component. At most n - 1 edges, whatever the number of ones."""
    n = len(adjacent)
    adjacent = adjacent.copy()
    np.fill_diagonal(adjacent, False)
    open_ = adjacent.any(axis=1)
    left, right = [], []
    while open_.any():
        root = int(np.argmax(open_))
        open_[root] = False
        frontier = np.array([root])
        while len(frontier):
            frontier = np.flatnonzero(adjacent[frontier].any(axis=0) & open_)
            open_[frontier] = False
            left.append(frontier)
            right.append(np.full(len(frontier), root))
    if not left:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(left), np.concatenate(right)


def bounded_units(rows: DataFrame, keys: list[str], node: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``blk, bi, bj``: buckets (equal ``keys``) above ``block_rows`` rows are split by a hash of
    ``node`` into blocks, and every pair of blocks becomes a unit of its own, so that each pair of
    rows of a bucket meets in a unit and no unit holds more than about two blocks. Buckets of one
    row are left out."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    found = rows.join(sizes, keys)
    blocks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")
    split = found.withColumn("_nb", blocks).withColumn(
        "blk", F.when(F.col("_nb") > 1, F.pmod(F.xxhash64(node), F.col("_nb")).cast("int")).otherwise(F.lit(0))
    )
    return (
        split.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .withColumn("bi", F.least("blk", "_o"))
        .withColumn("bj", F.greatest("blk", "_o"))
        .drop("_n", "_nb", "_o")
    )


def per_unit(
    units: DataFrame,
    keys: list[str],
    order: list[str],
    work: Callable[[dict[str, np.ndarray | pa.Array]], dict[str, np.ndarray] | None],
    schema: str,
    arrays: tuple[str, ...] = (),
) -> DataFrame:
    """Runs ``work`` once for each unit (equal ``keys``), on the unit's columns as numpy arrays
    (``arrays`` stay Arrow lists). A task streams its sorted partition and holds one unit at a time."""
    names = units.columns

    def flush(parts: list[pa.Table]):
        whole = pa.concat_tables(parts).combine_chunks()
        got = work(
            {
                c: whole.column(c).combine_chunks() if c in arrays else whole.column(c).to_numpy(zero_copy_only=False)
                for c in names
            }
        )
        return None if got is None else pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in got.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            whole = pa.Table.from_batches([batch])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key = tuple(c[a] for c in columns)
                if held and key != last:
                    out = flush(held)
                    held = []
                    if out is not None:
                        yield out
                last = key
                held.append(whole.slice(a, b - a))
        if held:
            out = flush(held)
            if out is not None:
                yield out

    return units.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
