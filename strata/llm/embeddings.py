"""Embedding near-duplicates found by sorted projection passes.

Each pass gives every vector a key of concatenated random-hyperplane signs, sorts the vectors of a
label lexicographically by it, and compares each with its neighbours in a bounded window. Windows
find links; the links of all passes are united into components. A group may be larger than a window,
so each component is then compared exactly, block against block, which makes ``n_links`` whole.

Two vectors at angle a agree in k signs with probability (1 - a/pi)^k, and share a window once the
vectors that agree in the first k signs fit into it: k = log2(n / window) if signs are spread evenly. The
number of passes follows from that, from the threshold and from ``miss``.

Where vectors crowd (a cone of a label), more signs are needed. The passes measure it: a row agrees with the row
a window farther on in so many signs that its window lies inside a longer run. Vectors whose measured signs
leave more than ten times ``miss`` get what they lack: all crowded vectors of a label are compared block against
block if that is less work than the passes they lack, else they go through so many more passes. So the work
grows with the square of a crowd only as long as that is the cheaper way.

Defined results: an id with two vectors stands for both, as one node of the links; null labels, null, empty or zero vectors and vectors with null or non-finite
components link with nothing; vectors of different lengths are not compared; rows that repeat an id
with the same label and vector count as one vector and all get its row; labels that aren't whole
numbers are told apart by a 64-bit hash of their text; an empty table gives an
empty result; further columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_units, connected_components, forest_edges, materialize, per_unit, table

WINDOW = 256
#: Rows of a sorted partition: enough windows that a seam reaches from one partition into the next only.
LEAST_ROWS, MOST_ROWS = 8 * WINDOW, 500_000
#: A crowd is compared whole up to so many vectors for each window of a pass that it lacks.
WHOLE = 4
SIGN_BITS = 63  # a key fits into a non-negative long
SEED = 20240229


def usable(embedding: str = "embedding") -> F.Column:
    """True for a vector that can link: present, finite in every component, not zero."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return e.isNotNull() & finite & F.exists(e, lambda x: x != 0)


def passes_for(rows: int, threshold: float, window: int, miss: float) -> int:
    hit = (1 - math.acos(threshold) / math.pi) ** signs_for(rows, window)
    return max(4, math.ceil(math.log(miss) / math.log(1 - hit)))


def signs_for(rows: int, window: int) -> float:
    return max(1.0, math.log2(max(2, rows) / window) + 1)


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Arrow list column of equal lengths as a matrix of unit rows in double precision."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of extreme values stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def projection_keys(vectors: DataFrame, passes: int, first: int = 0) -> DataFrame:
    """``(p, label, dim, key, rep, e)``: one row for each vector and pass, from pass ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.left_shift(np.int64(1), np.arange(SIGN_BITS - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = unit_rows(part.column(3))
                for p in range(first, first + passes):
                    if (dim, p) not in planes:
                        planes[dim, p] = np.random.default_rng([SEED, int(dim), p]).standard_normal((int(dim), SIGN_BITS))
                    key = ((x @ planes[dim, p]) > 0) @ weights
                    n = len(key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p, np.int32)), part.column(0), part.column(1), pa.array(key.astype(np.int64)), part.column(2), part.column(3)],
                        names=["p", "label", "dim", "key", "rep", "e"],
                    )

    return vectors.select("label", "dim", "rep", "e").mapInArrow(run, f"p int, label long, dim int, key long, rep long, e {dict(vectors.dtypes)['e']}")


def window_links(keyed: DataFrame, threshold: float, window: int, total: int, signs: float = SIGN_BITS) -> tuple[DataFrame, DataFrame]:
    """``edges(a, b)``: spanning edges of the links found inside the windows of each sorted
    partition, and of those across neighbouring partitions' ends. ``total``: rows of ``keyed``.
    And ``(rep, depth)`` for each row of a pass whose window lies in a run of more than ``signs`` equal signs."""

    def crowded(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        near, far = part.slice(0, max(0, part.num_rows - window)), part.slice(window)
        same = np.ones(near.num_rows, bool)
        for c in ("p", "label", "dim"):
            same &= near.column(c).to_numpy() == far.column(c).to_numpy()
        apart = near.column("key").to_numpy() ^ far.column("key").to_numpy()
        depth = SIGN_BITS - np.frexp(apart.astype(np.float64))[1] + 1  # signs needed: one more than are shared
        deep = same & (depth > signs)
        return near.column("rep").to_numpy()[deep], np.minimum(depth[deep], SIGN_BITS).astype(np.int32)

    def compare(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        group = np.stack([part.column(c).to_numpy() for c in ("p", "label", "dim")])
        rep = part.column("rep").to_numpy()
        left, right = [], []
        cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), len(rep)]
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            x = unit_rows(part.column("e").slice(a, b - a).combine_chunks())
            near = np.abs(np.subtract.outer(np.arange(b - a), np.arange(b - a))) <= window
            i, j = forest_edges((x @ x.T >= threshold) & near)
            left.append(rep[a + i])
            right.append(rep[a + j])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))

    columns = ["p", "label", "dim", "key", "rep", "e"]
    schema = "a long, b long, depth int, seam int, side int, " + ", ".join(f"{c} {t}" for c, t in zip(columns, ("int", "long", "int", "long", "long", dict(keyed.dtypes)["e"])))
    step = 2 * window

    def edges(a: np.ndarray, b: np.ndarray | None, depth: np.ndarray | None, like: pa.Schema) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(a.astype(np.int64)), pa.nulls(n, pa.int64()) if b is None else pa.array(b.astype(np.int64)), pa.nulls(n, pa.int32()) if depth is None else pa.array(depth),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), *(pa.nulls(n, like.field(c).type) for c in columns),
            ],
            names=["a", "b", "depth", "seam", "side", *columns],
        )

    def ends(rows: pa.Table, seam: int, side: int) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        if n:
            rows = rows.combine_chunks()
            whole = pa.Table.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(np.full(n, seam, np.int32)), pa.array(np.full(n, side, np.int32)), *(rows.column(c) for c in columns)],
                names=["a", "b", "depth", "seam", "side", *columns],
            )
            yield from whole.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        seam = None
        held: list[pa.RecordBatch] = []
        count = 0

        def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal tail
            for at in range(0, rows.num_rows, step):
                part = rows.slice(at, step)
                whole = part if tail is None else pa.concat_tables([tail, part])
                a, b = compare(whole)
                if len(a):
                    yield edges(a, b, None, whole.schema)
                reps, depth = crowded(whole)
                if len(reps):
                    yield edges(reps, None, depth, whole.schema)
                tail = whole.slice(max(0, whole.num_rows - window))

        for batch in batches:
            if not batch.num_rows:
                continue
            if seam is None:
                seam = int(batch.column("seam")[0].as_py())
                yield from ends(pa.Table.from_batches([batch]).slice(0, window), seam, 1)
            held.append(batch)
            count += batch.num_rows
            if count >= step:
                yield from block(pa.Table.from_batches(held))
                held, count = [], 0
        if held:
            yield from block(pa.Table.from_batches(held))
        if tail is not None:
            yield from ends(tail, seam + 1, 0)

    usual = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(1, total // LEAST_ROWS), max(usual, total // MOST_ROWS))
    sorted_ = (
        keyed.repartitionByRange(parts, "p", "label", "dim", "key", "rep")
        .sortWithinPartitions("p", "label", "dim", "key", "rep")
        .withColumn("seam", F.spark_partition_id())
    )
    found = materialize(sorted_.mapInArrow(run, schema), "embedding-windows")

    def across(unit: dict) -> dict | None:
        part = pa.table({c: unit[c] for c in columns})
        a, b = compare(part)
        return {"a": a, "b": b} if len(a) else None

    seams = found.where("seam is not null").select("seam", *columns, "side")
    met = per_unit(seams, ["seam"], ["side", "p", "label", "dim", "key", "rep"], across, "a long, b long", arrays=("e",))
    return found.where("b is not null").select("a", "b").unionAll(met), found.where("depth is not null").select(F.col("a").alias("rep"), "depth")


def crowded_links(vectors: DataFrame, depths: DataFrame, passes: int, signs: float, threshold: float, window: int, miss: float) -> DataFrame | None:
    """``edges(a, b)`` that the passes so far may have left out where vectors crowd; None if they don't."""
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi

    def log_miss(k: F.Column) -> F.Column:
        return F.log1p(-F.pow(F.lit(agree), k))

    usual = math.log1p(-(agree**signs))
    logs = depths.groupBy("rep").agg((F.sum(log_miss(F.col("depth"))) + (F.lit(passes) - F.count("*")) * usual).alias("log"))
    lacking = logs.where(F.col("log") > math.log(miss * 10)).select("rep", (passes * (math.log(miss) / F.col("log") - 1)).alias("more"))
    crowd = materialize(vectors.join(lacking, "rep").select("label", "dim", "rep", "e", "more"), "embedding-crowd")
    sizes = crowd.groupBy("label", "dim").agg(F.count("*").alias("m"), F.ceil(F.max("more")).alias("most"))
    # comparing all takes m / 2 products for a vector, a pass two windows of them
    plan = materialize(sizes.withColumn("whole", F.col("m") <= WHOLE * window * F.col("most")), "embedding-crowds")
    whole = crowd.join(plan.where("whole").select("label", "dim"), ["label", "dim"], "left_semi").select("label", "dim", "rep", "e")
    rest = plan.where(~F.col("whole")).agg(F.sum("m").alias("m"), F.max("most").alias("most")).first()
    if plan.isEmpty():
        return None

    def compare(unit: dict) -> dict | None:
        x = unit_rows(unit["e"])
        i, j = forest_edges(x @ x.T >= threshold)
        return {"a": unit["rep"][i], "b": unit["rep"][j]} if len(i) else None

    edges = per_unit(bounded_units(whole, ["label", "dim"], "rep"), ["label", "dim", "bi", "bj"], ["rep"], compare, "a long, b long", arrays=("e",))
    if rest.m:
        many = crowd.join(plan.where(~F.col("whole")).select("label", "dim"), ["label", "dim"], "left_semi")
        edges = edges.unionAll(window_links(projection_keys(many, int(rest.most), passes), threshold, window, rest.m * int(rest.most))[0])
    return materialize(edges, "embedding-crowd-links")


def component_links(parts: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """``(rep, links)``: for each vector of a component, the other vectors of it at the threshold or
    above, counted with their copies. Compared block against block; only counts leave a task."""
    members = parts.join(vectors, parts.node == vectors.rep).select("component", "rep", "copies", "e")
    units = bounded_units(members, ["component"], "rep")

    def count(unit: dict) -> dict | None:
        x = unit_rows(unit["e"])
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if unit["bi"][0] != unit["bj"][0]:
            near &= unit["blk"][:, None] != unit["blk"][None, :]
        return {"rep": unit["rep"], "links": (near @ unit["copies"].astype(np.float64)).astype(np.int64)}

    counted = per_unit(units, ["component", "bi", "bj"], ["rep"], count, "rep long, links long", arrays=("e",))
    return counted.groupBy("rep").agg(F.sum("links").alias("links"))


def embedding_links(vectors: DataFrame, threshold: float = 0.98, window: int = WINDOW, miss: float = 1e-4) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for every row of ``vectors(vec_id, embedding, label)``."""
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    single = isinstance(kinds["embedding"].elementType, T.FloatType)  # others are held in double precision
    label = F.col("label").cast("long") if isinstance(kinds["label"], T.IntegralType) else F.xxhash64(F.col("label").cast("string"))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
        F.when(F.col("label").isNotNull(), label).alias("label"),
    )
    good = rows.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    distinct = materialize(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"))
        .select("label", F.size("embedding").alias("dim"), "rep", "copies", F.col("embedding").alias("e")),
        "embedding-distinct",
    )
    rows_ = distinct.count()
    passes = passes_for(rows_, threshold, window, miss)
    signs = signs_for(rows_, window)
    edges, depths = window_links(projection_keys(distinct, passes), threshold, window, rows_ * passes, signs)
    more = crowded_links(distinct, depths, passes, signs, threshold, window, miss)
    edges = edges if more is None else edges.unionAll(more)
    parts = connected_components(edges, "embedding-links")
    links = component_links(parts, distinct, threshold)
    placed = materialize(
        distinct.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .join(links, "rep", "left")
        .select(
            F.col("label").alias("_l"), F.col("e").alias("_e"), F.coalesce("component", "rep").alias("_c"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_n"),
        ),
        "embedding-placed",
    )
    ok = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    whole = rows.where(ok).join(placed, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    alone = rows.where(~F.coalesce(ok, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id")
    ).unionAll(alone)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The same rows by comparing all pairs; for small tables.
OP7_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  r(node, reach) AS (SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
  c AS (SELECT node, min(reach) AS component FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
  SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component, vec_id) AS component_id, coalesce(c.component, vec_id) = vec_id AS kept
  FROM embeddings LEFT JOIN c ON vec_id = c.node LEFT JOIN n ON vec_id = n.a"""
