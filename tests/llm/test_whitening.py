import math
from fractions import Fraction

import numpy as np
import pytest

from strata.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(rows, k=4):
    """Brute force: exact sums, covariance in fractions turned to doubles, eigenvectors by numpy."""
    kept = [(i, e) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    x = [(i, [math.floor(256.0 * float(c)) for c in e]) for i, e in kept]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(v[d] for v in fit) for d in range(len(fit[0]))]
    c = np.array([[float(v[d] - Fraction(sums[d], n)) for d in range(len(sums))] for v in fit])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, v in x:
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        w = np.array([float(a - Fraction(s, n)) for a, s in zip(v, sums)]) @ u[:, :k] / np.sqrt(e[:k])
        out.setdefault(i, []).append((n, dev, w, e[:k] / e.sum()))
    return out


def compare(got, want, k=4):
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for (i, c), found in rows.items():
        assert len(found) == len(want[i])
        n, dev, w, share = want[i][0]
        r = found[0]
        assert (r.n, r.deviation) == (n, dev)
        assert r.explained == pytest.approx(share[c - 1], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(w[c - 1]), abs=1e-8)
        if abs(w[c - 1]) > 1e-6:
            signs.setdefault(c, set()).add(math.copysign(1, r.whitened) == math.copysign(1, w[c - 1]))
        assert r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values()) and {i for i, _ in rows} == set(want) and {c for _, c in rows} == set(range(1, k + 1))


def test_equals_brute_force_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] + [9, 0, -4, 0, 1, 0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(1000 + i, [float(c) for c in base[5]]) for i in range(200)] + [(7, [float(c) for c in base[7]])]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] + [0.0] * 5), (2003, [float("-inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, whitened string").repartition(7)
    compare(whitening.embedding_whitening(df).collect(), plain(rows))


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(whitening.op11_embedding_whitening(spark, SF).collect(), plain(rows))


def test_factors_of_many_partitions_merge_in_a_tree(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, (400, 5))
    df = spark.createDataFrame([(5, v.tolist()) for v in x], "dim int, x array<long>").repartition(23)
    lists = whitening.exact_sums(df)
    assert lists == {5: (400, x.sum(axis=0).tolist())}
    r = whitening.tsqr(df, lists, fan_in=2)[5]
    c = x - x.mean(axis=0)
    assert r.shape == (5, 5) and np.allclose(r.T @ r, c.T @ c)


def test_rank_lengths_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    flat = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [5.0, 10.0, 15.0]), (4, [1.0]), (5, [3.0]), (6, []), (None, [2.0, 4.0, 6.0])], schema)
    got = whitening.embedding_whitening(flat).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 1, 2), (5, 1, 2)]
    assert all(r.explained == pytest.approx(1) for r in got)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.embedding_whitening(spark.createDataFrame(rows, schema)).collect() == []


def test_extreme_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, -0.0])]
    got = whitening.embedding_whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and all(r.deviation is None for r in got if r.vec_id < 3)
    assert all(math.isfinite(r.whitened) for r in got)
    big = (1 << 62, [1 << 61, 5])
    assert whitening.deviations(np.array([[1 << 61, 5]]), 3, [3 << 61, 14]) == [1]
    assert whitening.deviations(np.array([[1 << 61, 5]]), 1, [0, 5]) == [None] and big
