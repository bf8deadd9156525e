import numpy as np

from strata.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def brute(rows, threshold=0.98):
    ok = {i: np.array(e, np.float64) for i, e, lab, _ in rows if lab is not None and e and None not in e and np.isfinite(np.array(e, float)).all() and any(e)}
    lab = {i: x for i, _, x, _ in rows}
    links = {i: set() for i in lab}
    for a in ok:
        for b in ok:
            if a != b and lab[a] == lab[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                links[a].add(b)
    comp = {i: i for i in lab}
    while True:
        new = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in comp}
        if new == comp:
            return {i: (len(links[i]), comp[i]) for i in comp}
        comp = new


def test_links_and_components_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            base = rng.normal(size=32)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((i, (base + rng.normal(size=32) * 0.12).astype(np.float32).tolist(), label, "x"))
                i += 1
    rows += [(i, rows[0][1], 0, "copy"), (i + 1, rows[0][1], 1, "other label"), (i + 2, [2 * v for v in rows[0][1]], 0, "scaled")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(spark.createDataFrame(rows, SCHEMA), window=16).collect()}
    assert got == brute(rows)


def test_vectors_that_link_with_nothing(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 1, None), (2, v, 1, None), (3, None, 1, None), (4, [0.0, 0.0], 1, None), (5, [1.0, None], 1, None), (6, [1.0, float("nan")], 1, None), (7, v, None, None), (8, [], 1, None), (9, [1.0, 2.0, 0.0], 1, None), (10, [float("inf"), 1.0], 1, None)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (1, 1)} | {i: (0, i) for i in range(3, 11)}
    assert embeddings.embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_group_larger_than_a_window_is_counted_whole(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.01).astype(np.float32).tolist(), 3, None) for i in range(120)]
    got = embeddings.embedding_links(spark.createDataFrame(rows, SCHEMA), window=8).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}


def test_repeated_rows_are_one_vector(spark):
    rows = [(1, [1.0, 0.0], 0, None), (1, [1.0, 0.0], 0, None), (2, [1.0, 0.0], 0, None)]
    got = sorted((r.vec_id, r.n_links) for r in embeddings.embedding_links(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1), (1, 1), (2, 1)]


def test_passes_grow_with_the_table():
    few, many = (embeddings.passes_for(n, 0.98, 256, 1e-4) for n in (10_000, 1_000_000_000))
    assert 4 <= few < many < 200


def test_text_labels_and_double_vectors(spark):
    # in single precision both pairs would be one vector
    rows = [(1, "a", [1.0, 1e-9]), (2, "a", [1.0, 2e-9]), (3, "b", [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, "b", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5)}


def cone(n, pairs, seed, dim=64):
    """A third of ``n`` vectors at cosine 0.95 to each other, with pairs at about 0.981 among them; the rest at random."""
    rng = np.random.default_rng(seed)
    m = n // 3
    axis = np.zeros(dim)
    axis[0] = 1.0
    side = rng.normal(size=(m, dim)) * (np.arange(dim) > 0)
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = rng.normal(size=(pairs, dim)) * (np.arange(dim) > 0)
    near -= (near * side[:pairs]).sum(axis=1, keepdims=True) * side[:pairs]
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    side[m - pairs :] = 0.62 * side[:pairs] + np.sqrt(1 - 0.62**2) * near
    x = np.concatenate([np.sqrt(0.95) * axis + np.sqrt(0.05) * side, rng.normal(size=(n - m, dim))])
    return x.astype(np.float32), m


def exact_links(x, threshold=0.98):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return {(i, int(j)) for i in range(len(u)) for j in np.flatnonzero(u @ u[i] >= threshold) if j != i}


def found_links(spark, x, **params):
    df = spark.createDataFrame([(i, v.tolist(), 0, None) for i, v in enumerate(x)], SCHEMA).repartition(8)
    return {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_links(df, **params).collect()}


def test_pairs_in_a_crowd_are_found(spark):
    x, m = cone(6000, 150, 7)
    links = exact_links(x)
    assert len(links) >= 290 and max(max(p) for p in links) < m
    got = found_links(spark, x, window=32)
    degree = {i: sum(a == i for a, _ in links) for i in range(m)}
    assert all(got[i][0] == degree[i] for i in range(m))


def test_crowds_too_large_to_compare_go_through_more_passes(spark, monkeypatch):
    x, m = cone(3000, 100, 8)
    links = exact_links(x)
    distinct = spark.createDataFrame([(0, 64, i, v.tolist()) for i, v in enumerate(x)], "label long, dim int, rep long, e array<float>")
    signs, passes = embeddings.signs_for(3000, 8), embeddings.passes_for(3000, 0.98, 8, 1e-4)
    edges, depths = embeddings.window_links(embeddings.projection_keys(distinct, passes), 0.98, 8, 3000 * passes, signs)
    before = {tuple(sorted(r)) for r in edges.collect()}
    want = {p for p in links if p[0] < p[1]}
    assert len(before & want) < len(want)
    monkeypatch.setattr(embeddings, "WHOLE", 0)
    more = embeddings.crowded_links(distinct, depths, passes, signs, 0.98, 8, 1e-4)
    assert want <= before | {tuple(sorted(r)) for r in more.collect()}
