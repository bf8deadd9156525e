import itertools
import math
import random
from collections import Counter, namedtuple
from fractions import Fraction

import pytest

from strata.llm import mixing


def windows_hold(plan, weights):
    """Whether each block of a phase lies in its window and each source within one block of its share."""
    total = sum(weights.values())
    n = dict.fromkeys(weights, 0)
    for t, s in enumerate(plan):
        k, share = n[s], Fraction(weights[s], total)
        assert math.floor(k / share) <= t < math.ceil((k + 1) / share)
        n[s] += 1
        for x, w in weights.items():
            assert abs(n[x] - Fraction(w, total) * (t + 1)) < 1


@pytest.mark.parametrize("weights", [{0: 1}, {0: 3, 1: 2, 2: 5}, {0: 1, 1: 1, 2: 998}, {i: i + 1 for i in range(40)}, {0: 333_333_333, 1: 271_828_183, 2: 7}])
def test_every_block_meets_its_window(weights):
    plan = list(itertools.islice(mixing.earliest_deadlines(weights, dict.fromkeys(weights, 10**9)), 3000))
    windows_hold([s for s, _ in plan], weights)


def test_exact_weights_keep_small_sources_small():
    blocks, weights = {0: 60_000, 1: 24_000, 2: 1400, 3: 10, 4: 1}, {0: 34_000.0, 1: 18_000.0, 2: 2470.0, 3: 77.0, 4: 8.1}
    first = next(mixing.phases(blocks, weights))
    total = sum(weights.values())
    for s, w in weights.items():
        assert abs(sum(x[0] == s for x in first) - w / total * len(first)) < 1


def check(rows, got, block, weights):
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert len(got) == len(rows) == len({r.place for r in got}) and sorted(slots) == list(range(len(slots)))
    blocks = {s: -(-sum(x[1] == s for x in rows) // block) for s in {x[1] for x in rows}}
    for s in blocks:
        assert [slots[t][1] for t in sorted(slots) if slots[t][0] == s] == list(range(blocks[s]))
    left, start = dict(blocks), 0
    while left:
        active = {s: weights[s] for s in left if weights.get(s, 0) > 0} or {s: float(n) for s, n in left.items()}
        total, n, t = sum(active.values()), dict.fromkeys(active, 0), start
        while all(n[s] < left[s] for s in active):
            n[slots[t][0]] += 1
            t += 1
            for s, w in active.items():
                assert abs(n[s] - w / total * (t - start)) < 1
        left, start = {s: k - n.get(s, 0) for s, k in left.items() if k > n.get(s, 0)}, t
    return slots


def test_shares_stay_within_a_block(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "c", None]), f"t{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    weights = {"a": 0.3, "b": 0.3, "c": 0.25, None: 0.15}
    check(rows, mixing.mix(df, weights, block=4).collect(), 4, weights)


def test_blocks_grow_once_the_schedule_is_full(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SLOTS", 30)
    rows = [(i, "ab"[i % 3 == 0], "t") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), {"a": 0.5, "b": 0.5}, block=4).collect()
    assert max(r.slot for r in got) + 1 <= 32
    check(rows, got, 30, {"a": 0.5, "b": 0.5})


def test_many_small_sources_are_mixed_as_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    rows = [(i, f"s{i % 4}" if i < 400 else f"x{i}", "t") for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=2).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted((i, s) for i, s, _ in rows)
    assert len({r.place for r in got}) == 500
    renamed = [r.asDict() | {"source": r.source if r.source in ("s0", "s1", "s2") else "others"} for r in got]
    assert len({(r["slot"], r["source"]) for r in renamed}) == len({r["slot"] for r in renamed})


Placed = namedtuple("Placed", "doc_id source block slot place")


def test_members_of_a_group_keep_their_own_weights(spark):
    sizes = {f"m{i}": 5 + 7 * (i % 5) for i in range(12)} | {None: 40}
    weights = {s: float(n % 4 + 1) for s, n in sizes.items()}
    members = spark.createDataFrame([(-1, s, n, weights[s]) for s, n in sizes.items()] + [(-3, "alone", 9, 1.0)], "_s int, source string, n long, w double")
    plan = sorted((r._start, r.source, r._ib) for r in mixing.group_schedule(members, 4).collect() if r.source != "alone")
    got, i = [], 0
    for slot, (start, source, k) in enumerate(plan):
        for j in range(min(4, sizes[source] - 4 * k)):
            got.append(Placed(i, source, k, slot, start + j))
            i += 1
    assert [r.place for r in got] == list(range(sum(sizes.values())))
    check([(r.doc_id, r.source) for r in got], got, 4, weights)


@pytest.mark.parametrize("weighted", [False, True])
def test_sources_beyond_the_driver_s(spark, monkeypatch, weighted):
    """Every source advances by its own weight, and none without a weight comes before the last that has one."""
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 5)
    names = [None, *(f"s{i}" for i in range(39))]
    rows = [(i, names[i % 40], "t") for i in range(1600)] + [(2000 + i, "large", "t") for i in range(300)]
    weights = {s: 0.0 if k % 10 == 9 else 3.0 if k % 2 else 1.0 for k, s in enumerate(names)} | {"large": 40.0} if weighted else None
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights, block=2).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, s, _ in rows) and len({r.place for r in got}) == len(rows)
    if weighted:
        order = [r.source for r in sorted(got, key=lambda r: r.place)]
        assert max(i for i, s in enumerate(order) if weights[s] > 0) < min(i for i, s in enumerate(order) if weights[s] == 0)
        early = Counter(order[:400])
        share = 400 / sum(weights.values())
        assert all(abs(early[s] - w * share) <= 8 for s, w in weights.items())


def test_repeats_unweighted_sources_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "z"), (None, "a")], "doc_id long, source string")
    got = mixing.mix(df, {"a": 1.0}, block=2).collect()
    assert sorted((r.doc_id or 0, r.source) for r in got) == sorted([(1, "a")] * 5 + [(2, "z"), (0, "a")])
    assert max(r.slot for r in got if r.source == "a") < min(r.slot for r in got if r.source == "z")
    assert mixing.mix(df.limit(0)).count() == 0


def test_documents_in_order(spark):
    rows = [(i, "ab"[i % 2], f"text {i}", i) for i in range(200)] + [(0, "a", "text 0", 0), (300, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, place long")
    out = mixing.mixed_documents(df, block=2)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    place = {(r.doc_id, r.source): r.place for r in mixing.mix(df, block=2).orderBy("place", ascending=False).collect()}
    order = [place[r[0], r[1]] for r in got]
    assert order == sorted(order)
