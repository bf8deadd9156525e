import hashlib
import random

import numpy as np
import pytest

from strata.llm import infilling


def plain(doc_id, text, seed="1"):
    """The rule over Python strings."""
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("values, universe", [([0], 0), ([0, 0, 0, 7], 7), ([5], 1 << 40), (list(range(0, 9000, 3)), 9000), (sorted(random.Random(1).choices(range(10**9), k=2000)), 10**9), (sorted(random.Random(2).choices(range(50), k=3000)), 50)])
def test_select_gives_every_value_back(values, universe):
    data = infilling.elias_fano(np.array(values), universe)
    stored = infilling.Boundaries(data)
    assert [stored.select(i) for i in range(len(values))] == values
    for i in (-1, len(values)):
        with pytest.raises(IndexError):
            stored.select(i)
    if len(values) > 1000:
        assert len(data) < 30 + len(values) * (2.3 + max(0, np.log2(max(1, universe / len(values))))) / 8 + 200


def test_boundaries_are_those_of_code_points():
    text = "aé漢😀́z" * 700
    starts = infilling.code_point_starts(text.encode())
    assert starts.tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert infilling.code_point_starts(b"").tolist() == [0]
    assert infilling.code_point_starts(b"\x80\x80a").tolist() == [0, 2, 3]


def check(rows, got):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr(plain(i, t)) for i, t in rows)


def test_outputs_equal_the_plain_rule_and_go_back(spark):
    rng = random.Random(5)
    letters = "ab<>PSM é漢😀\n\0"
    rows = [(i, "".join(rng.choices(letters, k=rng.randrange(40)))) for i in range(400)]
    rows += [(1000 + i, "the same text é" * 9) for i in range(300)] + [(2000, None), (2001, ""), (None, "no id"), (7, "twice"), (7, "twice"), (7, "another"), (-3, "x" * 300_000 + "é<"), (2002, "a<S"), (2003, "<P"), (2004, "has <M> inside")]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, n int, form string").repartition(5)
    got = infilling.fill_in_middle(df, chunk=32)
    check(rows, got.collect())
    forms = {r.form for r in got.collect()}
    assert forms == {"plain", "psm", "spm"}
    back = got.select("doc_id", infilling.restored(got.output, got.form).alias("t")).collect()
    assert sorted((r.doc_id or 0, r.t) for r in back) == sorted((i or 0, t or "") for i, t in rows)


def test_each_distinct_text_is_listed_once(spark):
    rows = [(i, t) for i in range(50) for t in ("one", "two", "one ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    index = infilling.distinct_index(df).collect()
    assert sorted((r.chars, r.copies) for r in index) == [(0, 50), (3, 50), (3, 50), (4, 50)]


def test_copies_of_a_hot_text_are_spread_and_none_is_lost(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', concat('t', id)) as text")
    got = infilling.fill_in_middle(df, chunk=100)
    assert got.count() == 4000 and got.select("doc_id").distinct().count() == 4000
    check([(r.doc_id, r.text) for r in df.collect()], got.collect())


def test_empty_table(spark):
    got = infilling.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert got.collect() == [] and got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
