import random

from strata.llm import decontamination as d

rng = random.Random(8)
WORDS = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"] + ["the", "of"] * 30
ITEMS = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 60)))) for i in range(60)]


def embed(words):
    return " ".join([*rng.choices(WORDS, k=150), *words, *rng.choices(WORDS, k=90)])


def edited(text, rate):
    w = text.split()
    for _ in range(int(rate * len(w))):
        p = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[p] = rng.choice(WORDS)
        elif kind == 1:
            w.insert(p, rng.choice(WORDS))
        elif len(w) > 1:
            del w[p]
    return w


def distance(item, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_exact_passages_and_clean_documents(spark):
    docs = [(i, embed(t.upper().split()), "x") for i, t in ITEMS] + [(1000 + i, embed([]), "x") for i in range(100)] + [(2000, None, "x"), (2001, "", "x"), (2002, ITEMS[3][1] + ". " + ITEMS[4][1], "x")]
    docs.append(docs[0])
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*ITEMS, (500, None), (501, "..."), (3, ITEMS[3][1])], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.edits) for r in d.contaminated(df, bench).collect()]
    want = {(i, i, 0) for i, _ in ITEMS} | {(2002, 3, 0), (2002, 4, 0)}
    assert want <= set(got) and {x[0] for x in got} == {x[0] for x in want}
    assert sum(x[:2] == (0, 0) for x in got) == 2
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1000 + i for i in range(100)} | {2000, 2001}
    assert d.contaminated(df.limit(0), bench).count() == 0 and d.contaminated(df, bench.limit(0)).count() == 0


def test_recall_of_edited_passages():
    index = d.Index(ITEMS, 0.2, 0.98)
    for rate in (0.05, 0.1, 0.2):
        hits = sum(any(g[1] == i for g in index.search([embed(edited(t, rate))])) for _ in range(3) for i, t in ITEMS)
        assert hits >= 0.9 * 3 * len(ITEMS), rate


def test_edits_are_exact():
    index = d.Index(ITEMS, 0.2, 0.98)
    for i, t in ITEMS[:25]:
        words = edited(t, 0.1)
        text = embed(words)
        for _, item, edits, _ in index.search([text]):
            assert edits == distance(ITEMS[item][1].split(), text.split())


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_ITEMS", 7)
    df = spark.createDataFrame([(i, embed(t.split())) for i, t in ITEMS], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(df, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert {(i, i) for i, _ in ITEMS} <= got


def changed(text, places):
    """Words at ``places`` replaced."""
    w = text.split()
    for p in places:
        w[p] = "zzz"
    return w


def test_recall_wherever_the_edits_lie():
    index = d.Index(ITEMS, 0.2, 0.98)
    for where in ("opening", "middle", "end"):
        hits = n = 0
        for i, t in ITEMS:
            size = len(t.split())
            k = int(0.2 * size)
            first = {"opening": 0, "middle": (size - k) // 2, "end": size - k}[where]
            for _ in range(4):
                n += 1
                hits += any(g[1] == i for g in index.search([embed(changed(t, range(first, first + k)))]))
        assert hits >= 0.95 * n, (where, hits, n)


def test_recall_of_short_items():
    own = random.Random(3)
    items = [(i, " ".join(own.choice(WORDS[:120]) for _ in range(5 + i % 4))) for i in range(80)]
    index = d.Index(items, 0.2, 0.98)
    for p in range(8):
        n = hits = 0
        for i, t in items:
            if p < len(t.split()):
                n += 1
                hits += any(g[1] == i for g in index.search([embed(changed(t, [p]))]))
        assert hits >= 0.93 * n, (p, hits, n)


def test_repetitions_follow_the_recall(monkeypatch):
    monkeypatch.setattr(d, "MIN_REPETITIONS", 1)
    few, many = d.Index(ITEMS, 0.2, 0.5), d.Index(ITEMS, 0.2, 0.98)
    assert sum(len(c.walks) for c in few.classes) < sum(len(c.walks) for c in many.classes)
    assert all(c.reached >= 0.98 for c in many.classes)


def test_all_pairs_equal_brute_force():
    own = random.Random(6)
    items = ITEMS[:20]
    docs = [embed(edited(own.choice(items)[1], own.choice([0, 0.1, 0.2]))) if own.random() < 0.7 else embed([]) for _ in range(60)]
    want = {(i, k) for i, t in enumerate(docs) for k, item in items if distance(item.split(), t.split()) <= int(0.2 * len(item.split()))}
    got = {(t, k) for t, k, *_ in d.Index(items, 0.2, 0.98).search(docs)}
    assert got <= want and len(got) >= 0.97 * len(want) > 20


def test_single_words_and_very_long_texts():
    index = d.Index([(1, "unicum"), (2, "two words"), (3, ITEMS[3][1])], 0.2, 0.98)
    text = " ".join(WORDS[:120] * 2000) + " unicum two words " + ITEMS[3][1]
    assert {g[1] for g in index.search([text, None, "two", "unicum"])} == {1, 2, 3}
    assert {g[:2] for g in index.search(["two", "unicum x"])} == {(1, 1)}
