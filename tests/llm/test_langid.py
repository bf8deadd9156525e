import random

import numpy as np

from strata.llm import langid

SYLLABLES = {"aa": ["ba", "ko", "ti", "lu"], "bb": ["sch", "ein", "ung", "über"], "cc": ["ción", "ado", "ñe", "que"]}


def texts(lang, n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40)) for _ in range(n)]


def test_gradients_equal_finite_differences(monkeypatch):
    net = langid.Network.start(["a", "b"], 3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x = rng.integers(97, 103, (4, 12)).astype(np.int16)
    x[0, 9:] = langid.PAD
    y = np.array([0, 1, 1, 0])
    g, _ = net.gradients(x, y)
    for key, index in [("f.z", (98, 2)), ("b.n", (99, 1)), ("f.ur", (3, 4)), ("b.uz", (1, 1)), ("f.un", (0, 5)), ("out", (9, 1)), ("bias", (0,))]:
        at = net.w[key][index]
        net.w[key][index] = at + 1e-3
        up = net.gradients(x, y)[1]
        net.w[key][index] = at - 1e-3
        down = net.gradients(x, y)[1]
        net.w[key][index] = at
        assert abs((up - down) / 2e-3 - g[key][index]) < 1e-4, key


def test_held_out_accuracy_and_edge_cases(spark):
    rows = [(i, t, lang, "x") for lang in SYLLABLES for i, t in enumerate(texts(lang, 60, lang), {"aa": 0, "bb": 100, "cc": 200}[lang])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = langid.fit(df)
    assert net.langs == ["aa", "bb", "cc"]
    test = [(i, t, lang) for lang in SYLLABLES for i, t in enumerate(texts(lang, 30, lang + "!"), {"aa": 0, "bb": 100, "cc": 200}[lang])]
    odd = [(900, None), (901, ""), (902, "123 !!"), (903, "ung " * 40000), (904, "x"), (900, None)]
    got = langid.predict(spark.createDataFrame([(i, t) for i, t, _ in test] + odd, "doc_id long, text string"), net).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert np.mean([by[i][0].lang_pred == lang for i, _, lang in test]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(test) + len(odd)
    assert [by[i][0].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and len(by[900]) == 2
    assert by[903][0].lang_pred == "bb" and by[904][0].lang_pred in net.langs


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.fit(df) is None
    assert langid.predict(df, None).first().lang_pred == "und"
    assert langid.predict(df.limit(0), None).count() == 0


def test_every_byte_is_labelled():
    x, of = langid.windows([b"a" * 200, b"", b"b"])
    assert x.shape == (4, langid.WINDOW) and of.tolist() == [0, 0, 0, 2]
    assert (x != langid.PAD).sum() == 201
    p = langid.Network.start(["a", "b"]).positions(x)
    assert p.shape == (langid.WINDOW, 4, 2) and np.allclose(p.sum(axis=2), 1, atol=1e-5)


def test_padding_does_not_change_a_text():
    net = langid.Network.start(["a", "b"])
    alone = net.documents(["short"])
    assert np.allclose(net.documents(["x" * 500, "short", None])[1], alone[0])
