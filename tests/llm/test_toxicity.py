import itertools
import random

import numpy as np
import pytest

from strata.llm import toxicity
from strata.llm.toxicity import INSULTS, MACHINES, Grammar, clause_grammar


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            words[rng.randrange(60)] = "grumvo" + rng.choice(["", "ka", "lis", "tor", "ven"])
        docs.append((i, " ".join(words).capitalize() + ".", "x"))
        labels.append((i, 1, int(bad)))
    docs += [(9000, None, "x"), (9001, "", "x"), (9002, "idiot " * 5000, "x"), (9003, "GRUMVOXA!", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_hidden_words_are_learned_and_generalise(spark, data):
    docs, labels = data
    grammar = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"))
    assert any("grumvo".startswith(p[:4]) for p in grammar.prefixes)
    score = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, grammar).collect()}
    assert len(score) == docs.count() and all(0 <= s <= 1 for s in score.values())
    bad = [score[i] for i in range(600) if i % 6 == 0 and i % 3 == 1 or i % 6 == 0]
    assert min(bad) > 0.3 > max(score[i] for i in range(600) if i % 6)
    assert score[9003] > 0.3 and score[9000] == score[9001] < 0.3
    kept = toxicity.reject_toxic(docs, grammar)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in score.items() if s < 0.3}


def test_clauses_leave_paths():
    g = Grammar({w: 3.0 for w in INSULTS})
    assert g.parse("you are an idiot")[0] == (0, 1, 0, 0)
    assert g.parse("you are not an idiot")[0] == (0, 1, 1, 0)
    assert g.parse("not an idiot but a plain old moron")[0] == (0, 0, 0, 0)  # one act is not excused
    assert g.parse("he said that it was trash")[0] == (0, 0, 0, 1)
    assert g.parse("i will kill you")[0] == (1, 1, 0, 0)
    assert g.parse("she said he would never hurt you")[0] == (1, 1, 1, 1)
    assert g.parse("a quiet day") is None
    assert [c.strip() for c in g.clauses("One. You idiot! Two; trash here\nend")] == ["you idiot", "trash here"]
    assert list(g.clauses("preidiot only inside")) == []


def test_composition_equals_running_the_machines_in_turn():
    whole = clause_grammar()
    machines = [m() for m in MACHINES]
    symbols = ["I", "T", "Y", "N", "R", "o"]
    for n in range(1, 5):
        for word in itertools.product(symbols, repeat=n):
            want = []
            for mid1 in machines[0].paths(list(word)):
                for mid2 in machines[1].paths(list(mid1[1])):
                    for mid3 in machines[2].paths(list(mid2[1])):
                        for end in machines[3].paths(list(mid3[1])):
                            want.append((mid1[0] + mid2[0] + mid3[0] + end[0], mid1[2] + mid2[2] + mid3[2] + end[2]))
            assert sorted((c, last) for c, _, last in whole.paths(list(word))) == sorted(want)


def test_cheapest_path_equals_the_enumeration_of_all():
    g = Grammar({"bad": 2.0, "worse": 3.5}, {"nast": 1.25}, {"bad": 2.5, "hit": 0.5})
    machine = clause_grammar()
    rng = random.Random(5)
    for _ in range(300):
        words = rng.choices(["bad", "worse", "nasty", "hit", "you", "not", "said", "day", "and", "it"], k=rng.randint(1, 6))
        found = []
        for arcs in itertools.product(*[g.arcs(w) for w in words]):
            for cost, _, last in machine.paths([s for s, _ in arcs]):
                found.append((cost + sum(c for _, c in arcs), last))
        got = g.parse(" ".join(words))
        if not found:
            assert got is None
            continue
        assert got[1] == pytest.approx(-min(found)[0])
        assert any(c == pytest.approx(-got[1]) and got[0] == tuple(int(x in last) for x in ("threat", "target", "negated", "reported")) for c, last in found)


def test_negations_targets_and_threats_are_learned(spark):
    rng = random.Random(9)
    fill = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        clause = rng.choices(fill, k=12)
        kind = i % 9
        if kind == 0:
            clause[6:8] = ["stupid", "zorp"]  # beside acts of toxic rows only
        elif kind == 1:
            clause[5:7] = ["vlim", "stupid"]  # before acts of clean rows only
        elif kind == 2:
            clause[1], clause[9] = "quodda", "stupid"
        elif kind == 3:
            clause[5:7] = ["splork", "you"]
        elif kind == 4:
            clause[6] = "stupid"
        rows.append((i, " ".join(clause) + "."))
        labels.append((i, 1, int(kind in (0, 3, 4))))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    g = toxicity.fit(docs, marks)
    assert "vlim" in g.negations and "quodda" in g.reports and "splork" in g.threats
    assert g.parts[2] >= 0 >= max(g.parts[3:])
    s = {t: float(g.score(g.features(t))) for t in ("so stupid", "vlim stupid", "splork you")}
    assert s["so stupid"] > 0.3 > s["vlim stupid"] and s["splork you"] > 0.3


def test_default_weights_order_the_paths():
    g = Grammar({w: 3.0 for w in INSULTS})
    s = {t: float(g.score(g.features(t))) for t in ("you idiot", "an idiot", "not an idiot", "fine day")}
    assert s["you idiot"] > s["an idiot"] > s["not an idiot"] > s["fine day"]


def test_signs_are_held():
    x = np.zeros((40, len(toxicity.PATHS)))
    x[:20, toxicity.INDEX[0, 0, 1, 0]] = 1.0
    x[20:30, toxicity.INDEX[0, 1, 0, 0]] = 1.0
    parts, _ = toxicity.weigh(x, np.array([1.0] * 20 + [0.0] * 20), 0.02, 60)
    assert parts[2] >= 0 and parts[3] <= 0 and parts[4] <= 0


def test_equal_texts_with_different_labels_count_once(spark):
    docs = spark.createDataFrame([(i, "same text" if i < 5 else f"text {i}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i in (0, 1, 2, 6))) for i in range(8)], "doc_id long, quality int, toxic int")
    got = {r.text: (r.doc_id, r.toxic) for r in toxicity.labelled_sample(docs, labels, 100).collect()}
    assert got["same text"] == (0, 1) and got["text 6"] == (6, 1) and got["text 7"] == (7, 0) and len(got) == 4


def test_without_labels_the_seed_words_hold(spark, data):
    docs, labels = data
    g = toxicity.fit(docs, labels.limit(0))
    assert set(INSULTS) <= set(g.words) and not g.prefixes
    assert toxicity.toxicity_scores(docs.limit(0), g).count() == 0
