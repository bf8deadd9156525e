import os
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from strata.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_ten_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(registry.queries()) <= set(names)


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first, columns = docs, docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
            assert docs.exceptAll(first).count() == 0
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] == counts[5] > 0
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = [r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()]
    assert not any(i in t for i in items for t in kept)
    run = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_cover_their_tables(spark, name):
    rows = {"op2": "pages", "op7": "embeddings"}.get(name.split("_")[0], "documents")
    if name.split("_")[0] in ("op5", "op9"):
        assert registry.queries()[name](spark, DATA.replace("0.001", "0.01")).count() > 0
    else:
        assert registry.queries()[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{rows}.parquet").count()


def test_token_starts_follow_the_mix(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sources = sorted(r.source for r in docs.select("source").distinct().collect())
    assert len(sources) > 1
    starts = []
    for first in (sources[0], sources[-1]):
        monkeypatch.setattr(corpus_pipeline, "MIX", {"weights": {s: 50.0 if s == first else 1.0 for s in sources}, "block": 2})
        got = corpus_pipeline.write_tokens(spark, corpus_pipeline.mix_sources(spark, docs, DATA), DATA).collect()
        place = {r.doc_id: r.place for r in corpus_pipeline.mixing.mix(docs, **corpus_pipeline.MIX).collect()}
        assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(place, key=place.get)
        starts.append({r.doc_id: r.start for r in got})
    assert starts[0] != starts[1]


def small_tables(spark, path, docs, bench, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, place string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edits(item, words):
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_run_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(31)
    words = ["".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    bench = [(i, text(rng.randint(8, 20))) for i in range(5)]
    docs, labels = [], []
    for i in range(120):
        t = text(rng.randint(40, 90))
        if i % 9 == 1:
            t += f". you stupid idiot {text(3)}"
        if i % 9 == 2 and docs:
            t = docs[i - 2][1] + " " + text(rng.choice([1, 30]))  # a near copy, or half of one
        if i % 9 == 4:
            t = docs[i - 4][1]
        if i % 9 == 5:
            b = bench[i % 5][1].split()
            b[rng.randrange(len(b))] = "zzz"
            t += " " + " ".join(b)
        docs.append((i, t, "en", f"s{i % 3}", len(t), "x"))
        if i % 2:
            labels.append((i, 1, int(i % 9 == 1)))
    small_tables(spark, tmp_path, docs, bench, labels)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.read.parquet(f"{tmp_path}/labels.parquet")
    grammar = corpus_pipeline.toxicity.fit(table, marks.where(~corpus_pipeline.toxicity.held_out(4, 2)))
    left = [(i, t) for i, t, *_ in docs if float(grammar.score(grammar.features(t))) < 0.3]
    assert len(left) < len(docs)
    sets = {i: shingles(t) for i, t in left}
    part = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(part[a], part[b]), min(part[a], part[b])
                part = {k: new if v == old else v for k, v in part.items()}
    assert len(set(part.values())) < len(part)
    left = [(i, t) for i, t in left if part[i] == i]
    clean = [(i, t) for i, t in left if not any(edits(b.split(), re.findall(r"\w+", t.lower())) <= int(0.2 * len(b.split())) for _, b in bench)]
    assert len(clean) < len(left) and set(got) == {i for i, _ in clean}
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokens.default_tokenizer())
    start = 0
    for r in sorted(got.values(), key=lambda r: r.start):
        ids = [*tokenizer.encode(docs[r.doc_id][1], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_on_nulls_repeats_and_empty_tables(spark, tmp_path):
    docs = [(1, None, None, None, None, None), (None, "no id here at all", "en", "a", 3, "x"), (2, "", "en", "a", 0, "x"), (3, "one two three four five six", None, "b", 3, "x"), (3, "one two three four five six", None, "b", 3, "x")]
    small_tables(spark, tmp_path / "a", docs, [(None, None)], [(None, None, None), (3, 1, 0), (3, 1, 1)])
    got = [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path / "a")).collect()]
    ids = [i for i, _ in got]
    assert len(got) == len(set(got)) + (ids.count(3) - 1) and {1, None} & set(ids) and 3 in ids
    small_tables(spark, tmp_path / "b", [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    for module in ("strata.operators.shared", "strata.llm.tokens"):
        monkeypatch.setattr(f"{module}.shared_dir", lambda _: f"file://{shared}")
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0
    left = sorted(p.name.rsplit("-", 1)[0] for p in shared.iterdir())
    assert left == ["pipeline-token_output", "token-shards"]
