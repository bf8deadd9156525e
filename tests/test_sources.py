import json

import pytest
from pyspark.sql import functions as F

from strata.operators.contracts import repeated
from strata.sources import index, manifest
from strata.sources.paged import PagedSource
from strata.streaming import resumable


def indexed(spark, ids):
    rows = [(i, "x", f"g{i}", "", "b", "2020", "p", 1.0, 128, "v", "pass", "s", "0" * 64, "train", "train") for i in ids]
    return spark.createDataFrame(rows, index.MODELLING_INDEX)


def test_index_round_trip(spark, tmp_path):
    df = indexed(spark, ["a", "b"])
    path = f"file://{tmp_path}/index"
    index.write_index(df, path, index.MODELLING_INDEX, repeated(df, "sample_id", "repeated_id"))
    back = index.read_index(spark, path, index.MODELLING_INDEX, F.col("sample_id") != "b", ["sample_id", "overlap_component_id", "patch_size_m"])
    assert [tuple(r) for r in back.collect()] == [("a", "", 128)]
    with pytest.raises(Exception, match="already exists"):
        index.write_index(df, path, index.MODELLING_INDEX)
    with pytest.raises(ValueError, match="repeated_id"):
        bad = indexed(spark, ["a", "a"])
        index.write_index(bad, path + "2", index.MODELLING_INDEX, repeated(bad, "sample_id", "repeated_id"))


def test_verified_write_and_quarantine(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    assert index.verified_write(df, f"file://{tmp_path}/a") == df.orderBy(F.col("id").desc()).agg(index.content_digest(df).alias("d")).first().d
    good = index.quarantine(df, F.col("id") < 7, F.lit("large"), f"file://{tmp_path}/q")
    assert good.count() == 7 and spark.read.parquet(f"file://{tmp_path}/q").where("reason = 'large'").count() == 3


def test_strict_documents(spark):
    with pytest.raises(ValueError):
        manifest.strict_json('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        manifest.strict_json('{"a": NaN}')
    sealed = manifest.sealed({"b": 1, "a": [2]})
    assert manifest.check_seal(sealed)["a"] == [2]
    with pytest.raises(ValueError):
        manifest.check_seal(sealed | {"b": 2})
    good = {"schema_version": "1", "items": [{"item_id": "one", "terrain": "a/b.tif"}, {"item_id": "two", "terrain": "c.tif"}]}
    assert manifest.batch_items(spark, json.dumps(good)).count() == 2
    for path in ("/abs.tif", "../up.tif", "a/b.tif"):
        with pytest.raises(ValueError):
            manifest.batch_items(spark, json.dumps(good | {"items": [*good["items"], {"item_id": "three", "terrain": path}]}))
    assert manifest.settings("a = 1", {"a": int}) == {"a": 1}
    with pytest.raises(ValueError):
        manifest.settings("a = true", {"a": int})
    with pytest.raises(ValueError):
        manifest.settings("a = 1\nb = 2", {"a": int})


def test_paged_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"page-{i:06d}.json").write_text(json.dumps([{"list_entry": i * 10 + k, "name": f"n{k % 2}", "easting": 1.5} for k in range(4)]))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("strata_paged").option("base", str(tmp_path)).option("pages", 3).load()
    assert df.count() == 12 and df.rdd.getNumPartitions() == 3
    some = spark.read.format("strata_paged").option("base", str(tmp_path)).option("pages", 3).option("where", "name=n1").load()
    assert some.count() == 6 and some.where("northing is null").count() == 6
    with pytest.raises(Exception):
        spark.read.format("strata_paged").option("base", str(tmp_path)).option("pages", 4).option("tries", 1).load().count()


def test_work_is_done_once(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    work = lambda df: df.select("id", (F.col("id") * 2).alias("v"))
    assert resumable.run_pending(spark.range(5), "id", work, state).count() == 5
    again = resumable.run_pending(spark.range(8), "id", work, state)
    assert again.count() == 8 and again.distinct().count() == 8


def test_streamed_work_is_done_once(spark, tmp_path):
    source, state = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    work = lambda df: df.select("id", (F.col("id") + 1).alias("v"))
    for top in (4, 6):
        spark.range(top).write.mode("append").parquet(source)
        resumable.stream_pending(spark, source, spark.range(1).schema, "id", work, state, f"file://{tmp_path}/cp").awaitTermination()
    rows = spark.read.parquet(state)
    assert rows.count() == 6 and rows.select("id").distinct().count() == 6


def test_digest_tells_nulls_apart(spark):
    def digest(rows, schema="a int, b int"):
        df = spark.createDataFrame(rows, schema)
        return df.agg(index.content_digest(df).alias("d")).first().d

    assert digest([(1, None), (2, 3)]) != digest([(None, 1), (2, 3)])
    assert digest([(1, 2), (3, 4)]) == digest([(3, 4), (1, 2)]) != digest([(1, 2), (3, 4), (3, 4)])
    assert digest([([1, None],)], "a array<int>") != digest([([None, 1],)], "a array<int>")
    assert digest([]) == digest([])


@pytest.fixture
def service():
    """A record service on this machine: counts and pages of what matches."""
    import http.server
    import threading
    import urllib.parse

    records = [{"list_entry": i, "name": f"n{i}", "easting": float(i), "northing": 0.0, "kind": "ab"[i % 2]} for i in range(25)]
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            asked.append(q)
            found = [r for r in records if q["where"] == "1=1" or r["kind"] == q["where"].split("'")[1]]
            if q.get("returnCountOnly"):
                got = {"count": len(found)}
            else:
                at, n = int(q["resultOffset"]), int(q["resultRecordCount"])
                got = {"features": [{"attributes": {k: r[k] for k in q["outFields"].split(",")}} for r in found[at : at + n]]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(got).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/query", asked
    server.shutdown()


def test_offset_pages_follow_the_count_and_send_the_predicate(spark, service):
    from strata.sources.paged import OffsetSource, record_count

    address, asked = service
    spark.dataSource.register(OffsetSource)
    rows = spark.read.format("strata_offset").option("address", address).option("page_size", "7").load()
    assert sorted(r.list_entry for r in rows.collect()) == list(range(25)) and rows.rdd.getNumPartitions() == 4
    asked.clear()
    part = spark.read.format("strata_offset").option("address", address).option("where", "kind='b'").load()
    assert sorted(r.list_entry for r in part.collect()) == list(range(1, 25, 2))
    assert asked and all(q["where"] == "kind='b'" for q in asked)
    assert record_count(address, "kind='a'") == 13
    assert spark.read.format("strata_offset").option("address", address).option("where", "kind='z'").load().count() == 0


def test_frozen_folds(spark, tmp_path):
    import hashlib

    def write(name, lines):
        (tmp_path / name).write_text("group,fold\n" + "\n".join(lines) + "\n")
        return str(tmp_path / name)

    good = ["g1,fold_0", "g2,fold_1", "g3,fold_0"]
    digest = hashlib.sha256("".join(f"{x.replace(',', ':')}\n" for x in good).encode()).hexdigest()
    got = index.read_folds(spark, write("a.csv", good[::-1]), digest, folds=2).collect()
    assert {r.group: r.fold for r in got} == {"g1": 0, "g2": 1, "g3": 0}
    for name, lines, folds, match in (("b", [*good, "g1,fold_1"], 2, "repeated_group"), ("c", ["g1,part_0"], 1, "fold_name"), ("d", good, 3, "missing_fold"), ("e", ["g1,fold_1", "g2,fold_0"], 2, "frozen")):
        with pytest.raises(ValueError, match=match):
            index.read_folds(spark, write(f"{name}.csv", lines), digest, folds=folds)


def test_ledger_keys(spark):
    from strata.operators import ledger

    made = {name: spark.createDataFrame([], schema) for name, (schema, _, _) in ledger.TABLES.items()}
    made["projects"] = spark.createDataFrame([("p1", "o1", "DRAFT", None), ("p1", "o1", "DRAFT", None), ("p2", None, "DRAFT", None)], ledger.TABLES["projects"][0])
    made["jobs"] = spark.createDataFrame([("j1", "p1", "DONE", None), ("j2", "p9", "DONE", None), (None, "p2", "DONE", None)], ledger.TABLES["jobs"][0])
    got = sorted((r.rule, r.key) for r in ledger.key_violations(made).collect())
    assert got == [("jobs.primary_key", ""), ("jobs.project_id", "j2"), ("projects.organisation_id", "p1"), ("projects.organisation_id", "p1"), ("projects.primary_key", "p1")]
