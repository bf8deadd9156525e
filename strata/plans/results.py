"""Result envelopes, batches, published figures and their checks (CON04, CON06, AGG21, CON15-16, SPL11-12, PRJ, DAT, RAS16, PIP, LDG)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import contracts, evidence, greedy, joins, ledger, metrics, spatial, splits
from . import views as v
from .metrics import BOOT_SQL
from .registry import query
from .splits import FOLDS

#: Approved models of the query and the digests of their settings.
CONFIGS = {"forest-a": "ab" * 32, "logistic-b": "cd" * 32}
ENVELOPES = f"""SELECT sample_id, CASE WHEN sample_id % 23 = 0 THEN score * 3 WHEN sample_id % 29 = 0 THEN CAST('nan' AS DOUBLE) ELSE score END AS score,
  CASE sample_id % 11 WHEN 0 THEN 'HUMAN_VETTED_OBSERVATION' WHEN 1 THEN 'AI_HYPOTHESIS' ELSE 'AI_OUTPUT' END AS evidence_level,
  CASE sample_id % 7 WHEN 0 THEN 'Forest A' WHEN 1 THEN 'logistic-b' ELSE 'forest-a' END AS model,
  CASE sample_id % 5 WHEN 0 THEN '{"cd" * 32}' ELSE '{"ab" * 32}' END AS config,
  CASE sample_id % 13 WHEN 0 THEN 'HUMAN_REVIEW_REQUIRED' WHEN 1 THEN 'HUMAN_REVIEW_REQUIRED,AUTOMATIC_EVIDENCE_ONLY,HUMAN_REVIEW_REQUIRED'
    ELSE 'HUMAN_REVIEW_REQUIRED,AUTOMATIC_EVIDENCE_ONLY' END AS warnings,
  CASE sample_id % 17 WHEN 3 THEN 'E001_SCOPE_ONLY' WHEN 4 THEN NULL ELSE '{",".join(contracts.LIMITATIONS)}' END AS limitations FROM ({v.SCORED})"""


@query(
    "con04_envelope_violations",
    f"""SELECT rule, CAST(sample_id AS VARCHAR) AS key FROM (SELECT sample_id, unnest([
      CASE WHEN NOT (score BETWEEN 0 AND 1) OR isnan(score) THEN 'score' END,
      CASE WHEN evidence_level NOT IN ('AI_OUTPUT', 'AI_HYPOTHESIS') THEN 'evidence_level' END,
      CASE WHEN NOT regexp_matches(model, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'model' END,
      CASE WHEN (model, config) NOT IN (('forest-a', '{"ab" * 32}'), ('logistic-b', '{"cd" * 32}')) THEN 'config' END,
      CASE WHEN warnings <> 'HUMAN_REVIEW_REQUIRED,AUTOMATIC_EVIDENCE_ONLY' THEN 'warnings' END,
      CASE WHEN limitations IS DISTINCT FROM '{",".join(contracts.LIMITATIONS)}' THEN 'limitations' END]) AS rule FROM ({ENVELOPES})) WHERE rule IS NOT NULL""",
)
def envelope_violations(spark: SparkSession, d: str) -> DataFrame:
    return contracts.envelope_violations(_envelopes(spark, d), "sample_id", CONFIGS)


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    k, score = F.col("sample_id"), F.col("score")
    return v.scored(spark, d).select(
        k,
        F.when(k % 23 == 0, score * 3).when(k % 29 == 0, F.lit(float("nan"))).otherwise(score).alias("score"),
        F.when(k % 11 == 0, "HUMAN_VETTED_OBSERVATION").when(k % 11 == 1, "AI_HYPOTHESIS").otherwise("AI_OUTPUT").alias("evidence_level"),
        F.when(k % 7 == 0, "Forest A").when(k % 7 == 1, "logistic-b").otherwise("forest-a").alias("model"),
        F.when(k % 5 == 0, "cd" * 32).otherwise("ab" * 32).alias("config"),
        F.split(
            F.when(k % 13 == 0, "HUMAN_REVIEW_REQUIRED").when(k % 13 == 1, "HUMAN_REVIEW_REQUIRED,AUTOMATIC_EVIDENCE_ONLY,HUMAN_REVIEW_REQUIRED")
            .otherwise("HUMAN_REVIEW_REQUIRED,AUTOMATIC_EVIDENCE_ONLY"), ",",
        ).alias("warnings"),
        F.when(k % 17 == 3, F.array(F.lit("E001_SCOPE_ONLY"))).when(k % 17 != 4, F.array(*[F.lit(c) for c in contracts.LIMITATIONS])).alias("limitations"),
    )


@query(
    "con04_public_envelopes",
    f"""SELECT 'result-v1' AS schema_version, evidence_level, score, model, config, '{" ".join(contracts.MESSAGES[c] for c in contracts.WARNINGS)}' AS warnings,
      '{" ".join(contracts.MESSAGES[c] for c in contracts.LIMITATIONS)}' AS limitations FROM ({ENVELOPES}) WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) AND evidence_level IN ('AI_OUTPUT', 'AI_HYPOTHESIS')
      AND (model, config) IN (('forest-a', '{"ab" * 32}'), ('logistic-b', '{"cd" * 32}')) AND warnings = 'HUMAN_REVIEW_REQUIRED,AUTOMATIC_EVIDENCE_ONLY' AND limitations = '{",".join(contracts.LIMITATIONS)}'""",
)
def public_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """The public fields of envelopes that break no rule."""
    rows = _envelopes(spark, d)
    broken = contracts.envelope_violations(rows, "sample_id", CONFIGS).select(F.col("key").cast("bigint").alias("sample_id")).distinct()
    public = contracts.public_envelopes(rows.join(broken, "sample_id", "left_anti"), "result-v1")
    return contracts.assert_public(public).withColumns({c: F.array_join(c, " ") for c in ("warnings", "limitations")})


RESULTS = """SELECT page_id // 32 AS batch, page_id AS item, CASE WHEN page_id % 17 = 0 THEN 'INPUT_CHANGED_AFTER_ADMISSION'
  WHEN length(html) > 12000 THEN 'RASTER_TOO_LARGE' WHEN page_id % 19 = 3 THEN 'CRS_MISMATCH' ELSE 'NONE' END AS error FROM pages"""


def _batch_results(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item")
    pages = v.table(spark, d, "pages").select(F.floor(F.col("page_id") / 32).alias("batch"), F.col("page_id").alias("item"), "html", F.length("html").alias("size"))
    present = F.when(k % 17 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html"))  # what stands there once the batch is run
    items = pages.withColumns({"admitted": F.sha2("html", 256), "present": F.sha2(present, 256)})
    return contracts.batch_results(items, ~F.col("admitted").eqNullSafe(F.col("present")), F.when(F.col("size") > 12000, "RASTER_TOO_LARGE").when(k % 19 == 3, "CRS_MISMATCH"))


@query(
    "con06_batch_results",
    f"""SELECT batch, item, CASE WHEN error = 'NONE' THEN 'FEATURES_READY' ELSE 'INVALID_INPUT' END AS status,
      CASE WHEN error = 'NONE' THEN 'SUCCEEDED' ELSE 'FAILED' END AS preparation, error FROM ({RESULTS})""",
)
def batch_results(spark: SparkSession, d: str) -> DataFrame:
    return _batch_results(spark, d)


@query(
    "agg21_batch_totals",
    f"""SELECT batch, count(*) AS total, count(*) FILTER (error = 'NONE') AS accepted, count(*) FILTER (error <> 'NONE') AS invalid,
      CASE WHEN bool_and(error = 'NONE') THEN 'COMPLETE' ELSE 'COMPLETE_WITH_INVALID_ITEMS' END AS status FROM ({RESULTS}) GROUP BY batch""",
)
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    return contracts.batch_totals(_batch_results(spark, d))


@query(
    "con15_score_columns",
    """SELECT rule, CAST(id AS VARCHAR) AS key FROM (SELECT c_custkey AS id, unnest([CASE WHEN c_custkey % 13 = 1 THEN 'stage' END, CASE WHEN c_custkey % 29 = 2 THEN 'pre_score' END, CASE WHEN c_custkey % 31 = 3 THEN 'record' END,
      CASE WHEN c_custkey % 31 = 3 OR c_custkey % 11 = 4 THEN 'review_status' END, CASE WHEN c_custkey % 31 <> 3 AND (c_custkey % 7 = 5 OR c_custkey % 19 = 6) THEN 'score_field' END]) AS rule FROM customer) WHERE rule IS NOT NULL""",
)
def score_columns(spark: SparkSession, d: str) -> DataFrame:
    """Manifest records of customers, some with a score among their fields, of another stage or state, or no object."""
    k = F.col("c_custkey")
    record = F.struct(
        F.when(k % 11 == 4, "scored").when(k % 3 == 0, "rejected").otherwise("accepted").alias("review_status"), F.col("c_nationkey").alias("group"),
        F.when(k % 7 == 5, 0.5).alias("Probability"), F.when(k % 19 == 6, 1).alias("predicted_label"), F.when(k % 5 == 0, 0.25).alias("probability_note"),
    )
    rows = v.table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 13 == 1, "scoring").when(k % 2 == 0, "curation").otherwise("dataset_freeze").alias("stage"), (k % 29 == 2).alias("scored"),
        F.when(k % 31 == 3, "[1]").otherwise(F.to_json(record)).alias("record"),
    )
    return contracts.manifest_violations(rows, "id")


PUBLISHED = f"""SELECT region, count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
  round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({v.SCORED}) GROUP BY region"""


@query("con16_reproduced_figures", f"SELECT region, region = 'src3' AS differs FROM ({PUBLISHED})")
def reproduced_figures(spark: SparkSession, d: str) -> DataFrame:
    """Published figures of each region (one was tampered with) against the same figures from the rows."""
    right = F.col("label") == F.col("predicted")
    figures = [
        F.count_if((F.col("label") == 1) & (F.col("predicted") == 1)).alias("tp"), F.count_if((F.col("label") == 0) & (F.col("predicted") == 1)).alias("fp"),
        F.round(F.avg(right.cast("double")), 6).alias("accuracy"),
    ]
    again = v.scored(spark, d).groupBy("region").agg(*figures)
    published = again.withColumn("tp", F.col("tp") + F.when(F.col("region") == "src3", 1).otherwise(0))
    return metrics.figures_differ(published, again, ["region"], ["tp", "fp", "accuracy"])


#: The rows with one prediction turned.
TURNED = f"SELECT * REPLACE (CASE WHEN sample_id = (SELECT min(sample_id) FROM ({v.SCORED})) THEN 1 - predicted ELSE predicted END AS predicted) FROM ({v.SCORED})"


def figures_sql(scored: str) -> str:
    boot = BOOT_SQL.replace("5000", "500").replace(v.SCORED, scored)
    return f"""SELECT unnest(['tn', 'fp', 'fn', 'tp', 'balanced_accuracy', 'accuracy', 'f1']) AS figure,
      unnest([tn, fp, fn, tp, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9), round((tp + tn) / (tp + tn + fp + fn), 9), round(2 * tp / (2 * tp + fp + fn), 9)]) AS x
      FROM (SELECT {", ".join(f"CAST(count(*) FILTER (label = {a} AND predicted = {b}) AS DOUBLE) AS {k}" for k, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))} FROM ({scored}))
      UNION ALL SELECT metric || unnest(['_low', '_high', '_undefined']), unnest([low, high, CAST(undefined AS DOUBLE)]) FROM ({boot})"""


def outcome_sql(figures: str) -> str:
    return f"""SELECT CASE WHEN n < 40 THEN 0 WHEN ba >= 0.75 AND low > 0.5 THEN 1 WHEN ba > 0.5 THEN 2 ELSE 3 END
      FROM (SELECT sum(x) FILTER (figure IN ('tn', 'fp', 'fn', 'tp')) AS n, max(x) FILTER (figure = 'balanced_accuracy') AS ba, least(ba, max(x) FILTER (figure = 'balanced_accuracy_low')) AS low FROM {figures})"""


@query("con16_sealed_figures", f"""WITH a AS ({figures_sql(v.SCORED)}), b AS ({figures_sql(TURNED)})
  SELECT figure, a.x AS published, b.x AS again, a.x = b.x AS agrees FROM a JOIN b USING (figure) UNION ALL SELECT 'outcome', NULL, NULL, ({outcome_sql('a')}) = ({outcome_sql('b')}) UNION ALL SELECT 'rows', NULL, NULL, false""")
def sealed_figures(spark: SparkSession, d: str) -> DataFrame:
    """The sealed figures of the scored rows against those of the rows with one prediction turned."""
    rows = v.scored(spark, d).select("sample_id", "region", "label", "predicted", "score")
    receipt = evidence.published_figures(rows, "region", 500, "boot-v1")
    first = F.col("sample_id") == F.lit(rows.agg(F.min("sample_id")).first()[0])
    return evidence.reproduced(receipt, rows.withColumn("predicted", F.when(first, 1 - F.col("predicted")).otherwise(F.col("predicted"))), "region", 500, "boot-v1")


@query(
    "spl11_fold_indices",
    f"SELECT fold, CAST(sum(CASE WHEN role = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test, CAST(sum(CASE WHEN role = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train FROM (SELECT f.fold, CASE WHEN s.fold = f.fold THEN 'test' ELSE 'train' END AS role FROM ({FOLDS}) s, (SELECT unnest(range(5)) AS fold) f) GROUP BY fold",
)
def fold_indices(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.fold_roles(v.samples(spark, d).withColumn("_f", F.col("block") % 5), "_f", 5)
    return rows.groupBy("fold").agg(F.count_if(F.col("role") == "test").alias("test"), F.count_if(F.col("role") == "train").alias("train"))


@query(
    "spl12_frozen_split",
    f"""WITH s AS (SELECT block, sample_id, CASE WHEN block IN (3, 7, 11) THEN 'final_test' WHEN block IN (1, 5) THEN 'development' ELSE 'train' END AS partition FROM ({v.SAMPLES})),
      t AS (SELECT block, sample_id, CASE WHEN block = 4 AND sample_id % 50 = 0 THEN 'development' ELSE partition END AS partition FROM s),
      h AS (SELECT block, sha256(string_agg(CAST(sample_id AS VARCHAR) || ':' || partition, chr(10) ORDER BY sample_id) || chr(10)) AS a FROM s GROUP BY block),
      g AS (SELECT block, sha256(string_agg(CAST(sample_id AS VARCHAR) || ':' || partition, chr(10) ORDER BY sample_id) || chr(10)) AS a FROM t GROUP BY block)
      SELECT h.block, h.a <> g.a AS differs FROM h JOIN g USING (block)""",
)
def frozen_split(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the frozen assignment against those of one that moved some rows of a block."""
    line = F.concat_ws(":", F.col("sample_id").cast("string"), "partition")
    frozen = splits.block_split(v.samples(spark, d), "block", [3, 7, 11], [1, 5])
    moved = frozen.withColumn("partition", F.when((F.col("block") == 4) & (F.col("sample_id") % 50 == 0), "development").otherwise(F.col("partition")))
    return metrics.figures_differ(metrics.inventory_digest(frozen, ["block"], line, "sample_id"), metrics.inventory_digest(moved, ["block"], line, "sample_id"), ["block"], ["digest"])


@query("prj03_encoded_labels", "SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS label FROM labels")
def encoded_labels(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("quality") == 1, "positive_bowl_barrow").otherwise("unlabelled_background")
    return v.table(spark, d, "labels").select("doc_id", contracts.encoded_label(name, "positive_bowl_barrow", "unlabelled_background").alias("label"))


@query("prj07_flat_metrics", f"SELECT region, accuracy, tp AS tp_positive_correct, fp AS fp_background_predicted_positive FROM ({PUBLISHED})")
def flat_metrics(spark: SparkSession, d: str) -> DataFrame:
    nested = v.scored(spark, d).groupBy("region").agg(
        F.struct(
            F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy"),
            F.struct(
                F.count_if((F.col("label") == 1) & (F.col("predicted") == 1)).alias("tp_positive_correct"),
                F.count_if((F.col("label") == 0) & (F.col("predicted") == 1)).alias("fp_background_predicted_positive"),
            ).alias("confusion_matrix"),
        ).alias("metrics")
    )
    return metrics.flattened(nested, "metrics")


@query("dat01_epoch_dates", "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN strftime(make_timestamp(1600000000000000 + event_id * 3600123000), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS at, CASE WHEN event_id % 9 <> 0 THEN strftime(make_timestamp(1600000000000000 + event_id * 3600123000), '%Y-%m-%d') END AS day FROM events")
def epoch_dates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    ms = F.when(k % 9 != 0, F.lit(1_600_000_000_000) + k * 3_600_123)
    return v.table(spark, d, "events").select("event_id", text.iso_utc(ms).alias("at"), text.date_prefix(text.iso_utc(ms)).alias("day"))


@query(
    "ras16_metadata_faults",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'crs_mismatch' WHEN p_partkey % 7 = 0 THEN 'resolution_mismatch' WHEN p_size % 5 = 0 THEN 'source_metadata_missing' END AS fault FROM part""",
)
def metadata_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = v.table(spark, d, "part").select(
        k.alias("id"), F.when(k % 20 == 0, "EPSG:4326").when(k % 10 != 0, "EPSG:27700").alias("crs"), F.lit(1.0).alias("x"),
        F.when(k % 7 == 0, 1.00001).otherwise(1.0000001).alias("y"), F.when(F.col("p_size") % 5 == 0, 3).otherwise(1).alias("bands"), F.lit("float32").alias("kind"),
    )
    fault = contracts.raster_metadata_fault(*[F.col(c) for c in ("crs", "x", "y", "bands", "kind")])
    return rows.select("id", fault.alias("fault"))


@query("pip02_public_rows", "SELECT 'prj_' || substr(sha256('project-v1:' || CAST(doc_id AS VARCHAR)), 1, 12) AS reference, n_chars AS size, 'e001-v1' AS version FROM documents")
def public_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "documents").select(
        F.concat(F.lit("prj_"), F.substring(F.sha2(F.concat(F.lit("project-v1:"), F.col("doc_id").cast("string")), 256), 1, 12)).alias("reference"),
        F.col("n_chars").alias("size"), F.lit("e001-v1").alias("version"),
    )
    return contracts.assert_public(rows)


GATES = """SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'rejected' ELSE 'needs_geometry_review' END AS status,
  CASE d.n_chars % 6 WHEN 0 THEN NULL WHEN 1 THEN 'fail' WHEN 2 THEN 'needs_review' ELSE 'pass' END AS geometry, d.n_chars % 31 = 0 AS duplicate,
  CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN 'fail' ELSE 'pass' END END AS coverage, CASE WHEN l.quality = 1 THEN 'pass' WHEN l.quality = 0 THEN 'needs_review' END AS provenance
  FROM documents d LEFT JOIN labels l USING (doc_id)"""


def gate_sql(geometry_open: str) -> str:
    return f"""SELECT doc_id, CASE WHEN status <> 'needs_geometry_review' THEN status WHEN duplicate THEN 'rejected' WHEN geometry IS NULL THEN '{geometry_open}' WHEN geometry = 'fail' THEN 'rejected'
      WHEN geometry = 'pass' THEN CASE WHEN coverage IS NULL OR provenance IS NULL THEN 'needs_terrain_review' WHEN coverage = 'fail' THEN 'rejected' WHEN provenance = 'pass' THEN 'accepted' ELSE 'needs_terrain_review' END
      ELSE '{geometry_open}' END AS status FROM ({GATES})"""


def _gates(spark: SparkSession, d: str, **variant: str) -> DataFrame:
    n, toxic, quality = F.col("n_chars"), F.col("toxic"), F.col("quality")
    rows = v.table(spark, d, "documents").select("doc_id", "n_chars").join(v.table(spark, d, "labels"), "doc_id", "left")
    status = contracts.gate_chain(
        F.when(F.col("doc_id") % 4 == 0, "rejected").otherwise("needs_geometry_review"),
        F.when(n % 6 == 1, "fail").when(n % 6 == 2, "needs_review").when(n % 6 != 0, "pass"), n % 31 == 0,
        F.when(toxic == 1, "fail").when(toxic.isNotNull(), "pass"), F.when(quality == 1, "pass").when(quality == 0, "needs_review"), **variant,
    )
    return rows.select("doc_id", status.alias("status"))


@query("con10_gate_chain", gate_sql("needs_geometry_review"))
def gate_chain(spark: SparkSession, d: str) -> DataFrame:
    return _gates(spark, d)


@query("pip04_gate_variant", gate_sql("uncertain"))
def gate_variant(spark: SparkSession, d: str) -> DataFrame:
    return _gates(spark, d, geometry_open="uncertain")


@query(
    "pip05_accepted_union",
    "SELECT c_custkey AS id, 'one' AS round, c_mktsegment AS programme FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey + 1000000, 'two', 'UNAVAILABLE' FROM supplier WHERE s_acctbal > 0",
)
def accepted_union(spark: SparkSession, d: str) -> DataFrame:
    first = v.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit("one").alias("round"), F.col("c_mktsegment").alias("programme"))
    second = v.table(spark, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") + 1000000).alias("id"), F.lit("two").alias("round"))
    return first.unionByName(second, allowMissingColumns=True).fillna("UNAVAILABLE", ["programme"])


@query(
    "pip06_dataset_freeze",
    f"""WITH s AS ({v.SAMPLES}), p AS (SELECT observation_group AS pair, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM s GROUP BY 1)
      SELECT (SELECT count(*) FROM s) AS rows, (SELECT count(*) FROM s) - (SELECT count(DISTINCT sample_id) FROM s) AS repeated,
      (SELECT count(*) FROM p WHERE a = 0 OR b = 0) AS incomplete, (SELECT count(DISTINCT observation_group) FROM s WHERE observation_group IN (SELECT s_suppkey FROM supplier)) AS shared""",
)
def dataset_freeze(spark: SparkSession, d: str) -> DataFrame:
    """Row count, repeated ids, groups without both classes, and groups shared with another data set."""
    s = v.samples(spark, d)
    groups = s.groupBy("observation_group").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("a"))
    other = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("observation_group"), F.lit(1).alias("other")).distinct()
    ids = s.groupBy("sample_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"))
    judged = groups.join(other, "observation_group", "left").agg(F.count_if((F.col("a") == 0) | (F.col("a") == F.col("n"))).alias("incomplete"), F.count("other").alias("shared"))
    return ids.crossJoin(judged)  # one row each


@query("set05_set_equality", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AND (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AS equal")
def set_equality(spark: SparkSession, d: str) -> DataFrame:
    differ = joins.set_differences(v.table(spark, d, "documents"), v.table(spark, d, "labels"), "doc_id")
    return differ.agg((F.count("*") == 0).alias("equal"))


@query("str05_split_lists", "SELECT p_partkey AS id, len(list_filter(list_transform(string_split(' a, ' || p_name || ',,b ', ','), lambda x: trim(x)), lambda x: x <> '')) AS n FROM part")
def split_lists(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(text.split_list(F.concat(F.lit(" a, "), F.col("p_name"), F.lit(",,b ")))).cast("bigint").alias("n"))


@query("ldg03_audited_inserts", "SELECT CAST(event_id AS VARCHAR) AS key, kind, CAST(user_id AS VARCHAR) AS actor FROM events, (SELECT unnest(['row', 'audit']) AS kind) WHERE event_type = 'signup'")
def audited_inserts(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events").where("event_type = 'signup'").select("event_id", F.col("user_id").cast("string").alias("user_id"), "ts", "value")
    return ledger.insert_audited(e, "event_id", "PROJECT_CREATED", "user_id", "ts").select("key", "kind", "actor")


@query(
    "ldg12_request_violations",
    """SELECT rule, CAST(event_id AS VARCHAR) AS key FROM (SELECT event_id, unnest([CASE WHEN event_id % 3 = 0 OR user_id % 5 = 0 THEN 'acknowledged' END, CASE WHEN event_type = 'error' THEN 'evidence_level' END]) AS rule FROM events) WHERE rule IS NOT NULL""",
)
def request_violations(spark: SparkSession, d: str) -> DataFrame:
    """A review request needs both acknowledgements and a human's evidence level."""
    rows = v.table(spark, d, "events").select(
        "event_id", (F.col("event_id") % 3 != 0).alias("scope_acknowledged"), (F.col("user_id") % 5 != 0).alias("limits_acknowledged"),
        F.when(F.col("event_type") == "error", "AI_OUTPUT").otherwise("HUMAN_VETTED_OBSERVATION").alias("evidence_level"),
    )
    rules = {"acknowledged": F.col("scope_acknowledged") & F.col("limits_acknowledged"), "evidence_level": ~F.col("evidence_level").isin(*contracts.EVIDENCE_LEVELS)}
    return contracts.row_violations(rows, "event_id", rules)


RESULT_STATES = "CASE event_type WHEN 'signup' THEN 'UNREVIEWED' WHEN 'view' THEN 'IN_REVIEW' WHEN 'click' THEN 'IN_REVIEW' WHEN 'error' THEN 'ESCALATED' ELSE 'REVIEWED' END"


@query(
    "ldg11_result_moves",
    f"""SELECT event_id FROM (SELECT event_id, s, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT *, {RESULT_STATES} AS s FROM events))
      WHERE NOT ((b IS NULL AND s = 'UNREVIEWED') OR (b IS NOT NULL AND b = 'UNREVIEWED' AND s = 'IN_REVIEW') OR (b IS NOT NULL AND b = 'IN_REVIEW' AND s IN ('REVIEWED', 'ESCALATED')))""",
)
def result_moves(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    state = F.when(t == "signup", "UNREVIEWED").when(t.isin("view", "click"), "IN_REVIEW").when(t == "error", "ESCALATED").otherwise("REVIEWED")
    return ledger.illegal_results(v.table(spark, d, "events").withColumn("state", state), "user_id", ["ts", "event_id"], "state").select("event_id")


SEEDS = (0, 1, 2)
ACCURACIES = ", ".join(f"avg(CASE WHEN label = CAST(score + {0.02 * s} >= 0.5 AS INTEGER) THEN 1.0 ELSE 0.0 END) AS s{s}" for s in SEEDS)


@query(
    "met07_robustness_rule",
    f"""WITH f AS (SELECT region, {ACCURACIES}, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) FILTER (sample_id % 2 = 0) AS half FROM ({v.SCORED}) GROUP BY region),
      a AS (SELECT avg(s0) AS mean, min(s0) AS low, greatest(avg(s0), avg(s1), avg(s2)) - least(avg(s0), avg(s1), avg(s2)) AS spread, avg(half) AS half FROM f)
      SELECT CASE WHEN mean >= 0.70 AND low >= 0.60 AND spread <= 0.05 AND half >= 0.65 THEN 'ROBUST' WHEN mean >= 0.60 AND low >= 0.50 THEN 'MIXED ROBUSTNESS' ELSE 'FRAGILE' END AS outcome FROM a""",
)
def robustness(spark: SparkSession, d: str) -> DataFrame:
    """Folds are regions; a seed shifts the score, and half of the rows stand for the half-data runs."""
    right = lambda p: (F.col("label") == p).cast("double")
    folds = v.scored(spark, d).groupBy("region").agg(
        *[F.avg(right((F.col("score") + 0.02 * s >= 0.5).cast("int"))).alias(f"s{s}") for s in SEEDS],
        F.avg(F.when(F.col("sample_id") % 2 == 0, right(F.col("predicted")))).alias("half"),
    )
    means = [F.avg(f"s{s}") for s in SEEDS]
    spread = F.greatest(*means) - F.least(*means)
    return folds.agg(metrics.robustness_outcome(F.avg("s0"), F.min("s0"), spread, F.avg("half")).alias("outcome"))


CELL_COUNTS = f"SELECT CAST(floor(easting / 100000.0) AS BIGINT) AS e, CAST(floor(northing / 100000.0) AS BIGINT) AS n, count(*) AS c FROM ({v.SITES}) GROUP BY 1, 2 HAVING count(*) >= 12"


@query(
    "met10_go_no_go",
    f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (ORDER BY c DESC, e, n) AS i FROM ({CELL_COUNTS})),
      r AS (SELECT 0::BIGINT AS i, [(-9::BIGINT, -9::BIGINT)] AS taken UNION ALL SELECT g.i, CASE WHEN len(list_filter(r.taken, lambda t: abs(t[1] - g.e) <= 1 AND abs(t[2] - g.n) <= 1)) = 0 AND len(r.taken) < 5 THEN list_append(r.taken, (g.e, g.n)) ELSE r.taken END FROM r JOIN g ON g.i = r.i + 1),
      t AS (SELECT (SELECT count(*) FROM ({v.SITES})) AS accepted, (SELECT count(*) FROM g) AS viable, (SELECT max(len(taken)) - 1 FROM r) AS holdouts,
        (SELECT count(*) FROM ({v.SITES}) WHERE site_id % 9973 = 0) = 0 AS fine, (SELECT count(*) FROM ({v.SITES}) WHERE site_id % 997 = 0) = 0 AS sourced)
      SELECT CASE WHEN accepted >= 250 AND viable >= 8 AND holdouts >= 2 AND fine AND sourced THEN 'FINAL GO' ELSE 'CONDITIONAL GO REMAINS' END AS decision, viable, holdouts, fine, sourced FROM t""",
)
def go_no_go(spark: SparkSession, d: str) -> DataFrame:
    """Groups are 100 km cells; holdout candidates are viable ones that do not touch."""
    place = lambda c: F.floor(F.col(c) / 100000.0).cast("bigint")
    sites = v.sites(spark, d)
    cells = sites.groupBy(place("easting").alias("e"), place("northing").alias("n")).agg(F.count("*").alias("count"))
    cells = cells.withColumn("cell", F.format_string("%05d_%05d", "e", "n"))
    holdouts = len(greedy.apart(cells))
    resolution = F.when(F.col("site_id") % 9973 == 0, 2.0).when(F.col("site_id") % 4 == 0, 0.5).otherwise(1.0)
    programme = F.when(F.col("site_id") % 997 == 0, "UNAVAILABLE").otherwise(F.concat(F.lit("P"), (F.col("site_id") % 6).cast("string")))
    known = sites.agg(F.count("*").alias("accepted"), F.bool_and(resolution <= 1).alias("fine"), F.bool_and(programme != "UNAVAILABLE").alias("sourced"))
    totals = known.crossJoin(cells.agg(F.count_if(F.col("count") >= 12).alias("viable")))  # one row each
    decision = metrics.go_decision(F.col("accepted"), F.col("viable"), F.lit(holdouts), F.col("fine"), F.col("sourced"))
    return totals.select(decision.alias("decision"), "viable", F.lit(holdouts).cast("bigint").alias("holdouts"), "fine", "sourced")


@query(
    "con14_policy_bounds",
    """SELECT rule, CAST(id AS VARCHAR) AS key FROM (SELECT p_partkey AS id, unnest([CASE WHEN p_partkey % 11 = 1 THEN 'label' END, CASE WHEN p_size % 10 = 2 THEN 'ratio' END, CASE WHEN p_partkey % 13 = 3 OR p_size < 3 THEN 'distances' END,
      CASE WHEN p_size * 100 >= 4000 THEN 'annulus' END, CASE WHEN p_partkey % 17 = 4 THEN 'gaps' END]) AS rule FROM part) WHERE rule IS NOT NULL""",
)
def policy_bounds(spark: SparkSession, d: str) -> DataFrame:
    """One sampling policy for each part: inner radius from its size, outer 4 km."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = v.table(spark, d, "part").select(
        k.alias("id"), F.when(k % 11 == 1, "background").otherwise("unlabelled_background").alias("label"), F.when(size % 10 == 2, 2).otherwise(1).alias("per_positive"),
        F.when(k % 13 == 3, 0.0).otherwise(500.0).alias("exclusion_m"), F.lit(250.0).alias("archaeology_exclusion_m"), F.when(size < 3, -256.0).otherwise(256.0).alias("separation_m"),
        (size * 100.0).alias("inner_m"), F.lit(4000.0).alias("outer_m"), F.when(k % 17 == 4, 1.5).otherwise(0.2).alias("most_gaps"),
    )
    return spatial.policy_violations(rows, "id")


ANSWERS = """SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'frozen' WHEN d.doc_id % 3 <> 0 THEN 'live' WHEN d.doc_id % 5 <> 0 THEN 'cached' ELSE 'none' END AS origin, d.doc_id % 3 = 0 AS failed, l.toxic, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)"""


@query(
    "pip04_terrain_answers",
    f"""SELECT doc_id, origin, CASE WHEN origin = 'none' THEN 'needs_review' WHEN coverage THEN 'pass' ELSE 'fail' END AS coverage, CASE WHEN origin = 'none' OR NOT sourced THEN 'needs_review' ELSE 'pass' END AS provenance,
      CASE WHEN origin = 'none' THEN 'HTTPError' WHEN NOT coverage THEN origin || '_no_cover' END AS reason,
      CASE WHEN origin = 'none' THEN 'needs_terrain_review' WHEN NOT coverage THEN 'rejected' WHEN sourced THEN 'accepted' ELSE 'needs_terrain_review' END AS status
      FROM (SELECT doc_id, origin, coalesce(toxic, 0) = 0 AS coverage, coalesce(quality, 0) = 1 AS sourced FROM ({ANSWERS}))""",
)
def terrain_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers for every document: a quarter is frozen, a third of live requests fails, most of those are cached."""
    k = F.col("doc_id")
    docs = v.table(spark, d, "documents").select("doc_id").join(v.table(spark, d, "labels"), "doc_id", "left")
    bad = F.coalesce(F.col("toxic"), F.lit(0)) != 0
    told = lambda name: [
        "doc_id", F.when(bad, "fail").otherwise("pass").alias("coverage"), F.when(F.coalesce("quality", F.lit(0)) == 1, "pass").otherwise("needs_review").alias("provenance"),
        F.when(bad, f"{name}_no_cover").alias("reason"),
    ]
    live = docs.select(*told("live"), F.when(k % 3 == 0, "HTTPError").alias("error"))
    return contracts.terrain_answers(docs, docs.where(k % 4 == 0).select(*told("frozen")), live, docs.where(k % 5 != 0).select(*told("cached")), "doc_id")
