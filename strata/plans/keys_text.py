"""Keys, predicates and text functions (KEY, FIL, STR, PRJ, DAT, MTH)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text
from . import views as v
from .registry import query

CELL = "CASE WHEN easting IS NULL THEN 'UNAVAILABLE' ELSE 'BNG_{k}KM_E' || CAST(CAST(floor(easting / {s}.0) AS BIGINT) AS VARCHAR) || '_N' || CAST(CAST(floor(northing / {s}.0) AS BIGINT) AS VARCHAR) END"


def cell_sql(km: int) -> str:
    return CELL.format(k=km, s=km * 1000)


def hash_sql(seed: str, key: str) -> str:
    return f"sha256('{seed}:' || CAST({key} AS VARCHAR))"


@query("key01_grid_cells", f"SELECT site_id, {cell_sql(100)} AS cell_100, {cell_sql(25)} AS cell_25 FROM (SELECT site_id, CASE WHEN site_id % 11 = 0 THEN NULL ELSE easting - 300000 END AS easting, northing - 300000 AS northing FROM ({v.SITES}))")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    s = v.sites(spark, d).select("site_id", F.when(F.col("site_id") % 11 != 0, F.col("easting") - 300000).alias("e"), (F.col("northing") - 300000).alias("n"))
    return s.select("site_id", keys.grid_cell(F.col("e"), F.col("n")).alias("cell_100"), keys.grid_cell(F.col("e"), F.col("n"), 25).alias("cell_25"))


@query("key02_cell_indices", f"SELECT site_id, CAST(regexp_extract(c, '_E(-?\\d+)_N(-?\\d+)$', 1) AS BIGINT) AS e_index, CAST(regexp_extract(c, '_E(-?\\d+)_N(-?\\d+)$', 2) AS BIGINT) AS n_index FROM (SELECT site_id, {cell_sql(25)} AS c FROM ({v.SITES}))")
def cell_indices(spark: SparkSession, d: str) -> DataFrame:
    e, n = keys.cell_indices(keys.grid_cell(F.col("easting"), F.col("northing"), 25))
    return v.sites(spark, d).select("site_id", e.alias("e_index"), n.alias("n_index"))


@query("key03_opaque_ids", "SELECT c_custkey AS site_id, 'E001P-' || substr(sha256('sample-v1:' || CAST(c_custkey AS VARCHAR)), 1, 12) AS sample_id FROM customer")
def opaque_ids(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return v.table(spark, d, "customer").select(c.alias("site_id"), keys.opaque_id(keys.SAMPLE_PREFIX, "sample-v1", c).alias("sample_id"))


@query("key04_provenance_ids", "SELECT DISTINCT year, 'EAP-' || substr(sha256(CAST(year AS VARCHAR) || '|1|National LIDAR Programme|' || pr), 1, 12) AS provenance FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS pr FROM orders)")
def provenance_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority").distinct()
    return rows.select("year", keys.provenance_id(F.col("year"), F.lit("1"), F.lit("National LIDAR Programme"), F.col("o_orderpriority")).alias("provenance")).distinct()


@query("key06_unit_draws", f"SELECT c_custkey AS id, round({v.sql_unit('h')}, 9) AS u, round({v.sql_unit('h', 17)}, 9) AS w, round({v.sql_unit('h', 1, 8)} , 9) AS short FROM (SELECT c_custkey, 'U:' || CAST(c_custkey AS VARCHAR) AS h FROM customer)")
def unit_draws(spark: SparkSession, d: str) -> DataFrame:
    h = keys.sha("U:", F.col("c_custkey"))
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(keys.unit_draw(h), 9).alias("u"), F.round(keys.unit_draw(h, 17), 9).alias("w"), F.round(keys.unit_draw(h, 1, 8), 9).alias("short"))


@query("key07_related_units", f"SELECT unit, count(*) AS n FROM (SELECT coalesce(nullif(component, ''), CAST(observation_group AS VARCHAR)) AS unit FROM ({v.SAMPLES})) GROUP BY unit")
def related_units(spark: SparkSession, d: str) -> DataFrame:
    unit = keys.related_unit(F.col("component"), F.col("observation_group").cast("string"))
    return v.samples(spark, d).groupBy(unit.alias("unit")).agg(F.count("*").alias("n"))


@query("key08_window_tokens", f"""SELECT window_id, sha256('a salt of sixteen:' || CAST("row" AS VARCHAR) || ':' || CAST("col" AS VARCHAR) || ':128') AS token FROM ({v.WINDOWS})""")
def window_tokens(spark: SparkSession, d: str) -> DataFrame:
    return v.windows(spark, d).select("window_id", keys.window_token("a salt of sixteen", F.col("row"), F.col("col"), F.lit(128)).alias("token"))


def sq(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def rx(pattern: str) -> str:
    flags = "is" if pattern.startswith("(?is)") else "i"
    body = pattern.split(")", 1)[1].replace("'", "''")
    return f"'{body}', '{flags}'"


TITLE_SQL = f"""SELECT entry_id, CASE WHEN bowl AND multiple THEN 'manual_review_required' WHEN bowl AND other THEN 'manual_review_required' WHEN bowl AND survival THEN 'manual_review_required'
  WHEN bowl AND context THEN 'manual_review_required' WHEN bowl THEN 'probable_bowl_candidate' WHEN other OR multiple OR survival THEN 'clear_title_exclusion' ELSE 'manual_review_required' END AS category,
  CASE WHEN bowl AND multiple THEN 'possible multiple monument' WHEN bowl AND other THEN 'mixed monument types' WHEN bowl AND survival THEN 'survival warning' WHEN bowl AND context THEN 'compound or contextual title'
  WHEN bowl THEN 'explicit singular bowl-barrow title' WHEN other THEN 'explicit non-target barrow type' WHEN multiple THEN 'explicit multiple monuments' WHEN survival THEN 'explicit survival warning'
  ELSE 'generic or ambiguous barrow title' END AS reason
FROM (SELECT entry_id, regexp_matches(t, {rx(text.TITLE_BOWL)}) AS bowl, regexp_matches(t, {rx(text.TITLE_MULTIPLE)}) AS multiple, regexp_matches(t, {rx(text.TITLE_NON_TARGET)}) AS other,
  regexp_matches(t, {rx(text.TITLE_SURVIVAL)}) AS survival, regexp_matches(t, {rx(text.TITLE_CONTEXT)}) AS context FROM (SELECT entry_id, {sq('title')} AS t FROM ({v.ENTRIES})))"""


@query("fil01_title_triage", TITLE_SQL)
def title_triage(spark: SparkSession, d: str) -> DataFrame:
    t = v.titles(spark, d).withColumn("t", text.triage_title(F.col("title")))
    return t.select("entry_id", "t.category", "t.reason")


ENTRY_SQL = f"""SELECT entry_id, CASE WHEN unnamed OR cairn OR several OR destroyed OR levelled OR (cropmark AND NOT relief) THEN 'rejected' WHEN NOT relief THEN 'uncertain' ELSE 'needs_geometry_review' END AS status,
  CASE WHEN unnamed THEN 'not_bowl_barrow' WHEN cairn THEN 'cairn' WHEN several THEN 'compound_or_multiple' WHEN destroyed THEN 'destroyed_or_reconstructed' WHEN levelled THEN 'no_upstanding_relief'
  WHEN cropmark AND NOT relief THEN 'cropmark_only' WHEN NOT relief THEN 'insufficient_evidence' END AS reason,
  CASE WHEN unnamed THEN 'uncertain' WHEN cairn OR several THEN CASE WHEN relief THEN 'yes' ELSE 'uncertain' END WHEN destroyed OR levelled OR (cropmark AND NOT relief) THEN 'no' WHEN NOT relief THEN 'uncertain' ELSE 'yes' END AS relief
FROM (SELECT entry_id, NOT regexp_matches(r || ' ' || d, {rx(text.TITLE_BOWL)}) AS unnamed, regexp_matches(d, {rx(text.ENTRY_CAIRN)}) AS cairn,
  regexp_matches(substr(d, 1, 700), {rx(text.ENTRY_MULTIPLE)}) OR regexp_matches(substr(d, 1, 700), {rx(text.ENTRY_COMPOUND)}) AS several, regexp_matches(d, {rx(text.ENTRY_DESTROYED)}) AS destroyed,
  regexp_matches(d, {rx(text.ENTRY_LEVELLED)}) AS levelled, regexp_matches(d, {rx(text.ENTRY_CROPMARK)}) AS cropmark, regexp_matches(d, {rx(text.ENTRY_RELIEF)}) AS relief
  FROM (SELECT entry_id, {sq('reasons')} AS r, {sq('details')} AS d FROM ({v.ENTRIES})))"""


@query("fil02_entry_rubric", ENTRY_SQL)
def entry_rubric(spark: SparkSession, d: str) -> DataFrame:
    t = v.titles(spark, d).withColumn("t", text.assess_entry(F.col("reasons"), F.col("details")))
    return t.select("entry_id", "t.status", "t.reason", "t.relief")


DIAMETER_SQL = f"""SELECT entry_id, list_max(list_filter(list_transform(flatten(list_transform(list_filter(string_split(regexp_replace(details, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda s: contains(lower(s), 'mound') OR contains(lower(s), 'barrow')), lambda s: list_concat(list_concat(regexp_extract_all(s, {rx(text.DIAMETERS[0])[:-5]}, 1, 'i'),
  regexp_extract_all(s, {rx(text.DIAMETERS[1])[:-5]}, 1, 'i')), regexp_extract_all(s, {rx(text.DIAMETERS[2])[:-5]}, 1, 'i')))), lambda x: CAST(x AS DOUBLE)), lambda x: x >= 1 AND x <= 80)) AS diameter FROM ({v.ENTRIES})"""


@query("fil03_described_diameter", DIAMETER_SQL)
def diameters(spark: SparkSession, d: str) -> DataFrame:
    return v.titles(spark, d).select("entry_id", text.described_diameter(F.col("details")).alias("diameter"))


@query("fil06_plain_text_safety", r"SELECT turn, count(*) AS n, CAST(count(*) FILTER (NOT regexp_matches(text, '[<>\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|https?://|file:|\.\./', 'i')) AS BIGINT) AS safe FROM conversations GROUP BY turn")
def plain_text(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "conversations").groupBy("turn").agg(F.count("*").alias("n"), F.count_if(text.safe_plain_text(F.col("text"))).alias("safe"))


@query("fil07_reference_patterns", "SELECT c_custkey AS id, regexp_matches(r, '^prj_[a-z0-9]{12}$') AS ok FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'prj_' || substr(sha256(c_name), 1, 12) ELSE 'prj_' || c_name END AS r FROM customer)")
def references(spark: SparkSession, d: str) -> DataFrame:
    r = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("prj_"), F.substring(keys.sha(F.col("c_name")), 1, 12))).otherwise(F.concat(F.lit("prj_"), F.col("c_name")))
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.opaque_reference(r, "prj").alias("ok"))


@query("str_functions", r"""SELECT conv_id, turn, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words,
  sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest FROM conversations""")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    squeezed = F.length(F.trim(F.regexp_replace(t, r"\s+", " "))).cast("bigint")
    return v.table(spark, d, "conversations").select("conv_id", "turn", squeezed.alias("squeezed"), text.word_count(t).alias("words"), text.line_digest(t).alias("digest"))


@query("str06_code_sets", "SELECT o_orderkey AS id, array_to_string(list_sort(list_distinct(string_split(o_orderstatus || ';' || substr(o_orderpriority, 1, 1) || ';' || o_orderstatus, ';'))), '|') AS codes FROM orders")
def codes(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat_ws(";", F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"))
    return v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(text.code_set(c), "|").alias("codes"))


@query("mth_rounding", "SELECT c_custkey AS id, floor(c_acctbal / 0.5 + 0.5) * 0.5 AS snapped, round_even(c_acctbal, 0) AS even, CAST(round(degrees(atan(sqrt(c_acctbal * c_acctbal + 4))), 6) AS DOUBLE) AS slope FROM customer")
def rounding(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.spatial import snap

    a = F.col("c_acctbal")
    return v.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), snap(a, 0.5).alias("snapped"), F.bround(a).alias("even"), F.round(F.degrees(F.atan(F.sqrt(a * a + 4))), 6).alias("slope")
    )


@query("dat_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(epoch_us(ts) // 1000 AS BIGINT) AS millis FROM events")
def dates(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "events").select("event_id", F.substring(F.col("ts").cast("string"), 1, 10).alias("day"), F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"))


@query("prj04_outcomes", f"SELECT sample_id, CASE WHEN label = 1 AND predicted = 1 THEN 'TP' WHEN label = 0 AND predicted = 0 THEN 'TN' WHEN predicted = 1 THEN 'FP' ELSE 'FN' END AS outcome, CASE WHEN score >= 0.66 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM ({v.SCORED})")
def outcomes(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.metrics import outcome

    s = F.col("score")
    return v.scored(spark, d).select("sample_id", outcome(F.col("label"), F.col("predicted")).alias("outcome"), F.when(s >= 0.66, "high").when(s >= 0.4, "medium").otherwise("low").alias("band"))
