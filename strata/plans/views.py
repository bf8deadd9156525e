"""Domain tables derived from the star-schema tables, as DataFrames and as the same SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import sha, unit_draw

EXTENT = 600_000
#: Title templates; ``{}`` is the part's name. They cover every branch of the triage.
TITLES = (
    "Bowl barrow at {}", "Bowl barrow and enclosure near {}", "Two bowl barrows on {}", "Bell barrow and bowl barrow {}", "Levelled bowl barrow {}",
    "Long barrow {}", "Round barrow cemetery {}", "Destroyed barrow {}", "Barrow  known as   {}", "Disc barrow {}", "Three round barrows {}", "Restored barrow {}",
)
#: Entry details, one for each outcome of the rubric and a few with sizes.
DETAILS = (
    "The monument includes a bowl barrow. The mound survives as an earthwork 1.2m high and 18m in diameter.",
    "The monument includes a cairn. It is a round cairn 14m across.",
    "The monument includes two bowl barrows. The mound measures 20m across.",
    "The monument includes a bowl barrow and another enclosure to the north.",
    "The bowl barrow has been destroyed by quarrying.",
    "The bowl barrow mound, 22.5m in diameter, was levelled in 1950.",
    "The bowl barrow is visible only as a cropmark.",
    "A bowl barrow of unknown condition.",
    "The barrow mound has a maximum diameter of 31.5 m. The ditch is 60m across! A mound 95m across is doubtful.",
    "A long enclosure with no mound of note.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], index: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{listed}], CAST({index} % {len(values)} + 1 AS BIGINT))"


def sql_unit(text: str, first: int = 1, digits: int = 16) -> str:
    return f"(CAST(CAST('0x' || substr(sha256({text}), {first}, {digits}) AS UBIGINT) AS DOUBLE) / {float(16**digits)!r})"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site_id, block_id, easting, northing)`` of every customer; integers, spread by hash."""
    c = F.col("c_custkey")

    def place(name: str) -> Column:
        return F.floor(unit_draw(sha(f"{name}:", c)) * EXTENT).cast("bigint")

    return table(spark, sf_dir, "customer").select(c.alias("site_id"), F.col("c_nationkey").alias("block_id"), place("E").alias("easting"), place("N").alias("northing"))


SITES = (
    "SELECT c_custkey AS site_id, c_nationkey AS block_id, "
    + ", ".join(f"CAST(floor({sql_unit(repr(n + ':') + ' || CAST(c_custkey AS VARCHAR)')} * {EXTENT}) AS BIGINT) AS {a}" for n, a in (("E", "easting"), ("N", "northing")))
    + " FROM customer"
)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(window_id, domain, row, col, score)``: order lines as scored windows on a 64 m grid,
    a domain for each supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("bigint").alias("domain")).distinct()
    rows = rows.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("window_id"), "domain")
    return rows.withColumn("h", sha("W:", F.col("window_id"))).select(
        "window_id", "domain", (F.floor(unit_draw(F.col("h"), 1, 8) * 77) * 64).cast("bigint").alias("row"), (F.floor(unit_draw(F.col("h"), 9, 8) * 77) * 64).cast("bigint").alias("col"),
        F.round(unit_draw(F.col("h"), 17, 8), 2).alias("score"),
    )


WINDOWS = f"""SELECT window_id, domain, CAST(floor({sql_unit("'W:' || window_id", 1, 8)} * 77) * 64 AS BIGINT) AS "row",
  CAST(floor({sql_unit("'W:' || window_id", 9, 8)} * 77) * 64 AS BIGINT) AS "col", round({sql_unit("'W:' || window_id", 17, 8)}, 2) AS score
  FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS window_id, CAST(l_suppkey AS BIGINT) AS domain FROM lineitem)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        p.alias("entry_id"), F.replace(_pick(TITLES, p), F.lit("{}"), F.col("p_name")).alias("title"), _pick(DETAILS, p).alias("details"),
        F.when(p % 3 == 0, F.lit("A bowl  barrow of note.")).otherwise(F.lit("")).alias("reasons"),
    )


ENTRIES = f"""SELECT p_partkey AS entry_id, replace({sql_pick(TITLES, 'p_partkey')}, '{{}}', p_name) AS title, {sql_pick(DETAILS, 'p_partkey')} AS details,
  CASE WHEN p_partkey % 3 = 0 THEN 'A bowl  barrow of note.' ELSE '' END AS reasons FROM part"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, region, label, score, predicted)``: labelled documents with a score that has ties."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id")
    score = F.round(0.7 * unit_draw(sha("S:", F.col("doc_id")), 1, 8) + 0.3 * F.col("quality"), 2)
    return rows.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("region"), F.col("quality").alias("label"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


SCORED = f"""SELECT sample_id, region, label, score, CAST(score >= 0.5 AS INTEGER) AS predicted FROM (SELECT doc_id AS sample_id, source AS region, quality AS label,
  round(0.7 * {sql_unit("'S:' || CAST(doc_id AS VARCHAR)", 1, 8)} + 0.3 * quality, 2) AS score FROM labels JOIN documents USING (doc_id))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, observation_group, component, block, label)``: two classes for each order's group."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    h = sha("C:", F.col("o_custkey"))
    return o.select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("observation_group"),
        F.when(unit_draw(h, 1, 8) < 0.1, F.concat(F.lit("K"), (F.col("o_custkey") % 7).cast("string"), F.lit("-"), F.col("c_nationkey").cast("string"))).otherwise(F.lit("")).alias("component"),
        F.col("c_nationkey").alias("block"), (F.col("o_orderkey") % 2).cast("int").alias("label"),
    )


SAMPLES = f"""SELECT o_orderkey AS sample_id, o_custkey AS observation_group,
  CASE WHEN {sql_unit("'C:' || CAST(o_custkey AS VARCHAR)", 1, 8)} < 0.1 THEN 'K' || CAST(o_custkey % 7 AS VARCHAR) || '-' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS component,
  c_nationkey AS block, CAST(o_orderkey % 2 AS INTEGER) AS label FROM orders JOIN customer ON o_custkey = c_custkey"""
