"""Ledger over the event table (LDG)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from . import views as v
from .registry import query

STATES = {"signup": "DRAFT", "view": "AUTHORIZED", "click": "PROCESSING", "error": "REVIEW_REQUIRED", "purchase": "REVIEWED"}
STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in STATES.items()) + " END"
EVENTS = f"SELECT event_id, user_id, ts, value, {STATE_SQL} AS state FROM events"


def _events(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    state = None
    for k, s in STATES.items():
        state = F.when(t == k, s) if state is None else state.when(t == k, s)
    return v.table(spark, d, "events").select("event_id", "user_id", "ts", "value", state.alias("state"))


@query("ldg02_insert_ignore", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') UNION ALL SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup')")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "events")
    return ledger.insert_ignore(e.where("event_type = 'signup'").select("user_id").distinct(), e.where("event_type = 'purchase'").select("user_id"), "user_id")


@query("ldg04_latest_state", f"SELECT user_id, arg_max(state, (ts, event_id)) AS state, max(event_id) FILTER (true) IS NOT NULL AS present FROM ({EVENTS}) GROUP BY user_id")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest(_events(spark, d).select("user_id", "event_id", "ts", "state"), ["user_id"], ["ts", "event_id"]).select("user_id", "state", F.lit(True).alias("present"))


@query("ldg05_upsert", f"""SELECT key, arg_min(id, (n, tm, id)) AS id, arg_max(state, (n, tm, id)) AS state FROM (SELECT user_id AS key, event_id AS id, ts AS tm, state, 0 AS n FROM ({EVENTS}) WHERE event_id < 2000
  UNION ALL SELECT user_id, event_id, ts, state, 1 FROM ({EVENTS}) WHERE event_id >= 2000) GROUP BY key""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), "state")
    return ledger.upsert(e.where("id < 2000"), e.where("id >= 2000"), ["key"], "at").select("key", "id", "state")


@query("ldg06_delete_cascade", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    c, o = v.table(spark, d, "customer"), v.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return ledger.delete_cascade(c, o, c.where("c_acctbal < 0"), "c_custkey")[1].select("o_orderkey")


@query("ldg07_tenant_select", f"SELECT user_id, event_id, state FROM ({EVENTS}) WHERE user_id % 10 = 3 ORDER BY ts DESC, event_id")
def tenant_select(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("user_id % 10 = 3").orderBy(F.col("ts").desc(), "event_id").select("user_id", "event_id", "state")


PLACE = "CASE state " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(ledger.PROJECT_STATES, 1)) + " END"


@query("ldg08_illegal_moves", f"SELECT event_id, user_id, state FROM (SELECT *, {PLACE} AS p, coalesce(lag({PLACE}) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS b FROM ({EVENTS})) WHERE p <> b + 1")
def illegal_moves(spark: SparkSession, d: str) -> DataFrame:
    return ledger.illegal_moves(_events(spark, d), "user_id", ["ts", "event_id"], "state").select("event_id", "user_id", "state")


@query("ldg09_report", f"SELECT user_id, count(*) AS events, count(*) FILTER (state = 'REVIEWED') AS reviewed, CASE WHEN min(state) = max(state) THEN min(state) ELSE 'MIXED' END AS uniform FROM ({EVENTS}) GROUP BY user_id")
def report(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("state") == "REVIEWED").alias("reviewed"), ledger.uniform("state", "MIXED").alias("uniform"))


@query("ldg10_overview", f"SELECT state, count(*) AS n, count(DISTINCT user_id) AS users FROM ({EVENTS}) GROUP BY state")
def overview(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
