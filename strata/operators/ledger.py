"""Append-only ledger: inserts, versions, tombstones, state machine and reports over event rows (LDG)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The order of a project's states, and a result's legal moves.
PROJECT_STATES = ("DRAFT", "AUTHORIZED", "PROCESSING", "REVIEW_REQUIRED", "REVIEWED", "REPORT_READY")
RESULT_MOVES = {"UNREVIEWED": ("IN_REVIEW",), "IN_REVIEW": ("REVIEWED", "ESCALATED")}


# Tables of the ledger with their keys, and what each refers to.
TABLES = {
    "organisations": ("organisation_id string, name string, created_at timestamp", "organisation_id", {}),
    "projects": ("project_id string, organisation_id string, state string, created_at timestamp", "project_id", {"organisation_id": "organisations"}),
    "jobs": ("job_id string, project_id string, status string, created_at timestamp", "job_id", {"project_id": "projects"}),
    "results": ("result_id string, job_id string, project_id string, review_state string, score double", "result_id", {"job_id": "jobs", "project_id": "projects"}),
    "audit": ("event_id string, project_id string, action string, actor string, at timestamp", "event_id", {"project_id": "projects"}),
}


def key_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """``(rule, key)`` of repeated or missing primary keys and of references to rows that are not there."""
    out = None
    for name, (_, key, refers) in TABLES.items():
        if name not in tables:
            continue
        rows = tables[name]
        k = F.coalesce(F.col(key), F.lit(""))
        found = rows.groupBy(k.alias("key")).agg(F.count("*").alias("n")).where("n > 1 or key = ''").select(F.lit(f"{name}.primary_key").alias("rule"), "key")
        for column, other in refers.items():
            if other in tables:
                there = tables[other].select(F.col(TABLES[other][1]).alias(column))
                lost = rows.where(F.col(column).isNotNull()).join(there, column, "left_anti").select(F.lit(f"{name}.{column}").alias("rule"), k.alias("key"))
                found = found.unionAll(lost)
        out = found if out is None else out.unionAll(found)
    return out


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``existing`` and the rows of ``new`` whose key is not there yet; of repeated new keys, the first
    by ``order`` stays (by all columns without it)."""
    rest = [c for c in new.columns if c != key]
    first = new.select(key).distinct()
    if rest:
        place = F.struct(*([order] if order else []), *rest)
        first = new.groupBy(key).agg(F.min_by(F.struct(*rest), place).alias("v")).select(key, "v.*").select(*new.columns)
    return existing.unionByName(first.join(existing.select(key), key, "left_anti"))


def insert_audited(new: DataFrame, key: str, action: str, actor: str, at: str) -> DataFrame:
    """Each row of ``new`` with its audit row, as one table of events ``(kind, key, payload, actor, at)``: one
    write makes both visible or neither."""
    payload = F.to_json(F.struct(*[c for c in new.columns if c not in (key, actor, at)]))
    pair = F.array(F.struct(F.lit("row").alias("kind"), payload.alias("payload")), F.struct(F.lit("audit").alias("kind"), F.lit(action).alias("payload")))
    return new.select(F.col(key).cast("string").alias("key"), F.explode(pair).alias("e"), F.col(actor).alias("actor"), F.col(at).alias("at")).select(
        "e.kind", "key", "e.payload", "actor", "at"
    )


def latest(versions: DataFrame, key: list[str], order: list) -> DataFrame:
    """Newest version of each key: a ``max_by`` that combines before the shuffle, not a window."""
    rest = [c for c in versions.columns if c not in key]
    newest = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return newest.select(*key, "v.*").select(*versions.columns)


def upsert(existing: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Latest wins; an existing row keeps its ``id``."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in (*key, "id")]
    g = both.groupBy(*key).agg(F.min_by("id", F.struct("_new", order, "id")).alias("id"), F.max_by(F.struct(*rest), F.struct("_new", order, "id")).alias("v"))
    return g.select(*key, "id", "v.*").select(*existing.columns)


def delete_cascade(parents: DataFrame, children: DataFrame, tombstones: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    gone = tombstones.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def illegal_moves(events: DataFrame, key: str, order: list, state: str, states: tuple[str, ...] = PROJECT_STATES) -> DataFrame:
    """Events whose state is not the one after the last of its key (the first one to begin with)."""
    place = F.array_position(F.array(*[F.lit(s) for s in states]), F.col(state))
    before = F.coalesce(F.lag(place).over(Window.partitionBy(key).orderBy(*order)), F.lit(0))
    return events.withColumn("_place", place).withColumn("_before", before).where(F.col("_place") != F.col("_before") + 1).drop("_place", "_before")


def illegal_results(events: DataFrame, key: str, order: list, state: str, moves: dict[str, tuple[str, ...]] = RESULT_MOVES) -> DataFrame:
    """Events whose state may not follow the one before it of the same key; the first must be the first
    of ``moves``."""
    before = F.coalesce(F.lag(state).over(Window.partitionBy(key).orderBy(*order)), F.lit(""))
    legal = F.col("_before").eqNullSafe("") & (F.col(state) == next(iter(moves)))
    for start, ends in moves.items():
        legal = legal | ((F.col("_before") == start) & F.col(state).isin(*ends))
    return events.withColumn("_before", before).where(~F.coalesce(legal, F.lit(False))).drop("_before")


def uniform(column: str, default: str):
    """The group's single value, or a default if it has several or none."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(F.lit(default))
