"""Fail-closed data contracts: violations as rows, admission in order, guards on public columns (CON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names that must never leave.
FORBIDDEN = ("easting", "northing", "ngr", "latitude", "longitude", "geometry", "polygon", "bbox", "bounds", "centre", "center")


def unsafe_fields(schema: T.DataType, path: str = "") -> list[str]:
    """Paths of forbidden names at any depth; case and dashes do not matter."""
    found = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            here = f"{path}.{f.name}".lstrip(".")
            if f.name.casefold().replace("-", "_") in FORBIDDEN:
                found.append(here)
            found += unsafe_fields(f.dataType, here)
    elif isinstance(schema, T.ArrayType):
        found += unsafe_fields(schema.elementType, path)
    elif isinstance(schema, T.MapType):
        found += unsafe_fields(schema.keyType, path) + unsafe_fields(schema.valueType, path)
    return found


def assert_public(df: DataFrame) -> DataFrame:
    found = unsafe_fields(df.schema)
    if found:
        raise ValueError(f"columns may not be published: {', '.join(found)}")
    return df


def row_violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(rule, key)`` of every rule a row breaks; a rule that gives NULL is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return rows.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def repeated(rows: DataFrame, column: str, rule: str) -> DataFrame:
    """``(rule, key)`` of values that occur more than once."""
    return rows.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "key")


def assert_empty(violations: DataFrame) -> None:
    """Fails with the first few violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.rule}: {r.key}" for r in found))


def input_reasons(rules: list[tuple[Column, str]]) -> Column:
    """All reasons that hold, in order, joined by ``;``."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules])), ";")


def admission(items: DataFrame, batch: str, order: str, most_items: int, most_bytes: int, most_total: int) -> DataFrame:
    """``(batch, item, status)`` in manifest order: admitted until the first item of the batch that breaks
    a rule, which names it; what follows is not reached. Columns: ``item, size, digest``."""
    w = Window.partitionBy(batch).orderBy(order)
    total = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = Window.partitionBy(batch, "digest").orderBy(order)
    fault = (
        F.when(F.row_number().over(w) > most_items, "too_many_items").when(F.col("size") > most_bytes, "item_too_large").when(total > most_total, "batch_too_large")
        .when(F.row_number().over(first) > 1, "duplicate_content")
    )
    judged = items.withColumn("_fault", fault)
    before = F.count("_fault").over(w.rowsBetween(Window.unboundedPreceding, -1))
    status = F.when(before > 0, "not_reached").when(F.col("_fault").isNotNull(), F.col("_fault")).otherwise("admitted")
    return judged.select(batch, "item", status.alias("status"))


# What an automatic result may claim and must say.
EVIDENCE_LEVELS = ("AI_OUTPUT", "AI_HYPOTHESIS")
WARNINGS = ("HUMAN_REVIEW_REQUIRED", "AUTOMATIC_EVIDENCE_ONLY")
LIMITATIONS = ("NOT_ARCHAEOLOGICAL_PROBABILITY", "NOT_ARCHAEOLOGICAL_CONFIRMATION", "E001_SCOPE_ONLY")
MESSAGES = {
    "HUMAN_REVIEW_REQUIRED": "Independent human review is required.",
    "AUTOMATIC_EVIDENCE_ONLY": "This is automatic terrain-model output only.",
    "NOT_ARCHAEOLOGICAL_PROBABILITY": "The score is not a probability that archaeology exists.",
    "NOT_ARCHAEOLOGICAL_CONFIRMATION": "The result does not confirm an archaeological site or discovery.",
    "E001_SCOPE_ONLY": "The model is limited to the documented E001 research scope.",
}
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
SLUG_LENGTH = 64
SCORE_COLUMNS = ("model_score", "prediction", "predicted_label", "probability")


MANIFEST_STAGES = ("curation", "terrain_acquisition", "dataset_freeze")
REVIEW_STATES = ("accepted", "rejected", "uncertain", "terrain_review_needed")


def coded(codes: Column, required: tuple[str, ...]) -> Column:
    """Whether a list of codes holds all required ones, none twice and no other one."""
    known = F.array(*[F.lit(c) for c in required])
    return (F.size(F.array_except(known, codes)) == 0) & (F.size(F.array_except(codes, known)) == 0) & (F.size(F.array_distinct(codes)) == F.size(codes))


def envelope_violations(rows: DataFrame, key: str, configs: dict[str, str]) -> DataFrame:
    """``(rule, key)`` of result envelopes ``(score, evidence_level, model, config, warnings, limitations)`` that may not
    leave. ``configs`` holds the approved models and the digest of each one's settings."""
    score = F.col("score")
    approved = F.lit(False)
    for model, digest in configs.items():
        approved = approved | ((F.col("model") == model) & (F.col("config") == digest))
    rules = {
        "score": score.between(0, 1) & ~F.isnan(score),
        "evidence_level": F.col("evidence_level").isin(*EVIDENCE_LEVELS),
        "model": F.col("model").rlike(SLUG) & (F.length("model") <= SLUG_LENGTH),
        "config": approved,
        "warnings": coded(F.col("warnings"), WARNINGS),
        "limitations": coded(F.col("limitations"), LIMITATIONS),
    }
    return row_violations(rows, key, rules)


def public_envelopes(rows: DataFrame, version: str) -> DataFrame:
    """What may be shown of envelopes without a violation: these fields and no other, with codes as sentences."""
    sentences = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    said = lambda c: F.transform(c, lambda code: sentences[code]).alias(c)
    return rows.select(F.lit(version).alias("schema_version"), "evidence_level", "score", "model", "config", said("warnings"), said("limitations"))


def manifest_violations(rows: DataFrame, key: str) -> DataFrame:
    """``(rule, key)`` of records ``(stage, scored boolean, record string)`` of a manifest from before scoring;
    ``record`` is a JSON object. A field is a score by its name, whatever the case."""
    names = F.transform(F.coalesce(F.json_object_keys("record"), F.array().cast("array<string>")), F.lower)
    rules = {
        "stage": F.col("stage").isin(*MANIFEST_STAGES), "pre_score": ~F.col("scored"), "record": F.json_object_keys("record").isNotNull(),
        "review_status": F.get_json_object("record", "$.review_status").isin(*REVIEW_STATES),
        "score_field": ~F.arrays_overlap(names, F.array(*[F.lit(c) for c in SCORE_COLUMNS])),
    }
    return row_violations(rows, key, rules)


def terrain_answers(items: DataFrame, frozen: DataFrame, live: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """``(key, origin, coverage, provenance, reason, status)``: each item's answer is the frozen one, else the live one
    unless that has an ``error``, else the cached one; without any it stays open, which is never a pass. The three
    tables have ``(key, coverage, provenance, reason)``, ``live`` also ``error``; a row a key at most."""
    fields = ("coverage", "provenance", "reason")
    out = items.select(key)
    for name, table in (("frozen", frozen), ("live", live.where("error IS NULL")), ("cached", cached)):
        out = out.join(table.select(key, F.struct(*fields).alias(name)), key, "left")
    out = out.join(live.where("error IS NOT NULL").select(key, "error"), key, "left")
    answer = F.coalesce("frozen", "live", "cached")
    origin = F.when(F.col("frozen").isNotNull(), "frozen").when(F.col("live").isNotNull(), "live").when(F.col("cached").isNotNull(), "cached").otherwise("none")
    status = F.when(answer["coverage"].isNull(), "needs_terrain_review").when(answer["coverage"] != "pass", "rejected").when(answer["provenance"] == "pass", "accepted").otherwise("needs_terrain_review")
    return out.select(
        key, origin.alias("origin"), F.coalesce(answer["coverage"], F.lit("needs_review")).alias("coverage"), F.coalesce(answer["provenance"], F.lit("needs_review")).alias("provenance"),
        F.coalesce(answer["reason"], F.when(answer.isNull(), F.coalesce("error", F.lit("no_answer")))).alias("reason"), status.alias("status"),
    )


def batch_results(items: DataFrame, changed: Column, fault: Column) -> DataFrame:
    """``(batch, item, status, preparation, error)``: an item that changed since it was admitted, or whose
    raster has a fault, is recorded; the others go on."""
    error = F.when(changed, "INPUT_CHANGED_AFTER_ADMISSION").otherwise(F.coalesce(fault, F.lit("NONE")))
    good = F.col("error") == "NONE"
    return items.select("batch", "item", error.alias("error")).select(
        "batch", "item", F.when(good, "FEATURES_READY").otherwise("INVALID_INPUT").alias("status"), F.when(good, "SUCCEEDED").otherwise("FAILED").alias("preparation"), "error"
    )


def batch_totals(results: DataFrame) -> DataFrame:
    """``(batch, total, accepted, invalid, status)``."""
    invalid = F.count_if(F.col("status") == "INVALID_INPUT")
    return results.groupBy("batch").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "FEATURES_READY").alias("accepted"), invalid.alias("invalid"),
        F.when(invalid == 0, "COMPLETE").otherwise("COMPLETE_WITH_INVALID_ITEMS").alias("status"),
    )


def gate_chain(status: Column, geometry: Column, duplicate: Column, coverage: Column, provenance: Column, geometry_open: str = "needs_geometry_review") -> Column:
    """Review status after the geometry gate and, for what passes, the terrain gate. A missing answer (NULL)
    is a state of review, never a rejection. ``geometry_open`` is what unclear geometry ends in."""
    terrain = (
        F.when(coverage.isNull() | provenance.isNull(), "needs_terrain_review").when(coverage == "fail", "rejected")
        .when(provenance == "pass", "accepted").otherwise("needs_terrain_review")
    )
    gate = F.when(duplicate, "rejected").when(geometry.isNull(), geometry_open).when(geometry == "fail", "rejected").when(geometry == "pass", terrain).otherwise(geometry_open)
    return F.when(status == "needs_geometry_review", gate).otherwise(status)


def encoded_label(label: Column, positive: str, background: str) -> Column:
    """1 or 0; any other label is an error."""
    return F.when(label == positive, 1).when(label == background, 0).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("NULL")))).cast("int"))


def raster_metadata_fault(crs: Column, x_resolution: Column, y_resolution: Column, bands: Column, kind: Column, expected: str = "EPSG:27700", resolution: float = 1.0, tolerance: float = 1e-6) -> Column:
    """First fault of a raster's metadata, NULL if there is none."""
    off = F.greatest(F.abs(x_resolution - resolution), F.abs(y_resolution - resolution)) > tolerance
    return (
        F.when(~F.coalesce(crs == expected, F.lit(False)), "crs_mismatch").when(F.coalesce(off, F.lit(True)), "resolution_mismatch")
        .when(~F.coalesce((bands == 1) & (kind != ""), F.lit(False)), "source_metadata_missing")
    )
