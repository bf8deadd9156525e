"""A training-data pipeline over ``documents``: toxicity, near-duplicates, benchmark passages, source
mixing, token output. Each stage works on what the one before it kept, reread from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import decontamination, mixing, simhash, tokens, toxicity
from strata.llm.common import drop_table, materialize, scratch, table

#: Settings of the mix, such as ``weights``; both stages that follow its schedule take them.
MIX: dict = {}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, fitted on labelled rows of ``docs``, doesn't reject."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(4, 2))
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies (five-word shingles, similarity 0.8 or more)."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule of their sources."""
    return mixing.mixed_documents(docs, **MIX)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the wavelet matrix shards of the documents hold: ids, places and checksums. Shards follow the
    schedule of the mix: files keep no order, but the same documents get the same places again."""
    return tokens.tokenized(mixing.placed_documents(docs, **MIX), order_col="_place")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]
#: The fitted grammar, the fingerprints and the schedule are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch() as keep:  # what a stage wrote on its way goes with it
            docs = keep(materialize(stage(spark, before, sf_dir), f"pipeline-{name}"))
        drop_table(before)
    return docs
