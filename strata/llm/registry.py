"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op5_benchmark_decontamination
from .embeddings import OP7_SQL, op7_embedding_near_dedup
from .html import op2_html_extraction
from .infilling import OP12_SQL, op12_fill_in_middle
from .langid import op3_language_id
from .mixing import op8_source_mixing
from .pii import op4_pii
from .secrets import op9_secret_scan
from .sharding import OP13_SQL, op13_sharding
from .simhash import op10_simhash_near_dedup
from .tokens import op1_token_output
from .toxicity import op6_toxicity
from .whitening import op11_embedding_whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = (
        op1_token_output, op2_html_extraction, op3_language_id, op4_pii, op5_benchmark_decontamination, op6_toxicity, op7_embedding_near_dedup, op8_source_mixing, op9_secret_scan,
        op10_simhash_near_dedup, op11_embedding_whitening, op12_fill_in_middle, op13_sharding,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_embedding_near_dedup": OP7_SQL, "op12_fill_in_middle": OP12_SQL, "op13_sharding": OP13_SQL}
