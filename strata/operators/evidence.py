"""Published figures as a sealed receipt, and their reproduction from the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.index import content_digest
from ..sources.manifest import check_seal, sealed
from . import metrics, resample


def published_figures(rows: DataFrame, unit: str, replicates: int, seed: str) -> dict:
    """Counts, metrics, bootstrap intervals and outcome of ``rows(<unit>, label, predicted, score)`` with a digest
    of the rows, sealed by a digest of its own."""
    c = metrics.confusion(rows, []).first()
    figures = {k: float(c[k]) for k in ("tn", "fp", "fn", "tp")} | {k: c[k] for k in ("balanced_accuracy", "accuracy", "f1")}
    for r in resample.group_bootstrap(rows, unit, replicates, seed).collect():
        figures |= {f"{r.metric}_low": r.low, f"{r.metric}_high": r.high, f"{r.metric}_undefined": float(r.undefined)}
    ends = [F.lit(figures[k]) for k in ("balanced_accuracy", "balanced_accuracy_low", "balanced_accuracy_high")]
    read = metrics.external_outcome(ends[0], F.least(ends[0], ends[1]), F.greatest(ends[0], ends[2]), F.lit(int(c.tn + c.fp + c.fn + c.tp)))
    outcome = rows.sparkSession.range(1).select(read.alias("o")).first().o
    return sealed({"figures": figures, "outcome": outcome, "rows": rows.select(content_digest(rows).alias("d")).first().d})


def reproduced(receipt: dict, rows: DataFrame, unit: str, replicates: int, seed: str) -> DataFrame:
    """``(figure, published, again, agrees)``: a sealed receipt against the same figures from ``rows``. A receipt
    that was changed after it was sealed is an error; rows that were changed show in ``rows`` at least."""
    check_seal(receipt)
    again = published_figures(rows, unit, replicates, seed)
    names = sorted(set(receipt["figures"]) | set(again["figures"]))
    found = [(k, receipt["figures"].get(k), again["figures"].get(k), receipt["figures"].get(k) == again["figures"].get(k)) for k in names]
    found += [(k, None, None, receipt[k] == again[k]) for k in ("outcome", "rows")]
    return rows.sparkSession.createDataFrame(found, "figure string, published double, again double, agrees boolean")
