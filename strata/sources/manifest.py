"""Strict driver-side documents: JSON without repeated keys, batch manifests, TOML settings, receipts."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

ITEM_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}")
MOST_ITEMS = 64  # a manifest's limit is part of its contract
MOST_BYTES = 64 * 1024


def strict_json(text: str) -> dict:
    """Parses JSON; a repeated key or a non-finite number is an error."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out = {}
        for k, v in items:
            if k in out:
                raise ValueError(f"repeated key: {k}")
            out[k] = v
        return out

    def constant(name: str) -> object:
        raise ValueError(f"not a number: {name}")

    got = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    if not isinstance(got, dict):
        raise ValueError("an object is needed")
    return got


def canonical_sha256(value: dict, without: str | None = None) -> str:
    """SHA-256 of sorted, compact JSON, less one key."""
    kept = {k: v for k, v in value.items() if k != without}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def sealed(value: dict, key: str = "receipt_sha256") -> dict:
    """The receipt with its own digest."""
    return value | {key: canonical_sha256(value, key)}


def check_seal(value: dict, key: str = "receipt_sha256") -> dict:
    if value.get(key) != canonical_sha256(value, key):
        raise ValueError("the receipt's digest does not match")
    return value


def batch_items(spark: SparkSession, text: str) -> DataFrame:
    """``(position, item_id, terrain)`` of a batch manifest, in its order."""
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("the manifest is too large")
    got = strict_json(text)
    if set(got) != {"schema_version", "items"} or not isinstance(got["items"], list) or not 0 < len(got["items"]) <= MOST_ITEMS:
        raise ValueError("the manifest's fields are wrong")
    rows, seen = [], set()
    for i, item in enumerate(got["items"]):
        if not isinstance(item, dict) or set(item) != {"item_id", "terrain"}:
            raise ValueError(f"item {i}: fields are wrong")
        path = PurePosixPath(item["terrain"])
        if not ITEM_ID.fullmatch(item["item_id"]) or path.is_absolute() or ".." in path.parts:
            raise ValueError(f"item {i}: id or path is not allowed")
        if item["item_id"] in seen or str(path) in seen:
            raise ValueError(f"item {i}: repeated id or path")
        seen |= {item["item_id"], str(path)}
        rows.append((i, item["item_id"], str(path)))
    return spark.createDataFrame(rows, "position int, item_id string, terrain string")


def settings(text: str, required: dict[str, type], optional: dict[str, type] | None = None) -> dict:
    """A TOML table with exactly the known keys, each of its type."""
    got = tomllib.loads(text)
    known = required | (optional or {})
    if unknown := sorted(set(got) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    if missing := sorted(set(required) - set(got)):
        raise ValueError(f"missing settings: {', '.join(missing)}")
    for k, v in got.items():
        if not isinstance(v, known[k]) or known[k] is int and isinstance(v, bool):
            raise ValueError(f"{k}: wrong type")
    return got
