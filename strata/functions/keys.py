"""Keys: grid cells, opaque ids, hash ranks and hash draws. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and prefixes of published ids.
CELL_PREFIX = "BNG"
UNAVAILABLE = "UNAVAILABLE"
SAMPLE_PREFIX = "E001P-"
COMPONENT_PREFIX = "E001O-"
PROVENANCE_PREFIX = "EAP-"
DEFAULT_SAMPLE_SEED = "E001-Phase-2A-2026-08-27"


def grid_cell(easting: Column, northing: Column, size_km: int = 100) -> Column:
    """Coarse cell id; floors, so negative coordinates go to the cell below. NULL gives a sentinel."""
    if size_km <= 0:
        raise ValueError("size_km must be positive")
    size = size_km * 1000

    def index(v: Column) -> Column:
        return F.floor(v / F.lit(float(size))).cast("bigint").cast("string")

    cell = F.concat(F.lit(f"{CELL_PREFIX}_{size_km}KM_E"), index(easting), F.lit("_N"), index(northing))
    return F.when(easting.isNull() | northing.isNull(), F.lit(UNAVAILABLE)).otherwise(cell)


def cell_indices(cell: Column) -> tuple[Column, Column]:
    """East and north index of a cell id; NULL if it is none."""
    pattern = r"_E(-?\d+)_N(-?\d+)$"
    found = cell.rlike(pattern)
    return tuple(F.when(found, F.regexp_extract(cell, pattern, k).cast("bigint")) for k in (1, 2))


def sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def opaque_id(prefix: str, version: str, key: Column) -> Column:
    """Prefix and the first 12 hex digits of the hash of ``version:key``."""
    return F.concat(F.lit(prefix), F.substring(sha(version, ":", key), 1, 12))


def provenance_id(year: Column, resolution: Column, programme: Column, dataset: Column) -> Column:
    text = F.concat_ws("|", *[c.cast("string") for c in (year, resolution, programme, dataset)])
    return F.concat(F.lit(PROVENANCE_PREFIX), F.substring(F.sha2(text, 256), 1, 12))


def hash_rank(seed: str, key: Column) -> Column:
    """Sort key that stands in for a random number: ascending, full hex digest."""
    return sha(seed, ":", key)


def unit_draw(digest: Column, first: int = 1, digits: int = 16) -> Column:
    """``digits`` hex digits of a digest from place ``first`` as a share of their range, in [0, 1)."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(16**digits))


def related_unit(component: Column, group: Column) -> Column:
    """Overlap component if there is one (not empty), else the observation group."""
    return F.coalesce(F.nullif(component, F.lit("")), group)


def window_token(salt: str, row: Column, col: Column, size: Column) -> Column:
    if len(salt) < 16:
        raise ValueError("salt needs 16 characters or more")
    return F.sha2(F.concat_ws(":", F.lit(salt), row.cast("string"), col.cast("string"), size.cast("string")), 256)
