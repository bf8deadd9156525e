"""Features and rasters of a map service, asked for by place and read on the executors.

``format("strata_features")`` reads features from ``address``. Comparisons of ``easting`` and ``northing`` with
numbers are pushed to the service as the box it is asked for (``spark.sql.python.filterPushdown.enabled`` must be
true); bounds may also be the options ``left, bottom, right, top``. The box is cut into tiles of ``tile``
units, a partition each; a tile is asked for in pages of ``limit`` features. A feature that reaches into several
tiles is given by the one that holds the lower left corner of what it shares with the box, so no two tiles give the
same one and nothing has to be made distinct. Points on an edge belong to one tile only, and to the box.

``requested`` asks for one raster a row and gives its content or the reason why there is none, for
``strata.streaming.acquisition``.
"""

from __future__ import annotations

import http.client
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

# Answers that are asked for again, features a page, tries, types and first bytes of a raster, its most bytes.
AGAIN = (429, 500, 502, 503, 504)
LIMIT, TRIES = 100, 5
RASTER_TYPES = ("image/tiff", "image/geotiff")
RASTER_STARTS = (b"II*\x00", b"MM\x00*")
MOST_BYTES = 8 * 1024 * 1024
MOST_TILES = 100_000
AXES = {"easting": 0, "northing": 1}


def answer(address: str, tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> dict:
    """The JSON document at an address; overloads and network faults are waited for min(8, 2^k) seconds."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(address, timeout=60) as got:
                return json.loads(got.read())
        except urllib.error.HTTPError as fault:
            if fault.code not in AGAIN or k + 1 == tries:
                raise
        except (OSError, http.client.HTTPException):
            if k + 1 == tries:
                raise
        wait(min(8, 2**k))
    raise ValueError("tries must be positive")


@dataclass
class Tile(InputPartition):
    """A tile of the box: ``low`` and ``high`` corners, and on which axes ``high`` is the box's own edge."""

    low: tuple[float, float]
    high: tuple[float, float]
    last: tuple[bool, bool]

    def __post_init__(self):
        super().__init__(self.low)

    def holds(self, place: tuple[float, float]) -> bool:
        return all(a <= x < b or (end and x == b) for a, x, b, end in zip(self.low, place, self.high, self.last))


def bounds(geometry: dict) -> tuple[tuple[float, float], tuple[float, float]]:
    """Lower left and upper right corner of any geometry."""
    places: list = []
    open_ = [geometry["coordinates"]]
    while open_:
        part = open_.pop()
        if isinstance(part[0], (int, float)):
            places.append(part)
        else:
            open_.extend(part)
    return tuple(min(p[a] for p in places) for a in (0, 1)), tuple(max(p[a] for p in places) for a in (0, 1))


class FeatureReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.address = options["address"]
        self.low = [float(options.get(k, "-inf")) for k in ("left", "bottom")]
        self.high = [float(options.get(k, "inf")) for k in ("right", "top")]
        self.tile = float(options.get("tile", "10000"))
        self.limit = int(options.get("limit", LIMIT))
        self.tries = int(options.get("tries", TRIES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes bounds of the two axes into the box. Spark checks all of them again: a feature is asked for by
        its extent, and its own place may lie outside."""
        for f in filters:
            axis = AXES.get(f.attribute[0]) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 else None
            if axis is not None and isinstance(f.value, (int, float)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[axis] = max(self.low[axis], float(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[axis] = min(self.high[axis], float(f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        if not all(map(math.isfinite, [*self.low, *self.high])):
            raise ValueError("a scan needs all four bounds, as filters on easting and northing or as options")
        if any(a > b for a, b in zip(self.low, self.high)):
            return []
        counts = [max(1, math.ceil((b - a) / self.tile)) for a, b in zip(self.low, self.high)]
        if counts[0] * counts[1] > MOST_TILES:
            raise ValueError(f"{counts[0] * counts[1]} tiles: take larger ones")
        out = []
        for i in range(counts[0]):
            for j in range(counts[1]):
                ends = (i + 1 == counts[0], j + 1 == counts[1])
                low = (self.low[0] + i * self.tile, self.low[1] + j * self.tile)
                out.append(Tile(low, tuple(self.high[a] if ends[a] else low[a] + self.tile for a in (0, 1)), ends))
        return out

    def read(self, partition: Tile | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one partition of a scan without any
            return
        at = 0
        while True:
            asked = {"bbox": ",".join(map(repr, (*partition.low, *partition.high))), "limit": self.limit, "offset": at, "f": "json"}
            found = answer(f"{self.address}?{urllib.parse.urlencode(asked)}", self.tries).get("features", [])
            for feature in found:
                low, high = bounds(feature["geometry"])
                inside = tuple(max(x, b) for x, b in zip(low, self.low))
                if partition.holds(inside):
                    fields = feature.get("properties") or {}
                    made = {"feature_id": str(feature["id"]), "easting": float(low[0]), "northing": float(low[1]), "right": float(high[0]), "top": float(high[1])}
                    made["properties"] = json.dumps(fields, sort_keys=True)
                    yield tuple(made.get(n) if n in made else fields.get(n) for n in self.names)
            at += len(found)
            if len(found) < self.limit:
                return


class FeatureSource(DataSource):
    """Features with ``easting, northing, right, top``, the corners of their extents, and ``properties`` as JSON."""

    @classmethod
    def name(cls) -> str:
        return "strata_features"

    def schema(self) -> str:
        return "feature_id string, easting double, northing double, right double, top double, properties string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeatureReader(schema, self.options)


def raster(address: str, most_bytes: int = MOST_BYTES, timeout: float = 90) -> tuple[str | None, bytes | None]:
    """``(reason, content)`` of one request: the reason why the answer is no raster, or its bytes."""
    try:
        with urllib.request.urlopen(address, timeout=timeout) as got:
            if got.headers.get_content_type() not in RASTER_TYPES:
                return "unexpected_content_type", None
            length = got.headers.get("Content-Length")
            if length and int(length) > most_bytes:
                return "response_too_large", None
            content = b""
            while len(content) <= most_bytes and (more := got.read(min(1 << 20, most_bytes + 1 - len(content)))):
                content += more
    except urllib.error.HTTPError as fault:
        return f"http_{fault.code}", None
    except (OSError, http.client.HTTPException):
        return "network", None
    if len(content) > most_bytes:
        return "response_too_large", None
    if length and len(content) != int(length):
        return "partial_response", None
    if not content.startswith(RASTER_STARTS):
        return "invalid_geotiff_signature", None
    return None, content


def requested(rows: DataFrame, address: Column, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds ``reason`` and ``raw``, the answer at each row's ``address``. One request a row; tries are the caller's
    rounds. A task gives every answer on as it comes."""
    named = rows.withColumn("_address", address)
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(batch.schema.get_field_index("_address")).to_pylist()
            rest = batch.select(kept)
            for i, place in enumerate(places):
                reason, content = ("no_address", None) if place is None else raster(place, most_bytes)
                one = rest.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([reason], pa.string()), pa.array([content], pa.binary())], names=[*kept, "reason", "raw"])

    return named.mapInArrow(run, StructType(rows.schema.fields).add("reason", "string").add("raw", "binary"))
