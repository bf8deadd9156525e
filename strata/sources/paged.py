"""Paged records as a Spark data source, read on the executors.

``format("strata_paged")`` reads JSON pages named ``page-000000.json`` and so on from ``base`` (folder or http
address), one partition for each of ``pages``; ``where`` (``field=value``) is checked here.

``format("strata_offset")`` reads a record service at ``address`` by offsets. The number of records is asked of
the service first (``returnCountOnly``), and ``where`` goes to it as it is, so that only matching records travel;
each partition takes ``page_size`` of them and fails if the service gives fewer than its share.

A request that fails is tried again ``tries`` times, waiting min(8, 2^k) seconds.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MOST_RECORDS = 2_000


def fetch(address: str, tries: int) -> object:
    """The JSON document at an address."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(address, timeout=30) as got:
                return json.loads(got.read())
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(min(8, 2**k))
    return None


class Page(InputPartition):
    def __init__(self, number: int, size: int = 0):
        self.number, self.size = number, size


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.base = options["base"].rstrip("/")
        self.pages = int(options["pages"])
        self.tries = int(options.get("tries", "5"))
        self.where = options.get("where", "")

    def partitions(self) -> list[InputPartition]:
        return [Page(i) for i in range(self.pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        field, _, value = self.where.partition("=")
        address = f"{self.base}/page-{partition.number:06d}.json"
        for record in fetch(address if "://" in address else f"file://{address}", self.tries):
            if not field or str(record.get(field)) == value:
                yield tuple(record.get(n) for n in self.names)


class OffsetReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.address = options["address"]
        self.where = options.get("where", "1=1")
        self.size = min(MOST_RECORDS, int(options.get("page_size", MOST_RECORDS)))
        self.tries = int(options.get("tries", "5"))

    def ask(self, **parameters: object) -> dict:
        return fetch(f"{self.address}?{urllib.parse.urlencode({'where': self.where, 'f': 'json', **parameters})}", self.tries)

    def partitions(self) -> list[InputPartition]:
        count = int(self.ask(returnCountOnly="true")["count"])
        return [Page(at, min(self.size, count - at)) for at in range(0, count, self.size)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one partition where nothing matches
            return
        found = self.ask(resultOffset=partition.number, resultRecordCount=partition.size, outFields=",".join(self.names))["features"]
        if len(found) != partition.size:
            raise OSError(f"{partition.size} records were due at offset {partition.number}, {len(found)} came")
        for record in found:
            yield tuple(record["attributes"].get(n) for n in self.names)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strata_paged"

    def schema(self) -> str:
        return "list_entry long, name string, easting double, northing double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


class OffsetSource(PagedSource):
    @classmethod
    def name(cls) -> str:
        return "strata_offset"

    def reader(self, schema: StructType) -> DataSourceReader:
        return OffsetReader(schema, self.options)


def record_count(address: str, where: str = "1=1", tries: int = 5) -> int:
    """Number of matching records, counted by the service."""
    return int(OffsetReader(StructType(), {"address": address, "where": where, "tries": str(tries)}).ask(returnCountOnly="true")["count"])
