import http.server
import json
import struct
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from strata.sources import coverage
from strata.sources.coverage import FeatureSource, requested
from strata.streaming import acquisition


def serve(handle):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urllib.parse.urlparse(self.path)
            code, headers, body = handle(url.path, {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()})
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


@pytest.fixture
def features(spark):
    """Points on a grid of 5, two polygons over several tiles, one of them reaching in from outside."""
    made = [{"id": f"p{x}-{y}", "geometry": {"type": "Point", "coordinates": [x, y]}, "properties": {"kind": "point"}} for x in range(0, 101, 5) for y in range(0, 101, 5)]
    for name, a, b in (("wide", 12, 58), ("outside", -30, 22)):
        made.append({"id": name, "geometry": {"type": "Polygon", "coordinates": [[[a, a], [b, a], [b, b], [a, b], [a, a]]]}, "properties": {"kind": "area"}})
    asked, busy = [], {"left": 3}

    def handle(_, q):
        if busy["left"]:
            busy["left"] -= 1
            return (429 if busy["left"] else 503), {}, b""
        box = [float(x) for x in q["bbox"].split(",")]
        asked.append(box)
        found = [f for f in made if all(lo <= box[2 + i] and hi >= box[i] for i, lo, hi in zip((0, 1), *coverage.bounds(f["geometry"])))]
        at = int(q["offset"])
        return 200, {}, json.dumps({"features": found[at : at + int(q["limit"])]}).encode()

    server = serve(handle)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield f"http://127.0.0.1:{server.server_port}/items", asked
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    server.shutdown()


def scan(spark, address, **options):
    spark.dataSource.register(FeatureSource)
    return spark.read.format("strata_features").options(address=address, tile="20", limit="10", **options).load()


def test_bounds_go_to_the_service_and_no_tile_repeats_another(spark, features):
    address, asked = features
    rows = scan(spark, address).where("easting >= 10 AND easting <= 60 AND northing > 10 AND northing < 47.5")
    got = sorted(r.feature_id for r in rows.collect())
    assert got == sorted([f"p{x}-{y}" for x in range(10, 61, 5) for y in range(15, 46, 5)] + ["wide"])
    assert len({tuple(b) for b in asked}) == 6 and all(b[0] >= 10 and b[2] <= 60 and b[1] >= 10 and b[3] <= 47.5 for b in asked)


def test_a_box_of_options_gives_each_feature_that_reaches_into_it_once(spark, features):
    address, asked = features
    rows = scan(spark, address, left="0", bottom="0", right="60", top="40")
    got = rows.collect()
    assert sorted(r.feature_id for r in got) == sorted([f"p{x}-{y}" for x in range(0, 61, 5) for y in range(0, 41, 5)] + ["wide", "outside"])
    assert {r.properties for r in got} == {'{"kind": "point"}', '{"kind": "area"}'} and rows.rdd.getNumPartitions() == 6
    with pytest.raises(Exception, match="four bounds"):
        scan(spark, address, left="0").count()
    assert scan(spark, address, left="5", right="4", bottom="0", top="1").count() == 0
    point = scan(spark, address, left="5", right="5", bottom="5", top="5").collect()
    assert sorted(r.feature_id for r in point) == ["outside", "p5-5"]


def test_only_overloads_are_asked_again():
    codes = iter([503, 429, 200, 404])
    server = serve(lambda *_: (next(codes), {}, b"{}"))
    waits = []
    address = f"http://127.0.0.1:{server.server_port}/"
    assert coverage.answer(address, wait=waits.append) == {} and waits == [1, 2]
    with pytest.raises(OSError):
        coverage.answer(address, wait=waits.append)
    assert waits == [1, 2]
    server.shutdown()


def test_rasters_and_reasons(spark, tmp_path):
    good = b"II*\x00" + struct.pack("<4f", 1, 2, 3, 4)
    tries = {}

    def handle(path, _):
        tries[path] = tries.get(path, 0) + 1
        tiff = {"Content-Type": "image/tiff"}
        return {
            "/good": (200, tiff, good), "/late": (200, tiff, good) if tries[path] > 2 else (503, {}, b""), "/html": (200, {"Content-Type": "text/html"}, good),
            "/large": (200, tiff | {"Content-Length": "5000"}, good), "/long": (200, tiff, b"MM\x00*" + bytes(4000)), "/part": (200, tiff | {"Content-Length": "100"}, good),
            "/png": (200, tiff, b"\x89PNG" + good), "/gone": (404, {}, b""),
        }[path]

    server = serve(handle)
    names = ["good", "late", "html", "large", "long", "part", "png", "gone", None]
    items = spark.createDataFrame([(i, None, n) for i, n in enumerate(names)], "item long, expected string, path string")
    place = F.concat(F.lit(f"http://127.0.0.1:{server.server_port}/"), "path")

    def kernel(rows):
        raw = F.col("raw").isNotNull()
        return rows.withColumns({"raw_fault": F.lit(None).cast("string"), "faults": F.when(raw, F.array().cast("array<string>")), "patch_sha256": F.sha2("raw", 256), "made": F.col("raw")})

    cache = spark.createDataFrame([], "item long, raw binary, processed binary")
    run = acquisition.acquire(items, cache, kernel, lambda rows: requested(rows, place, 1000), f"file://{tmp_path}/run", pause=lambda _: None)
    got = {names[r.item]: (r.action, r.reasons[0] if r.reasons else None, r.attempts) for r in run.results.collect()}
    server.shutdown()
    assert got == {
        "good": ("downloaded", None, 1), "late": ("downloaded", None, 3), "html": ("download_failed", "unexpected_content_type", 1), "large": ("download_failed", "response_too_large", 1),
        "long": ("download_failed", "response_too_large", 1), "part": ("download_failed", "retry_exhausted_partial", 4), "png": ("download_failed", "invalid_geotiff_signature", 1),
        "gone": ("download_failed", "http_404", 1), None: ("download_failed", "no_address", 1),
    }
    assert tries["/late"] == 3 and tries["/part"] == 4 and tries["/gone"] == 1
