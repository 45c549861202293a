"""The data source of feature services, on a server of our own."""

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from plotline.sources import service as S

POINTS = [(k, (k % 10) / 10, (k // 10) / 10) for k in range(57)]


def geo(rows):
    return [{"type": "Feature", "id": k, "geometry": {"type": "Point", "coordinates": [x, y]}, "properties": {"number": str(k)}} for k, x, y in rows]


class Handler(BaseHTTPRequestHandler):
    """Layers /paged, /old (only its own form), /plain (no pages), /short (held back), /bad, and the collection /collections/c."""

    failed = 0

    def log_message(self, *a):
        pass

    def answer(self, body, code=200, kind="application/json"):
        data = gzip.compress(body.encode()) if "gzip" in self.headers.get("Accept-Encoding", "") and code == 200 else body.encode()
        self.send_response(code)
        self.send_header("Content-Type", kind)
        if code == 200:
            self.send_header("Content-Encoding", "gzip")
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        url = urlsplit(self.path)
        asked = {k: v[0] for k, v in parse_qs(url.query).items()}
        layer = url.path.split("/")[1]
        if layer == "collections":
            w, s, e, n = map(float, asked["bbox"].split(","))
            rows, at = [p for p in POINTS if w <= p[1] <= e and s <= p[2] <= n], int(asked.get("start", 0))
            size = int(asked["limit"])
            links = [{"rel": "next", "type": "text/html", "href": "/nowhere"}]
            if at + size < len(rows):
                links.append({"rel": "next", "href": f"items?bbox={asked['bbox']}&limit={size}&start={at + size}&key={asked.get('key', '')}"})
            return self.answer(json.dumps({"features": geo(rows[at : at + size]), "links": links}))
        if layer == "moody" and Handler.failed < 2:
            Handler.failed += 1
            return self.answer("", 503)
        if layer == "gone":
            return self.answer("", 404)
        if layer == "page":
            return self.answer("<html><title>Sign in</title></html>", kind="text/html")
        if layer == "bad":
            return self.answer(json.dumps({"error": {"code": 499, "message": "Token   Required", "details": []}}))
        if not url.path.endswith("/query"):
            return self.answer(json.dumps({"maxRecordCount": 20, "advancedQueryCapabilities": {"supportsPagination": layer not in ("plain", "short")}}))
        if "returnCountOnly" in asked:
            return self.answer(json.dumps({"count": len(POINTS)}))
        if layer == "old" and asked["f"] == "geojson":
            return self.answer(json.dumps({"status": "error", "messages": ["Output format not supported."]}))
        if layer == "stubborn" and "resultOffset" in asked:
            return self.answer(json.dumps({"error": {"code": 400, "message": "Pagination is not supported."}}))
        at, size = int(asked.get("resultOffset", 0)), int(asked.get("resultRecordCount", len(POINTS)))
        size = min(size, 7) if layer == "paged" else size  # fewer than it says
        rows = POINTS[at : at + size]
        if asked["f"] == "json":
            return self.answer(json.dumps({"features": [{"attributes": {"number": str(k)}, "geometry": {"x": x, "y": y}} for k, x, y in rows]}))
        self.answer(json.dumps({"features": geo(rows), "properties": {"exceededTransferLimit": layer == "short"}}))


@pytest.fixture(scope="module")
def server():
    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def load(spark, url, **more):
    S.register(spark)
    return spark.read.format(S.FORMAT).options(url=url, west=0, south=0, east=1, north=1, **more).load()


def numbers(features):
    return sorted(int(r["n"]) for r in features.select(F.get_json_object("properties", "$.number").alias("n")).collect())


@pytest.mark.parametrize("layer, pages, form", [("paged", 9, "geojson"), ("old", 3, "json"), ("plain", 1, "geojson"), ("moody", 3, "geojson"), ("stubborn", 1, "geojson")])
def test_layers(spark, server, layer, pages, form):
    got = load(spark, f"{server}/{layer}").cache()
    assert got.count() == pages and {r["format"] for r in got.collect()} == {form}
    features = S.page_features(got)
    assert numbers(features) == [k for k, _, _ in POINTS] and {r["kind"] for r in features.collect()} == {"Point"}
    assert json.loads(features.first()["coordinates"]) == [0.0, 0.0]
    got.unpersist()


def test_collections(spark, server):
    whole = load(spark, f"{server}/collections/c?key=k", page=10)
    assert whole.rdd.getNumPartitions() == 1 and numbers(S.page_features(whole)) == [k for k, _, _ in POINTS]
    split = load(spark, f"{server}/collections/c", page=10, splits=2)
    many = S.page_features(split)
    assert split.rdd.getNumPartitions() == 4 and many.count() > len(POINTS)  # those on an edge come twice
    assert numbers(S.distinct_features(many)) == [k for k, _, _ in POINTS]
    assert S.distinct_features(many.withColumn("id", F.lit(None).cast("string"))).count() == len(POINTS)


@pytest.mark.parametrize("layer, said", [("short", "smaller box"), ("bad", "Token Required"), ("gone", "404"), ("page", "other than JSON")])
def test_errors(spark, server, layer, said):
    with pytest.raises(Exception, match=said):
        load(spark, f"{server}/{layer}").collect()


def test_limits(spark, server):
    with pytest.raises(Exception, match="57 features, more than the limit of 50"):
        load(spark, f"{server}/paged", limit=50).collect()
    with pytest.raises(S.ServiceError, match="longer than 100"):
        S.fetched(f"{server}/paged/query?f=geojson", largest=100)
    with pytest.raises(S.ServiceError, match="no answer from 127.0.0.1"):
        S.fetched("http://127.0.0.1:9/x", timeout=1, attempts=1)


def test_error_texts():
    assert S.said_error({"features": []}) is None
    assert S.said_error({"error": {"code": 400, "message": " ", "details": ["", "Bad  field"]}}) == "Bad field"
    assert S.said_error({"error": {"code": 400}}) == "400"
    assert S.said_error({"error": {"message": "x" * 200}}) == "x" * 160 + "..."
    assert S.held_back({"exceededTransferLimit": True}) and not S.held_back({"exceededTransferLimit": True, "properties": {"exceededTransferLimit": False}})
