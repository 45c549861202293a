"""The data source of tile archives, on a server of our own."""

import gzip
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from plotline.sources import archive as A
from plotline.sources import tiles as T
from tests.test_sources import tile, varint

ZOOM = 4


def packed_directory(rows):
    """Rows (number, offset, length, run) as an archive holds them."""
    deltas = [b - a for a, b in zip([0, *(r[0] for r in rows)], (r[0] for r in rows))]
    offsets = [0 if i and r[1] == rows[i - 1][1] + rows[i - 1][2] else r[1] + 1 for i, r in enumerate(rows)]
    return gzip.compress(varint(len(rows)) + b"".join(b"".join(map(varint, c)) for c in (deltas, [r[3] for r in rows], [r[2] for r in rows], offsets)))


def made():
    """All tiles of zoom 4 and one of zoom 3 in four leaves; the last sixteen are one run."""
    data, entries = b"", []

    def add(number, run, content):
        nonlocal data
        entries.append((number, len(data), len(content), run))
        data += content

    add(A.number_of(3, 0, 0), 1, gzip.compress(tile([(1, 1, "coarse")])))
    first = A.number_of(ZOOM, 0, 0)
    for k in range(240):
        _, x, y = T.tile_of(first + k)
        add(first + k, 1, gzip.compress(tile([(5, 5, f"{x}-{y}")])))
    add(first + 240, 16, gzip.compress(tile([(5, 5, "sea")])))
    leaves, root = b"", []
    for at in range(0, len(entries), 64):
        leaf = packed_directory(entries[at : at + 64])
        root.append((entries[at][0], len(leaves), len(leaf), 0))
        leaves += leaf
    head_root = packed_directory(root)
    leaves_at = 127 + len(head_root)
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(head_root), 0, 0, leaves_at, len(leaves), leaves_at + len(leaves), len(data))
    head += b"\0" * (97 - len(head)) + bytes([2, 2, 1, 0, ZOOM])
    return head + b"\0" * (127 - len(head)) + head_root + leaves + data


class Handler(BaseHTTPRequestHandler):
    whole = made()
    asked: list = []

    def log_message(self, *a):
        pass

    def do_GET(self):
        begin, end = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        Handler.asked.append((begin, end))
        code = 200 if self.path == "/dumb" else 206
        if self.path == "/missing":
            code = 404
        self.send_response(code)
        self.send_header("ETag", f'"{begin if self.path == "/changing" else 1}"')
        self.end_headers()
        self.wfile.write(self.whole[begin : end + 1])


@pytest.fixture(scope="module")
def server():
    made_server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made_server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made_server.server_port}"
    made_server.shutdown()


def load(spark, url, **more):
    A.register(spark)
    return spark.read.format(A.FORMAT).options(url=url, **more).load()


def test_numbers_go_both_ways():
    assert all(T.tile_of(A.number_of(z, x, y)) == (z, x, y) for z in range(5) for x in range(1 << z) for y in range(1 << z))


def test_whole_archive(spark, server):
    got = load(spark, f"{server}/a#layer", partitions=3)
    assert got.rdd.getNumPartitions() == 2  # two entries each
    rows = got.collect()
    assert sorted((r["tx"], r["ty"]) for r in rows) == [(x, y) for x in range(16) for y in range(16)] and {r["zoom"] for r in rows} == {ZOOM}
    numbers = [r["props"]["number"] for r in T.decode_points(got).collect()]
    assert numbers.count("sea") == 16 and len(set(numbers)) == 241 and "coarse" not in numbers


def test_box(spark, server):
    Handler.asked.clear()
    rows = load(spark, f"{server}/a", west=-179, south=70, east=-130, north=80).collect()
    x0, x1, y0, y1 = A.cover((-179, 70, -130, 80), ZOOM)
    assert sorted((r["tx"], r["ty"]) for r in rows) == [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
    assert (x0, x1, y0, y1) == (0, 2, 1, 3)


def test_neighbours_are_fetched_together(monkeypatch):
    monkeypatch.setattr(A, "GAP_BYTES", 10)
    monkeypatch.setattr(A, "RANGE_BYTES", 100)
    entries = [(1, 0, 40, 1), (2, 45, 40, 1), (3, 85, 40, 1), (4, 200, 400, 1)]
    assert [[e[0] for e in g] for g in A.fetch_groups(entries[::-1])] == [[1, 2], [3], [4]] and not list(A.fetch_groups([]))


@pytest.mark.parametrize("path, said", [("dumb", "whole files"), ("changing", "changed"), ("missing", "404")])
def test_errors(spark, server, path, said):
    with pytest.raises(Exception, match=said):
        load(spark, f"{server}/{path}").collect()
