"""Tile archives and vector tiles, read as binary files and decoded in tasks of their own.

``read_archive`` lists an archive's tiles; ``decode_points`` turns tiles into points.
"""

from __future__ import annotations

import gzip
import math
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.session import ship

HEADER_BYTES = 127
#: A task passes on so many points of a tile at once, whatever the tile holds.
AT_ONCE = 10_000


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number is cut short")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a message: ints, or bytes of known length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
            yield number, value
        elif kind in (1, 2, 5):
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("a field is cut short")
            yield number, data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown kind of field {kind}")


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = varint(data, at)
        out.append(n)
    return out


def tag_value(data: bytes) -> str:
    for number, v in fields(data):
        if number == 1:
            return v.decode()
        if number == 2:
            return str(struct.unpack("<f", v)[0])
        if number == 3:
            return str(struct.unpack("<d", v)[0])
        if number in (4, 5):
            return str(v - (1 << 64) if v >> 63 else v)
        if number == 6:
            return str(zigzag(v))
        if number == 7:
            return "true" if v else "false"
    return ""


def layers(tile: bytes) -> Iterator[tuple[str, int, Iterator[tuple[int, dict, list[int]]]]]:
    """Name, extent and features (type, tags, geometry commands) of each layer of a tile."""

    def found(parts: list, keys: list[str], values: list[str]) -> Iterator[tuple[int, dict, list[int]]]:
        for n, feature in parts:
            if n == 2:
                own = dict(fields(feature))
                pairs = packed(own.get(2, b""))
                yield own.get(3, 0), {keys[k]: values[v] for k, v in zip(pairs[::2], pairs[1::2])}, packed(own.get(4, b""))

    for number, layer in fields(tile):
        if number != 3:
            continue
        parts = list(fields(layer))
        name = next((v.decode() for n, v in parts if n == 1), "")
        extent = next((v for n, v in parts if n == 5), 4096)
        keys, values = [v.decode() for n, v in parts if n == 3], [tag_value(v) for n, v in parts if n == 4]
        yield name, extent, found(parts, keys, values)


def points(commands: list[int]) -> Iterator[tuple[int, int]]:
    """Positions of a point feature's move commands."""
    at = x = y = 0
    while at < len(commands):
        command, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if command != 1:
            return
        for _ in range(count):
            x, y = x + zigzag(commands[at]), y + zigzag(commands[at + 1])
            at += 2
            yield x, y


def directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """Entries (tile id, offset, length, run length) of an archive's directory."""
    n, at = varint(data, 0)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = varint(data, at)
            column.append(v)
        columns.append(column)
    ids, runs, lengths, raw = list(accumulate(columns[0])), columns[1], columns[2], columns[3]
    offsets: list[int] = []
    for i, v in enumerate(raw):
        offsets.append(offsets[-1] + lengths[i - 1] if v == 0 and i else v - 1)
    return list(zip(ids, offsets, lengths, runs))


def find(entries: list[tuple[int, int, int, int]], tile: int) -> tuple[int, int, int, int] | None:
    """The entry of a tile: its own, one whose run covers it, or the leaf that may hold it."""
    i = bisect_right([e[0] for e in entries], tile) - 1
    if i < 0:
        return None
    entry = entries[i]
    return entry if entry[3] == 0 or tile < entry[0] + entry[3] else None


def tile_of(number: int) -> tuple[int, int, int]:
    """Zoom, x and y of a tile's number along the Hilbert curves of all zooms."""
    zoom = 0
    while number >= 1 << (2 * zoom):
        number -= 1 << (2 * zoom)
        zoom += 1
    x = y = 0
    for level in range(zoom):
        s = 1 << level
        rx = 1 & (number >> 1)
        ry = 1 & (number ^ rx)
        if ry == 0:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, number = x + s * rx, y + s * ry, number >> 2
    return zoom, x, y


def header(data: bytes) -> dict[str, int]:
    """Places and kinds from an archive's first bytes; ValueError if it can't be read here."""
    if len(data) < HEADER_BYTES or data[:7] != b"PMTiles" or data[7] != 3:
        raise ValueError("no tile archive of version 3")
    names = ("root", "root_size", "meta", "meta_size", "leaves", "leaves_size", "tiles", "tiles_size")
    out = dict(zip(names, struct.unpack_from("<8Q", data, 8)))
    out |= {"inner": data[97], "outer": data[98], "type": data[99], "min_zoom": data[100], "max_zoom": data[101]}
    if out["inner"] not in (1, 2) or out["outer"] not in (1, 2) or out["type"] != 1 or out["max_zoom"] > 26:
        raise ValueError("an archive of another kind")
    return out


def plain(data: bytes, compression: int) -> bytes:
    return gzip.decompress(data) if compression == 2 else data


def archive_tiles(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Zoom, x, y and bytes of the tiles of the highest zoom."""
    h = header(data)

    def walk(entries):
        for number, offset, length, run in entries:
            if run == 0:
                at = h["leaves"] + offset
                yield from walk(directory(plain(data[at : at + length], h["inner"])))
            for i in range(run):
                yield number + i, data[h["tiles"] + offset : h["tiles"] + offset + length]

    for number, tile in walk(directory(plain(data[h["root"] : h["root"] + h["root_size"]], h["inner"]))):
        zoom, x, y = tile_of(number)
        if zoom == h["max_zoom"]:
            yield zoom, x, y, plain(tile, h["outer"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows (zoom, tx, ty, tile) of the archives under ``path``, one task per archive.

    Spark's binary reader holds one file in memory; archives beyond a task's memory have
    to be cut by zoom and area where they are made.
    """
    ship(spark)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for row in archive_tiles(bytes(content)):
                    yield pd.DataFrame([row], columns=["zoom", "tx", "ty", "tile"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "zoom int, tx long, ty long, tile binary")


def decode_points(tiles: DataFrame) -> DataFrame:
    """Points (lon, lat, props, layer, seam, edge) of vector tiles (zoom, tx, ty, tile).

    Points of a tile's buffer are dropped. ``seam`` marks points on the far edges, which
    the next tile has too, ``edge`` those on the near ones. A task holds one tile's features
    as bytes, and ``AT_ONCE`` of its points.
    """
    ship(tiles.sparkSession)

    def places(zoom: int, tx: int, ty: int, tile: bytes) -> Iterator[tuple]:
        n = 1 << zoom
        for name, extent, found in layers(tile):
            for kind, props, commands in found:
                for x, y in points(commands) if kind == 1 else ():
                    if 0 <= x <= extent and 0 <= y <= extent:
                        lon = (tx + x / extent) / n * 360 - 180
                        lat = math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (ty + y / extent) / n))))
                        yield lon, lat, props, name, x == extent or y == extent, x == 0 or y == 0

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                found = places(t.zoom, t.tx, t.ty, bytes(t.tile))
                while rows := list(islice(found, AT_ONCE)):
                    yield pd.DataFrame(rows, columns=["lon", "lat", "props", "layer", "seam", "edge"])

    return tiles.mapInPandas(run, "lon double, lat double, props map<string,string>, layer string, seam boolean, edge boolean")


def without_seams(points_df: DataFrame) -> DataFrame:
    """Of a point that two tiles hold on their seam, one: a far-edge point stays only if no
    near-edge point has its place and properties, and then once."""
    place = [F.round("lon", 9).alias("_lon"), F.round("lat", 9).alias("_lat"), F.to_json(F.array_sort(F.map_entries("props"))).alias("_props"), F.col("layer").alias("_layer")]
    seam = points_df.where("seam").withColumns({c: x for c, x in zip(("_lon", "_lat", "_props", "_layer"), place)}).dropDuplicates(["_lon", "_lat", "_props", "_layer"])
    edge = points_df.where("edge AND NOT seam").select(*[x.alias(c) for c, x in zip(("_a", "_b", "_c", "_d"), place)]).distinct()
    kept = seam.join(edge, (F.col("_lon") == F.col("_a")) & (F.col("_lat") == F.col("_b")) & (F.col("_props") == F.col("_c")) & (F.col("_layer") == F.col("_d")), "left_anti")
    return points_df.where("NOT seam").unionByName(kept.select(*points_df.columns))
