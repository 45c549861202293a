"""Tile archives over HTTP as a Spark data source, read by ranges: a row for each tile.

    archive.register(spark)
    tiles = spark.read.format("tile_archive").options(url=..., west=..., south=..., east=..., north=...).load()

Planning reads the header and the root directory. Each task takes some of the root's
entries, reads their leaf directories, and of the tiles of the highest zoom those that
meet the box, neighbours in one request. No task holds more than a range.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plotline.session import ship
from plotline.sources.service import ATTEMPTS, TIMEOUT_SECONDS, WAIT_SECONDS, ServiceError
from plotline.sources.tiles import directory, header, plain, tile_of

FORMAT = "tile_archive"
TILE_SCHEMA = "zoom int, tx long, ty long, tile binary"
#: Header and root directory lie within the first bytes of an archive.
HEAD_BYTES = 16384
#: Tiles are fetched together across gaps of this many bytes, up to so many bytes at once.
GAP_BYTES, RANGE_BYTES = 65536, 8 * 1024 * 1024
PARTITIONS = 64

Entry = tuple[int, int, int, int]


class ArchiveChanged(ServiceError):
    """The archive is no longer the one that the read was planned on."""


def ranged(url: str, begin: int, size: int, tag: str | None = None) -> tuple[bytes, str | None]:
    """Bytes of a file on a server, and the file's version tag. Servers that send whole
    files are refused, and so is a file of another version."""
    asked = Request(url, headers={"Range": f"bytes={begin}-{begin + size - 1}"})
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with urlopen(asked, timeout=TIMEOUT_SECONDS) as answer:
                if answer.status != 206:
                    raise ServiceError("the server sends whole files only")
                found = answer.headers.get("ETag")
                if tag is not None and found is not None and found != tag:
                    raise ArchiveChanged("the archive changed while it was read")
                return answer.read(size), found
        except HTTPError as e:
            if e.code == 416:
                raise ArchiveChanged("the archive is shorter than it was") from e
            if e.code < 500 or attempt == ATTEMPTS:
                raise ServiceError(f"{e.code} {e.reason}") from e
        except (URLError, TimeoutError, ConnectionError) as e:
            if attempt == ATTEMPTS:
                raise ServiceError(f"no answer: {getattr(e, 'reason', e)}") from e
        time.sleep(WAIT_SECONDS * attempt)
    raise AssertionError


def number_of(zoom: int, x: int, y: int) -> int:
    """A tile's number along the Hilbert curves of all zooms."""
    number = ((1 << (2 * zoom)) - 1) // 3
    for level in range(zoom - 1, -1, -1):
        s = 1 << level
        rx, ry = (x >> level) & 1, (y >> level) & 1
        number += s * s * ((3 * rx) ^ ry)
        x, y = x & (s - 1), y & (s - 1)
        if ry == 0:
            x, y = (s - 1 - y, s - 1 - x) if rx else (y, x)
    return number


def cover(box: tuple[float, float, float, float], zoom: int) -> tuple[int, int, int, int]:
    """Columns and rows (first and last) of the tiles that a box of degrees meets."""
    n = 1 << zoom
    west, south, east, north = box
    column = lambda lon: max(0, min(n - 1, math.floor((lon + 180) / 360 * n)))

    def row(lat: float) -> int:
        r = math.radians(max(-85.06, min(85.06, lat)))
        return max(0, min(n - 1, math.floor((1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * n)))

    return column(west), column(east), row(north), row(south)


def fetch_groups(entries: list[Entry]) -> Iterator[list[Entry]]:
    """Entries in the order of their bytes, those together that one request fetches."""
    group: list[Entry] = []
    for e in sorted(entries, key=lambda e: e[1]):
        if group and (e[1] - (group[-1][1] + group[-1][2]) > GAP_BYTES or e[1] + e[2] - group[0][1] > RANGE_BYTES):
            yield group
            group = []
        group.append(e)
    if group:
        yield group


@dataclass
class Entries(InputPartition):
    """Some entries of the root directory."""

    entries: list[Entry] = field(default_factory=list)


class ArchiveReader(DataSourceReader):
    def __init__(self, url: str, box: tuple[float, float, float, float] | None, parts: int):
        self.url, self.parts = url, parts
        first, self.tag = ranged(url, 0, HEAD_BYTES)
        self.head = header(first)
        self.zoom = self.head["max_zoom"]
        self.within = cover(box, self.zoom) if box else None
        at, size = self.head["root"], self.head["root_size"]
        data = first[at : at + size] if at + size <= len(first) else self.bytes(at, size)
        self.root = directory(plain(data, self.head["inner"]))

    def bytes(self, begin: int, size: int) -> bytes:
        return ranged(self.url, begin, size, self.tag)[0]

    def partitions(self) -> list[InputPartition]:
        """Entries that may have tiles of the highest zoom, dealt out in order."""
        least = number_of(self.zoom, 0, 0)
        ends = [e[0] + e[3] if e[3] else (self.root[i + 1][0] if i + 1 < len(self.root) else None) for i, e in enumerate(self.root)]
        useful = [e for e, end in zip(self.root, ends) if end is None or end > least]
        size = max(1, -(-len(useful) // self.parts))
        return [Entries(useful[k : k + size]) for k in range(0, len(useful), size)] or [Entries()]

    def wanted(self, number: int) -> tuple[int, int, int] | None:
        zoom, x, y = tile_of(number)
        if zoom != self.zoom:
            return None
        if self.within is None:
            return zoom, x, y
        x0, x1, y0, y1 = self.within
        return (zoom, x, y) if x0 <= x <= x1 and y0 <= y <= y1 else None

    def tiles(self, entries: list[Entry]) -> Iterator[Entry]:
        """Entries of tiles, those of leaves in their place."""
        for e in entries:
            if e[3]:
                yield e
            else:
                yield from self.tiles(directory(plain(self.bytes(self.head["leaves"] + e[1], e[2]), self.head["inner"])))

    def read(self, partition: Entries) -> Iterator[tuple[int, int, int, bytes]]:
        found = [e for e in self.tiles(partition.entries) if any(self.wanted(e[0] + i) for i in range(e[3]))]
        for group in fetch_groups(found):
            begin = group[0][1]
            data = self.bytes(self.head["tiles"] + begin, max(e[1] + e[2] for e in group) - begin)
            for number, offset, length, run in group:
                tile = plain(data[offset - begin : offset - begin + length], self.head["outer"])
                for place in filter(None, (self.wanted(number + i) for i in range(run))):
                    yield *place, tile


class TileArchive(DataSource):
    """Options: url; west, south, east, north for the tiles of a box; partitions."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TILE_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        sides = [self.options.get(k) for k in ("west", "south", "east", "north")]
        box = tuple(map(float, sides)) if all(s is not None for s in sides) else None
        return ArchiveReader(self.options["url"].partition("#")[0], box, int(self.options.get("partitions", PARTITIONS)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TileArchive)
