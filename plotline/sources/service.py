"""Feature services over HTTP as a Spark data source: a row for each answer page.

    service.register(spark)
    pages = spark.read.format("feature_service").options(url=..., west=..., south=..., east=..., north=...).load()
    features = service.page_features(pages)

A feature layer (protocol ``arcgis``) tells how many rows a box holds, and its pages are
read by one task each. A collection (``ogc``) has only links from page to page; its box
is divided into ``splits`` squares a side, each followed by a task of its own, and a
feature in several squares comes several times (see ``distinct_features``). Tasks only
fetch; Spark parses the answers.
"""

from __future__ import annotations

import gzip
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urljoin, urlsplit
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plotline.session import ship
from plotline.sources.catalog import esri_features

FORMAT = "feature_service"
PAGE_SCHEMA = "url string, format string, body string"
ARCGIS, OGC = "arcgis", "ogc"

# Fixed values of the services' protocols and of how they are read.
PAGE_ROWS = 1000
TIMEOUT_SECONDS = 60
LARGEST_ANSWER = 64 * 1024 * 1024
ATTEMPTS, WAIT_SECONDS = 3, 0.5
SHOWN_ERROR = 160
ACCEPT = "application/geo+json, application/json"


class ServiceError(RuntimeError):
    """What a service says is wrong."""


def said_error(answer: dict) -> str | None:
    """The plain text of an error answer, spaces squeezed and cut; null if it is none."""
    error = answer.get("error")
    said = None
    if isinstance(error, dict):
        details = [d for d in error.get("details") or [] if str(d).strip()]
        said = str(error.get("message") or "").strip() or (details[0] if details else None) or str(error.get("code") or "unknown error")
    elif answer.get("status") == "error":
        said = next(iter(answer.get("messages") or []), "error")
    if said is None:
        return None
    plain = " ".join(str(said).split())
    return plain if len(plain) <= SHOWN_ERROR else plain[:SHOWN_ERROR] + "..."


def fetched(url: str, timeout: float = TIMEOUT_SECONDS, largest: int = LARGEST_ANSWER, attempts: int = ATTEMPTS) -> tuple[str, dict]:
    """An answer as text and as JSON. Failures of the network and of the server are tried
    again; what the service refuses, and answers that are too long or no JSON, are errors."""
    for attempt in range(1, attempts + 1):
        try:
            with urlopen(Request(url, headers={"Accept": ACCEPT, "Accept-Encoding": "gzip"}), timeout=timeout) as answer:
                data = answer.read(largest + 1)
                packed = answer.headers.get("Content-Encoding") == "gzip"
            break
        except HTTPError as e:
            if e.code < 500 or attempt == attempts:
                raise ServiceError(f"{e.code} {e.reason}") from e
        except (URLError, TimeoutError, ConnectionError) as e:
            if attempt == attempts:
                raise ServiceError(f"no answer from {urlsplit(url).hostname}: {getattr(e, 'reason', e)}") from e
        time.sleep(WAIT_SECONDS * attempt)
    if len(data) > largest:
        raise ServiceError(f"the answer is longer than {largest} bytes")
    text = (gzip.decompress(data) if packed else data).decode("utf-8", "replace")
    try:
        parsed = json.loads(text)
    except ValueError as e:
        raise ServiceError("the server sent something other than JSON") from e
    if not isinstance(parsed, dict):
        raise ServiceError("the server sent something other than an object")
    if (error := said_error(parsed)) is not None:
        raise ServiceError(error)
    return text, parsed


@dataclass(frozen=True)
class Service:
    """What is asked of a service: a layer or collection, a box and a condition."""

    url: str
    protocol: str
    box: tuple[float, float, float, float]
    fields: str = "*"
    where: str = ""
    page: int = PAGE_ROWS
    timeout: float = TIMEOUT_SECONDS
    splits: int = 1
    limit: int | None = None

    @staticmethod
    def of(options: dict[str, str]) -> Service:
        box = tuple(float(options[k]) for k in ("west", "south", "east", "north"))
        url = options["url"].rstrip("/")
        protocol = options.get("protocol") or (OGC if "/collections/" in url else ARCGIS)
        limit = options.get("limit")
        return Service(
            url, protocol, box, options.get("fields") or "*", options.get("where") or "", int(options.get("page", PAGE_ROWS)),
            float(options.get("timeout", TIMEOUT_SECONDS)), int(options.get("splits", 1)), int(limit) if limit else None,
        )

    def query(self, form: str, offset: int | None, rows: int, count: bool = False) -> str:
        """A request to a feature layer: box, fields, condition and page are the server's work."""
        envelope = ",".join(f"{c:f}" for c in self.box)
        out = f"{self.url}/query?f={form}&geometry={quote(envelope, safe='')}&geometryType=esriGeometryEnvelope&inSR=4326&spatialRel=esriSpatialRelIntersects"
        out += f"&outFields={quote(self.fields, safe='')}&outSR=4326&where={quote(self.where or '1=1', safe='')}"
        if count:
            return out + "&returnCountOnly=true"
        return out + "&returnGeometry=true" + (f"&resultOffset={offset}&resultRecordCount={rows}" if offset is not None else "")

    def items(self) -> str:
        """The first page of a collection; what the address already asks for, such as a key, stays."""
        base, _, asked = self.url.partition("?")
        base = base if base.endswith("/items") else base + "/items"
        own = "bbox=" + ",".join(f"{c:f}" for c in self.box) + f"&limit={self.page}"
        return f"{base}?{asked}&{own}" if asked else f"{base}?{own}"

    def squares(self) -> list[Service]:
        """The service's box in ``splits`` by ``splits`` parts."""
        w, s, e, n = self.box
        at = lambda a, b, k: a + (b - a) * k / self.splits
        parts = [(at(w, e, i), at(s, n, j), at(w, e, i + 1), at(s, n, j + 1)) for i in range(self.splits) for j in range(self.splits)]
        return [Service(**{**self.__dict__, "box": p, "splits": 1}) for p in parts]


def held_back(answer: dict) -> bool:
    """Whether a page says that the server held rows back; the properties' flag comes first."""
    own = answer.get("properties")
    flag = own.get("exceededTransferLimit") if isinstance(own, dict) else None
    return bool(answer.get("exceededTransferLimit") if flag is None else flag)


def layer_page(service: Service, offset: int | None, rows: int) -> tuple[str, str, str, dict]:
    """One page (url, format, text, answer), as GeoJSON or else in the service's own form:
    old servers know no other, and it carries the clearer errors."""
    url = service.query("geojson", offset, rows)
    try:
        return url, "geojson", *fetched(url, service.timeout)
    except ServiceError as e:
        if "pagination" in str(e).lower():
            raise
        url = service.query("json", offset, rows)
        return url, "json", *fetched(url, service.timeout)


def layer_pages(service: Service, begin: int, end: int) -> Iterator[tuple[str, str, str]]:
    """The rows [begin, end) of a layer, in as many pages as the server makes of them."""
    at = begin
    while at < end:
        url, form, text, answer = layer_page(service, at, end - at)
        got = len(answer.get("features") or [])
        if not got:
            return
        yield url, form, text
        at += got


def whole_layer(service: Service) -> Iterator[tuple[str, str, str]]:
    """A layer that can't be paged: what it gives at once, which must be all."""
    url, form, text, answer = layer_page(service, None, 0)
    if held_back(answer):
        raise ServiceError("the service has no pages and holds rows back; ask for a smaller box")
    yield url, form, text


def linked_pages(service: Service) -> Iterator[tuple[str, str, str]]:
    """The pages of a collection, until one is empty, has no next one, or was seen before."""
    url, seen = service.items(), set()
    while url and url not in seen:
        seen.add(url)
        text, answer = fetched(url, service.timeout)
        if not answer.get("features"):
            return
        yield url, "geojson", text
        links = [x for x in answer.get("links") or [] if x.get("rel") == "next" and "html" not in str(x.get("type") or "")]
        url = urljoin(url, links[0]["href"]) if links else None


@dataclass
class Pages(InputPartition):
    """Rows [begin, end) of a layer, a whole layer, or a collection."""

    service: Service
    begin: int | None = None
    end: int | None = None


class ServiceReader(DataSourceReader):
    def __init__(self, service: Service):
        self.service = service

    def partitions(self) -> list[InputPartition]:
        service = self.service
        if service.protocol == OGC:
            return [Pages(s) for s in service.squares()]
        about = fetched(f"{service.url}?f=json", service.timeout)[1]
        can = (about.get("advancedQueryCapabilities") or {}).get("supportsPagination", about.get("supportsPagination", True))
        many = fetched(service.query("json", None, 0, count=True), service.timeout)[1].get("count")
        if service.limit is not None and many is not None and many > service.limit:
            raise ServiceError(f"the box holds {many} features, more than the limit of {service.limit}")
        if not can or many is None:
            return [Pages(service)]
        page = min(service.page, about.get("maxRecordCount") or service.page)
        return [Pages(service, at, min(at + page, many)) for at in range(0, many, page)] or [Pages(service, 0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple[str, str, str]]:
        if partition.service.protocol == OGC:
            return linked_pages(partition.service)
        if partition.begin is None:
            return whole_layer(partition.service)
        return self.paged(partition)

    def paged(self, partition: Pages) -> Iterator[tuple[str, str, str]]:
        """The partition's pages. A server that says only now that it has none refuses all
        tasks alike: the first one then reads the whole layer, and the others nothing."""
        try:
            yield from layer_pages(partition.service, partition.begin, partition.end)
        except ServiceError as e:
            if "pagination" not in str(e).lower():
                raise
            if partition.begin == 0:
                yield from whole_layer(partition.service)


class FeatureService(DataSource):
    """Options: url, west, south, east, north; protocol, fields, where, page, timeout,
    splits, and limit, the number of features beyond which a layer is an error."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> ServiceReader:
        return ServiceReader(Service.of(dict(self.options)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FeatureService)


def page_features(pages: DataFrame) -> DataFrame:
    """Features (id, kind, coordinates, properties) of answer pages in either form; those
    without a geometry are left out. Properties are JSON, as are coordinates."""
    feature = "struct<id:string,geometry:struct<type:string,coordinates:string>,properties:string>"
    geo = pages.where("format = 'geojson'").select(F.explode(F.from_json(F.get_json_object("body", "$.features"), f"array<{feature}>")).alias("f"))
    geo = geo.select("f.id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.coalesce("f.properties", F.lit("{}")).alias("properties"))
    own = esri_features(pages.where("format = 'json'").select(F.col("body").alias("json"))).select(F.lit(None).cast("string").alias("id"), "kind", "coordinates", "properties")
    return geo.where("kind IS NOT NULL AND coordinates IS NOT NULL").unionByName(own)


def distinct_features(features: DataFrame) -> DataFrame:
    """Each feature once: those of one id, or without one, of equal geometry and properties."""
    same: Column = F.coalesce(F.concat(F.lit("id:"), "id"), F.sha2(F.concat_ws("\u0001", "kind", "coordinates", "properties"), 256))
    one = F.min(F.struct(*[c for c in features.columns])).alias("_one")
    return features.groupBy(same.alias("_same")).agg(one).select("_one.*")
