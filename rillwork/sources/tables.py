"""Readers with given schemas."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import last_segment, normal_name
from . import retrieval
from .files import listed, store

READINGS = "station_name string, date string, dateTime timestamp, value double, quality string, measure string"


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file or folder with a header, of the schema's types; bad fields are null."""
    df = spark.read.schema(schema).csv(path, header=True, encoding=encoding)
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, folder: str, schema: str, suffix: str = "trimmed.csv") -> DataFrame:
    """All CSV files of a folder whose names end so, with ``file``."""
    df = spark.read.schema(schema).option("pathGlobFilter", f"*{suffix}").csv(folder, header=True)
    return df.withColumn("file", last_segment(F.input_file_name()))


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """``station, ts, value, quality, measure``; names normalised, NaN null."""
    df = read_csv(spark, path, READINGS)
    value = F.when(~F.isnan("value"), F.col("value"))
    return df.select(normal_name(F.col("station_name")).alias("station"), F.col("dateTime").alias("ts"), value.alias("value"), "quality", "measure")


def _features(properties: Sequence[str]) -> str:
    fields = ", ".join(f"`{p}`: string" for p in properties)
    return f"features array<struct<properties: struct<{fields}>, geometry: struct<type: string, coordinates: string>>>"


def _polygons(rows: DataFrame, properties: Sequence[str], *kept: str) -> DataFrame:
    """One row a polygon of the features ``f``: parts of a multipart one are rows of their own, with all rings."""
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    deep = "array<array<array<array<double>>>>"
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(text, deep))
    # the last point repeats the first
    ring = lambda r: F.transform(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rows = rows.select(*kept, *(F.col(f"f.properties.{p}").alias(p) for p in properties), F.posexplode(parts).alias("part", "_rings"))
    return rows.select(*kept, *properties, ring(F.col("_rings")[0]).alias("ring"), F.transform(F.slice("_rings", 2, F.greatest(F.size("_rings") - 1, F.lit(0))), ring).alias("holes"), "part")


def read_geojson(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """``properties, ring`` (the outer one, as x and y)``, holes, part`` of each polygon; each part of a multipart one is a row. Points and lines have no rows."""
    rows = spark.read.schema(_features(properties)).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return _polygons(rows, properties)


def read_vectors(spark: SparkSession, folder: str, subfolders: str, suffix: str, properties: Sequence[str]) -> DataFrame:
    """``file`` and what ``read_geojson`` gives, of all files named ``*suffix`` at any depth whose folder's name fits ``subfolders`` (a pattern).

    A file that isn't GeoJSON has no features and so no rows; the others are read all the same.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
    found = found.where(F.element_at(F.split("path", "/"), -2).rlike(f"^(?:{subfolders})$"))
    rows = found.select(last_segment(F.col("path")).alias("file"), F.explode(F.from_json(F.decode("content", "UTF-8"), _features(properties))["features"]).alias("f"))
    return _polygons(rows, properties, "file")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, value`` (cell centres) of grids with a six-line header; missing cells are left out. One file is one row of text."""
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.split("value", r"\r?\n").alias("l"))
    head = lambda i: F.element_at(F.split(F.trim(F.col("l")[i]), r"\s+"), -1).cast("double")
    rows = lines.select(head(1).alias("n"), head(2).alias("x0"), head(3).alias("y0"), head(4).alias("size"), head(5).alias("none"), F.posexplode(F.slice("l", 7, F.size("l"))).alias("r", "line"))
    rows = rows.where(F.trim("line") != "").select("*", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("c", "v"))
    value = F.col("v").cast("double")
    return rows.where(value != F.col("none")).select((F.col("x0") + (F.col("c") + 0.5) * F.col("size")).alias("x"), (F.col("y0") + (F.col("n") - F.col("r") - 0.5) * F.col("size")).alias("y"), value.alias("value"))


def month_files(spark: SparkSession, start: str, end: str, base: str, extension: str = ".nc") -> DataFrame:
    """``file``: ``base + first day - last day`` for each month."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m"))
    stamp = lambda c: F.date_format(c, "yyyyMMdd")
    return months.select(F.concat(F.lit(base), stamp("m"), F.lit("-"), stamp(F.last_day("m")), F.lit(extension)).alias("file"))


def of_own_month(df: DataFrame, file: str = "file", time: str = "time", prefix: str = "") -> DataFrame:
    """Rows of files named ``prefix..._<year>_<month>.<ext>`` whose time lies in that month; other files' rows are left out.

    Landed archives overlap at their ends; after this, months can be stacked.
    """
    name = last_segment(F.col(file))
    stamp = lambda i: F.regexp_extract(name, r"_([0-9]{4})_([0-9]{1,2})\.[^.]*$", i).try_cast("int")
    month = F.when(stamp(1).isNotNull() & stamp(2).between(1, 12), F.make_date(stamp(1), stamp(2), F.lit(1)))
    return df.where(name.startswith(prefix) & (F.trunc(F.to_date(time), "month") == month))


def station_details(df: DataFrame, raw: str = "metadata", measures: str = "measures") -> DataFrame:
    """``label`` of the first JSON and the first measure's ``@id`` of the second; null where either is missing."""
    return df.withColumns({"station_name": F.get_json_object(raw, "$.label"), "measure_uri": F.get_json_object(measures, "$[0]['@id']")})


def flow_measure(measures: DataFrame, key: str = "station", uri: str = "uri", order: str = "seq") -> DataFrame:
    """``station, uri``: the last one that holds ``flow-mean``, else the last."""
    rank = F.struct(F.col(uri).contains("flow-mean"), F.col(order))
    return measures.groupBy(key).agg(F.max_by(uri, rank).alias(uri))


def http_page(url: str) -> list[dict]:
    """The ``items`` of a JSON page."""
    with urllib.request.urlopen(url, timeout=60) as reply:
        return json.load(reply).get("items", [])


class PagedReadings(DataSource):
    """Readings behind a paged JSON service: ``spark.read.format("paged_readings").option("uris", ...)``.

    A partition is one measure; its pages are asked for with a growing offset until one is short. A page that fails fails its task, which
    Spark repeats; with ``incomplete=keep`` it ends its measure with the pages before it. Options: ``uris`` (comma-separated), ``start``,
    ``end``, ``limit``, ``incomplete``. Levels and flows are read alike, by the addresses of their measures.
    """

    fetch: Callable[[str], list[dict]] = staticmethod(http_page)

    @classmethod
    def name(cls) -> str:
        return "paged_readings"

    def schema(self) -> str:
        return "measure string, dateTime string, date string, value double, quality string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options), type(self).fetch)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[str], list[dict]]):
        self.uris = [u.strip() for u in options.get("uris", "").split(",") if u.strip().startswith("http")]
        self.query = {k: options[o] for k, o in (("mineq-date", "start"), ("max-date", "end")) if o in options}
        self.limit, self.fetch, self.lenient = int(options.get("limit", 50000)), fetch, options.get("incomplete") == "keep"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.uris] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        offset = 0
        while partition.value:
            query = urllib.parse.urlencode(self.query | {"_limit": self.limit, "_offset": offset})
            try:
                items = self.fetch(f"{partition.value}/readings?{query}")
            except (urllib.error.URLError, ValueError, OSError):
                if self.lenient:
                    return
                raise
            for x in items:
                value = x.get("value")
                yield partition.value, x.get("dateTime"), x.get("date"), None if value is None else float(value), x.get("quality")
            if len(items) < self.limit:
                return
            offset += self.limit


class StationList(DataSource):
    """Stations around places, behind a JSON service: ``spark.read.format("station_list").option("base", ...)``.

    A partition is one place: ``places`` holds ``lat:lon`` parts, comma-separated, ``dist`` the kilometres around each; ``parameter``
    names what is measured. Rows hold the station's JSON (``metadata``) and that of its measures (``measures``), which
    ``station_details`` and ``flow_measure`` read; stations near several places come once a place.
    """

    fetch: Callable[[str], list[dict]] = staticmethod(http_page)

    @classmethod
    def name(cls) -> str:
        return "station_list"

    def schema(self) -> str:
        return "place string, station string, metadata string, measures string"

    def reader(self, schema) -> DataSourceReader:
        return _StationReader(dict(self.options), type(self).fetch)


class _StationReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[str], list[dict]]):
        self.places = [p.strip() for p in options.get("places", "").split(",") if p.strip()]
        self.base, self.fetch = options["base"].rstrip("/"), fetch
        self.query = {"dist": options.get("dist", "1"), **({"observedProperty": options["parameter"]} if "parameter" in options else {})}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.places] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            lat, _, lon = partition.value.partition(":")
            for station in self.fetch(f"{self.base}/stations?{urllib.parse.urlencode({'lat': lat, 'long': lon, **self.query})}"):
                measures = station.get("measures", [])
                yield partition.value, station.get("notation"), json.dumps(station), json.dumps(measures if isinstance(measures, list) else [measures])


READING = "dateTime string, date string, value double, quality string"


def pages(request: dict, fetch: Callable[[str], list[dict]] = http_page) -> Iterator[list[dict]]:
    """All readings of ``request``: its ``uri`` from ``start`` to ``end``, ``limit`` at a time, until a page is short."""
    query = {k: request[o] for k, o in (("mineq-date", "start"), ("max-date", "end")) if request.get(o)}
    limit, offset = int(request.get("limit") or 50000), 0
    while True:
        items = fetch(f"{request['uri']}/readings?{urllib.parse.urlencode(query | {'_limit': limit, '_offset': offset})}")
        yield [{"dateTime": x.get("dateTime"), "date": x.get("date"), "value": None if x.get("value") is None else float(x["value"]), "quality": x.get("quality")} for x in items]
        if len(items) < limit:
            return
        offset += limit


@lru_cache(maxsize=2)
def _landed(names: tuple[str, ...]) -> pa.Table:
    """Readings of a landed copy in order of time; pages of one measure are cut from the same table."""
    parts = []
    for name in names:
        files, path = store(name)
        parts.append(pq.read_table(path, filesystem=files, columns=["dateTime", "date", "value", "quality"], partitioning=None))
    return pa.concat_tables(parts).sort_by("dateTime")


def replay(url: str) -> list[dict]:
    """A page as the service would give it, from a landed copy: ``<folder of Parquet>/readings?...`` with ``dateTime, date, value, quality``."""
    place, _, asked = url.partition("/readings?")
    query = dict(urllib.parse.parse_qsl(asked))
    names = tuple(listed(place, (".parquet",)))
    if not names:
        return []
    rows = _landed(names)
    if "mineq-date" in query:
        rows = rows.filter(pc.greater_equal(rows["date"], query["mineq-date"]))
    if "max-date" in query:
        rows = rows.filter(pc.less_equal(rows["date"], query["max-date"]))
    return rows.slice(int(query.get("_offset", 0)), int(query["_limit"])).to_pylist()


#: Ids that share a folder of a landed copy of stations.
IDS = 1000


@lru_cache(maxsize=8)
def _answers(folder: str) -> dict[int, list[dict]]:
    """What a landed copy holds of each id in one of its folders."""
    out: dict[int, list[dict]] = {}
    for name in listed(folder, (".parquet",)):
        files, path = store(name)
        for x in pq.read_table(path, filesystem=files, columns=["id", "station", "measure"], partitioning=None).to_pylist():
            out.setdefault(x["id"], []).append(x)
    return out


def replay_station(url: str) -> list[dict]:
    """What the service would answer for a station's id, or for its measures, from a landed copy: ``<folder>/ids=<id // IDS>`` with ``id, station``
    (JSON) and ``measure``. A station's own address is ``<folder>/id=<id>``. Folders read last are held, so ids should be asked for in order."""
    place, _, asked = url.partition("?")
    if asked:
        named = dict(urllib.parse.parse_qsl(asked))["wiskiID"]
    else:
        place, _, named = place.removesuffix("/measures").rpartition("/id=")
    out = _answers(f"{place}/ids={int(named) // IDS}").get(int(named), [])
    if asked:
        return [json.loads(x["station"]) for x in out]
    if any(x["measure"] is None for x in out):
        raise OSError("no measures")
    return [{"@id": x["measure"]} for x in out]


def download(spark: SparkSession, measures: DataFrame, place: str, uri: str = "measure_uri", start: str | None = None, end: str | None = None, limit: int = 50000, flow: bool = False, attempts: int = 1, fetch: Callable[[str], list[dict]] = http_page) -> DataFrame:
    """``measure`` and all readings of the measures in ``uri`` that have arrived at ``place``.

    Each measure is a task of its own (``retrieval``): a rerun asks only for those that failed, found nothing or are new, and never doubles
    a reading. Addresses that aren't URIs (of a service or a store) or paths from the root are no measures. ``flow`` takes the day after ``end``
    in as well, as the service's flows end before it.
    """
    last = (date.fromisoformat(end) + timedelta(days=1)).isoformat() if end and flow else end
    asked = measures.select(F.col(uri).alias("task")).where(F.col("task").rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?/"))
    asked = asked.select("task", F.col("task").alias("uri"), F.lit(start).alias("start"), F.lit(last).alias("end"), F.lit(limit).alias("limit"))
    retrieval.retrieve(asked, place, lambda request: pages(request, fetch), READING, attempts)
    return retrieval.retrieved(spark, place, READING).withColumnRenamed("task", "measure")


def look_up_stations(stations: DataFrame, base: str, key: str = "station_id", fetch: Callable[[str], list[dict]] = http_page) -> DataFrame:
    """``stations`` with ``metadata`` and ``measures``: JSON of the station that the service has for the id in ``key``, and of its measures.

    The first of several is taken. Null where the service has none or the request fails, which never ends the job; measures are asked for under the
    station's own address, and only where there is one. Columns of these names are replaced. ``station_details`` reads both.
    """
    kept = [c for c in stations.columns if c not in ("metadata", "measures")]
    rows = stations.select(*kept)
    schema = StructType([*rows.schema.fields, StructField("metadata", StringType()), StructField("measures", StringType())])

    def first(url: str) -> list[dict] | None:
        try:
            return fetch(url)
        except (urllib.error.URLError, ValueError, OSError, AttributeError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, measured = [], []
            for name in batch.column(kept.index(key)).to_pylist():
                items = first(f"{base}?{urllib.parse.urlencode({'wiskiID': name})}") if name is not None else None
                station = items[0] if items else None
                address = station.get("@id") if isinstance(station, dict) else None
                measures = first(f"{address}/measures") if address else None
                found.append(None if station is None else json.dumps(station))
                measured.append(None if measures is None else json.dumps(measures))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(measured, pa.string())], [*kept, "metadata", "measures"])

    return rows.mapInArrow(run, schema)
