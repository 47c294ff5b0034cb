"""Retrieval in tasks that are done once: a ledger names what has arrived, and only what it names is ever read.

A task (a month of an archive, a measure of a station) writes to a file of its own that nothing names yet. When all tasks of a run have ended, one
entry of the ledger, put in place by one rename, names the files of those that came whole. A run that is cut off before that has
changed nothing; a rerun asks for what the ledger lacks. So nothing comes twice and nothing is lost.
"""

from __future__ import annotations

import io
import json
import urllib.error
import urllib.request
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import publish, ranges, remove, stage, store

#: Requests that run at a time, and bytes of an answer that are held at a time.
ABREAST, CHUNK = 8, 1 << 20
_ENTRY = "task string, file string, n bigint, state string, error string, at timestamp, run string"

#: Gives the parts of a task's answer: lists of rows, or pieces of a file. Any error ends the attempt.
Fetch = Callable[[dict], Iterator[list[dict] | bytes]]


def fetch_file(request: dict) -> Iterator[bytes]:
    """The file at ``request["url"]``, in any store or by HTTP."""
    url = request["url"]
    if url.startswith(("http:", "https:")):
        with urllib.request.urlopen(url, timeout=600) as reply:
            while part := reply.read(CHUNK):
                yield part
        return
    with ranges(url) as read:
        for at in range(0, read.size, CHUNK):
            yield read(at, CHUNK)


@dataclass
class _Message(WriterCommitMessage):
    entries: list[dict] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    """Takes ``task, part, state, error, name``: parts of a task in a row, then its end; or an error, which undoes the attempt."""

    def __init__(self, options: dict[str, str]):
        self.place, self.rows = options["path"].rstrip("/"), pa.ipc.read_schema(pa.BufferReader(bytes.fromhex(options["schema"]))) if "schema" in options else None
        self.run, self.unzip = options["run"], options.get("unzip") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        out = _Message()
        files, root = store(self.place)
        try:
            self._take(iterator, files, root, out)
        except BaseException:  # this attempt's files are named nowhere
            remove(f"{self.place}/{e['file']}" for e in out.entries if e["file"])
            raise
        return out

    def _take(self, iterator: Iterator[pa.RecordBatch], files: fs.FileSystem, root: str, out: _Message) -> None:
        path = sink = writer = None
        n = 0
        for batch in iterator:
            for x in batch.to_pylist():
                if x["part"] is not None:
                    if sink is None:
                        path, n = f"data/{uuid.uuid4().hex}" + (".parquet" if self.rows else ""), 0
                        files.create_dir(f"{root}/data", recursive=True)
                        sink = files.open_output_stream(f"{root}/{path}")
                        writer = pq.ParquetWriter(sink, self.rows) if self.rows else None
                    if writer:
                        table = pa.ipc.open_stream(x["part"]).read_all()
                        n += table.num_rows
                        writer.write_table(table)
                    else:
                        n += len(x["part"])
                        sink.write(x["part"])
                    continue
                if writer:
                    writer.close()
                if sink:
                    sink.close()
                state, error = x["state"] if x["state"] != "done" or n else "empty", x["error"]
                if state == "done" and not self.rows:
                    try:
                        path = self._named(path, x["name"])
                    except (ValueError, zipfile.BadZipFile) as e:
                        state, error = "failed", repr(e)
                if state != "done" and path:
                    remove([f"{self.place}/{path}"])
                    path = None
                out.entries.append({"task": x["task"], "file": path, "n": n, "state": state, "error": error, "run": self.run})
                path = sink = writer = None
                n = 0

    def _named(self, path: str, name: str) -> str:
        """An archive's only file, or the file itself, under its name in a folder of its own."""
        target = f"{path}-file/{name}"
        if self.unzip:
            with ranges(f"{self.place}/{path}") as read:
                data = read(0, 4)
                if data == b"PK\3\4":
                    packed = zipfile.ZipFile(io.BytesIO(read(0, read.size)))
                    inner = [i for i in packed.infolist() if not i.is_dir()]
                    if len(inner) != 1 or not inner[0].file_size:
                        raise ValueError(f"{name}: no archive of one file")
                    with packed.open(inner[0]) as source:
                        staged, _ = stage(self.place, iter(lambda: source.read(CHUNK), b""))
                    publish(staged, f"{self.place}/{target}")
                    remove([f"{self.place}/{path}"])
                    return target
        publish(f"{self.place}/{path}", f"{self.place}/{target}")
        return target

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        entries = [e for m in messages if m for e in m.entries]
        at = datetime.now(timezone.utc)
        lines = "".join(json.dumps(e | {"at": at.isoformat()}) + "\n" for e in entries)
        staged, _ = stage(self.place, [lines.encode()])
        publish(staged, f"{self.place}/ledger/{at:%Y%m%dT%H%M%S%f}-{self.run}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        remove(f"{self.place}/{e['file']}" for m in messages if m for e in m.entries if e["file"])


class LedgerSink(DataSource):
    """The sink of ``retrieve``: options ``path``, ``run``, ``schema`` (of rows, else files) and ``unzip``."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def ledger(spark: SparkSession, place: str) -> DataFrame:
    """``task, file, n, state, error, at, run`` of every task of every run; state is ``done``, ``empty`` or ``failed``. Of several that were done, the first counts."""
    files, path = store(f"{place.rstrip('/')}/ledger")
    if files.get_file_info(path).type != fs.FileType.Directory:
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).json(f"{place.rstrip('/')}/ledger")


def done(spark: SparkSession, place: str) -> DataFrame:
    """``task, file, n`` of the tasks that are done, one row each."""
    first = F.min_by(F.struct("file", "n"), F.struct("at", "run", "file"))
    return ledger(spark, place).where("state = 'done'").groupBy("task").agg(first.alias("f")).select("task", "f.file", "f.n")


def retrieve(tasks: DataFrame, place: str, fetch: Fetch, schema: str | None = None, attempts: int = 1, abreast: int = ABREAST, unzip: bool = True, kept: str = "done") -> DataFrame:
    """Asks for those of ``tasks`` (``task`` and whatever ``fetch`` needs) that the ledger at ``place`` lacks; gives their ledger rows of this run.

    With a ``schema`` answers are lists of rows, kept as one Parquet file a task (``retrieved``); else they are files, kept under the
    task's ``name`` (or its ``task``), an archive's only file in its place (``retrieved_files``). ``abreast`` requests run at a
    time, each up to ``attempts`` times; one that fails then is told in the ledger and asked for again by the next run, as is one
    whose answer is empty. With ``kept="all"`` an empty answer counts as done. Rows of one task are one task; null tasks are none.
    """
    spark = tasks.sparkSession
    spark.dataSource.register(LedgerSink)
    fields = None if schema is None else pa.schema(_arrow_fields(spark, schema))
    pending = tasks.where(F.col("task").isNotNull()).dropDuplicates(["task"]).join(done(spark, place), "task", "left_anti")
    if kept == "all":
        pending = pending.join(ledger(spark, place).where("state = 'empty'").select("task").distinct(), "task", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["task", "part", "state", "error", "name"]
        row = lambda *v: pa.RecordBatch.from_pylist([dict(zip(names, v))], pa.schema([("task", pa.string()), ("part", pa.binary()), ("state", pa.string()), ("error", pa.string()), ("name", pa.string())]))
        for batch in batches:
            for request in batch.to_pylist():
                task, name = str(request["task"]), str(request.get("name") or request["task"])
                for attempt in range(attempts):
                    try:
                        for part in fetch(request):
                            if fields is not None:
                                table = pa.Table.from_pylist(part, fields)
                                buffer = io.BytesIO()
                                with pa.ipc.new_stream(buffer, fields) as stream:
                                    stream.write_table(table)
                                part = buffer.getvalue()
                            yield row(task, part, None, None, name)
                        yield row(task, None, "done", None, name)
                        break
                    except (OSError, ValueError, KeyError, urllib.error.URLError) as e:
                        last = attempt + 1 == attempts
                        yield row(task, None, "failed" if last else "again", repr(e), name)

    run_id = uuid.uuid4().hex
    parts = pending.repartition(abreast).mapInArrow(run, "task string, part binary, state string, error string, name string")
    options = {"run": run_id, "unzip": str(unzip).lower(), **({} if fields is None else {"schema": fields.serialize().to_pybytes().hex()})}
    parts.write.format("ledger").options(**options).mode("append").save(place)
    return ledger(spark, place).where((F.col("run") == run_id) & (F.col("state") != "again"))


def _arrow_fields(spark: SparkSession, schema: str) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in spark.createDataFrame([], schema).schema.fields]


def retrieved(spark: SparkSession, place: str, schema: str) -> DataFrame:
    """``task`` and the rows of all tasks that are done."""
    files, path = store(f"{place.rstrip('/')}/data")
    if files.get_file_info(path).type != fs.FileType.Directory:
        return spark.createDataFrame([], f"task string, {schema}")
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{place.rstrip('/')}/data").withColumn("_file", F.concat(F.lit("data/"), F.col("_metadata.file_name")))
    return rows.join(done(spark, place).select("task", F.col("file").alias("_file")), "_file").drop("_file").select("task", *(c for c in rows.columns if c != "_file"))


def retrieved_files(spark: SparkSession, place: str) -> DataFrame:
    """``task, path, n`` of the files that are done."""
    return done(spark, place).select("task", F.concat(F.lit(place.rstrip("/") + "/"), "file").alias("path"), "n")


def sweep(spark: SparkSession, place: str) -> int:
    """Removes files that no entry names, left by runs that were cut off; while none is under way. Their number."""
    files, path = store(f"{place.rstrip('/')}/data")
    if files.get_file_info(path).type != fs.FileType.Directory:
        return 0
    there = [f"data/{i.path[len(path.rstrip('/')) + 1 :]}" for i in files.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File]
    named = {r["file"] for r in ledger(spark, place).where("state = 'done'").select("file").collect()}
    lost = [f for f in there if f not in named]
    remove(f"{place.rstrip('/')}/{f}" for f in lost)
    return len(lost)


def archive_months(spark: SparkSession, start: str, end: str, base: str, prefix: str, suffix: str = ".grib", area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Tasks for ``retrieve``: ``task`` and ``name`` (``<prefix>_<year>_<month><suffix>``) of each month, and ``url``: ``base`` with the
    month's days, hours and area (north, west, south, east) as its query where it is a service, else the file of that name in the folder ``base``."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m"))
    name = F.concat(F.lit(prefix), F.lit("_"), F.year("m"), F.lit("_"), F.month("m"), F.lit(suffix))
    days = F.concat(F.lit("?from="), F.date_format("m", "yyyy-MM-dd"), F.lit("T00:00&to="), F.date_format(F.last_day("m"), "yyyy-MM-dd"), F.lit("T23:00"), F.lit("" if area is None else "&area=" + ",".join(f"{a:g}" for a in area)))
    url = F.concat(F.lit(base), days) if base.startswith(("http:", "https:")) else F.concat(F.lit(base.rstrip("/") + "/"), "name")
    return months.select(name.alias("name"), "m").withColumn("url", url).select(F.col("name").alias("task"), "name", "url")
