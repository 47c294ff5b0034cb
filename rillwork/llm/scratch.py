"""Tables that cut lineage, and positions in a total order.

Both write Parquet to the folder that ``spark.checkpoint.dir`` names, so a lost executor costs no more
than a re-read, and the reader knows each table's true size when it picks a join.
"""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid
import weakref

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block of ``running``: a window never holds more than this many rows of a group.
BLOCK_BITS = 13
#: A group of one ``HEAVY``-th of all rows or more is handled apart by ``join_groups``.
HEAVY = 64
#: Groups that ``join_groups`` lets Spark broadcast at most: they take several times the room of their file, by which Spark judges them.
FEW = 100_000
#: Begins the names of columns that operators add for themselves beside a table's own.
T = "__rw_"
#: The same for ``running``, which those operators call.
R = "__rw_run_"


class _Tables:
    """What one application has written: each table's folder, with a weak reference to the JVM's list of its files.

    Every plan that reads a table, lazily derived ones too, holds that list; once the JVM has collected it nothing can read the
    table any more.
    """

    def __init__(self) -> None:
        self.lock, self.held, self.marked = threading.Lock(), [], False


_of: weakref.WeakKeyDictionary[SparkContext, _Tables] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set and Spark runs in one process (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rillwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _own_folder(spark: SparkSession) -> tuple[str, object, object]:
    """This application's part of the shared folder, with Hadoop's path and file system."""
    folder = f"{shared_folder(spark)}/rillwork/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return folder, path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_table(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read back.

    The table goes some time after the last plan that reads it has gone (``free_tables``), or when the application ends.
    """
    spark = df.sparkSession
    folder, path, files = _own_folder(spark)
    own = _of.setdefault(spark.sparkContext, _Tables())
    if not own.marked:
        files.mkdirs(path)
        files.deleteOnExit(path)
        own.marked = True
    free_tables(spark)
    place = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    out = spark.read.schema(df.schema).parquet(place)
    index = out._jdf.queryExecution().analyzed().relation().location()
    with own.lock:
        own.held.append((place, spark.sparkContext._jvm.java.lang.ref.WeakReference(index)))
    return out


def free_tables(spark: SparkSession, collect: bool = False) -> int:
    """Deletes the tables that no plan can read any more, as far as the JVM has collected them; ``collect`` asks it to. Their number."""
    own = _of.get(spark.sparkContext)
    if own is None:
        return 0
    if collect:
        gc.collect()  # plans held by this process
        spark.sparkContext._jvm.System.gc()
    with own.lock:
        gone = [t for t in own.held if t[1].get() is None]
        own.held = [t for t in own.held if t not in gone]
    for place, _ in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def join_groups(rows: DataFrame, groups: DataFrame, keys: dict[str, str], n: str) -> DataFrame:
    """``rows``, left-joined to ``groups``: one row for each group of ``rows``, with its number of rows in ``n``; nulls are values.

    ``keys`` maps columns of ``rows`` to those of ``groups``, which are dropped, as is ``n``. A group of at least a
    ``HEAVY``-th of all rows has its row broadcast (there are ``HEAVY`` such groups at most), and its rows are dealt evenly in the
    shuffle that joins the others: no key's rows meet in one task, whatever their share. More than ``FEW`` groups are never broadcast.
    """
    groups = write_table(groups, "groups")
    total, many = groups.agg(F.coalesce(F.sum(n), F.lit(0)), F.count(F.lit(1)) > FEW).first()
    whole = lambda columns, salt: F.struct(*(c.alias(f"k{i}") for i, c in enumerate(columns)), salt.cast("long").alias("salt"))
    values = [c for c in groups.columns if c not in {n, *keys.values()}]
    packed = groups.select(whole(map(F.col, keys.values()), F.lit(0)).alias(f"{R}key"), F.struct(*values).alias(f"{R}value"), n)
    heavy = packed.where(F.col(n) * HEAVY >= total).select(F.col(f"{R}key").alias(f"{R}heavy_key"), F.col(f"{R}value").alias(f"{R}heavy"))
    light = packed.where(F.col(n) * HEAVY < total).select(f"{R}key", f"{R}value")
    dealt = rows.join(F.broadcast(heavy), whole(map(F.col, keys), F.lit(0)) == F.col(f"{R}heavy_key"), "left")
    settled = F.col(f"{R}heavy").isNotNull()
    dealt = dealt.withColumn(f"{R}own", whole((F.when(~settled, F.col(k)) for k in keys), F.when(settled, 1 + F.monotonically_increasing_id()).otherwise(0)))
    joined = dealt.join(light.hint("merge") if many else light, F.col(f"{R}own") == F.col(f"{R}key"), "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"{R}heavy")[c], F.col(f"{R}value")[c]).alias(c) for c in values))


def _before(totals: DataFrame, columns: list[str]) -> DataFrame:
    """For each block, the sums of ``columns`` over the blocks before it: within runs of blocks, and over the runs."""
    totals = totals.withColumn(f"{R}run", F.shiftright(f"{R}block", BLOCK_BITS))
    above = totals.groupBy(f"{R}run").agg(*(F.sum(c).alias(f"{c}_a") for c in columns))
    upto = Window.orderBy(f"{R}run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 2**(2 * BLOCK_BITS) rows and partition
    above = above.select(f"{R}run", *(F.coalesce(F.sum(f"{c}_a").over(upto), F.lit(0)).alias(f"{c}_a") for c in columns))
    within = Window.partitionBy(f"{R}run").orderBy(f"{R}block").rowsBetween(Window.unboundedPreceding, -1)
    inside = totals.select(f"{R}block", f"{R}run", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(c) for c in columns))
    return inside.join(above, f"{R}run").select(f"{R}block", *((F.col(c) + F.col(f"{c}_a")).alias(c) for c in columns))


def running(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None, rank: str = "rank", row_id: str = "row_id") -> DataFrame:
    """Adds ``row_id``, ``rank`` (from 0 in ``order``) and exclusive running sums ``{output: column}``.

    One range sort gives each row its partition and place in it; blocks of at most ``2**BLOCK_BITS`` rows are
    then summed apart and offset by the totals of the blocks before. No group of rows with an equal key
    meets in one task, whatever its size; the single-task window sees one row for each partition and 2**(2 * BLOCK_BITS) rows. Columns of the outputs' names are replaced.
    """
    sums = sums or {}
    outputs = {row_id, rank, *sums}
    kept = [c for c in df.columns if c not in outputs]
    rows = write_table(df.orderBy(*order).withColumns({f"{R}v_{o}": F.col(c) for o, c in sums.items()} | {f"{R}row": F.monotonically_increasing_id()}).drop(*outputs), "ordered")
    rows = rows.withColumn(f"{R}block", F.shiftright(f"{R}row", BLOCK_BITS))
    totals = rows.groupBy(f"{R}block").agg(F.count(F.lit(1)).alias(f"{R}n"), *(F.sum(f"{R}v_{o}").alias(f"{R}t_{o}") for o in sums))
    offsets = _before(totals, [f"{R}n", *(f"{R}t_{o}" for o in sums)])
    own = Window.partitionBy(f"{R}block").orderBy(f"{R}row")
    own_before = own.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"{R}r": F.row_number().over(own) - 1} | {f"{R}s_{o}": F.coalesce(F.sum(f"{R}v_{o}").over(own_before), F.lit(0)) for o in sums})
    joined = local.join(offsets, f"{R}block")
    return joined.select(
        *kept,
        F.col(f"{R}row").alias(row_id),
        (F.col(f"{R}n") + F.col(f"{R}r")).alias(rank),
        *((F.col(f"{R}t_{o}") + F.col(f"{R}s_{o}")).alias(o) for o in sums),
    )
