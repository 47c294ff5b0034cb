"""Readers and writers, by writing tables to the shared folder and reading them again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import preparation, spatial
from ..sources import config, sinks, tables
from .registry import READINGS, STATIONS, query, r, readings, shared_root, stations, table


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/sources/{uuid.uuid4().hex}/{name}"


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s01_k01_csv(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "supplier")
    sinks.write_csv(table(spark, d, "supplier"), place)
    return tables.read_csv(spark, place, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", columns=["s_suppkey", "s_name", "s_acctbal"])


@query("SELECT 'n' || n_regionkey || CASE WHEN n_nationkey < 12 THEN 'a' ELSE 'b' END || '_trimmed.csv' AS file, n_nationkey, n_name FROM nation")
def s02_k02_folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """A folder of a file a region and half, appended one after another; the scan takes all with the suffix, and no others."""
    place, n = _place(spark, "nations"), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = set()
    for k in range(5):
        for half, rows in (("a", n.where("n_nationkey < 12")), ("b", n.where("n_nationkey >= 12"))):
            sinks.write_csv(rows.where(F.col("n_regionkey") == k).coalesce(1), place, append=True)
            for found in files.listStatus(path(place)):
                name = found.getPath().getName()
                if name.endswith(".csv") and name not in named:
                    named.add(f"n{k}{half}_trimmed.csv")
                    files.rename(found.getPath(), path(f"{place}/n{k}{half}_trimmed.csv"))
    sinks.write_csv(n, f"{place}/other")
    return tables.read_many(spark, place, "n_nationkey int, n_name string, n_regionkey int").select("file", "n_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def s20_k03_partitioned_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Written by status, so the filter reads one folder."""
    place = _place(spark, "orders")
    sinks.write_parquet(table(spark, d, "orders"), place, by="o_orderstatus")
    return spark.read.parquet(place).where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("SELECT n_name AS name, 4 AS corners, (n_nationkey * 10)::DOUBLE AS west, 'POLYGON ((' || n_nationkey * 10 || '.0 0.0, ' || n_nationkey * 10 + 10 || '.0 0.0, ' || n_nationkey * 10 + 10 || '.0 5.0, ' || n_nationkey * 10 || '.0 5.0, ' || n_nationkey * 10 || '.0 0.0))' AS wkt FROM nation")
def s17_k06_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as GeoJSON text, read back as rings."""
    x = F.col("n_nationkey") * 10.0
    corner = lambda a, b: F.array(a, F.lit(b))
    ring = F.array(corner(x, 0.0), corner(x + 10, 0.0), corner(x + 10, 5.0), corner(x, 5.0), corner(x, 0.0))
    shape = F.struct(F.struct(F.col("n_name").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    place = _place(spark, "boxes")
    table(spark, d, "nation").agg(F.collect_list(shape).alias("features")).write.json(place)
    out = tables.read_geojson(spark, place, ["name"])
    return out.select("name", F.size("ring").alias("corners"), F.col("ring")[0]["x"].alias("west"), sinks.geometry_text(F.col("ring")).alias("wkt"))


@query(f"WITH {STATIONS} SELECT station, CAST(1 + floor(easting / 1000) + 10 * floor(northing / 1000) AS DOUBLE) AS value FROM stations WHERE easting < 10000 AND northing < 10000 AND floor(easting / 1000) + floor(northing / 1000) <> 7")
def s16_grid_sampling(spark: SparkSession, d: str) -> DataFrame:
    """An ASCII grid with missing cells, sampled at the stations."""
    rows = [" ".join("-9" if c + y == 7 else str(1 + c + 10 * y) for c in range(10)) for y in range(9, -1, -1)]
    text = "\n".join(["ncols 10", "nrows 10", "xllcorner 0", "yllcorner 0", "cellsize 1000", "NODATA_value -9", *rows])
    place = _place(spark, "grid.asc")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(place)
    grid = tables.read_ascii_grid(spark, place).select(spatial.cell(F.col("x"), 1000.0).alias("ix"), spatial.cell(F.col("y"), 1000.0).alias("iy"), "value")
    asked = stations(spark, d).select("station", spatial.cell(F.col("easting"), 1000.0).alias("ix"), spatial.cell(F.col("northing"), 1000.0).alias("iy"))
    return asked.join(grid, ["ix", "iy"]).select("station", "value")


@query(f"WITH {READINGS} SELECT replace(lower(trim(' ' || upper(station) || ' ')), ' ', '_') AS station, ts, CASE WHEN event_id % 6 > 0 THEN value END AS value, quality FROM readings")
def s19_d02_readings(spark: SparkSession, d: str) -> DataFrame:
    """Raw readings as CSV with NaN, read by the library's schema."""
    e = readings(spark, d)
    raw = e.select(F.concat(F.lit(" "), F.upper("station"), F.lit(" ")).alias("station_name"), F.to_date("ts").cast("string").alias("date"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("dateTime"), F.when(F.col("event_id") % 6 > 0, F.col("value")).otherwise(float("nan")).alias("value"), "quality", F.lit("m").alias("measure"))
    place = _place(spark, "readings")
    sinks.write_csv(raw, place)
    return tables.read_readings(spark, place).select("station", "ts", "value", "quality")


@query("SELECT n_name AS name, '/data/' || r_name || '/' || n_nationkey AS value FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, '/data/' || r_name FROM region UNION ALL SELECT 'kept', '{other}'")
def s22_x06_settings(spark: SparkSession, d: str) -> DataFrame:
    """A settings tree made of regions, whose folders nations' texts name."""
    regions = {row["r_name"]: row["r_regionkey"] for row in table(spark, d, "region").collect()}
    names = {k: n for n, k in regions.items()}
    nations = {row["n_name"]: "{" + names[row["n_regionkey"]] + "}/" + str(row["n_nationkey"]) for row in table(spark, d, "nation").collect()}
    tree = config.settings({"root": "/data", **{n: "/data/" + n for n in regions}, "nested": {"nations": nations, "kept": "{other}"}})
    return spark.createDataFrame([*((n, tree[n]) for n in regions), *tree["nested"]["nations"].items(), ("kept", tree["nested"]["kept"])], "name string, value string")


@query("SELECT * FROM (VALUES ('numeric', 'p_size,p_retailprice'), ('category', 'p_brand,p_type'), ('key', 'p_partkey,p_name')) t(kind, columns)")
def p21_p22_column_groups(spark: SparkSession, d: str) -> DataFrame:
    columns = table(spark, d, "part").columns
    groups = preparation.column_groups(columns, {"numeric": ["p_size", "p_retailprice", "absent"], "category": preparation.prefixed(columns, ["p_brand", "p_t", "p_ty"]), "key": ["p_partkey", "p_name"]})
    return spark.createDataFrame([(k, ",".join(v)) for k, v in groups.items()], "kind string, columns string")


@query("SELECT count(*) AS n, true AS same FROM part")
def k08_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Equal tables in another order have equal hashes."""
    p = table(spark, d, "part")
    same = sinks.content_hash(p) == sinks.content_hash(p.orderBy(F.desc("p_partkey")))
    return p.agg(F.count(F.lit(1)).alias("n"), F.lit(same).alias("same"))


@query("WITH w AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings) SELECT vec_id, round(s, 5) AS total FROM w")
def k05_k10_array_round_trip(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark, "vectors")
    sinks.write_parquet(table(spark, d, "embeddings"), place)
    add = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return spark.read.parquet(place).select("vec_id", r(add, 5).alias("total"))


@query("SELECT event_id, ts AS time FROM (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 'rain_2024_1.nc' WHEN 1 THEN 'rain_2024_02.nc' WHEN 2 THEN 'heat_2024_01.nc' WHEN 3 THEN 'rain_2024_13.nc' ELSE 'rain_notes.txt' END AS file FROM events) WHERE file = 'rain_2024_1.nc' AND month(ts) = 1 OR file = 'rain_2024_02.nc' AND month(ts) = 2")
def s12_s13_own_month(spark: SparkSession, d: str) -> DataFrame:
    names = ["rain_2024_1.nc", "rain_2024_02.nc", "heat_2024_01.nc", "rain_2024_13.nc", "rain_notes.txt"]
    file = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "events").select("event_id", F.col("ts").alias("time"), F.concat(F.lit("/landed/"), file).alias("file"))
    return tables.of_own_month(rows, prefix="rain").select("event_id", "time")


@query("SELECT 'n' || n_nationkey || '_superficial.geojson' AS file, n_name AS name, (n_nationkey * 10)::DOUBLE AS west FROM nation WHERE n_regionkey IN (0, 1)")
def s18_vector_folders(spark: SparkSession, d: str) -> DataFrame:
    """A file a nation in a folder a region; the scan takes folders by name, files by suffix, and outlives a broken file."""
    place, n = _place(spark, "geology"), table(spark, d, "nation").collect()  # 25 rows
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def put(name: str, text: str) -> None:
        out = files.create(path(f"{place}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()

    for x in n:
        w = x["n_nationkey"] * 10.0
        ring = [[w, 0.0], [w + 10, 0.0], [w + 10, 5.0], [w, 0.0]]
        shape = {"features": [{"properties": {"name": x["n_name"]}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
        put(f"{('ew', 'sc')[x['n_regionkey'] % 2] if x['n_regionkey'] < 2 else 'zz'}_{x['n_regionkey']}/n{x['n_nationkey']}_superficial.geojson", json.dumps(shape))
    put("ew_0/broken_superficial.geojson", "{")
    put("ew_0/n0_bedrock.geojson", "{}")
    return tables.read_vectors(spark, place, "(ew|sc).*", "_superficial.geojson", ["name"]).select("file", "name", F.col("ring")[0]["x"].alias("west"))


@query("SELECT p_brand AS name, CAST(max(p_size) AS VARCHAR) AS value FROM part GROUP BY p_brand")
def k09_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Fitted twice: what was written last is read."""
    place, fitted = _place(spark, "parameters"), table(spark, d, "part").groupBy(F.col("p_brand").alias("name"))
    sinks.write_parameters(fitted.agg(F.min("p_size").alias("value")), place)
    sinks.write_parameters(fitted.agg(F.max("p_size").alias("value")), place)
    return sinks.read_parameters(spark, place)


@query("SELECT l_partkey % 50 AS src, count(DISTINCT l_suppkey % 50) AS n FROM lineitem GROUP BY ALL")
def s21_edge_table(spark: SparkSession, d: str) -> DataFrame:
    """Edges stored and read as a table, where others store arrays of pairs."""
    place = _place(spark, "edges")
    sinks.write_parquet(table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 50).alias("dst")).distinct(), place)
    return spark.read.parquet(place).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
