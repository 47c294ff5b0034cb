"""Projections, filters, scalar functions, joins, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assembly, calendars, metrics, order, preparation
from ..sources import tables as sources
from .registry import DAILY, RAIN, READINGS, STATIONS, daily, query, r, rain, readings, stations, stored, table


@query("SELECT n_nationkey, replace(lower(trim(n_name)), ' ', '_') AS name, upper(n_name) AS loud, 'Station ' || upper(n_name[1]) || lower(n_name[2:]) AS title FROM nation")
def x01_f13_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select("n_nationkey", S.normal_name(F.col("n_name")).alias("name"), F.upper("n_name").alias("loud"), F.concat(F.lit("Station "), S.title_name(F.col("n_name"))).alias("title"))


@query("SELECT page_id, split_part(url, '/', -1) AS last, regexp_extract(url, '^[a-z]+', 0) AS scheme, starts_with(url, 'https') AS safe, contains(url, 'example.net') AS net, regexp_matches(url, '/(en|de)/') AS known, url LIKE '%.html' AS html FROM pages")
def x02_x03_path_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", S.last_segment(u).alias("last"), F.regexp_extract(u, "^[a-z]+", 0).alias("scheme"), u.startswith("https").alias("safe"), u.contains("example.net").alias("net"), u.rlike("/(en|de)/").alias("known"), u.endswith(".html").alias("html"))


@query("""WITH g AS (SELECT s_suppkey, 'NY' || (100 + s_suppkey % 800) || (200 + s_suppkey % 700) AS ref FROM supplier)
SELECT s_suppkey, ref, 300000 + CAST(rpad(substr(ref, 3, 3), 5, '0') AS BIGINT) AS easting, 500000 + CAST(rpad(substr(ref, 6, 3), 5, '0') AS BIGINT) AS northing FROM g""")
def x04_j20_g01_grid_reference(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat(F.lit("NY"), (100 + F.col("s_suppkey") % 800).cast("string"), (200 + F.col("s_suppkey") % 700).cast("string"))
    squares = spark.createDataFrame([("NY", 300000, 500000), ("NZ", 400000, 500000)], "letters string, base_e long, base_n long")
    rows = table(spark, d, "supplier").select("s_suppkey", ref.alias("ref")).withColumn("letters", F.substring("ref", 1, 2))
    e, n = S.grid_easting_northing(F.col("ref"), F.col("base_e"), F.col("base_n"))
    return rows.join(squares, "letters", "left").select("s_suppkey", "ref", e.alias("easting"), n.alias("northing"))


@query("SELECT p_partkey, replace(CAST(p_retailprice AS VARCHAR), '.', '-') AS token, concat_ws('_', p_brand, p_type) AS label FROM part")
def x05_file_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.file_token(F.col("p_retailprice")).alias("token"), F.concat_ws("_", "p_brand", "p_type").alias("label"))


@query("""WITH h AS (SELECT n_nationkey, list_transform(range(1, 33), lambda i: CAST(instr('0123456789abcdef', substr(md5(n_name), i, 1)) - 1 AS BIGINT)) AS x FROM nation)
SELECT n_nationkey, list_reduce(x, lambda a, b: (a * 16 + b) % 10000) AS bucket FROM h""")
def x07_stable_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", S.stable_bucket(F.col("n_name")).alias("bucket"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def a33_x08_sha256(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"""WITH {DAILY}, x AS (SELECT DISTINCT day FROM daily UNION SELECT CAST(o_orderdate AS DATE) FROM orders)
SELECT day, dayofyear(day) AS doy, CASE WHEN (year(day) % 4 = 0 AND (year(day) % 100 <> 0 OR year(day) % 400 = 0)) AND dayofyear(day) >= 60 THEN dayofyear(day) - 1 ELSE dayofyear(day) END AS doy365, least(dayofyear(day), 365) AS clipped,
  month(day) AS month, day(last_day(day)) AS days, CAST(date_trunc('month', day) AS DATE) AS first, CAST(day - INTERVAL 72 MONTH AS DATE) AS six_years_before FROM x""")
def x09_x10_x13_dates(spark: SparkSession, d: str) -> DataFrame:
    days = daily(spark, d).select("day").union(table(spark, d, "orders").select(F.to_date("o_orderdate"))).distinct()
    c = F.col("day")
    long = lambda x, n: x.cast("long").alias(n)
    return days.select("day", long(F.dayofyear(c), "doy"), long(S.day_of_year_365(c), "doy365"), long(F.least(F.dayofyear(c), F.lit(365)), "clipped"), long(F.month(c), "month"), long(F.dayofmonth(F.last_day(c)), "days"), F.trunc(c, "month").alias("first"), F.add_months(c, -72).alias("six_years_before"))


@query("""SELECT event_id, round(sqrt(value), 8) AS root, round(ln(value + 1), 8) AS log1, round(1 / (1 + exp(-value / 50)), 8) AS logistic, floor(value) AS down, ceil(value) AS up, round_even(value, 1) AS even, round(atan2(value, 3), 8) AS angle, round(sqrt(value * value + 9), 8) AS hyp FROM events""")
def x16_x17_math(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", r(F.sqrt(v), 8).alias("root"), r(F.log(v + 1), 8).alias("log1"), r(S.sigmoid(v / 50), 8).alias("logistic"), F.floor(v).cast("double").alias("down"), F.ceil(v).cast("double").alias("up"), F.bround(v, 1).alias("even"), r(F.atan2(v, F.lit(3.0)), 8).alias("angle"), r(F.hypot(v, F.lit(3.0)), 8).alias("hyp"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def x18_json_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm, len(embedding) AS n, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 6) AS head FROM embeddings""")
def x19_x20_arrays(spark: SparkSession, d: str) -> DataFrame:
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", r(F.sqrt(add(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")))), 6).alias("norm"), F.size("embedding").cast("long").alias("n"), r(add(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))), 6).alias("head"))


@query("SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS quality, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def p01_ensure_columns(spark: SparkSession, d: str) -> DataFrame:
    return assembly.with_columns(table(spark, d, "customer"), [("c_custkey", "long"), ("c_name", "string"), ("quality", "double"), ("c_nationkey", "long")])


@query("SELECT s_acctbal, s_suppkey, s_name FROM supplier")
def p02_p03_p06_reorder(spark: SparkSession, d: str) -> DataFrame:
    return assembly.reordered(table(spark, d, "supplier").drop("s_nationkey", "absent"), ["s_acctbal", "absent"])


@query("SELECT p_partkey AS node_id, p_size AS size_class, p_retailprice AS price FROM part")
def p04_p05_rename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumnsRenamed({"p_partkey": "node_id", "p_size": "size_class", "p_retailprice": "price"}).select("node_id", "size_class", "price")


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'SMALL' THEN 'low' WHEN 'STANDARD' THEN 'mid' ELSE 'unknown' END AS class, CASE p_type WHEN 'ECONOMY' THEN 1.5::DOUBLE WHEN 'SMALL' THEN 2.5 END AS code,
  CASE p_size WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE p_size END AS size FROM part""")
def p07_p09_p10_value_maps(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", S.mapped(t, {"ECONOMY": "low", "SMALL": "low", "STANDARD": "mid"}, "unknown").alias("class"), S.mapped(t, {"ECONOMY": 1.5, "SMALL": 2.5}).alias("code"), S.mapped(F.col("p_size"), {1: 100, 2: 200}, keep=True).alias("size"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size END AS a, CASE WHEN p_size % 2 > 0 THEN p_retailprice END AS b FROM part)
SELECT p_partkey, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END AS mean FROM x""")
def p12_mean_of_available(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", S.mean_of_available(F.when(s % 3 > 0, s), F.when(s % 2 > 0, F.col("p_retailprice"))).alias("mean"))


@query("""WITH x AS (SELECT l_orderkey, list(DISTINCT CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'N' THEN 'Low' ELSE 'None' END) AS v FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN len(v) >= 3 THEN 'Mixed' WHEN list_contains(v, 'High') THEN 'High' WHEN list_contains(v, 'Low') THEN 'Low' WHEN list_contains(v, 'None') THEN 'None' END AS class FROM x""")
def p13_priority_class(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    name = S.mapped(F.col("l_returnflag"), {"A": "High", "N": "Low"}, "None")
    return li.groupBy("l_orderkey").agg(F.collect_set(name).alias("v")).select("l_orderkey", S.priority_class(F.col("v"), ["High", "Moderate", "Low", "None"]).alias("class"))


@query("SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(least(value, 80), 8) END AS capped FROM events")
def p14_clip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.clip(F.col("value"), 8.0, 80.0).alias("capped"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'no date' ELSE '2024-02-03 04:05:06' END AS TIMESTAMP) AS time FROM events")
def p15_coerce(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    return e.select("event_id", S.to_number(F.when(i % 7 == 0, "bad").otherwise(F.col("value").cast("string"))).alias("number"), S.to_time(F.when(i % 5 == 0, "no date").otherwise("2024-02-03 04:05:06")).alias("time"))


@query("SELECT event_id, greatest(-(value - 20), 0) AS evaporation, round(value - 273.15, 6) AS celsius, round(value / 100, 6) AS hectopascal, round(value * 86400, 4) AS per_day, round(value / 1000 * 1e6, 4) AS volume, CASE WHEN value > 110 THEN value - 17.5 ELSE value END AS pressure FROM events")
def p16_p17_units(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.greatest(-(v - 20), F.lit(0.0)).alias("evaporation"), r(v - 273.15).alias("celsius"), r(v / 100).alias("hectopascal"), r(v * 86400, 4).alias("per_day"), r(v / 1000 * 1e6, 4).alias("volume"), F.when(v > 110, v - 17.5).otherwise(v).alias("pressure"))


@query("WITH x AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) SELECT event_id, coalesce(v, -999.0) AS filled, CAST(v AS FLOAT) AS small, v IS NULL AS missing FROM x")
def p19_p20_f05_sentinel(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return e.select("event_id", F.col("v").alias("filled"), F.col("v").cast("float").alias("small"), F.col("v").isNull().alias("missing")).fillna(-999.0, ["filled"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND NOT (o_orderpriority = '5-LOW' OR o_custkey % 10 = 3)")
def f04_f06_f07_f11_filters(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 200000) & ~((F.col("o_orderpriority") == "5-LOW") | (F.col("o_custkey") % 10 == 3))).select("o_orderkey", "o_totalprice")


@query("WITH x AS (SELECT event_id, value AS a, CASE WHEN event_id % 4 = 0 THEN value * 1.000001 WHEN event_id % 4 = 1 THEN value + 0.5 ELSE value END AS b FROM events) SELECT event_id, abs(a - b) <= 1e-8 + 1e-5 * abs(b) AS same FROM x")
def f12_close_to(spark: SparkSession, d: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    return table(spark, d, "events").select("event_id", S.close_to(v, F.when(i % 4 == 0, v * 1.000001).when(i % 4 == 1, v + 0.5).otherwise(v)).alias("same"))


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events) WHERE value IS NOT NULL")
def f10_drop_missing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value")).dropna(subset=["value"])


@query("WITH s AS (SELECT o_custkey, sum(o_totalprice) / 1e7 AS score FROM orders GROUP BY ALL) SELECT o_custkey, round(score, 6) AS score FROM s WHERE score >= 0.3")
def f09_threshold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.sum("o_totalprice") / 1e7).alias("score")).where("score >= 0.3").select("o_custkey", r("score"))


@query("SELECT p_partkey AS node_id, p_size, s_name, n_name, r_name FROM part LEFT JOIN supplier ON p_partkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j01_j02_j08_static_chain(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), "p_size")
    out = assembly.left_chain(p, [table(spark, d, "supplier").withColumnRenamed("s_suppkey", "node_id")], "node_id")
    out = assembly.left_chain(out.withColumnRenamed("s_nationkey", "n_nationkey"), [table(spark, d, "nation")], "n_nationkey")
    return assembly.left_chain(out.withColumnRenamed("n_regionkey", "r_regionkey"), [table(spark, d, "region")], "r_regionkey").select("node_id", "p_size", "s_name", "n_name", "r_name")


@query(f"""WITH {RAIN}, cal AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-03-31', INTERVAL 1 DAY)) AS DATE) AS day),
  ship AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(count(*) AS DOUBLE) AS shipped FROM lineitem GROUP BY ALL) SELECT day, rainfall, shipped FROM cal LEFT JOIN rain USING (day) LEFT JOIN ship USING (day)""")
def j03_series_chain(spark: SparkSession, d: str) -> DataFrame:
    ship = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("shipped"))
    return assembly.merge_series(calendars.calendar(spark, "1996-01-01", "1996-03-31"), [rain(spark, d), ship])


@query(f"""WITH {RAIN}, cal AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-01-31', INTERVAL 1 DAY)) AS DATE) AS day), nodes AS (SELECT s_suppkey AS node_id FROM supplier),
  target AS (SELECT l_suppkey AS node_id, CAST(l_shipdate AS DATE) AS day, round(avg(l_quantity), 6) AS level FROM lineitem GROUP BY ALL)
SELECT day, node_id, s_acctbal, rainfall, level FROM cal CROSS JOIN nodes LEFT JOIN supplier ON node_id = s_suppkey LEFT JOIN rain USING (day) LEFT JOIN target USING (day, node_id)""")
def d11_j04_j05_j06_j09_fact_table(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), "s_acctbal")
    target = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node_id"), F.to_date("l_shipdate").alias("day")).agg(F.round(F.avg("l_quantity"), 6).alias("level"))
    return assembly.fact_table(calendars.calendar(spark, "1996-01-01", "1996-01-31"), s.select("node_id"), [s], [rain(spark, d)], target).select("day", "node_id", "s_acctbal", "rainfall", "level")


@query("SELECT c_custkey, replace(lower(c_mktsegment), ' ', '_') AS segment, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 15")
def j07_name_join(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation").where("n_nationkey < 15")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", S.normal_name(F.col("c_mktsegment")).alias("segment"), "n_name")


@query(f"WITH {DAILY}, clim AS (SELECT dayofyear(day) AS doy, avg(value) AS c FROM daily GROUP BY ALL) SELECT station, day, round(c, 6) AS climate FROM daily JOIN clim ON dayofyear(day) = doy")
def j21_day_of_year_join(spark: SparkSession, d: str) -> DataFrame:
    rows = daily(spark, d).withColumn("doy", F.dayofyear("day"))
    return rows.join(rows.groupBy("doy").agg(F.avg("value").alias("climate")), "doy").select("station", "day", r("climate"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_isin(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def u05_anti_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query(f"WITH {RAIN}, b AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM rain), a AS (SELECT rainfall, row_number() OVER (ORDER BY day) AS i FROM rain) SELECT day, rainfall FROM b JOIN a USING (i)")
def j22_positional(spark: SparkSession, d: str) -> DataFrame:
    rows = order.numbered(rain(spark, d), "day", cut=stored)
    return rows.select("i", "day").join(rows.select("i", "rainfall"), "i").select("day", "rainfall")


@query("SELECT 'S' AS kind, s_suppkey AS id, s_acctbal AS balance FROM supplier UNION ALL SELECT 'C', c_custkey, c_acctbal FROM customer")
def u01_union(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    return s.select(F.lit("S").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")).unionByName(c.select(F.lit("C").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")))


@query(f"WITH {DAILY}, p AS (SELECT 0 AS n, station, day, value FROM daily WHERE day < '2024-01-20' UNION ALL SELECT 1, station, day, -value FROM daily WHERE day > '2024-01-10') SELECT station, day, round(arg_min(value, n), 6) AS value FROM p GROUP BY ALL")
def u02_u06_stacked(spark: SparkSession, d: str) -> DataFrame:
    rows = daily(spark, d)
    late = rows.where("day > '2024-01-10'").withColumn("value", -F.col("value"))
    return assembly.stacked([rows.where("day < '2024-01-20'"), late], ["station", "day"]).select("station", "day", r("value"))


@query("SELECT DISTINCT l_partkey % 50 AS src, l_suppkey % 50 AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey % 50, l_partkey % 50 FROM lineitem")
def u03_u04_edge_union(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 50).alias("dst"))
    return li.union(li.select("dst", "src")).dropDuplicates(["src", "dst"])


@query(f"WITH {DAILY} SELECT coalesce(a.day, b.day) AS day, round(a.value, 6) AS u1, round(b.value, 6) AS u2 FROM (SELECT * FROM daily WHERE station = 'u1') a FULL JOIN (SELECT * FROM daily WHERE station = 'u2') b ON a.day = b.day")
def u07_outer_align(spark: SparkSession, d: str) -> DataFrame:
    one = lambda s: daily(spark, d).where(F.col("station") == s).select("day", F.round("value", 6).alias(s))
    return one("u1").join(one("u2"), "day", "full")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q02_q04_top(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events WHERE CAST(('0x' || substr(md5('9:' || event_id), 1, 8)) AS BIGINT) < 0.1 * 4294967296")
def q05_q06_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("9:"), F.col("event_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return table(spark, d, "events").where(draw < 0.1 * 4294967296).select("event_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders QUALIFY k <= 3")
def q03_smallest_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w).cast("long")).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "k")


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS k FROM c) SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type) AS modes FROM m WHERE k = 1 GROUP BY p_brand")
def a05_all_modes(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.spatial import all_modes

    return all_modes(table(spark, d, "part"), "p_brand", "p_type").select("p_brand", F.array_join("modes", ",").alias("modes"))


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), a AS (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY ALL) SELECT p_brand, arg_min(p_type, (-n, p_type)) AS p_type, round(any_value(m), 6) AS price FROM c JOIN a USING (p_brand) GROUP BY p_brand")
def a03_a04_mode_and_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.mode("p_type", True).alias("p_type"), F.round(F.avg("p_retailprice"), 6).alias("price"))


@query("WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice / 7 END AS v FROM part) SELECT p_partkey, round_even(coalesce(v, (SELECT median(v) FROM x)), 2) AS v FROM x")
def a06_median_fill(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice") / 7).alias("v"))
    return x.crossJoin(F.broadcast(x.agg(F.percentile("v", F.lit(0.5)).alias("m")))).select("p_partkey", F.bround(F.coalesce("v", "m"), 2).alias("v"))


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) - count(CASE WHEN o_custkey % 9 > 0 THEN 1 END) AS nulls, round(100.0 * count(CASE WHEN o_custkey % 9 > 0 THEN 1 END) / count(*), 6) AS coverage FROM orders GROUP BY ALL")
def a21_a22_counts(spark: SparkSession, d: str) -> DataFrame:
    some = F.when(F.col("o_custkey") % 9 > 0, 1)
    n = F.count(F.lit(1))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(n.alias("n"), F.countDistinct("o_custkey").alias("customers"), (n - F.count(some)).alias("nulls"), F.round(100.0 * F.count(some) / n, 6).alias("coverage"))


@query(f"WITH {READINGS} SELECT station, arg_min(quality, ts) AS quality, round(arg_min(value, ts) FILTER (value > 20), 6) AS value FROM readings GROUP BY ALL")
def a23_first_values(spark: SparkSession, d: str) -> DataFrame:
    rows = readings(spark, d).withColumn("value", F.when(F.col("value") > 20, F.col("value")))
    return rows.groupBy("station").agg(calendars.first_by("quality", "ts").alias("quality"), F.round(calendars.first_by("value", "ts"), 6).alias("value"))


@query(f"WITH {DAILY} SELECT day, count(*) AS n, string_agg(station || '=', ',' ORDER BY station) AS nodes FROM daily GROUP BY day")
def a24_snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = daily(spark, d).groupBy("day").agg(F.sort_array(F.collect_list(F.struct("station", "value"))).alias("nodes"))
    return rows.select("day", F.size("nodes").cast("long").alias("n"), F.array_join(F.transform("nodes", lambda x: F.concat(x["station"], F.lit("="))), ",").alias("nodes"))


@query("WITH t AS (SELECT o_custkey, min(o_totalprice) AS min_val, avg(o_totalprice) AS mean_val, max(o_totalprice) AS max_val, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY ALL) SELECT o_custkey, min_val, round(mean_val, 4) AS mean_val, max_val, o_orderpriority FROM t ORDER BY t.min_val, t.mean_val, o_custkey LIMIT 10")
def a25_j27_trial_ranking(spark: SparkSession, d: str) -> DataFrame:
    return metrics.trial_ranking(table(spark, d, "orders"), "o_custkey", "o_totalprice", ["o_orderpriority"], "o_orderkey").withColumn("mean_val", F.round("mean_val", 4))


@query(f"WITH {READINGS} SELECT station, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci, count(value) AS n FROM readings GROUP BY ALL")
def a26_confidence(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confidence_summary(readings(spark, d), "value", ["station"]).select("station", r("mean"), r("sd"), r("ci"), "n")


@query(f"WITH {READINGS} SELECT station, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, max(value) AS most FROM readings GROUP BY ALL")
def a27_five_numbers(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.five_numbers(readings(spark, d), "value", ["station"])
    return out.select("station", "least", r("q1"), r("median"), r("q3"), r("iqr"), "most")


@query("SELECT l_suppkey, round_even(avg(l_extendedprice) FILTER (l_returnflag = 'A'), 3) AS A, round_even(avg(l_extendedprice) FILTER (l_returnflag = 'N'), 3) AS N, round_even(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 3) AS R FROM lineitem GROUP BY ALL")
def a31_pivot(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pivoted(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"], "l_extendedprice")


@query(f"WITH {READINGS} SELECT station, arg_max(event_id, (value, -event_id)) AS top, arg_min(event_id, (value, event_id)) AS low FROM readings GROUP BY ALL")
def a32_arg_extremes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return readings(spark, d).groupBy("station").agg(F.max_by("event_id", F.struct("value", -e)).alias("top"), F.min_by("event_id", F.struct("value", e)).alias("low"))


@query("""WITH span AS (SELECT date_trunc('month', min(o_orderdate)) AS first, max(o_orderdate) AS last FROM orders), m AS (SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 MONTH)) AS DATE) AS m FROM span) SELECT 'https://x.org/rain_' || strftime(m, '%Y%m%d') || '-' || strftime(last_day(m), '%Y%m%d') || '.nc' AS file FROM m""")
def s11_month_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of all months that have orders."""
    first, last = table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").cast("string"), F.max("o_orderdate").cast("date").cast("string")).first()
    return sources.month_files(spark, first, last, "https://x.org/rain_")


@query("""WITH m AS (SELECT l_suppkey AS station, l_linenumber AS seq, CASE WHEN l_quantity < 5 THEN '/flow-mean-' ELSE '/level-' END || l_orderkey AS uri, l_orderkey FROM lineitem)
SELECT station, arg_max(uri, (uri LIKE '%flow-mean%', l_orderkey * 10 + seq)) AS uri FROM m GROUP BY station""")
def s08_flow_measure(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    uri = F.concat(F.when(F.col("l_quantity") < 5, "/flow-mean-").otherwise("/level-"), F.col("l_orderkey").cast("string"))
    return sources.flow_measure(li.select(F.col("l_suppkey").alias("station"), uri.alias("uri"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS station_name, CASE WHEN event_id % 4 > 0 THEN 'https://x.org/measures/' || event_id || '-level' END AS measure_uri FROM events")
def s05_station_details(spark: SparkSession, d: str) -> DataFrame:
    """The first of two measures, where a station has any."""
    one = lambda kind: F.format_string('{"@id": "https://x.org/measures/%d-' + kind + '"}', F.col("event_id").cast("long"))
    measures = F.when(F.col("event_id") % 4 > 0, F.format_string("[%s, %s]", one("level"), one("flow"))).otherwise("[]")
    e = table(spark, d, "events").select("event_id", F.regexp_replace("props", '"k"', '"label"').alias("metadata"), measures.alias("measures"))
    return sources.station_details(e).select("event_id", "station_name", "measure_uri")


@query(f"WITH {STATIONS} SELECT station, easting, northing, level FROM stations")
def d04_station_table(spark: SparkSession, d: str) -> DataFrame:
    return stations(spark, d).select("station", "easting", "northing", "level")


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'High' WHEN 'SMALL' THEN 'None' WHEN 'STANDARD' THEN 'Low' ELSE 'unknown' END AS productivity FROM part")
def p08_productivity(spark: SparkSession, d: str) -> DataFrame:
    """The class ``None`` is a name, not a missing value."""
    return table(spark, d, "part").select("p_partkey", S.mapped(F.col("p_type"), {"ECONOMY": "High", "SMALL": "None", "STANDARD": "Low"}, "unknown").alias("productivity"))


@query("SELECT p_partkey, CASE WHEN p_size <= 2 THEN 'Freely draining' WHEN p_size = 3 THEN 'Slightly impeded' END AS drainage FROM part")
def p11_drainage(spark: SparkSession, d: str) -> DataFrame:
    """Without a default, what isn't in the map is null."""
    return table(spark, d, "part").select("p_partkey", S.mapped(F.col("p_size"), {1: "Freely draining", 2: "Freely draining", 3: "Slightly impeded"}).alias("drainage"))


@query(f"WITH {DAILY} SELECT station, day, round(value, 6) AS value, row_number() OVER (ORDER BY station, day) AS place FROM daily")
def q01_sorted(spark: SparkSession, d: str) -> DataFrame:
    """All rows by station and time, in range partitions; places from each partition's start."""
    placed = order.numbered(daily(spark, d).withColumn("at", F.struct("station", "day")), "at", name="place", cut=stored)
    return placed.select("station", "day", r("value"), (F.col("place") + 1).alias("place"))


@query("SELECT p_partkey, p_size, (p_brand = 'Brand#11')::INT::DOUBLE AS brand_11, (p_brand = 'Brand#22')::INT::DOUBLE AS brand_22, (p_type = 'SMALL')::INT::DOUBLE AS small FROM part")
def u08_one_hot_beside(spark: SparkSession, d: str) -> DataFrame:
    """A block of flags beside the columns there are."""
    out = preparation.one_hot(table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type"), {"p_brand": ["Brand#11", "Brand#22"], "p_type": ["SMALL"]})
    return out.select("p_partkey", "p_size", *(F.col(f"`{c}`").cast("double").alias(n) for c, n in (("p_brand_Brand#11", "brand_11"), ("p_brand_Brand#22", "brand_22"), ("p_type_SMALL", "small"))))
