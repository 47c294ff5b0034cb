"""Ledgered retrieval: runs that fail in part, are cut off, or are repeated."""

from __future__ import annotations

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from rillwork.sources import retrieval, tables

SCHEMA = "k int, v string"


def tasks(spark, n):
    return spark.createDataFrame([(f"t{i}", i) for i in range(n)], "task string, i int")


def rows(spark, place):
    return sorted((r["task"], r["k"], r["v"]) for r in retrieval.retrieved(spark, place, SCHEMA).collect())


def expected(n):
    return sorted((f"t{i}", k, f"v{k}") for i in range(n) for k in range(i % 4 + 1))


def flaky(folder, every=3, partly=False):
    """Answers in two parts; each third task fails the first time, after a part of it if ``partly``."""

    def fetch(request):
        i = request["i"]
        mark = f"{folder}/tried-{i}"
        bad = (i + 1) % every == 0 and not os.path.exists(mark)
        open(mark, "a").close()
        if bad and not partly:
            raise OSError("refused")
        yield [{"k": 0, "v": "v0"}]
        if bad:
            raise ValueError("cut off")
        yield [{"k": k, "v": f"v{k}"} for k in range(1, i % 4 + 1)]

    return fetch


@pytest.mark.parametrize("partly", [False, True])
def test_each_row_arrives_once_though_a_third_fails(spark, tmp_path, partly):
    place, fetch = f"file://{tmp_path}/kept", flaky(tmp_path, partly=partly)
    first = {r["task"]: r["state"] for r in retrieval.retrieve(tasks(spark, 20), place, fetch, SCHEMA).collect()}
    assert {t for t, s in first.items() if s == "failed"} == {f"t{i}" for i in range(2, 20, 3)} and len(first) == 20
    assert rows(spark, place) == [r for r in expected(20) if (int(r[0][1:]) + 1) % 3]
    again = {r["task"]: r["state"] for r in retrieval.retrieve(tasks(spark, 20), place, fetch, SCHEMA).collect()}
    assert again == {f"t{i}": "done" for i in range(2, 20, 3)}  # no other is asked for
    assert rows(spark, place) == expected(20)
    assert retrieval.retrieve(tasks(spark, 20), place, fetch, SCHEMA).count() == 0 and rows(spark, place) == expected(20)
    assert retrieval.sweep(spark, place) == 0
    assert retrieval.retrieve(tasks(spark, 22), place, fetch, SCHEMA).count() == 2


def test_attempts_within_a_run(spark, tmp_path):
    place = f"file://{tmp_path}/kept"
    got = retrieval.retrieve(tasks(spark, 12), place, flaky(tmp_path, partly=True), SCHEMA, attempts=2).collect()
    assert [r["state"] for r in got] == ["done"] * 12 and rows(spark, place) == expected(12)


def test_a_run_that_is_cut_off_changes_nothing(spark, tmp_path):
    place = f"file://{tmp_path}/kept"
    retrieval.retrieve(tasks(spark, 3), place, flaky(tmp_path, every=99), SCHEMA)

    def dies(request):
        yield [{"k": 0, "v": "v0"}]
        if request["i"] == 7:
            raise RuntimeError("the task dies")  # no failure of the service: Spark's task fails

    with pytest.raises(Exception, match="the task dies"):
        retrieval.retrieve(tasks(spark, 9), place, dies, SCHEMA)
    assert rows(spark, place)[:3] == expected(3)[:3] and {r[0] for r in rows(spark, place)} == {"t0", "t1", "t2"}
    retrieval.sweep(spark, place)
    assert retrieval.sweep(spark, place) == 0
    retrieval.retrieve(tasks(spark, 9), place, flaky(tmp_path, every=99), SCHEMA)
    assert rows(spark, place) == expected(9)


def test_two_runs_at_once_count_once(spark, tmp_path):
    """Both have asked for the same task before either has ended: the first entry counts."""
    place = f"file://{tmp_path}/kept"
    retrieval.retrieve(tasks(spark, 4), place, flaky(tmp_path, every=99), SCHEMA)
    (entry,) = os.listdir(tmp_path / "kept" / "ledger")
    (tmp_path / "aside").mkdir()
    os.rename(tmp_path / "kept" / "ledger" / entry, tmp_path / "aside" / entry)
    retrieval.retrieve(tasks(spark, 4), place, flaky(tmp_path, every=99), SCHEMA)
    os.rename(tmp_path / "aside" / entry, tmp_path / "kept" / "ledger" / entry)
    assert rows(spark, place) == expected(4)
    assert retrieval.sweep(spark, place) == 0  # both are named


def test_archives_of_files(spark, tmp_path):
    """Months of an archive: plain, zipped, empty, missing, and a zip of two files."""
    remote, place = tmp_path / "remote", f"file://{tmp_path}/kept"
    remote.mkdir()

    def packed(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, f"inner {n}" * 1000)
        return out.getvalue()

    months = retrieval.archive_months(spark, "2001-11-15", "2002-03-01", f"file://{remote}", "era", ".grib")
    names = sorted(r["name"] for r in months.collect())
    assert names == ["era_2001_11.grib", "era_2001_12.grib", "era_2002_1.grib", "era_2002_2.grib", "era_2002_3.grib"]
    (remote / names[0]).write_bytes(b"plain")
    (remote / names[1]).write_bytes(packed(["download"]))
    (remote / names[2]).write_bytes(b"")
    (remote / names[3]).write_bytes(packed(["a", "b"]))
    first = {r["task"]: r["state"] for r in retrieval.retrieve(months, place, retrieval.fetch_file).collect()}
    assert [first[n] for n in names] == ["done", "done", "empty", "failed", "failed"]
    held = {r["task"]: r["path"] for r in retrieval.retrieved_files(spark, place).collect()}
    assert {t: open(p.removeprefix("file://"), "rb").read() for t, p in held.items()} == {names[0]: b"plain", names[1]: b"inner download" * 1000}
    assert all(p.endswith("/" + t) for t, p in held.items())
    for n in names[2:]:
        (remote / n).write_bytes(b"late")
    assert sorted(r["task"] for r in retrieval.retrieve(months, place, retrieval.fetch_file).collect()) == names[2:]
    assert retrieval.retrieved_files(spark, place).count() == 5 and retrieval.sweep(spark, place) == 0
    service = retrieval.archive_months(spark, "2004-02-10", "2004-02-11", "https://x/y", "era", area=(55.5, -3, 54, -1.25)).first()
    assert service["url"] == "https://x/y?from=2004-02-01T00:00&to=2004-02-29T23:00&area=55.5,-3,54,-1.25"


def test_nothing_to_retrieve(spark, tmp_path):
    place = f"file://{tmp_path}/none"
    assert retrieval.retrieved(spark, place, SCHEMA).count() == 0 and retrieval.sweep(spark, place) == 0
    none = tasks(spark, 1).where("false")
    assert retrieval.retrieve(none, place, flaky(tmp_path), SCHEMA).count() == 0
    odd = spark.createDataFrame([(None, 1), ("t2", 2), ("t2", 2)], "task string, i int")
    assert retrieval.retrieve(odd, place, flaky(tmp_path, every=99), SCHEMA).count() == 1


def test_stations_by_their_own_id(spark):
    def service(url):
        if url.endswith("wiskiID=a"):
            return [{"@id": "http://x/a", "label": "A"}, {"@id": "http://x/b"}]
        if url.endswith("wiskiID=c"):
            return [{"@id": "http://x/c", "label": "C"}]
        if url.endswith("wiskiID=d"):
            return [{"label": "no address"}]
        if url == "http://x/a/measures":
            return [{"@id": "m1"}, {"@id": "m2"}]
        if "broken" in url or url.endswith("/c/measures"):
            raise OSError("down")
        return []

    ids = spark.createDataFrame([(i, "clash") for i in ("a", "broken", "c", "d", "none", None)], "station_id string, metadata string")
    got = {r["station_id"]: r for r in tables.station_details(tables.look_up_stations(ids, "http://x/stations", fetch=service)).collect()}
    assert (got["a"]["station_name"], got["a"]["measure_uri"]) == ("A", "m1") and len(json.loads(got["a"]["measures"])) == 2
    assert (got["c"]["station_name"], got["c"]["measure_uri"]) == ("C", None) and got["d"]["station_name"] == "no address"
    assert all(got[i]["metadata"] is None and got[i]["station_name"] is None for i in ("broken", "none", None))


def test_flows_take_in_the_day_after(spark, tmp_path):
    asked = []

    def page(url):
        with open(tmp_path / "asked", "a") as f:
            f.write(url + "\n")
        first = int(url.rpartition("_offset=")[2])
        return [{"dateTime": f"d{i}", "date": "x", "value": None if i == 1 else str(i), "quality": None} for i in range(first, min(first + 2, 5))]

    measures = spark.createDataFrame([("http://m", 1), (None, 2), ("not an address", 3), ("http://m", 4)], "measure_uri string, i int")
    got = tables.download(spark, measures, str(tmp_path / "kept"), start="2020-02-01", end="2020-02-28", limit=2, flow=True, fetch=page)
    assert sorted((r["dateTime"], r["value"]) for r in got.collect()) == [("d0", 0.0), ("d1", None), ("d2", 2.0), ("d3", 3.0), ("d4", 4.0)]
    asked = (tmp_path / "asked").read_text().split()
    assert [a.partition("?")[2] for a in asked] == [f"mineq-date=2020-02-01&max-date=2020-02-29&_limit=2&_offset={o}" for o in (0, 2, 4)]
    assert got.agg(F.count("measure")).first()[0] == 5


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_downloads_from_a_folder_named_by_its_path_or_uri(spark, tmp_path, scheme):
    service = f"{scheme}{tmp_path}/service"
    rows = spark.range(9).selectExpr("concat('d', 8 - id) as dateTime", "concat('2020-01-0', 1 + id div 3) as date", "double(id) as value", "'Good' as quality", "id % 2 as kind")
    rows.write.partitionBy("kind").parquet(service)
    measures = spark.createDataFrame([(f"{service}/kind={k}",) for k in (0, 1)] + [("not an address",)], "measure_uri string")
    got = tables.download(spark, measures, f"{scheme}{tmp_path}/kept", start="2020-01-02", limit=2, fetch=tables.replay)
    assert sorted((r["measure"][-1], r["dateTime"], r["value"]) for r in got.collect()) == sorted((str(i % 2), f"d{8 - i}", float(i)) for i in range(3, 9))


def test_a_shared_folder_named_by_its_path_gives_all_readings(spark, sf_dir, tmp_path, monkeypatch):
    from rillwork.plans import archive_queries

    monkeypatch.setattr(archive_queries, "shared_root", lambda _: str(tmp_path))
    assert archive_queries.s06_s07_download(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_a_landed_copy_of_stations_keeps_many_ids_in_a_folder(spark, tmp_path):
    place, n = f"file://{tmp_path}/stations", 2 * tables.IDS
    rows = [(i, json.dumps({"@id": f"{place}/id={i}", "label": f"L{i}"}), f"m{i}" if i % 2 else None) for i in range(1, n, 7)]
    held = spark.createDataFrame(rows, "id bigint, station string, measure string").withColumn("ids", F.floor(F.col("id") / tables.IDS))
    held.repartition("ids").write.partitionBy("ids").parquet(place)
    assert len([f for f in os.listdir(tmp_path / "stations") if f.startswith("ids=")]) == 2
    asked = spark.range(2 * n).select(F.col("id").alias("station_id"))
    got = tables.station_details(tables.look_up_stations(asked, place, fetch=tables.replay_station)).select("station_id", "station_name", "measure_uri")
    known = {i: (f"L{i}", m) for i, _, m in rows}
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == {i: known.get(i, (None, None)) for i in range(2 * n)}
