import gzip
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dockflow.contract import ContractError, default_contract
from dockflow.operators import conform
from dockflow.sources import archives, planning, weather


def zip_of(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/") + ".csv", text)
        z.writestr("readme.txt", "not a table")


def test_zip_members_at_any_depth_by_their_own_header(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    zip_of(tmp_path / "deep" / "er" / "a.zip",
           x='Trip ID,Note\r\n1,"a, b"\r\n2,\r\n3,a\u2028b\r\n', sub__y="tripid\n7\n")
    zip_of(tmp_path / "b.zip", z="trip_id,note\n9,it's 5\" wide\n10,next")
    rows = archives.read_zip_csv(spark, str(tmp_path)).collect()
    got = sorted(((r["archive"], r["member"], tuple(sorted(r["cells"].items()))) for r in rows), key=str)
    assert got == [
        ("a.zip", "sub/y.csv", (("tripid", "7"),)),
        ("a.zip", "x.csv", (("Note", "a, b"), ("Trip ID", "1"))),
        ("a.zip", "x.csv", (("Note", "a\u2028b"), ("Trip ID", "3"))),
        ("a.zip", "x.csv", (("Note", None), ("Trip ID", "2"))),
        ("b.zip", "z.csv", (("note", "it's 5\" wide"), ("trip_id", "9"))),
        ("b.zip", "z.csv", (("note", "next"), ("trip_id", "10"))),
    ]


def test_member_larger_than_a_block_is_spread(spark, tmp_path, monkeypatch):
    lines = "".join(f"{i},{'é' * (i % 50)}\n" for i in range(200_000))
    zip_of(tmp_path / "big.zip", t="id,text\n" + lines)
    df = archives.read_zip_csv(spark, str(tmp_path))
    found = df.selectExpr("count(*)", "count(DISTINCT cells['id'])", "sum(length(cells['text']))").first()
    assert tuple(found) == (200_000, 200_000, sum(i % 50 for i in range(200_000)))


def test_no_archives_is_an_error(spark, tmp_path):
    with pytest.raises(ContractError):
        archives.read_zip_csv(spark, str(tmp_path))


def test_a_thousand_csv_files_meet_their_headers_in_one_read(spark, tmp_path):
    """Odd names of files, byte order marks, quotes and repeated header lines included."""
    for n in range(1000):
        head, line = (("trip id,note", f'{n},"a, {n}"') if n % 3 else ("note,bike,trip id", f",b{n},{n}"))
        mark = "\ufeff" if n % 2 else ""
        ending = "\r\n" if n % 5 else "\n"
        (tmp_path / f"part {n} %41é.csv").write_text(ending.join([mark + head, line, "", head, ""]), "utf-8", newline="")
    (tmp_path / "empty.csv").write_text("")
    df = archives.read_csv_text(spark, str(tmp_path))
    got = {r["trip id"]: (r["note"], r["bike"]) for r in df.collect()}
    assert df.count() == 1000 and sorted(df.columns) == ["bike", "note", "trip id"]
    assert got == {str(n): ((f"a, {n}", None) if n % 3 else (None, f"b{n}")) for n in range(1000)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("] text") == 1


def test_csv_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "q1").mkdir()
    (tmp_path / "q1" / "a.csv").write_text("Trip ID,Bike Type,Note\n1,electric,x\n")
    (tmp_path / "b.csv").write_text("bike_type,trip_id\nclassic,2\n")
    (tmp_path / "c.csv").write_text("tripid\n3\n")
    df = archives.read_csv_text(spark, str(tmp_path))
    assert set(df.columns) == {"Trip ID", "Bike Type", "Note", "bike_type", "trip_id", "tripid"}
    picked = conform.resolve_columns(df, {k: conform.COLUMN_ALIASES[k] for k in ("trip_id", "bike_type")})
    assert sorted(map(tuple, picked.collect())) == [("1", "electric"), ("2", "classic"), ("3", None)]


def test_header_audit_names_archive_and_column(spark, tmp_path):
    rest = "start_time,end_time,start_station,end_station,bike_id\n1,2,,,,,\n"
    zip_of(tmp_path / "good.zip", t="trip_id,duration," + rest)
    zip_of(tmp_path / "bad.zip", t="trip_id,dur," + rest)
    gaps = conform.missing_columns(archives.read_zip_headers(spark, str(tmp_path)))
    assert [(r["archive"], r["column_name"]) for r in gaps.collect()] == [("bad.zip", "duration")]


PAYLOAD = {
    "_point": {"name": "center"},
    "hourly": {
        "time": ["2026-01-01T00:00", "2026-01-01T08:00", "2026-01-01T12:00", "2026-01-02T12:00"],
        "temperature_2m": [1, 2.5, None, 4],
        "rain": [0, 0],
    },
    "daily": {"time": ["2026-01-01", "2026-01-02"], "sunrise": ["2026-01-01T08:00", None],
              "sunset": ["2026-01-01T17:00", "2026-01-02T17:00"]},
}


def test_weather_arrays_are_zipped(spark, tmp_path):
    for name in ("a", "b"):  # the second file repeats the first
        (tmp_path / f"{name}.json.gz").write_bytes(gzip.compress(json.dumps(PAYLOAD).encode()))
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(b'{"hourly": {"time": ["2026-01-01T00:00"]}}'))
    docs = weather.read_payloads(spark, str(tmp_path))
    rows = weather.weather_hours(docs, default_contract(), unzoned=True).orderBy("point_name", "hour_ts").collect()
    assert [(r["point_name"], r["hour_ts"].hour, r["temperature_2m"], r["rain"], r["is_daylight"]) for r in rows] == [
        ("center", 0, 1.0, 0.0, 0.0), ("center", 8, 2.5, 0.0, 1.0), ("center", 12, None, None, 1.0),
        ("center", 12, 4.0, None, None), ("unknown", 0, None, None, None),
    ]
    assert rows[0]["snowfall"] is None


def page(*links):
    return "".join(f'<a class="x" HREF="{x}">t</a>' for x in links)


def test_links(spark):
    base = "https://example.org/up/2026/07/bikes"
    pages = spark.createDataFrame([
        (1, page(f"{base}-trips-2021-q4.zip", f"{base}-trips-2022-q1.zip", f"{base}-stations-2026-01-01.csv")),
        (2, page(f"{base}-trips-2022-q1.zip?old", f"{base}-new-trips-2022-q1.zip", f"{base}-stations-2026-07-15.csv")),
    ], "page_id long, html string")
    found = planning.trip_archives(pages, 2022).collect()
    assert [tuple(r) for r in found] == [(2022, 1, f"{base}-new-trips-2022-q1.zip")]
    assert planning.newest_station_file(pages).first()[0] == f"{base}-stations-2026-07-15.csv"


@pytest.mark.parametrize("last,chunks", [("2022-01-01", 1), ("2022-07-02", 1), ("2022-07-03", 2), ("2023-01-01", 2)])
def test_chunks_cover_every_day_once(spark, last, chunks):
    points = planning.grid_points(spark, default_contract())
    bounds = spark.sql(f"SELECT DATE'2022-01-01' AS first_day, DATE'{last}' AS last_day")
    plan = planning.fetch_plan(points, bounds)
    days = plan.selectExpr("point_name", "explode(sequence(chunk_start, chunk_end)) AS d")
    assert plan.count() == chunks * 4
    assert days.count() == days.distinct().count() == 4 * spark.sql(
        f"SELECT datediff(DATE'{last}', DATE'2022-01-01') + 1").first()[0]


def test_landed_chunks_are_not_fetched_again(spark, tmp_path):
    bounds = spark.sql("SELECT DATE'2022-01-01' AS first_day, DATE'2022-12-31' AS last_day")
    plan = planning.fetch_plan(planning.grid_points(spark, default_contract()), bounds)
    (tmp_path / "point=north").mkdir()
    (tmp_path / "point=north" / "2022-01-01_2022-07-02.json.gz").write_bytes(b"x")
    left = planning.still_to_fetch(plan, planning.landed_objects(spark, str(tmp_path)))
    names = {r["object_name"] for r in left.collect()}
    assert len(names) == plan.count() - 1 and "point=north/2022-01-01_2022-07-02.json.gz" not in names


def test_station_file(spark):
    raw = spark.createDataFrame(
        [("3005", "A", "1/5/2024"), ("3006.0", "B", "2024-02-06"), ("x", "C", "1/1/2024"), ("3007", "D", "soon")],
        "`Station ID` string, Name string, `Day of Go_live_date` string",
    )
    rows = sorted(conform.parse_stations(raw, unzoned=True).collect())
    assert [(r["station_id"], r["go_live_date"]) for r in rows] == [
        (3005, datetime(2024, 1, 5)), (3006, datetime(2024, 2, 6)), (3007, None)]
    assert tuple(conform.undated_stations(conform.parse_stations(raw)).first()) == (3, 1)
    with pytest.raises(ContractError):
        conform.parse_stations(raw.drop("Name"))


def test_records_are_split_as_a_csv_reader_would(spark):
    import csv

    lines = ["a,b", ",a,,", '"x, y",z', '"say ""hi""",2', 'stray"quote,3', '"",q', 'é,"ü,""ß"""', "one"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r.i: r.cells for r in rows.select("i", archives.split_record(F.col("line")).alias("cells")).collect()}
    assert got == {i: next(csv.reader([x])) for i, x in enumerate(lines)}
