"""Receiver downloads, survey downloads, CSV and stage tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rivertrack.plans.fixed import fixed_detections, fixed_pipeline, fixed_raw
from rivertrack.sources import files, receivers

HEADER = "Date         Time       Site   Ant   Freq     Type     Code  Power"
DOWNLOADS = {
    # two downloads that overlap; the second is out of time order
    "Station4/a_09102024.txt": f"""{HEADER}
2024-09-10   13:18:35     4     1   149.500   LOTEK    211    -73
2024-09-10   13:18:41     4     1   149.500   LOTEK    5      -73

2024-09-10   13:18:50     4     1   149.320   LOTEK    196    -80
2024-09-10   13:18:xx     4     1   149.320   LOTEK    196    -80
2024-09-10   13:19
""",
    "Station4/b_10172024.txt": f"""{HEADER}
2024-09-12   10:00:00     4     1   149.500   LOTEK    1     -91
2024-09-10   13:18:41     4     1   149.500   LOTEK    5      -60
""",
    # two antennas in one second; station written as 7
    "Station6/c_09102024.txt": f"""{HEADER}
2024-09-10   13:18:41     7     2   149.500   LOTEK    5      -99
2024-09-10   13:18:41     7     1   149.500   LOTEK    5      -40
2023-07-03   13:18:41     7     1   149.500   LOTEK    5      -40
2023-08-03   13:18:41     7     1   149.500   LOTEK    5      -40
""",
}


@pytest.fixture(scope="module")
def downloads(tmp_path_factory):
    root = tmp_path_factory.mktemp("downloads")
    for name, text in DOWNLOADS.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return str(root)


def _directories(root):
    return [f"{root}/Station4", f"{root}/Station6"], {f"{root}/Station6": "6"}


@pytest.fixture(params=["whole files", "small splits"])
def splits(spark, request):
    if request.param == "small splits":
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_scan_receiver(spark, rows, downloads, splits):
    got = rows(
        receivers.scan_receiver(spark, [f"{downloads}/Station4"]),
        "tag", "ts", "station", "power", "src_file",
    )
    assert got == sorted(
        [
            ("149.500 211", datetime(2024, 9, 10, 13, 18, 35), "4", -73, "a_09102024.txt"),
            ("149.500 005", datetime(2024, 9, 10, 13, 18, 41), "4", -73, "a_09102024.txt"),
            ("149.320 196", datetime(2024, 9, 10, 13, 18, 50), "4", -80, "a_09102024.txt"),
            ("149.500 001", datetime(2024, 9, 12, 10, 0, 0), "4", -91, "b_10172024.txt"),
            ("149.500 005", datetime(2024, 9, 10, 13, 18, 41), "4", -60, "b_10172024.txt"),
        ],
        key=repr,
    )


def test_receiver_quarantine(spark, rows, downloads):
    bad = rows(receivers.receiver_quarantine(spark, [f"{downloads}/Station4"]), "value")
    assert [b[0].split()[1] for b in bad] == ["13:18:xx", "13:19"]


def test_fixed_raw_keeps_first_in_file_order(spark, rows, downloads, splits):
    raw = fixed_raw(spark, *_directories(downloads))
    got = rows(raw, "station", "tag", "ts", "power")
    at = datetime(2024, 9, 10, 13, 18, 41)
    assert ("4", "149.500 005", at, -73) in got
    assert ("6", "149.500 005", at, -99) in got  # one directory does not hide another
    assert len(got) == 6  # 2023-07-03 lies before the deployment
    assert raw.select("seq").distinct().count() == 6
    four, six = (r.seq for r in raw.where("code = 5 AND year(ts) = 2024").orderBy("seq").collect())
    assert raw.where(F.col("seq") == four).first().station == "4"


def test_fixed_pipeline(spark, rows, downloads):
    raw = fixed_raw(spark, *_directories(downloads))
    kept = fixed_detections(raw)
    assert sorted(r[0] for r in rows(kept, "tag")) == [
        "149.320 196",
        "149.500 001",
        "149.500 005",
        "149.500 005",
    ]
    tags = spark.createDataFrame(
        [("149.500 005", datetime(2024, 9, 10, 13, 18, 40), "M", 55.0)],
        "tag STRING, tag_ts TIMESTAMP_NTZ, sex STRING, fork_length DOUBLE",
    )
    got = rows(fixed_pipeline(raw, tags), "station", "zone", "rkm", "method")
    assert got == [
        ("4", "Nanika River", 214.0, "Fixed"),
        ("6", "Morice Lake", 201.0, "Fixed"),
    ]


SRX = {
    "F39_20240922.TXT": """Receiver SRX1200
Something else
  ID Only Records:
Date      Time     Channel TagID Antenna Power Latitude Longitude
-----------------------------------------------------------------
09/22/2024  08:00:00  1  19   1  120  54.5  -127.1
09/22/2024  08:00:05  2  196  1  130  54.6  -127.2

09/22/2024  08:00:10  1  999  1  10
09/22/24    08:00:15  3  7    1  90
09-22-2024  08:00:20  8  7    2  91   54.7  -127.3
End of data
""",
    "G40_20240925.DTA": """Header
ID Only Records
09/25/2024  01:00:00  1  1  1  1  1  1
09/25/2024  02:00:00  1  2  1  1  1  1
09/25/2024  03:00:00  1  3  1  1  54.8  -127.4
""",
}


def test_scan_srx(spark, rows, tmp_path, splits):
    for name, text in SRX.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "H41_empty.TXT").write_text("no records in this file\n")
    got = rows(
        receivers.scan_srx(spark, str(tmp_path)),
        "station", "ts", "channel", "code", "power", "lat", "long", "date", "hour",
    )
    d1, d2 = date(2024, 9, 22), date(2024, 9, 25)
    assert got == [
        ("F39_20", datetime(2024, 9, 22, 8, 0, 0), 1, 19, 120.0, 54.5, -127.1, d1, 8),
        ("F39_20", datetime(2024, 9, 22, 8, 0, 15), 3, 7, 90.0, None, None, d1, 8),
        ("F39_20", datetime(2024, 9, 22, 8, 0, 20), 8, 7, 91.0, 54.7, -127.3, d1, 8),
        ("F39_20", datetime(2024, 9, 22, 8, 0, 5), 2, 196, 130.0, 54.6, -127.2, d1, 8),
        # exactly two lines after the marker are skipped, whatever they hold
        ("G40_20", datetime(2024, 9, 25, 3, 0, 0), 1, 3, 1.0, 54.8, -127.4, d2, 3),
    ]


def test_srx_zone(spark, tmp_path):
    (tmp_path / "F39.TXT").write_text(SRX["F39_20240922.TXT"])
    first = receivers.scan_srx(spark, str(tmp_path), src_tz="America/Phoenix").orderBy("ts").first()
    assert first.ts == datetime(2024, 9, 22, 15, 0, 0)


def test_number_lines(spark, tmp_path, splits):
    text = [f"line {i} " + "x" * (i % 37) for i in range(200)]
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).write_text("\n".join(text))
    read = files.read_lines(spark, str(tmp_path))
    lines = files.number_lines(read, files.split_table(read))
    for name in ("one.txt", "two.txt"):
        got = lines.where(F.col("src_file") == name).orderBy("line").collect()
        assert [r.value for r in got] == text
        assert [r.line for r in got] == list(range(1, 201))


def test_read_csv_tokens(spark, rows, tmp_path):
    path = tmp_path / "tags.csv"
    path.write_text('Date,Tag.Number,Length\n2024-07-05,12,55.5\nunkn,3?,NA\n"",unkn,\n')
    got = files.read_csv(
        spark, str(path), "`Date` DATE, `Tag.Number` INT, `Length` DOUBLE", ["", "unkn", "NA"]
    )
    assert got.columns == ["Date", "Tag.Number", "Length"]
    assert rows(got) == sorted(
        [(date(2024, 7, 5), 12, 55.5), (None, None, None), (None, None, None)], key=repr
    )


def test_write_csv(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i INT, s STRING")
    files.write_csv(df, str(tmp_path / "out"))
    assert rows(files.read_csv(spark, str(tmp_path / "out"), "i INT, s STRING")) == rows(df)


def test_stage_roundtrip(spark, rows):
    df = spark.createDataFrame(
        [(1, date(2024, 1, 1), "a"), (2, date(2024, 1, 2), None)], "i INT, d DATE, s STRING"
    )
    plain = files.write_stage(df, files.stage_path(spark, "t"))
    parted = files.write_stage(df, files.stage_path(spark, "t"), partition_by=["d"])
    assert rows(plain) == rows(df)
    assert parted.columns == df.columns
    assert rows(parted) == rows(df)


def test_stage_by_date_writes_few_files(spark, tmp_path):
    df = spark.range(0, 4000, 1, 16).selectExpr(
        "id", "date_add(DATE '2024-01-01', cast(id % 3 AS INT)) AS date"
    )
    path = tmp_path / "stage"
    stage = files.write_stage(df, str(path), ["date"])
    assert len(list(path.glob("date=*/*.parquet"))) == 3  # not one per task and day
    one_day = stage.where("date = DATE '2024-01-02'")
    assert "PartitionFilters: [isnotnull(date" in one_day._jdf.queryExecution().toString()
    assert one_day.count() == 1333


def test_more_than_sixteen_stations_keep_their_rows(spark, tmp_path):
    from rivertrack.plans.fixed import fixed_raw

    places = []
    for i in range(20):
        place = tmp_path / f"Station{i + 100}"
        place.mkdir()
        head = "Date Time Site Ant Freq Type Code Power\n"
        (place / "a.txt").write_text(head + "2024-09-04 15:03:08 1 1 149.500 LOTEK 7 -80\n")
        places.append(str(place))
    rows = fixed_raw(spark, places, {p: p[-3:] for p in places}).select("station", "seq").collect()
    assert [r.station for r in sorted(rows, key=lambda r: r.seq)] == [str(i + 100) for i in range(20)]


def test_positions_off_the_earth_are_null(spark):
    from rivertrack.operators.spatial import project_utm

    rows = [(-127.0, 54.0), (-127.0, 90.0), (-127.0, 200.0), (float("nan"), 54.0), (-127.0, None)]
    df = project_utm(spark.createDataFrame(rows, "long double, lat double"))
    got = [r.x is not None and r.y is not None for r in df.collect()]
    assert got == [True, True, False, False, False]
