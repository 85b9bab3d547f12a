"""From files to report: what the seven steps of the study do, in one go."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.operators.cleaning import lost_tags
from rivertrack.operators.lookups import tags_2024
from rivertrack.operators.rules import study_rules
from rivertrack.operators.spatial import project_utm
from rivertrack.plans import cascade, fixed, mobile, movement
from rivertrack.plans.study import Inputs, run_study
from rivertrack.schema import DETECTIONS, TAG_METADATA_2024, conform
from rivertrack.sources import files, receivers

HEADER = "Date         Time       Site   Ant   Freq     Type     Code  Power\n"


def record(day, time, site, code, power=-80, freq="149.500"):
    return f"{day}   {time}     {site}     1   {freq}   LOTEK    {code}    {power}\n"


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    stations = {
        "Station1": [
            record("2024-07-12", "10:00:00", 1, 19),
            record("2024-07-12", "10:00:03", 1, 19),  # under the pulse rate
            record("2024-07-12", "10:00:16", 1, 19),  # 13 s after a raw row
            record("2024-07-13", "10:00:00", 1, 212),  # test tag
            record("2024-07-11", "10:00:00", 1, 19),  # before tagging
            record("2024-07-13", "10:00:00", 1, 150),  # unknown tag
        ],
        "Station2": [
            record("2024-07-14", "22:00:00", 2, 19),
            record("2024-07-20", "00:00:00", 2, 7),
        ],
        "Station4": [
            record("2024-07-30", "12:00:00", 4, 7),
            record("2024-07-30", "12:01:00", 4, 7),
        ],
        "Station6": [
            record("2024-07-31", "12:00:00", 9, 7),
            record("2024-08-30", "12:00:00", 9, 19),
        ],
    }
    for name, rows in stations.items():
        (root / name).mkdir()
        (root / name / "d.txt").write_text(HEADER + "".join(rows))
    (root / "Mobile").mkdir()
    (root / "Mobile" / "Mobile_0830.TXT").write_text(
        "x\nID Only Records\nDate Time\n---\n"
        "08/30/2024 01:00:00 1 19 1 120 54.10 -127.40\n"
        "08/30/2024 01:05:00 1 19 1 140 54.101 -127.40\n"
        "08/30/2024 01:05:00 1 19 1 130 54.0 -127.0\n"
        "08/30/2024 01:06:00 1 19 1 150\n"
        "08/30/2024 01:07:00 9 19 1 150 54.1 -127.4\n"
        "End of data\n"
    )
    (root / "tags.csv").write_text(
        "Date,Frequency,Tag.Number,Gender,Length\n"
        "2024-07-12,unkn,19,m,55.5\n2024-07-12,500,7,F,NA\n2024-07-12,500,8,,51\n"
    )
    return root


@pytest.fixture(scope="module")
def tables(spark, study):
    meta = files.read_metadata(
        spark, str(study / "tags.csv"), TAG_METADATA_2024, K.NA_TOKENS_2024
    )
    tags = tags_2024(meta)
    dirs = [str(study / s) for s in ("Station1", "Station2", "Station4", "Station6")]
    raw = fixed.fixed_raw(spark, dirs, {dirs[-1]: "6"})
    points = project_utm(
        spark.createDataFrame(
            [(1, -127.40, 54.10, 203.0, "Morice Lake"), (2, -127.0, 54.0, 150.0, "Morice River")],
            "idx BIGINT, long DOUBLE, lat DOUBLE, rkm DOUBLE, zone STRING",
        )
    ).drop("long", "lat")
    srx = mobile.mobile_raw(receivers.scan_srx(spark, str(study / "Mobile")))
    survey = mobile.mobile_pipeline(srx, tags, points).withColumn("station", F.lit("Mobile"))
    fixed_rows = cascade.with_station_positions(fixed.fixed_pipeline(raw, tags))
    union = cascade.unified_timeline(fixed_rows, survey, tags)
    stage = files.write_stage(union, files.stage_path(spark, "union"), partition_by=["date"])
    stage = conform(stage)
    cleaned = cascade.cleaning_cascade(
        stage, study_rules(spark, "early"), study_rules(spark, "lost_tag", "odd")
    )
    return {"tags": tags, "fixed": fixed_rows, "mobile": survey, "union": stage, "clean": cleaned}


def test_stages(tables, rows):
    assert rows(tables["fixed"], "station", "tag").count(("1", "149.500 019")) == 3
    assert tables["fixed"].count() == 9
    # first of two at one time; without position or channel: out
    assert [(r.rkm, r.power) for r in tables["mobile"].orderBy("ts").collect()] == [
        (203.0, 120.0),
        (203.0, 140.0),
    ]
    assert tables["union"].columns == conform(tables["union"], DETECTIONS).columns
    assert tables["union"].count() == 9 + 2 + 3


def test_cleaned(tables, rows):
    got = rows(tables["clean"], "tag", "ts", "station", "method")
    assert got == sorted(
        [
            ("149.500 007", datetime(2024, 7, 12), "Tagging", "Tagging"),
            ("149.500 007", datetime(2024, 7, 20), "2", "Fixed"),
            ("149.500 007", datetime(2024, 7, 30, 12), "4", "Fixed"),
            ("149.500 007", datetime(2024, 7, 30, 12, 1), "4", "Fixed"),
            # the row at station 6 comes after the terminal river
            ("149.500 008", datetime(2024, 7, 12), "Tagging", "Tagging"),
            ("149.500 019", datetime(2024, 7, 12), "Tagging", "Tagging"),
            ("149.500 019", datetime(2024, 7, 12, 10), "1", "Fixed"),
            ("149.500 019", datetime(2024, 7, 12, 10, 0, 16), "1", "Lost Tag"),
            ("149.500 019", datetime(2024, 7, 14, 22), "2", "Fixed"),
            ("149.500 019", datetime(2024, 8, 30, 1, 5), "Mobile", "Mobile"),
            ("149.500 019", datetime(2024, 8, 30, 12), "6", "Fixed"),
        ],
        key=repr,
    )


def test_lost_tags(tables, rows):
    got = rows(lost_tags(tables["fixed"]), "tag", "earliest")
    assert got == [("149.500 019", datetime(2024, 7, 12, 10, 0, 16))]


def test_report(tables, rows):
    report = movement.movement_report(tables["clean"], tables["tags"])
    got = {r.tag: r for r in report["arrival_summary"].collect()}
    male, female = got["149.500 019"], got["149.500 007"]
    assert (male.fallback_date, male.fallback_hours) == (date(2024, 7, 12), 10.0)
    assert (male.bulkley_days, female.nanika_days) == (3.0, 18.0)  # 2.9 and 18.5, half to even
    assert male.nanika_date is None and got["149.500 008"].fallback_date is None
    assert rows(report["undetected_tags"]) == [("149.500 008",)]
    counts = report["detected_counts"].first()
    assert (counts.tags, counts.any, counts.fixed, counts.mobile) == (3, 2, 2, 1)
    assert rows(report["spawner_fate"], "tag", "source", "zone") == [
        ("149.500 007", "morice_system", "Nanika River"),
        ("149.500 019", "morice_system", "Morice Lake"),
    ]
    presence = {r.section: r for r in report["zone_presence_counts"].collect()}
    assert (presence["bulkley"].male, presence["bulkley"].female) == (1, 1)
    assert (presence["nanika"].female, presence["nanika"].total) == (1, 1)


def test_whole_study(spark, study, tables, rows, tmp_path):
    points = str(tmp_path / "points")
    project_utm(
        spark.createDataFrame(
            [(1, -127.40, 54.10, 203.0, "Morice Lake"), (2, -127.0, 54.0, 150.0, "Morice River")],
            "idx BIGINT, long DOUBLE, lat DOUBLE, rkm DOUBLE, zone STRING",
        )
    ).select("idx", "x", "y", "rkm", "zone").write.parquet(points)
    dirs = [str(study / s) for s in ("Station1", "Station2", "Station4", "Station6")]
    out = str(tmp_path / "out")
    stages = run_study(
        spark,
        Inputs(
            str(study / "tags.csv"), dirs, str(study / "Mobile"), points, {dirs[-1]: "6"}
        ),
        out,
    )
    columns = ["tag", "ts", "station", "method", "rkm", "power"]
    assert rows(stages["detections_clean"], *columns) == rows(tables["clean"], *columns)
    rates = files.read_csv(
        spark, f"{out}/report/false_positive_rate", "station STRING, raw INT, kept INT"
    )
    assert rows(rates) == [("1", 5, 3), ("2", 2, 2), ("4", 2, 2), ("6", 2, 2)]
    assert stages["unknown_stations"].count() == 0
    assert stages["survey_maps"].where("extent = 'Study area'").count() == 1
    moves = files.read_csv(spark, f"{out}/report/impossible_moves", "tag STRING")
    assert moves.count() == 0
    history = stages["detection_history"]
    assert {(r.tag, r.page, r.panel) for r in history.select("tag", "page", "panel").collect()} == {
        ("149.500 007", 1, 1),
        ("149.500 008", 1, 2),
        ("149.500 019", 1, 3),
    }
