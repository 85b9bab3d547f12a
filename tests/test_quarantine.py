"""Lines of survey downloads that are not records are kept, with their place and the reason."""

import pytest
from pyspark.sql import functions as F

from rivertrack.plans.study import Inputs, run_study
from rivertrack.sources import receivers

RECORD = "08/30/2024 01:0{}:00 1 {} 1 120 54.10 -127.40\n"
GOOD = "x\nID Only Records\nDate Time\n---\n" + RECORD.format(0, 19) + "\n" + RECORD.format(1, 999) + RECORD.format(2, 7) + "End of data\n"
FILES = {"F39_a b.TXT": GOOD, "G40_cut.TXT": "Receiver\n\n" + RECORD.format(3, 19), "H41_empty.TXT": ""}
WANT = [
    ("F39_a b.TXT", 7, "error code", RECORD.format(1, 999).strip()),
    ("F39_a b.TXT", 9, "no tag number", "End of data"),
    ("G40_cut.TXT", 1, "no marker", "Receiver"),
    ("G40_cut.TXT", 2, "no marker", ""),
    ("G40_cut.TXT", 3, "no marker", RECORD.format(3, 19).strip()),
    ("H41_empty.TXT", None, "no marker", None),
]


@pytest.fixture
def surveys(tmp_path):
    (tmp_path / "Mobile").mkdir()
    for name, text in FILES.items():
        (tmp_path / "Mobile" / name).write_text(text)
    return str(tmp_path / "Mobile")


def _found(quarantine):
    rows = quarantine.select(F.replace("src_file", F.lit("%20"), F.lit(" ")), "line", "reason", "value").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_rows_read_are_kept_or_quarantined(spark, surveys):
    kept, quarantine = receivers.read_srx(spark, surveys)
    assert _found(quarantine) == WANT
    assert sorted(r.code for r in kept.collect()) == [7, 19]
    # of the marked file the lines of text after the preamble, of the others all
    after = [x for x in GOOD.splitlines()[4:] if x.strip()]
    unmarked = sum(len(t.splitlines()) for t in FILES.values() if "ID Only" not in t)
    assert kept.count() + quarantine.where("line is not null").count() == len(after) + unmarked


def test_study_writes_the_quarantine(spark, surveys, tmp_path):
    station = tmp_path / "Station1"
    station.mkdir()
    (station / "d.txt").write_text("Date Time Site Ant Freq Type Code Power\n2024-07-12 10:00:00 1 1 149.500 LOTEK 19 -80\n")
    (tmp_path / "tags.csv").write_text("Date,Frequency,Tag.Number,Gender,Length\n2024-07-12,500,19,m,55.5\n")
    point = "1L idx, 500000D x, 6000000D y, 203D rkm, 'Morice Lake' zone"
    spark.sql(f"SELECT {point}").write.parquet(str(tmp_path / "points"))
    inputs = Inputs(str(tmp_path / "tags.csv"), [str(station)], surveys, str(tmp_path / "points"))
    stages = run_study(spark, inputs, str(tmp_path / "out"))
    assert _found(spark.read.parquet(str(tmp_path / "out" / "mobile_quarantine"))) == WANT
    assert stages["mobile_raw"].count() == 2
