"""No line is lost without a word: accounts of downloads, survey order without line numbers, cells
that do not cast."""

import pytest
from pyspark.sql import functions as F

from rivertrack.plans import fixed
from rivertrack.plans.study import Inputs, run_study
from rivertrack.sources import files, receivers
from rivertrack.sources.accounts import LineAccount, LostLines

HEADER = "Date Time Site Ant Freq Type Code Power\n"
LINE = "2024-07-{:02} 10:00:{:02} {} 1 149.500 LOTEK {} -80\n"
BAD = [
    ("2024-07-12 10:xx:00 1 1 149.500 LOTEK 19 -80", "no time"),
    ("2024-07-12 10:00:01 1 1 149.500 LOTEK", "no frequency or code"),
    ("cut", "no time"),
]


@pytest.fixture
def stations(tmp_path):
    for name, site in (("Station1", 1), ("Station6", 9)):
        (tmp_path / name).mkdir()
        for part in "ab":
            good = "".join(LINE.format(d, s, site, 19) for d in (12, 13) for s in range(20))
            early = "2023-07-01 10:00:00 1 1 149.500 LOTEK 19 -80\n"
            bad = "".join(text + "\n" for text, _ in BAD)
            (tmp_path / name / f"{part}.txt").write_text(HEADER + good + "\n  \n" + early + bad + HEADER)
    return [str(tmp_path / "Station1"), str(tmp_path / "Station6")]


@pytest.fixture(params=["whole files", "small splits"])
def splits(request, spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64" if request.param == "small splits" else before)
    yield request.param
    spark.conf.set(key, before)


def test_lines_add_up(spark, stations, splits):
    account = LineAccount()
    raw = fixed.fixed_raw(spark, stations, {stations[1]: "6"}, account)
    assert raw.count() == 2 * 40  # the second file of a station repeats the first
    unread = fixed.fixed_quarantine(spark, stations, account).collect()
    want = {"lines": 4 * 48, "header": 8, "blank": 8, "early": 4, "rejected": 12, "kept": 160}
    assert account.check(len(unread)) == want
    assert sorted((r.value, r.reason) for r in unread) == sorted(BAD * 4)
    assert {r.src_file for r in unread} == {"a.txt", "b.txt"}


def test_a_lost_line_ends_the_run(spark, stations):
    account = LineAccount()
    fixed.fixed_raw(spark, stations, account=account).count()
    n = fixed.fixed_quarantine(spark, stations, account).count()
    with pytest.raises(LostLines, match="12 lines were rejected, 11 were written"):
        account.check(n - 1)


def test_lines_counted_twice_are_counted_afresh(spark, stations, monkeypatch):
    account = LineAccount()
    fixed.fixed_raw(spark, stations, account=account).count()
    n = fixed.fixed_quarantine(spark, stations, account).count()
    honest = account.counts
    # as after a lost executor, whose tasks were counted in both runs
    monkeypatch.setattr(account, "counts", lambda s: {k: v + 3 * (s == "records") for k, v in honest(s).items()})
    assert account.check(n)["kept"] == 160


def test_a_kind_that_is_missing_ends_the_run(spark, stations):
    account = LineAccount()
    lines = fixed.fixed_lines(spark, stations)
    kinds = {k: c for k, c in receivers.line_kinds().items() if k != "early"}
    account.watch("records", lines, kinds).count()
    with pytest.raises(LostLines, match="leaves lines out"):
        account.check(12)


SURVEY = "log\nID Only Records:\n{}08/30/2024 01:00:00 1 19 1 120 54.1 -127.4\nx y\n08/30/2024 01:00:05 1 999 1 1\nEnd of data\n"


def test_survey_lines_add_up_and_only_rejects_are_numbered(spark, tmp_path, splits):
    texts = {f"S{i:02}.TXT": "pad\n" * i + SURVEY.format("a\nb\n") for i in range(12)}
    texts |= {"N1.TXT": "no marker\n\n", "M1.TXT": "ID Only Records\n", "M2.TXT": "x\nID Only Records\nonly\n"}
    texts["TWICE.TXT"] = SURVEY.format("a\nb\n") * 2
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    account = LineAccount()
    kept, rejects = receivers.read_srx(spark, str(tmp_path), account=account)
    plan = kept._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and plan.count("FileScan text") == 1
    assert kept.count() == 12 + 2
    got = sorted((r.src_file, r.line, r.reason) for r in rejects.collect())
    want = []
    for name, text in texts.items():
        lines = text.splitlines()
        at = next((i for i, x in enumerate(lines) if "ID Only Records" in x), None)
        for i, x in enumerate(lines):
            if at is None:
                want.append((name, i + 1, "no marker"))
            elif i > at + 2 and x.strip():
                code = (x.split() + [""] * 4)[3]
                if not code.isdigit():
                    want.append((name, i + 1, "no tag number"))
                elif code == "999":
                    want.append((name, i + 1, "error code"))
    assert got == sorted(want)
    counts = account.check(len(got))
    assert counts["lines"] == sum(len(t.splitlines()) for t in texts.values()) and counts["kept"] == 14


def test_cells_that_do_not_cast(spark, tmp_path, splits):
    rows = [f"2024-07-{1 + i % 28:02},{500 + i},{i},m,{50 + i}.5" for i in range(60)]
    rows[7] = "2024-07-32,500,3?,m,50"
    rows[41] = "unkn,NA,49?,F,fifty"
    (tmp_path / "a.csv").write_text("Date,Frequency,Tag.Number,Gender,Length\n" + "\n".join(rows) + "\n")
    (tmp_path / "b.csv").write_text("Date,Frequency,Tag.Number,Gender,Length\n2024-07-01,x,1,m,NA\n")
    ddl = "`Date` DATE, `Frequency` INT, `Tag.Number` INT, `Gender` STRING, `Length` DOUBLE"
    got = files.csv_rejects(spark, str(tmp_path), ddl, ["", "unkn", "NA"])
    assert sorted((r.src_file, r.row, r.column, r.text) for r in got.collect()) == [
        ("a.csv", 8, "Date", "2024-07-32"),
        ("a.csv", 8, "Tag.Number", "3?"),
        ("a.csv", 42, "Length", "fifty"),
        ("a.csv", 42, "Tag.Number", "49?"),
        ("b.csv", 1, "Frequency", "x"),
    ]
    read = files.read_csv(spark, str(tmp_path), ddl, ["", "unkn", "NA"])
    assert read.where(F.col("`Tag.Number`").isNull()).count() == 2


def test_study_writes_what_it_could_not_read(spark, stations, tmp_path):
    (tmp_path / "Mobile").mkdir()
    (tmp_path / "Mobile" / "S.TXT").write_text(SURVEY.format("a\nb\n"))
    (tmp_path / "tags.csv").write_text("Date,Frequency,Tag.Number,Gender,Length\n2024-07-12,500,19,m,long\n")
    point = "1L idx, 500000D x, 6000000D y, 203D rkm, 'Morice Lake' zone"
    spark.sql(f"SELECT {point}").write.parquet(str(tmp_path / "points"))
    out = str(tmp_path / "out")
    inputs = Inputs(str(tmp_path / "tags.csv"), stations, str(tmp_path / "Mobile"), str(tmp_path / "points"))
    stages = run_study(spark, inputs, out)
    assert stages["fixed_quarantine"].groupBy("reason").count().orderBy("reason").collect() == [
        ("no frequency or code", 4),
        ("no time", 8),
    ]
    [bad] = stages["tags_rejected"].collect()
    assert (bad.src_file, bad.row, bad.column, bad.text) == ("tags.csv", 1, "Length", "long")
    lines = files.read_csv(spark, f"{out}/report/lines", "source STRING, kind STRING, lines BIGINT").collect()
    assert {(r.source, r.kind): r.lines for r in lines}["fixed", "kept"] == 160
    assert {(r.source, r.kind): r.lines for r in lines}["mobile", "kept"] == 1
