"""Receiver downloads: fixed stations (one header line, whitespace-separated) and mobile SRX
surveys (a preamble of any length, then records, then a trailer)."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.functions.keys import tag_key
from rivertrack.functions.times import parse_date, parse_ts
from rivertrack.schema import fixed_table
from rivertrack.sources.accounts import LineAccount
from rivertrack.sources.files import number_lines, read_lines, split_table

# fixed values: the line that precedes an SRX file's records, and how many lines follow it
SRX_MARKER = "ID Only Records"
SRX_LINES_AFTER_MARKER = 2
SRX_STATION_CHARS = 6
# why lines of a survey download are in quarantine
NO_MARKER, NO_TAG, ERROR_RECORD = "no marker", "no tag number", "error code"
# and lines of a fixed station's
NO_TIME, NO_KEY = "no time", "no frequency or code"


def _fields() -> Column:
    """The whitespace-separated fields of a line (NUL bytes are skipped)."""
    return F.split(F.trim(F.translate("value", "\t\r\x00", "  ")), " +")


def _records(lines: DataFrame, parsed: dict[str, Column]) -> DataFrame:
    """The fields ``_f`` of each line, parsed into the named columns. As a generated row, the
    fields are split and parsed once: a filter on the result would otherwise be pushed below and
    parse them again."""
    record = F.struct(*[c.alias(name) for name, c in parsed.items()])
    return lines.withColumn("_f", _fields()).select("*", F.inline(F.array(record))).drop("_f")


def _field(i: int) -> Column:
    return F.get(F.col("_f"), F.lit(i))


def _is_header() -> Column:
    return F.col("value").rlike(r"^\s*Date\s")


def _is_blank() -> Column:
    return ~F.col("value").rlike(r"\S")


def parse_receiver(lines: DataFrame) -> DataFrame:
    """Lines with the typed fields of a receiver record; one that does not parse has a NULL
    ``tag`` or ``ts``."""
    freq, code = _field(4).try_cast("decimal(6,3)"), _field(6).try_cast("int")
    return _records(
        lines,
        {
            "date": _field(0).try_cast("date"),
            "ts": parse_ts(F.concat_ws(" ", _field(0), _field(1))),
            "station": _field(2),
            "antenna": _field(3).try_cast("int"),
            "freq": freq,
            "type": _field(5),
            "code": code,
            "power": _field(7).try_cast("int"),
            "tag": tag_key(freq, code),
        },
    )


def _unreadable() -> Column:
    """Why a record is no detection; NULL for one that is."""
    return F.when(F.col("ts").isNull(), NO_TIME).when(F.col("tag").isNull(), NO_KEY)


def receiver_lines(
    spark: SparkSession, paths, station: str | None = None, deploy_start: str | None = None
) -> DataFrame:
    """All lines of the downloads under ``paths`` with their ``kind``: header, blank, early (before
    ``deploy_start``), rejected (with the ``reason``) or kept, the last three parsed. ``station``
    overrides the site number written in the files."""
    start = F.lit(deploy_start).cast("date")
    early = F.lit(False) if deploy_start is None else F.coalesce(F.col("date") < start, F.lit(False))
    kind = (
        F.when(_is_blank(), "blank")
        .when(_is_header(), "header")
        .when(F.col("reason").isNotNull(), "rejected")
        .when(early, "early")
        .otherwise("kept")
    )
    lines = parse_receiver(read_lines(spark, paths)).withColumn("reason", _unreadable())
    if station is not None:
        lines = lines.withColumn("station", F.lit(station))
    return lines.withColumn("kind", kind)


LINE_KINDS = ("header", "blank", "early", "rejected", "kept")


def line_kinds() -> dict[str, Column]:
    return {k: F.col("kind") == k for k in LINE_KINDS}


def of_kind(lines: DataFrame, kind: str) -> DataFrame:
    rows = lines.where(F.col("kind") == kind)
    if kind == "rejected":
        return rows.select("src_path", "src_file", "src_block", "seq", "reason", "value")
    return rows.drop("kind", "reason", "value")


def scan_receiver(
    spark: SparkSession, paths, station: str | None = None, deploy_start: str | None = None
) -> DataFrame:
    """The detections in all downloads under ``paths`` in one scan, with their file, as
    ``receiver_lines`` reads them."""
    text = read_lines(spark, paths).where(~_is_header() & ~_is_blank())
    rows = parse_receiver(text).where(_unreadable().isNull()).drop("value")
    if station is not None:
        rows = rows.withColumn("station", F.lit(station))
    if deploy_start is not None:
        rows = rows.where(F.col("date") >= F.lit(deploy_start).cast("date"))
    return rows


def receiver_quarantine(spark: SparkSession, paths) -> DataFrame:
    """The lines that are no detections: src_path, src_file, src_block, seq, reason, value."""
    return of_kind(receiver_lines(spark, paths), "rejected")


def _srx_lines(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines, with the place (src_block, seq) of the last line before their file's records
    as ``_bound`` (NULL for a file without a marker); the splits; paths of files without any
    line. The order of lines needs no numbers: (src_block, seq) is file order, so only the
    splits are looked at first, and no line is written or moved."""
    lines = read_lines(spark, paths)
    splits = split_table(lines, F.col("value").contains(SRX_MARKER))
    number = F.when(
        F.col("mark").isNotNull(), F.col("before") + F.col("mark") - F.col("first") + 1
    )
    splits = splits.withColumn("marker", F.min(number).over(Window.partitionBy("src_path")))
    last = F.col("marker") + SRX_LINES_AFTER_MARKER
    here = (F.col("before") < last) & (last <= F.col("before") + F.col("n"))
    place = F.struct("src_block", (F.col("first") + last - F.col("before") - 1).alias("seq"))
    # a file that ends before that has no records
    end = F.struct(F.lit(2**63 - 1).alias("src_block"), F.lit(2**63 - 1).alias("seq"))
    bounds = (
        splits.where(F.col("marker").isNotNull())
        .groupBy("src_path")
        .agg(F.coalesce(F.max(F.when(here, place)), end).alias("_bound"))
    )
    # file:///x is file:/x in a line's path
    named = [(re.sub("^([^:/]+):///", r"\1:/", x),) for x in spark.read.text(paths).inputFiles()]
    empty = fixed_table(spark, named, "src_path STRING").join(splits, "src_path", "left_anti")
    return lines.join(bounds, "src_path", "left"), splits, empty


def _iso_day(text: str) -> Column:
    """Month, day, year in either length, with any usual separator, as year-month-day text."""
    part = F.split(F.col(text), "[-/.]")
    year = F.get(part, F.lit(2))
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.when(
        F.size(part) == 3, F.concat_ws("-", year, F.get(part, F.lit(0)), F.get(part, F.lit(1)))
    )


SRX_KINDS = ("preamble", "blank", "rejected", "kept")


def _after_marker() -> Column:
    return F.struct("src_block", "seq") > F.col("_bound")


def srx_kinds() -> dict[str, Column]:
    """What becomes of a line of ``_srx_lines``, from the line alone."""
    marked, after = F.col("_bound").isNotNull(), _after_marker()
    code = F.get(_fields(), F.lit(3)).try_cast("int")
    good = F.coalesce(code != K.ERROR_CODE, F.lit(False))
    text = ~_is_blank()
    return {
        "preamble": marked & ~after,
        "blank": marked & after & ~text,
        "rejected": ~marked | (after & text & ~good),
        "kept": marked & after & text & good,
    }


def read_srx(
    spark: SparkSession, paths, src_tz: str | None = None, account: LineAccount | None = None
) -> tuple[DataFrame, DataFrame]:
    """Mobile survey downloads: the records, and beside them the quarantine (src_path, src_file,
    line, reason, value). Each line of text after a file's marker and the two lines that follow
    it is in one of them. Short records are filled with NULL; the trailer and other lines without
    a tag number and the error code go to quarantine, and so do all lines of a file without a
    marker; a file without a line is one row there. Times stay wall-clock; with ``src_tz`` they
    are taken as that zone's and turned into UTC wall-clock time. Both count their lines in
    ``account``. Only lines in quarantine are numbered."""
    lines, splits, empty = _srx_lines(spark, paths)

    def watched(scan: str) -> DataFrame:
        return lines if account is None else account.watch(scan, lines, srx_kinds())

    def parsed(from_lines: DataFrame) -> DataFrame:
        return _records(
            from_lines.where(F.col("_bound").isNotNull() & _after_marker() & ~_is_blank()).drop("_bound"),
            {
                "_day": _field(0),
                "_time": _field(1),
                "channel": _field(2).try_cast("int"),
                "code": _field(3).try_cast("int"),
                "antenna": _field(4),
                "power": _field(5).try_cast("double"),
                "lat": _field(6).try_cast("double"),
                "long": _field(7).try_cast("double"),
            },
        )

    ts = parse_ts(F.concat_ws(" ", "_iso", "_time"))
    if src_tz is not None:
        ts = F.convert_timezone(F.lit(src_tz), F.lit("UTC"), ts)
    kept = (
        parsed(watched("records"))
        .where(F.col("code").isNotNull() & (F.col("code") != K.ERROR_CODE))
        .withColumn("_iso", _iso_day("_day"))
        .withColumns({"date": parse_date("_iso"), "ts": F.when(F.col("_iso").isNotNull(), ts)})
        .withColumns(
            {"hour": F.hour("ts"), "station": F.substring("src_file", 1, SRX_STATION_CHARS)}
        )
        .drop("value", "_day", "_time", "_iso")
    )

    kinds = srx_kinds()
    all_lines = watched("rejects")
    no_code = F.get(_fields(), F.lit(3)).try_cast("int").isNull()
    reason = (
        F.when(F.col("_bound").isNull(), NO_MARKER).when(no_code, NO_TAG).otherwise(ERROR_RECORD)
    )
    rejected = all_lines.where(kinds["rejected"]).withColumn("reason", reason).drop("_bound")
    nowhere = empty.select(
        "src_path",
        F.element_at(F.split("src_path", "/"), -1).alias("src_file"),
        F.lit(None).cast("bigint").alias("line"),
        F.lit(NO_MARKER).alias("reason"),
        F.lit(None).cast("string").alias("value"),
    )
    quarantine = (
        number_lines(rejected, splits)
        .select("src_path", "src_file", "line", "reason", "value")
        .unionByName(nowhere)
    )
    return kept, quarantine


def scan_srx(spark: SparkSession, paths, src_tz: str | None = None) -> DataFrame:
    """The records of ``read_srx``."""
    return read_srx(spark, paths, src_tz)[0]
