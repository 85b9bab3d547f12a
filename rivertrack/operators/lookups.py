"""Lookups and derived columns. Tables here are fixed and small, hence broadcast; the tag table
grows with the study, so joining it is left to Catalyst's own size check."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivertrack import constants as K
from rivertrack.functions.keys import tag_key
from rivertrack.functions.times import parse_date, parse_ts
from rivertrack.operators.cleaning import dedup_keep_first
from rivertrack.operators.timeline import SLICE, hot_rows, is_sliced
from rivertrack.schema import fixed_table


def stations(spark) -> DataFrame:
    return fixed_table(
        spark, K.STATIONS, "station STRING, zone STRING, rkm DOUBLE, lat DOUBLE, long DOUBLE"
    )


def station_lookup(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Add zone, rkm, lat and long of the station; NULL for an unknown one. The study's own
    stations are broadcast; a table that is given, only if its size allows."""
    table = F.broadcast(stations(df.sparkSession)) if table is None else table
    return df.join(table, "station", "left")


def split_unknown_stations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After ``station_lookup``: (rows with a zone, rows to quarantine). A NULL zone must not
    reach the cleaning steps."""
    return df.where(F.col("zone").isNotNull()), df.where(F.col("zone").isNull())


def channel_frequency(df: DataFrame, channel: str = "channel") -> DataFrame:
    """Add ``frequency`` of a receiver channel, ``other`` if it is not listed."""
    table = fixed_table(df.sparkSession, K.CHANNELS, f"`{channel}` INT, frequency STRING")
    return df.join(F.broadcast(table), channel, "left").withColumn(
        "frequency", F.coalesce("frequency", F.lit(K.OTHER_CHANNEL))
    )


def first_match(cases: list[tuple[Column, object]]) -> Column:
    """The value of the first case that holds; NULL if none does."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def exclude_test_tags(df: DataFrame, tags=tuple(K.TEST_TAGS)) -> DataFrame:
    return df.where(~F.col("tag").isin(*tags))


def reject_error_records(
    df: DataFrame, code: str = "code", error_code: int = K.ERROR_CODE
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows): a code that is no number, or the receiver's error code."""
    number = F.col(code).try_cast("int")
    good = F.coalesce(number != error_code, F.lit(False))
    return df.where(good), df.where(~good)


def detection_tag_join(det: DataFrame, tags: DataFrame, salts: int = 64) -> DataFrame:
    """Detections of known tags, with tagging time, sex and length. Several rows per tag in
    either table are allowed.

    Not hinted: the tag table grows with the study, so Catalyst broadcasts it only when its size
    permits and otherwise splits skewed tags at run time. On sliced detections the long tags are
    known, and their join is spread over ``salts`` keys: their few tag rows are repeated."""
    if not is_sliced(det):
        return det.join(tags, "tag", "left").where(F.col("tag_ts").isNotNull())
    long_tags = F.broadcast(hot_rows(det).select("tag").distinct().withColumn("_long", F.lit(True)))
    spread = F.when(F.col("_long"), F.sequence(F.lit(0), F.lit(salts - 1)))
    tags = (
        tags.join(long_tags, "tag", "left")
        .withColumn("_salt", F.explode(F.coalesce(spread, F.array(F.lit(0)))))
        .drop("_long")
    )
    salt = F.when(F.col(SLICE).isNotNull(), F.pmod(F.hash(SLICE), F.lit(salts))).otherwise(0)
    return (
        det.withColumn("_salt", salt)
        .join(tags, ["tag", "_salt"], "left")
        .drop("_salt")
        .where(F.col("tag_ts").isNotNull())
    )


def after_tagging(det: DataFrame, tags: DataFrame) -> DataFrame:
    return detection_tag_join(det, tags).where(F.col("ts") > F.col("tag_ts"))


def metadata_overrides(
    df: DataFrame,
    frequencies: DataFrame | None = None,
    dates: DataFrame | None = None,
) -> DataFrame:
    """Patch missing metadata: a known frequency by code, then a known date by code and
    frequency. Columns code, freq and date are text, as read."""
    spark = df.sparkSession
    if frequencies is None:
        frequencies = F.broadcast(
            fixed_table(spark, K.FREQUENCY_OVERRIDES, "code STRING, new_freq STRING")
        )
    if dates is None:
        dates = F.broadcast(
            fixed_table(spark, K.DATE_OVERRIDES, "code STRING, freq STRING, new_date STRING")
        )
    return (
        df.join(frequencies, "code", "left")
        .withColumn("freq", F.coalesce("new_freq", "freq"))
        .drop("new_freq")
        .join(dates, ["code", "freq"], "left")
        .withColumn("date", F.coalesce("new_date", "date"))
        .drop("new_date")
        .select(*df.columns)
    )


def tags_2024(raw: DataFrame) -> DataFrame:
    """Tag table from the 2024 metadata layout: upper-case sex, patched frequency and date,
    midnight as tagging time, first row per tag. ``seq`` must give the file order."""
    text = raw.select(
        F.col("Date").alias("date"),
        F.col("Frequency").alias("freq"),
        F.col("`Tag.Number`").alias("code"),
        F.upper("Gender").alias("sex"),
        F.col("Length").try_cast("double").alias("fork_length"),
        "seq",
    )
    patched = metadata_overrides(text)
    tagged = patched.select(
        parse_date("date").cast("timestamp_ntz").alias("tag_ts"),
        tag_key(
            F.concat(F.lit("149."), "freq").try_cast("decimal(6,3)"),
            F.col("code").try_cast("int"),
        ).alias("tag"),
        "sex",
        "fork_length",
        "seq",
    ).where(F.col("tag_ts").isNotNull() & F.col("tag").isNotNull())
    return dedup_keep_first(tagged, by=("tag",), order=("seq",)).drop("seq")


def tags_2023(raw: DataFrame) -> DataFrame:
    """Tag table from the 2023 layout: US dates with a clock time; recaptured fish and tags
    without a usable code are left out."""
    written = F.concat_ws(" ", F.concat(F.lit("149."), "freq"), F.coalesce("code", F.lit("NA")))
    day = parse_date("date", "M/d/yyyy")
    rows = raw.select(
        parse_ts(F.concat_ws(" ", day.cast("string"), "time")).alias("tag_ts"),
        written.alias("written"),
        tag_key(
            F.concat(F.lit("149."), "freq").try_cast("decimal(6,3)"),
            F.col("code").try_cast("int"),
        ).alias("tag"),
        F.upper("sex").alias("sex"),
        F.col("forkLength").try_cast("double").alias("fork_length"),
    )
    recaptures = fixed_table(raw.sparkSession, K.RECAPTURES, "at STRING, written STRING")
    return (
        rows.where(~F.col("written").isin(*K.BAD_TAGS) & F.col("tag").isNotNull())
        .join(
            F.broadcast(recaptures.select("written", parse_ts("at").alias("tag_ts"))),
            ["written", "tag_ts"],
            "left_anti",
        )
        .select("tag_ts", "tag", "sex", "fork_length")
    )


def tagging_events(tags: DataFrame) -> DataFrame:
    """Each tagging with a known time as a synthetic detection at rkm 0."""
    label = F.lit("Tagging")
    return tags.where(F.col("tag_ts").isNotNull()).withColumns(
        {
            "ts": F.col("tag_ts"),
            "date": F.col("tag_ts").cast("date"),
            "rkm": F.lit(0.0),
            "zone": label,
            "method": label,
            "station": label,
            "power": F.lit(None).cast("double"),
            "lat": F.lit(None).cast("double"),
            "long": F.lit(None).cast("double"),
        }
    )


def sex_label(sex="sex") -> Column:
    c = F.upper(sex)
    return first_match(
        [(c == "M", "Male"), (c == "F", "Female"), (c.isNull() | (c == ""), "Unknown")]
    )
