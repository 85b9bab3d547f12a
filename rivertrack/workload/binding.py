"""The given tables in telemetry roles: events as detections, customers as tagged animals."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivertrack.functions.keys import tag_key
from rivertrack.operators.timeline import slice_hot_tags
from rivertrack.sources.files import stage_path

# first terminal zone, then second
Z1, Z2 = "purchase", "signup"
# events lie hours apart, so the thresholds are wider than the study's
MIN_GAP = 3600.0
LOST_GAP, LOST_TOLERANCE = 13 * 3600.0, 1800.0
MAX_DISTANCE, MAX_RATE = 50.0, 100.0


# schemas of the given tables, so that reading one starts no job
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    station = (
        F.when(kind == "view", "1")
        .when(kind == "click", "2")
        .when(kind == "error", "3")
        .when(kind == "purchase", "4")
        .when(kind == "signup", "5")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tag"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("power"),
        F.col("ts").cast("date").alias("date"),
        F.get_json_object("props", "$.k").cast("double").alias("rkm"),
        kind.alias("zone"),
        station.alias("station"),
        F.when(kind == "error", "Mobile").otherwise("Fixed").alias("method"),
    )


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections ready for the timeline operators: very long tags are sliced."""
    return slice_hot_tags(detections(spark, sf_dir))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        number.alias("tag"),
        F.when(number % 3 == 0, "M").when(number % 3 == 1, "F").alias("sex"),
        F.col("c_acctbal").alias("fork_length"),
        F.expr(
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 10 as int))"
        ).alias("tag_ts"),
    )


def frequency(tag: Column) -> Column:
    return F.when(tag % 2 == 0, "149.500").otherwise("149.320")


def key_of(tag: Column) -> Column:
    return tag_key(frequency(tag).cast("decimal(6,3)"), tag)


def keyed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections under frequency-and-code keys."""
    number = F.col("tag")
    return detections(spark, sf_dir).withColumns(
        {"freq": frequency(number), "code": number, "tag": key_of(number)}
    )


def keyed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(spark, sf_dir).withColumn("tag", key_of(F.col("tag")))


def positions(df: DataFrame) -> DataFrame:
    """A position near the row's river kilometre."""
    off = (F.col("power") - 100.0) / 10000.0
    return df.withColumns(
        {"long": -127.0 - F.col("rkm") / 100.0 + off, "lat": 54.0 + F.col("rkm") / 100.0 - off}
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the plane: the first two components of each vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("det_id"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
        "label",
    )


def label_points(points: DataFrame) -> DataFrame:
    """One reference point per label: its lowest vector."""
    return points.groupBy("label").agg(
        F.min("det_id").alias("idx"),
        F.min_by("x", "det_id").alias("x"),
        F.min_by("y", "det_id").alias("y"),
    ).withColumnRenamed("label", "zone_label")


def render_receiver(det: DataFrame) -> str:
    """Write detections as receiver downloads, one file per task, and return the folder."""
    folder = stage_path(det.sparkSession, "receiver")
    det.select(
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.date_format("ts", "HH:mm:ss.SSSSSS").alias("Time"),
        F.col("station").alias("Site"),
        F.lit(1).alias("Ant"),
        F.col("freq").alias("Freq"),
        F.lit("LOTEK").alias("Type"),
        F.col("code").alias("Code"),
        F.round(F.col("power") * 100).cast("int").alias("Power"),
    ).write.options(sep=" ", header=True).csv(folder)
    return folder


# a station's folder, and the station that all its rows are
STATION_OF = {"5": "6"}


def render_stations(det: DataFrame) -> dict[str, str]:
    """Write detections as downloads, a folder for each of stations 1, 2, 4 and 5, with times cut
    to the hour, so that many rows share one. River kilometre 13 has no readable time and 77 no
    code; station 5 reports another site number. Returns the folder of each station."""
    folder = stage_path(det.sparkSession, "stations")
    line = F.concat_ws(
        " ",
        F.date_format("ts", "yyyy-MM-dd"),
        F.when(F.col("rkm") == 13, "xx:00:00").otherwise(F.date_format("ts", "HH:00:00")),
        F.when(F.col("station") == "5", "9").otherwise(F.col("station")),
        F.lit("1"),
        F.col("freq"),
        F.lit("LOTEK"),
        F.when(F.col("rkm") == 77, "??").otherwise(F.col("code").cast("string")),
        F.round(F.col("power") * 100).cast("int"),
    )
    rows = det.where(F.col("station").isin("1", "2", "4", "5"))
    (
        rows.select("station", "seq", line.alias("Date Time Site Ant Freq Type Code Power"))
        .sortWithinPartitions("station", "seq")
        .drop("seq")
        .write.partitionBy("station")
        .options(header=True, sep="\t", quote="")
        .csv(folder)
    )
    return {s: f"{folder}/station={s}" for s in ("1", "2", "4", "5")}


def render_srx(det: DataFrame) -> str:
    """Write detections as SRX survey downloads: preamble, records, trailer in every file.
    River kilometre 13 becomes the error code, 77 a broken tag number; rows in the second
    terminal zone have no position, hence are short."""
    folder = stage_path(det.sparkSession, "srx")
    code = (
        F.when(F.col("rkm") == 13, "999")
        .when(F.col("rkm") == 77, "??")
        .otherwise(F.col("code").cast("string"))
    )
    position = F.when(
        F.col("zone") != Z2, F.concat_ws(" ", F.col("lat").cast("string"), F.col("long"))
    )
    lines = det.select(
        F.concat_ws(
            "  ",
            F.date_format("ts", "MM/dd/yyyy"),
            F.date_format("ts", "HH:mm:ss.SSSSSS"),
            F.col("station"),
            code,
            F.lit("1"),
            F.round(F.col("power") * 100).cast("int").cast("string"),
            position,
        ).alias("value")
    )

    def with_preamble(batches):
        import pyarrow as pa

        def text(*values):
            return pa.RecordBatch.from_pydict({"value": list(values)})

        yield text(
            "Receiver log", "", "Site: survey", "ID Only Records:", "Date Time Channel ...", "---"
        )
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])
        yield text("End of data")

    lines.mapInArrow(with_preamble, "value string").write.text(folder)
    return folder


def render_metadata(tag_table: DataFrame) -> str:
    """Write tags as a metadata CSV with several spellings of NA."""
    folder = stage_path(tag_table.sparkSession, "metadata")
    length = F.col("fork_length")
    tag_table.select(
        "tag",
        F.coalesce("sex", F.lit("unkn")).alias("sex"),
        F.when(length < 0, "NA").otherwise(length.cast("string")).alias("fork_length"),
        F.when(length > 9000, "").otherwise(F.col("tag_ts").cast("string")).alias("tag_ts"),
    ).write.options(header=True, emptyValue="").csv(folder)
    return folder
