"""Reading text, CSV and layer files, and writing stage tables."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivertrack.session import shared_dir


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Text lines with their place: src_path, src_file, src_block (first byte of the split) and
    seq, which rises with the line within a split. Files are split like any other, so a file
    may be larger than a task; (src_path, src_block, seq) is file order."""
    return spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("src_path"),
        F.col("_metadata.file_name").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("seq"),
    )


FILE_ORDER = ("src_path", "src_block", "seq")
PLACE = "src_path", "src_block"


def pin_splits(spark: SparkSession) -> None:
    """From now on files are split alike however many executors there are: two scans of the same
    files then number their lines alike. Spark derives the size of small splits from the
    cores it has at the time of a scan, unless told."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))


def split_table(lines: DataFrame, marker: Column | None = None) -> DataFrame:
    """A row per split of the files: its lines ``n``, its first ``seq``, the lines of the file
    ``before`` it and, if a marker is given, the ``seq`` of its first line that meets it. One
    aggregation whose rows each come from one task; written, as it is read more than once."""
    pin_splits(lines.sparkSession)
    marked = F.lit(None).cast("bigint") if marker is None else F.min(F.when(marker, F.col("seq")))
    sizes = lines.groupBy(*PLACE).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), marked.alias("mark")
    )
    sizes = write_stage(sizes, stage_path(lines.sparkSession, "splits"))
    earlier = (
        Window.partitionBy("src_path")
        .orderBy("src_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def number_lines(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Add ``line``, the 1-based number in the file. The join is on splits, so no file is one
    group; ``seq`` has no gaps within a split."""
    first = splits.select(*PLACE, (F.col("before") + 1 - F.col("first")).alias("_add"))
    return (
        lines.join(first, [*PLACE])
        .withColumn("line", F.col("seq") + F.col("_add"))
        .drop("_add")
    )


def null_tokens(df: DataFrame, tokens, columns=None) -> DataFrame:
    """Any of several NA spellings in the text columns becomes NULL."""
    text = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]
    quoted = {name: F.col(f"`{name}`") for name in text}
    return df.withColumns(
        {n: F.when(~c.isin(*tokens), c) for n, c in quoted.items()}  # no match -> NULL
    )


def _csv_text(spark: SparkSession, path, ddl: str, options: dict) -> tuple[DataFrame, T.StructType]:
    """The cells as text, and the types they are meant to have."""
    schema = T.StructType.fromDDL(ddl)
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    text = spark.read.schema(raw).options(header=True, **options).csv(path)
    return text, schema


def read_csv(spark: SparkSession, path, ddl: str, tokens=("", "NA"), **options) -> DataFrame:
    """A CSV with a header and several NA spellings. Everything is read as text, freed of the
    tokens, then cast to ``ddl``; a value that does not cast is NULL (see ``csv_rejects``)."""
    text, schema = _csv_text(spark, path, ddl, options)
    return null_tokens(text, tokens).select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def csv_rejects(spark: SparkSession, path, ddl: str, tokens=("", "NA"), **options) -> DataFrame:
    """What ``read_csv`` with the same arguments turns into NULL although it says something:
    src_path, src_file, row (1-based, without the header), column and text of each such cell."""
    text, schema = _csv_text(spark, path, ddl, options)
    cells = [
        F.when(
            F.col(f"`{f.name}`").isNotNull()
            & ~F.col(f"`{f.name}`").isin(*tokens)
            & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(),
            F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("text")),
        )
        for f in schema.fields
    ]
    lines = text.select(
        F.filter(F.array(*cells), lambda c: c.isNotNull()).alias("_bad"),
        F.col("_metadata.file_path").alias("src_path"),
        F.col("_metadata.file_name").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    splits = split_table(lines)
    bad = number_lines(lines.where(F.size("_bad") > 0), splits)
    return bad.select("src_path", "src_file", F.col("line").alias("row"), F.inline("_bad"))


def read_metadata(spark: SparkSession, path, ddl: str, tokens) -> DataFrame:
    """A tag metadata file with ``seq`` giving its file order."""
    return read_csv(spark, path, ddl, tokens).withColumn("seq", F.monotonically_increasing_id())


def read_layer(spark: SparkSession, path) -> DataFrame:
    """A point, line or polygon layer, converted to Parquet beforehand."""
    return spark.read.parquet(path)


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, path: str) -> None:
    """Write a report as CSV with a header, no row-name column, and NA for NULL."""
    df.write.mode("overwrite").options(header=True, nullValue="NA").csv(path)


def write_stage(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    """Write a stage table (no row-name column) and return it as read back: later steps start
    from the files, so a lost executor costs a re-read and not the steps before. Partitioned
    by ``date``, later date filters read only their days; rows are brought together by day for
    that, big days in several files, so that not every task writes a file per day."""
    if partition_by:
        even = df.hint("rebalance", *partition_by)
        even.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_clustered(
    df: DataFrame, path: str, by=("tag",), order=("ts", "seq"), buckets: int | None = None
) -> DataFrame:
    """Write a stage table in ``buckets`` files by the hash of ``by`` and return it as read back.
    Spark knows how it lies, so a window or an aggregation by ``by`` reads it without a shuffle,
    and writing rows that already lie so needs none either. No key may fill a file: see
    ``timeline.cluster``. The table is external; its catalog entry is only needed to open it."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"rivertrack_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, *by)
        .write.mode("overwrite")
        .bucketBy(buckets, *by)
        .sortBy(*by, *order)
        .option("path", path)
        .saveAsTable(name)
    )
    stage = spark.table(name).select(*df.columns)
    stage.schema  # resolved before its entry goes
    spark.sql(f"DROP TABLE {name}")
    return stage
