"""What the operators of this subpackage share: reading, written intermediate tables, Arrow maps."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rivertrack.sources.files import stage_path, write_clustered, write_stage

# The six characters that separate words, as a class of Java, Python and RE2 patterns alike.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df, name, partition_by=()):
    """``df`` written once to the shared folder and read back: later steps start from files that
    every executor reaches, so a lost executor costs a re-read and no step runs twice. The
    step's shuffle files go as soon as it has ended, not when the driver next collects garbage."""
    return _stage(df, name, lambda path: write_stage(df, path, partition_by))


def dropped(*tables):
    """Delete tables that ``written`` or ``clustered`` made and that nothing will read again, as
    what was made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clustered(df, name, by, order):
    """``df`` written like ``written``, in files by the hash of ``by``: joins and aggregations by
    these columns read it without a shuffle."""
    return _stage(df, name, lambda path: write_clustered(df, path, by, order))


def _stage(df, name, write):
    conf, path = df.sparkSession.conf, stage_path(df.sparkSession, name)
    before = conf.get(DROP_SHUFFLES)
    conf.set(DROP_SHUFFLES, "true")
    try:
        out = write(path)
    finally:
        conf.set(DROP_SHUFFLES, before)
    out.stage_path = path
    return out


def short_batches(spark, rows=1000):
    """From now on at most ``rows`` rows go to Python at a time. Whole texts are long, and Spark
    holds a batch in the JVM and in Python at once; its bound is a number of rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def let(value, body):
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_text(text="text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def map_batches(df, schema, start):
    """Run Python on Arrow batches, narrow: no shuffle and no group is held. ``start()`` runs
    once per task and returns a function from the input columns (lists) to the output columns
    (sequences); an optional attribute ``finish`` returns the task's last output columns."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches):
        step = start()
        for batch in batches:
            columns = step(*[c.to_pylist() for c in batch.columns])
            yield from _batch(columns)
        finish = getattr(step, "finish", None)
        if finish is not None:
            yield from _batch(finish())

    def _batch(columns):
        if len(columns) and len(columns[0]):
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, out)
