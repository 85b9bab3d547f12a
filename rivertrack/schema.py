"""Schemas of the tables, and small helpers that conform a DataFrame to them.

Times are wall-clock TIMESTAMP_NTZ throughout; frequencies are DECIMAL(6,3) because they
identify a tag and are never computed with. ``seq`` is the tie-breaker within one instant of
one tag: any column order gives the same result only because it is explicit.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

DETECTIONS = (
    "date DATE, ts TIMESTAMP_NTZ, tag STRING, freq DECIMAL(6,3), code INT, power DOUBLE, "
    "zone STRING, rkm DOUBLE, method STRING, station STRING, tag_ts TIMESTAMP_NTZ, sex STRING, "
    "fork_length DOUBLE, lat DOUBLE, long DOUBLE, src_file STRING, seq BIGINT"
)
RECEIVER = (
    "date DATE, ts TIMESTAMP_NTZ, station STRING, antenna INT, freq DECIMAL(6,3), type STRING, "
    "code INT, power INT, tag STRING, src_file STRING, seq BIGINT"
)
TAG_METADATA_2024 = (
    "`Date` STRING, `Frequency` STRING, `Tag.Number` STRING, `Gender` STRING, `Length` STRING"
)
TAG_METADATA_2023 = (
    "date STRING, time STRING, freq STRING, code STRING, sex STRING, forkLength STRING"
)
# what their cells are meant to be; a date in another layout than ISO stays text
TAG_TYPES_2024 = (
    "`Date` DATE, `Frequency` INT, `Tag.Number` INT, `Gender` STRING, `Length` DOUBLE"
)
TAG_TYPES_2023 = "date STRING, time STRING, freq INT, code INT, sex STRING, forkLength DOUBLE"
TAGS = "tag_ts TIMESTAMP_NTZ, tag STRING, sex STRING, fork_length DOUBLE"
RKM_POINTS = "idx BIGINT, x DOUBLE, y DOUBLE, rkm DOUBLE, zone STRING"
FIXED_LOCATIONS = "`Station` STRING, `Latitude` DOUBLE, `Longitude` DOUBLE"


def fixed_table(spark: SparkSession, rows: list[tuple], ddl) -> DataFrame:
    """A constant lookup table. Only for tables that ship with the package. Made from Arrow, so
    that it is a local relation whose size Catalyst knows."""
    schema = T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    columns = zip(*rows) if rows else [[] for _ in schema]
    table = pa.Table.from_arrays(
        [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema)],
        names=schema.names,
    )
    return spark.createDataFrame(table, schema)


def conform(df: DataFrame, ddl: str = DETECTIONS) -> DataFrame:
    """Exactly the columns of ``ddl``, in order; missing ones become typed NULLs."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in T.StructType.fromDDL(ddl).fields
        ]
    )
