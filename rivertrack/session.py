"""Session settings the library relies on, and the folder shared by all executors."""

import tempfile

from pyspark.sql import SparkSession

# Runtime settings worth having on any cluster; all are Spark's own.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where that costs another shuffle further on
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def local_session(cpus: int = 8, name: str = "rivertrack", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", f"{tempfile.gettempdir()}/rivertrack-warehouse")
        .config("spark.sql.shuffle.partitions", str(partitions))
        # checkpoints go with the plans that read them; to be set when a cluster's session starts
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the session names. Only a local session without one gets a
    temporary folder, as tests do; a cluster must name a folder all executors can reach."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        known = tempfile.mkdtemp(prefix="rivertrack-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known.rstrip("/")
