"""Spark session helpers.

Local runs (tests, bench) build a ``local[N]`` session with AQE on.  On a
cluster the caller passes its own session; nothing here overrides settings
that the cluster already fixed (checkpoint dir, shuffle partitions).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session should carry: UTC so dates derived from
# timestamps agree with the SQL oracle, AQE so joins against dimension
# tables of unknown size are re-planned from real shuffle sizes (a runtime
# size check before any broadcast), and skew-join splitting for hot keys.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # wide reports (97 columns and their inputs) stay in generated code
    "spark.sql.codegen.maxFields": "300",
    "spark.sql.parquet.aggregatePushdown": "true",
    # broadcast decisions stay size-checked (planner estimate, then AQE on
    # real shuffle sizes).  The estimate is the size of compressed columns in files:
    # a hash table of the driver takes 30 to 50 times that (four columns of 1.2 million
    # parts: about 4 MB, 144 MB as a table), and twice so much while it is built
    "spark.sql.autoBroadcastJoinThreshold": str(1 << 20),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(8 << 20),
}


def local_session(cores: int | None = None, app: str = "scorecraft") -> SparkSession:
    """A local session for tests and benchmarks."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores * 4))  # AQE coalesces small ones
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the defaults that an existing session (cluster case) leaves open.

    Only the time zone is always set: dates depend on it.
    """
    own = set(spark.conf.getAll)
    for k, v in SESSION_DEFAULTS.items():
        if k == "spark.sql.session.timeZone" or k not in own:
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names; set one only if unset.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is.  Only a local session without one (tests, bench) gets a
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        try:
            current = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            current = None
    if not current:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="scorecraft-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current.rstrip("/")
