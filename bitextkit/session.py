"""SparkSession helpers.

The library never creates data on the driver and never assumes a local
machine: the only filesystem location it uses on its own is the shared
checkpoint folder named by ``spark.checkpoint.dir``.  Tests run without a
cluster, so :func:`ensure_checkpoint_dir` sets a scratch folder only when the
session has none.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "bitextkit",
                shuffle_partitions: int | None = None,
                extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    ``master`` is only for local runs; on a cluster leave it ``None`` so the
    launcher's master is used.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="bitextkit-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used between pipeline stages whose result feeds several actions (e.g. the
    cleaned corpus feeding both the funnel report and the written corpus) so
    that a lost executor recomputes from the checkpoint, not from the scan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


UNKNOWN_BYTES = 1 << 50     # Spark's estimate for a source of unknown size is far above this


def input_bytes(df: DataFrame) -> int:
    """Estimated bytes that ``df`` reads: the sizes of its plan's sources, which
    a join cannot multiply.  No job runs; sources of unknown size count 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < UNKNOWN_BYTES)


#: Bytes of estimated input for each partition of a stage whose work its shuffle's bytes do not show.
PARTITION_BYTES = 8 << 20


def partitions_for(df: DataFrame, times: int = 1) -> int:
    """``spark.sql.shuffle.partitions``, or more if the size of the input (read
    ``times`` times) asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, times * input_bytes(df) // PARTITION_BYTES)
