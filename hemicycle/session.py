"""Session defaults and the shared folder for materialised intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the operators rely on; a value the user set wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where the split costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # long texts and files: what a Python worker holds is set by bytes, not by the number of rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
#: Those that a session made elsewhere is given as well.
PREPARED = ("spark.sql.adaptive.", "spark.sql.execution.arrow.")


def build_session(master: str | None = None, app: str = "hemicycle", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the run-time settings its owner left unset."""
    given = spark.sparkContext.getConf()
    for key, value in DEFAULTS.items():
        if not given.contains(key) and key.startswith(PREPARED):
            spark.conf.set(key, value)
    return spark


def spread(scan: DataFrame) -> DataFrame:
    """Spread a small scan over all cores before work that is heavy per row.

    A scan with at least one split per core, as any large table has, is left alone; only a
    table of a few splits is dealt out, and that moves little data.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    base = os.path.join(tempfile.gettempdir(), f"hemicycle-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: it outlives lost executors and its inputs."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Bytes up to which :func:`small_enough` allows a broadcast.
BROADCAST_BYTES = 64 << 20


def small_enough(side: DataFrame, key: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a side whose counted bytes are within the bound; else leave the join to Spark.

    A row counts for its key, a string, and 64 bytes.
    """
    size = F.coalesce(F.sum(F.octet_length(key) + F.lit(64)), F.lit(0))
    return F.broadcast(side) if side.agg(size).first()[0] <= most else side


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/hemicycle/{label}-{uuid.uuid4().hex}"
