"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Joins on cell or frame keys can be dominated by one hot key. AQE splits such
    # partitions from the measured map output sizes; forcing it keeps the split even
    # when a later aggregate then needs one more exchange.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Lets the binary sources skip whole files by frame.
    "spark.sql.python.filterPushdown.enabled": "true",
}

_fallback_scratch: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """Return a fresh folder name for intermediate tables.

    The folder lies under ``spark.checkpoint.dir``, the shared folder the cluster
    names. Only where driver and executors are one process (a local master, as in tests)
    may the setting be missing; a temporary folder of this machine is used then.
    """
    global _fallback_scratch
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if _fallback_scratch is None:
            _fallback_scratch = tempfile.mkdtemp(prefix="fieldframe-")
        root = _fallback_scratch
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table that several results need to the scratch folder and read it back.

    Unlike a cache the files survive the loss of executors, and the plan behind them is cut.
    Catalyst also knows their size: a small table is broadcast from the start, where a derived
    one would first have the other side of the join shuffled.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
