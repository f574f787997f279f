"""Session settings the plans are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Wall-clock columns are TIMESTAMP_NTZ, so UTC keeps casts free of zone shifts.
# The last two let the adaptive planner split a hot join key even where that
# costs one more exchange.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the SQL options above on a running session; cluster sizing stays the cluster's."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor and the driver reach.

    A local session without that setting gets a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="courierlens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
