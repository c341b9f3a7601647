"""Session settings, and the package on the executors' Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: What the engine expects; ANSI mode stays on, so all divisions are guarded.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session for local use; on a cluster, pass the cluster's own and call ship()."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


#: Arrow batches of long texts; a Python worker holds several copies of one at a time.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, by path where the machine is shared, else as a zip, and bound their batches."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES).rstrip("b").isdigit() and int(spark.conf.get(BATCH_BYTES).rstrip("b")) > BATCH:
        spark.conf.set(BATCH_BYTES, str(BATCH))
    if context.environment.get("FACTORLOOM_SHIPPED"):
        return spark
    if context.master.startswith("local"):
        paths = [str(ROOT), context.environment.get("PYTHONPATH", "")]
        context.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    else:
        archive = Path(tempfile.mkdtemp()) / "factorloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((ROOT / "factorloom").rglob("*.py")):
                out.write(file, file.relative_to(ROOT))
        context.addPyFile(str(archive))
    context.environment["FACTORLOOM_SHIPPED"] = "1"
    return spark
