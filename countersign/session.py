"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def pin_utc(spark: SparkSession) -> SparkSession:
    """Batch days and stamps are UTC; make the session agree."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_folder(spark: SparkSession) -> SparkSession:
    """Give a local session without a shared folder one of this machine.

    For tests, measurements and the entry point; gone when the interpreter ends.
    A session of a cluster is left as it is: its owner names the folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and re.match(r"local(\[|$)", context.master):
        folder = tempfile.mkdtemp(prefix="countersign-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and measurements."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("countersign")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return local_folder(pin_utc(spark))
