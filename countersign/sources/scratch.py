"""Folders for intermediate tables that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the shared folder the session names.

    That is ``spark.checkpoint.dir`` or what ``setCheckpointDir`` was given; the
    library knows no other folder.
    """
    shared = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return f"{shared.rstrip('/')}/countersign-{purpose}-{uuid.uuid4().hex}"
