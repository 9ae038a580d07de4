"""Where jobs put intermediate tables: the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir`` (or what ``setCheckpointDir`` was given).  Where neither is set, a temporary one on a local master; on a cluster, whose machines share no such folder, an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"
