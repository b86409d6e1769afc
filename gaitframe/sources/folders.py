"""The folder for what queries write on their way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nothing has yet, in the folder that driver and executors share; a local one only on a local master."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gaitframe-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
