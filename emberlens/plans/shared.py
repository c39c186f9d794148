"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

LOCAL = "/tmp/checkpoints"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for ``purpose`` below the session's ``spark.checkpoint.dir``. A local
    session without one gets a folder of this machine; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster's session needs spark.checkpoint.dir, a folder that all machines share")
        root = LOCAL
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_dir`` named, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
