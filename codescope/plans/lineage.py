"""Store an intermediate result that several branches of a plan read."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. In local mode, where one machine runs everything, it may be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.local.dir', '/tmp').split(',')[0].rstrip('/')}/codescope-{spark.conf.get('spark.app.id')}"


def new_location(spark: SparkSession) -> str:
    """A new path below the shared folder; what is written there is removed when the session ends."""
    location = f"{shared_folder(spark)}/codescope-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return location


def stored(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``frame`` once to the shared folder and read it back, so that losing executors never repeats its work.

    With ``by`` there is a directory for each value of these columns, so a filter on them reads only its own files.
    """
    location = new_location(frame.sparkSession)
    frame.write.partitionBy(*by).parquet(location) if by else frame.write.parquet(location)
    back = frame.sparkSession.read.schema(frame.schema).parquet(location).select(frame.columns)
    back.stored_at = location
    return back


def discard(frame: DataFrame) -> None:
    """Remove what ``stored`` has written for ``frame``, once nothing will read it again."""
    session = frame.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
