"""Files between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder that lasts until the application ends: in spark.checkpoint.dir, or a temporary one where all run on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"{shared or 'file://' + tempfile.mkdtemp(prefix='spark-')}/spillway-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(own)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return f"{own}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written once and read again, so that what reads them twice sees the same ones and works them out once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
