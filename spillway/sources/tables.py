"""Tables and text files that operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def load_prefix_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An AS or country table; each loads by itself."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.parquet(path)


def read_feed(spark: SparkSession, path: str, schema, feeds: list[str] | None = None, files_per_trigger: int = 8) -> DataFrame:
    """A stream of packets or messages from a folder of Parquet files, of all or of some feeds."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.where(F.col("feed_id").isin(feeds)) if feeds else stream


def read_darknet(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Interval records of a darknet log with start <= timestamp < end; lines that are no JSON are in _corrupt_record."""
    rows = spark.read.schema(schemas.DARKNET).json(path, mode="PERMISSIVE")
    if start is not None:
        rows = rows.where(F.col("timestamp") >= start)
    return rows if end is None else rows.where(F.col("timestamp") < end)


def darknet_series(records: DataFrame, kind: str) -> DataFrame:
    """interval_start (seconds), key, n of one of udp, tcp and ipid."""
    key = "ipid" if kind == "ipid" else "port"
    return records.where("_corrupt_record is null").select(F.col("timestamp").alias("interval_start"), F.explode(kind).alias("e")).select("interval_start", F.col(f"e.{key}").alias("key"), F.col("e.seen_count").alias("n"))


def read_denat_csv(spark: SparkSession, path: str) -> DataFrame:
    """De-NAT queries or responses, by the header; lines with another number of fields are left out."""
    header = spark.read.text(path).first()
    names = (header.value if header else "").strip().split(",")
    for schema in (schemas.DENAT_QUERY, schemas.DENAT_RESPONSE):
        expected = [c.split()[0] for c in schema.split(", ")]
        if names == expected:
            return spark.read.csv(path, header=True, schema=schema, mode="DROPMALFORMED")
    raise ValueError(f"no de-NAT header: {names}")
