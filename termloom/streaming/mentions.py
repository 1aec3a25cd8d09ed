"""Mentions as a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import clean_label
from termloom.session import scratch


def read_mentions(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over the Parquet files at ``path`` (a file, or a folder to which files are added), with their stored schema."""
    schema = spark.read.parquet(path).schema
    # a single file is watched through its folder
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if path.endswith(".parquet") and _is_file(spark, path):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _seen(mentions: DataFrame) -> DataFrame:
    return mentions.filter("seen_at is not null").withColumn("seen_at", F.col("seen_at").cast("timestamp"))


def _by_day(seen: DataFrame) -> DataFrame:
    counts = seen.groupBy(
        F.window("seen_at", "1 day").alias("w"),
        F.coalesce(clean_label(F.col("stratum")), F.lit("(none)")).alias("stratum")
    ).agg(F.count("*").alias("mentions"), F.count_if(F.col("source") == F.col("target")).alias("self_mentions"))
    return counts.select(F.col("w.start").alias("day"), "stratum", "mentions", "self_mentions")


def daily_counts(mentions: DataFrame) -> DataFrame:
    """(day, stratum, mentions, self_mentions); '(none)' for no stratum, rows never seen are left out. Works on streams and tables."""
    return _by_day(_seen(mentions))


def closed_days(mentions: DataFrame, delay: str = "2 days") -> DataFrame:
    """``daily_counts`` that may be appended to a sink: days older than the watermark are final, and rows later than ``delay`` are dropped."""
    return _by_day(_seen(mentions).withWatermark("seen_at", delay))


def stream_counts(spark: SparkSession, path: str) -> DataFrame:
    """Run ``daily_counts`` over all files there are, micro-batch by micro-batch, and return the final table.

    Late rows count: without a watermark a day's state stays open, and days times strata are few.
    """
    name, at = f"t{uuid.uuid4().hex}", scratch(spark, "stream")
    query = (
        daily_counts(read_mentions(spark, path))
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", at)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.table(name).withColumn("day", F.col("day").cast("timestamp_ntz"))
