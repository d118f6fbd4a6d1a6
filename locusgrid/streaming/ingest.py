"""Streaming ingest: call records that arrive in a folder keep running per-contig statistics up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusgrid.functions import expr as X


def stream_records(spark: SparkSession, folder: str, schema: str = "chr string, start long, sample string, m double, u double") -> DataFrame:
    return spark.readStream.schema(schema).option("sep", "\t").csv(folder)


def running_stats(records: DataFrame) -> DataFrame:
    """(chr, sample, n, cov, beta) over all records so far: bounded state, one row a contig and sample."""
    out = records.where("m + u > 0").groupBy("chr", "sample").agg(F.count("*").alias("n"), F.sum(F.col("m") + F.col("u")).alias("cov"), F.sum("m").alias("m"))
    return out.select("chr", "sample", "n", "cov", X.ratio(F.col("m"), F.col("cov")).alias("beta"))
