"""The driver's tables as points, measurements and registers, once for Spark and once as SQL with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import d, micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(keys: DataFrame, by: str) -> DataFrame:
    """The rows in a few tasks for each core, however few files they come from: each is to become hundreds of rows."""
    return keys.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism, by)


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of ten frames and three sensors."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(5)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("frame_no"), F.col("vec_id").alias("seq"), (F.col("vec_id") % 3).cast("int").alias("sensor"), (F.col("vec_id") % 16).cast("int").alias("ring"),
        *[(d(20) * e[i]).alias(c) for i, c in enumerate("xyz")], (d(255) * F.least(d(1), F.abs(e[3]) * d(4))).alias("intensity"),
    )


PTS = """pts AS (SELECT CAST(label AS BIGINT) AS frame_no, vec_id AS seq, CAST(vec_id % 3 AS INTEGER) AS sensor, CAST(vec_id % 16 AS INTEGER) AS ring,
  20 * CAST(embedding[1] AS DOUBLE) AS x, 20 * CAST(embedding[2] AS DOUBLE) AS y, 20 * CAST(embedding[3] AS DOUBLE) AS z,
  255 * least(1::DOUBLE, abs(CAST(embedding[4] AS DOUBLE)) * 4) AS intensity FROM embeddings)"""


def meas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of a stream for each user; stamps in hours."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("value").alias("v"), micros(F.col("ts")).alias("us"), (micros(F.col("ts")) / d(3.6e9)).alias("stamp"), "props")


MEAS = "meas AS (SELECT user_id AS stream, event_id AS seq, event_type AS kind, value AS v, epoch_us(ts) AS us, CAST(epoch_us(ts) AS DOUBLE) / 3.6e9::DOUBLE AS stamp, props FROM events)"


def cloud_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud for each supplier, for volume."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame_no"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("x"), (F.col("l_discount") * d(100)).alias("y"), (F.col("l_tax") * d(100)).alias("z"), F.col("l_extendedprice").alias("intensity"))


BIG = "big AS (SELECT l_suppkey AS frame_no, l_orderkey * 8 + l_linenumber AS seq, l_quantity AS x, l_discount * 100::DOUBLE AS y, l_tax * 100::DOUBLE AS z, l_extendedprice AS intensity FROM lineitem)"


def regs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 7 % 65536).cast("int").alias("raw"), (F.col("o_custkey") % 2 == 0).alias("is_signed"), (F.col("o_custkey") % 3 != 0).alias("read"))


REGS = "regs AS (SELECT o_orderkey AS seq, CAST(o_orderkey * 7 % 65536 AS INTEGER) AS raw, o_custkey % 2 = 0 AS is_signed, o_custkey % 3 <> 0 AS read FROM orders)"
