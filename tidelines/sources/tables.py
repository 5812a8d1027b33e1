"""Attribute histories from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import EVENTS, ORDERS, TimeFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_observations(spark: SparkSession, sf_dir: str, frame: TimeFrame = EVENTS, values: int = 3) -> DataFrame:
    """role_id, ts, value: the last event of each user, type and day."""
    e = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    day = F.to_date("ts")
    k = F.get_json_object("props", "$.k").cast("int") % values
    rows = e.where(day.between(F.lit(frame.start), F.lit(frame.end))).select(F.concat_ws("||", F.col("user_id").cast("string"), "event_type").alias("role_id"), day.alias("d"), F.struct("ts", "event_id").alias("at"), F.concat(F.lit("k"), k.cast("string")).alias("value"))
    return rows.groupBy("role_id", F.col("d").alias("ts")).agg(F.max_by("value", "at").alias("value"))


def event_histories(spark: SparkSession, sf_dir: str, frame: TimeFrame = EVENTS, values: int = 3) -> DataFrame:
    """role_id, ts, value, wc: a day's value is decayed (DE) from the next day without an event; R before the first event."""
    obs = event_observations(spark, sf_dir, frame, values)
    w = Window.partitionBy("role_id").orderBy("ts")
    own = obs.select("role_id", "ts", "value", F.lag("ts").over(w).isNull().alias("first"), F.lead("ts").over(w).alias("next"))
    none = F.lit(None).cast("string")
    entry = lambda ts, value, wc: F.struct(ts.alias("ts"), value.alias("value"), wc.alias("wc"))
    after = F.date_add("ts", 1)
    entries = F.array(
        entry(F.col("ts"), F.col("value"), none),
        F.when((F.col("next").isNull() | (F.col("next") > after)) & (after <= F.lit(frame.end)), entry(after, none, F.lit("DE"))),
        F.when(F.col("first") & (F.col("ts") > F.lit(frame.start)), entry(F.lit(frame.start), none, F.lit("R"))),
    )
    return own.select("role_id", F.explode(F.array_compact(entries)).alias("e")).select("role_id", "e.ts", "e.value", "e.wc")


def order_histories(spark: SparkSession, sf_dir: str, frame: TimeFrame = ORDERS) -> DataFrame:
    """role_id, ts, value, wc: a customer's latest order status by week, carried forward; R before the first order."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    day = F.to_date("o_orderdate")
    rows = o.where(day.between(F.lit(frame.start), F.date_add(F.lit(frame.end), frame.granularity - 1))).select(F.col("o_custkey").cast("string").alias("role_id"), frame.floor(day).alias("ts"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderstatus").alias("value"))
    weekly = rows.groupBy("role_id", "ts").agg(F.max_by("value", "at").alias("value"))
    w = Window.partitionBy("role_id").orderBy("ts")
    kept = weekly.withColumn("p", F.lag("value").over(w)).where(F.col("p").isNull() | (F.col("p") != F.col("value"))).select("role_id", "ts", "value", F.lit(None).cast("string").alias("wc"))
    start = kept.groupBy("role_id").agg(F.min("ts").alias("t")).where(F.col("t") > F.lit(frame.start)).select("role_id", F.lit(frame.start).alias("ts"), F.lit(None).cast("string").alias("value"), F.lit("R").alias("wc"))
    return kept.unionByName(start)


def event_revisions(spark: SparkSession, sf_dir: str, values: int = 3) -> DataFrame:
    """Events as raw revisions: key, property, valid_from, revision_id, value."""
    e = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int") % values
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("property"), F.col("ts").alias("valid_from"), F.col("event_id").alias("revision_id"), F.concat(F.lit("k"), k.cast("string")).alias("value"))
