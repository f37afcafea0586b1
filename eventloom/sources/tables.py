"""Event-shaped views of the star-schema tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.timing import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value and t in microseconds."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("t"))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point process a user: neuron, t."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("neuron"), micros("ts").alias("t"))


def triggers(spark: SparkSession, sf_dir: str, kind: str = "purchase") -> DataFrame:
    """Events of one type as triggers: trigger, e (time) and label (day of the week)."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return rows.select(F.col("event_id").alias("trigger"), micros("ts").alias("e"), (F.dayofweek("ts") - 1).cast("long").alias("label"))


def spans(spark: SparkSession, sf_dir: str, kind: str, length: int) -> DataFrame:
    """[t, t + length) of each event of a type, with its event_id and user_id."""
    rows = events(spark, sf_dir).where(F.col("event_type") == kind)
    return rows.select("event_id", "user_id", F.col("t").alias("t0"), (F.col("t") + F.lit(length).cast("long")).alias("t1"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir, which all executors share; where it is unset, in a temporary one for local sessions and an error for others."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="eventloom-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
