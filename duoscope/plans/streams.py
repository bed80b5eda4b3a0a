"""Streaming queries, run to the end of what has landed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from duoscope.plans.audits import _CONFUSION, _RATES, KEYS, _shown
from duoscope.plans.base import Plan
from duoscope.runtime import ensure_checkpoint_dir, table
from duoscope.streaming import incremental

PLAN = Plan()


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result after everything there is; only for results of a few rows per group."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"drained_{uuid.uuid4().hex}"
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def _arriving(spark: SparkSession, root: str, name: str) -> DataFrame:
    return incremental.arriving(spark, f"{root}/{name}.parquet*", table(spark, root, name).schema)


@PLAN.query(f"with c as (select model, benchmark, dialect, {_CONFUSION} from audit_pairs group by all) select *, {_RATES} from c")
def stream_confusion(spark: SparkSession, root: str) -> DataFrame:
    """Paired outcomes of a stream of graded pairs."""
    return _shown(_drain(incremental.running_confusion(_arriving(spark, root, "audit_pairs"), KEYS), "complete"))


@PLAN.query("select event_type, count(*) as events, count(distinct event_id) as distinct_events from events group by event_type")
def stream_events(spark: SparkSession, root: str) -> DataFrame:
    """Events by type, each id once."""
    from pyspark.sql import functions as F

    once = incremental.first_deliveries(_arriving(spark, root, "events"), ["event_id"], "ts", "3650 days")
    return _drain(once.groupBy("event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("event_id", 0.01).alias("about")), "complete").select("event_type", "events", F.col("events").alias("distinct_events"))
