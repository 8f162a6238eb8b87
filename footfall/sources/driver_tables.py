"""The given Parquet tables as event logs.

``events`` stands for a clickstream: a journey is one user in one three-day
block, ``purchase`` is the target and seven days without activity mean failure.
``lineitem`` stands for a long order history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.times import epoch_seconds
from footfall.operators.clean import as_event_log

TARGET = "purchase"
INACTIVITY = 7
NAMES = ("click", "error", "purchase", "signup", "view")
BLOCK_SECONDS = 259_200

# The event dimension for the five event types; ``error`` has none.
DEFINITIONS = (
    ("click", 1, 2, None, "Discover"),
    ("signup", 1, 12, 1, "Apply for Credit"),
    ("view", 1, 4, None, "First Purchase"),
    ("purchase", 1, 28, 6, "Order Shipped"),
)
CODES = {"click": 2, "error": 99, "purchase": 28, "signup": 12, "view": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    df = table(spark, sf_dir, "events")
    block = F.floor(epoch_seconds("ts") / BLOCK_SECONDS).cast("string")
    journey = F.concat(F.col("user_id").cast("string"), F.lit(" "), block)
    return as_event_log(df, journey, "event_type", "ts", "event_id", keep)


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per order line; returned lines are not shipments."""
    df = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_returnflag") == "R", "order_returned").otherwise("order_shipped")
    return as_event_log(df, "l_orderkey", name, "l_shipdate", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(DEFINITIONS),
        "event_name string, journey_id int, event_definition_id int, milestone_number int, stage string",
    )
