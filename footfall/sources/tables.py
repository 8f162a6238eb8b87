"""Readers with explicit schemas, and writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.times import parse_ts
from footfall.operators.spread import null_safe_join, with_place
from footfall.schema import EVENT_DEFINITION_SCHEMA, ID, RAW_EVENT_SCHEMA, TS
from footfall.session import materialize

BOM = "﻿"


def read_events_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType = RAW_EVENT_SCHEMA,
) -> DataFrame:
    """Event log CSV with a fixed schema; only the chosen columns are parsed.

    Timestamps are ISO-8601 in UTC; text that does not parse becomes null.
    """
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    if columns is not None:
        df = df.select(*columns)
    if TS in df.columns:
        df = df.withColumn(TS, parse_ts(TS))
    return df


def read_events(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Event log from Parquet, column-pruned by the scan."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, rows_per_file: int = 2_000_000) -> None:
    """Write Parquet. With ``partition_by`` the rows of a value meet in as many
    tasks as its size needs: neither does one task write a value that fills much
    of the table, nor does every task write a small file for every value."""
    if partition_by is None:
        df.write.mode("overwrite").parquet(path)
        return
    columns, df = df.columns, with_place(df, "_place")
    sizes = materialize(df.groupBy(partition_by).agg(F.ceil(F.count("*") / rows_per_file).alias("_files")), "sizes")
    dealt = null_safe_join(df, sizes, [partition_by], "left").withColumn(
        "_salt", F.pmod("_place", "_files")
    )
    dealt = dealt.repartition(partition_by, "_salt").select(*columns)
    dealt.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def read_event_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Event dimension: one row per event, milestone may be missing.

    Columns are matched by position, so a byte-order mark before the first
    header name does no harm.
    """
    df = (
        spark.read.schema(EVENT_DEFINITION_SCHEMA)
        .option("header", True)
        .option("enforceSchema", True)
        .option("encoding", "UTF-8")
        .csv(path)
    )
    return df.withColumn("event_name", F.regexp_replace("event_name", BOM, ""))


def write_predictions(df: DataFrame, path: str, p: str = "p", columns: Sequence[str] = (ID,)) -> None:
    """Prediction CSV ``id, order_shipped``, written in parallel parts."""
    out = df.select(*columns, F.col(p).alias("order_shipped"))
    out.write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, order_shipped double").option("header", True).csv(path)


def write_sequences(df: DataFrame, path: str) -> None:
    """Sequence arrays with label and journey id in one table."""
    df.write.mode("overwrite").parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], covers: tuple[str, object] | None = None) -> DataFrame:
    """Reuse a finished table if its largest value reaches ``covers``, else rebuild it."""
    if table_exists(spark, path):
        have = spark.read.parquet(path)
        if covers is None:
            return have
        column, needed = covers
        # Compared by Spark as the column's type, so 10 is more than 9.
        if have.agg(F.max(column) >= F.lit(needed)).first()[0]:
            return have
    write_table(build(), path)
    return spark.read.parquet(path)


def load_template(spark: SparkSession, path: str, expected_rows: int | None = None) -> DataFrame:
    """Scoring template CSV: each id once, with its ``position`` in the file.

    The position is the start of the file's split plus the row within it, so it
    grows with the file order however the file is split. Repeated ids and a wrong
    row count raise an error.
    """
    read = spark.read.option("header", True).csv(path)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    df = read.select(F.col(ID).cast("string"), (F.col("_metadata.file_block_start") + within).alias("position"))
    repeated = df.groupBy(ID).count().where("count > 1").head(1)
    if repeated:
        raise ValueError(f"template id {repeated[0][0]!r} occurs more than once")
    return check_rows(df, expected_rows)


def check_rows(df: DataFrame, expected_rows: int | None) -> DataFrame:
    if expected_rows is not None:
        rows = df.count()
        if rows != expected_rows:
            raise ValueError(f"table has {rows} rows; expected {expected_rows}")
    return df


def conform_to_template(pred: DataFrame, template: DataFrame, p: str = "p", key: str = ID) -> DataFrame:
    """Every template id once, with its prediction or the median prediction.

    Repeated predictions of an id are merged to their mean, a null id is an id like any
    other, and other columns of the template, such as a position, are kept.
    """
    from footfall.operators.quantiles import quantiles

    median = quantiles(pred, p, {"m": 0.5}).scalar()
    merged = pred.groupBy(key).agg(F.avg(p).alias(p))
    joined = null_safe_join(template, merged, [key], "left")
    return joined.withColumn(p, F.coalesce(F.col(p), median))
