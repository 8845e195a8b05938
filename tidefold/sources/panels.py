"""Regular panels built from the star-schema tables.

Each panel covers a fixed common period, so its number of slots is known before
any data is read. That length is what lets the operators use plain windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.clock import slots_between
from tidefold.operators.resample import panel

HOUR = 3600
DAY = 24 * HOUR
WEEK = 7 * DAY


@dataclass(frozen=True)
class Period:
    start: datetime
    end: datetime
    step: int
    season: int

    @property
    def slots(self) -> int:
        return slots_between(self.start, self.end, self.step)


# Common periods of the panels, [start, end).
EVENT_HOURS = Period(datetime(2024, 1, 1), datetime(2024, 1, 31), HOUR, 24)
EVENT_DAYS = Period(datetime(2024, 1, 1), datetime(2024, 1, 31), DAY, 7)
ORDER_WEEKS = Period(datetime(1994, 12, 26), datetime(2001, 8, 6), WEEK, 52)
SHIP_WEEKS = Period(datetime(1995, 1, 2), datetime(2001, 11, 5), WEEK, 52)


def observed_period(rows: DataFrame, step: int, season: int, anchor: datetime = datetime(1970, 1, 1), ts: str = "ts") -> Period:
    """The period of whole steps, counted from ``anchor``, that holds every row: nothing lies outside.

    One job over a single column; a file's statistics answer it where the source has them.
    """
    first, last = rows.agg(F.min(ts).cast("timestamp_ntz"), F.max(ts).cast("timestamp_ntz")).first()
    if first is None:
        raise ValueError("There are no rows to take a period from.")
    slot = timedelta(seconds=step)
    return Period(anchor + slot * ((first - anchor) // slot), anchor + slot * ((last - anchor) // slot + 1), step, season)


def outside(rows: DataFrame, period: Period, ts: str = "ts") -> DataFrame:
    """Per series: rows before, in and behind a fixed period, which a panel over it would leave out."""
    low, high = (F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz") for t in (period.start, period.end))
    return rows.groupBy("series_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col(ts) < low).alias("rows_before"), F.count_if(F.col(ts) >= high).alias("rows_behind"),
        F.count_if(F.col(ts).isNull()).alias("rows_without_time"),
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str, key: str = "event_type") -> DataFrame:
    return table(spark, folder, "events").select(
        F.col(key).alias("series_id"), "event_id", "ts", "value"
    )


def orders_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("series_id"))
    orders = table(spark, folder, "orders").select(
        "o_custkey", F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value")
    )
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("series_id", "ts", "value")


def shipments(spark: SparkSession, folder: str, key: str = "l_returnflag") -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col(key).alias("series_id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"),
    )


def evt_hour(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    p = period or EVENT_HOURS
    return panel(events(spark, folder), p.start, p.end, p.step)


def user_day(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    p = period or EVENT_DAYS
    return panel(events(spark, folder, "user_id"), p.start, p.end, p.step, how="sum")


def seg_week(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    p = period or ORDER_WEEKS
    return panel(orders_by_segment(spark, folder), p.start, p.end, p.step)


def ship_week(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    p = period or SHIP_WEEKS
    return panel(shipments(spark, folder), p.start, p.end, p.step, how="sum")


def supplier_week(spark: SparkSession, folder: str, period: Period | None = None) -> DataFrame:
    p = period or SHIP_WEEKS
    return panel(shipments(spark, folder, "l_suppkey"), p.start, p.end, p.step, how="sum")
