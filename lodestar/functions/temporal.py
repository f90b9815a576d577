"""Dates and month-and-day intervals, which Spark's calendar intervals cannot order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(months: Column, days: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"))


def add_interval(date: Column, i: Column) -> Column:
    """Months first, with the day clamped to the month's end, then days."""
    return F.date_add(F.add_months(date, i["months"]), i["days"])


def date_difference(a: Column, b: Column) -> Column:
    return interval(F.lit(0), F.datediff(a, b))


def scale_interval(i: Column, by: Column) -> Column:
    return interval(i["months"] * by, i["days"] * by)


def interval_key(i: Column) -> Column:
    """Orders intervals, a month as thirty days."""
    return i["months"] * 30 + i["days"]
