"""Retention: cohorts, new versus returning buyers, time between purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.functions.numbers import percent, rounded_ratio
from clientela.operators.ledger import Ledger
from clientela.params import Period

_BITS = 63  # months held by one bigint


def _month_index(day: Column, period: Period) -> Column:
    first = period.start.year * 12 + period.start.month
    return F.year(day) * 12 + F.month(day) - first


def cohort_retention(ledger: Ledger, period: Period) -> DataFrame:
    """Customers active each month after the month of their first purchase within the period.

    The months a customer bought in are a bit set in one ``bigint`` per 63 months of the period,
    so customers are reduced before the only shuffle that carries their sales. Customers with the same
    months are counted next, and only the different patterns are taken apart into months.
    """
    last = period.months - 1
    index = _month_index(F.col("day"), period)
    words, bought = [], F.lit(False)
    for low in range(0, period.months, _BITS):
        here = index.between(low, low + _BITS - 1)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), index - low)
        words.append(F.bit_or(F.when(here, bit)).alias(f"w{low}"))
        is_set = F.getbit(F.col(f"w{low}"), F.col("month") - low) == 1
        bought = F.when(F.col("month") >= low, is_set).otherwise(bought)
    counts = (
        ledger.orders(period)
        .groupBy("customer_id")
        .agg(F.min(index).alias("cohort"), *words)
        .groupBy("cohort", *(f"w{low}" for low in range(0, period.months, _BITS)))
        .agg(F.count("*").alias("customers"))
        .withColumn("month", F.explode(F.sequence("cohort", F.lit(last))))
        .filter(bought)
        .groupBy("cohort", (F.col("month") - F.col("cohort")).alias("age"))
        .agg(F.sum("customers").alias("active_customers"))
    )
    # from here on at most months * (months + 1) / 2 rows
    cohort = Window.partitionBy("cohort")
    first_month = F.trunc(F.lit(period.start), "MM")
    return (
        counts.withColumn(
            "cohort_size", F.max(F.when(F.col("age") == 0, F.col("active_customers"))).over(cohort)
        )
        .select(
            F.add_months(first_month, F.col("cohort")).alias("cohort_month"),
            "age",
            "active_customers",
            "cohort_size",
            (rounded_ratio("active_customers", "cohort_size", 1000) / 10.0).alias("retention"),
        )
        .orderBy("cohort_month", "age")
    )


def cohort_matrix(cohorts: DataFrame, period: Period) -> DataFrame:
    """Retention as a matrix: one row per cohort, one column per age the period allows."""
    ages = list(range(period.months))
    matrix = cohorts.groupBy("cohort_month").pivot("age", ages).agg(F.avg("retention"))
    return matrix.select(
        "cohort_month",
        F.date_format("cohort_month", "MMM/yyyy").alias("cohort_label"),
        *(F.col(str(a)).alias(f"age_{a}") for a in ages),
    ).orderBy("cohort_month")


def _pairs_in_period(ledger: Ledger, period: Period) -> DataFrame:
    """One row per customer and store: first purchase there, and whether it saw one in the period."""
    return (
        ledger.orders()
        .groupBy("customer_id", "store")
        .agg(
            F.min("day").alias("first_here"),
            F.max(period.contains(F.col("day"))).alias("in_period"),
        )
    )


def period_buyers_new_vs_returning(ledger: Ledger, period: Period, per: str = "store") -> DataFrame:
    """Buyers of the period; new and returning are counted per customer and store, or per ``customer``.

    New means that the customer's first purchase in any store is not before the period.
    """
    if per not in ("store", "customer"):
        raise ValueError(f"buyers are counted per store or customer, not per {per!r}")
    pairs = F.count_if("in_period")
    if per == "customer":
        pairs = F.least(pairs, F.lit(1))
    before = period.begins_after(F.col("first_purchase"))
    return (
        _pairs_in_period(ledger, period)
        .groupBy("customer_id")
        .agg(
            F.min("first_here").alias("first_purchase"),
            pairs.alias("pairs"),
        )
        .agg(
            F.count_if(F.col("pairs") > 0).alias("buyers"),
            F.coalesce(
                F.sum(F.when(~before, F.col("pairs"))), F.lit(0)
            ).alias("new_customers"),
            F.coalesce(
                F.sum(F.when(before, F.col("pairs"))), F.lit(0)
            ).alias("returning_customers"),
        )
    )


def period_buyers_shares(ledger: Ledger, period: Period) -> DataFrame:
    """:func:`period_buyers_new_vs_returning` in percent of the buyers; may exceed 100 in sum."""
    return period_buyers_new_vs_returning(ledger, period).withColumns(
        {
            "new_share": percent(F.col("new_customers"), F.col("buyers")),
            "returning_share": percent(F.col("returning_customers"), F.col("buyers")),
        }
    )


def new_vs_returning_by_store(ledger: Ledger, period: Period) -> DataFrame:
    """Buyers of each store in the period, by whether they are new to all stores."""
    customer = Window.partitionBy("customer_id")  # one row per store
    before = period.begins_after(F.col("first_purchase"))
    return (
        _pairs_in_period(ledger, period)
        .withColumn("first_purchase", F.min("first_here").over(customer))
        .filter("in_period")
        .groupBy("store")
        .agg(
            F.count_if(~before).alias("new_customers"),
            F.count_if(before).alias("returning_customers"),
            F.count("*").alias("total"),
        )
        .orderBy(F.desc("total"), "store")
    )


def new_vs_returning_by_store_long(by_store: DataFrame) -> DataFrame:
    """:func:`new_vs_returning_by_store` with one row per store and kind."""
    long = by_store.unpivot("store", ["new_customers", "returning_customers"], "column", "customers")
    kind = F.when(F.col("column") == "new_customers", "Novas").otherwise("Recorrentes")
    return long.select("store", kind.alias("kind"), "customers")


def repurchase_interval(ledger: Ledger, period: Period, same_store: bool = False) -> DataFrame:
    """Mean days between consecutive purchases of a customer, under the store of the later one.

    With ``same_store`` the purchase before is the one before in that store.

    Sales of one customer, day and store are merged before the window: only the first sale of a
    day can lie days after the one before it, all others lie zero days after. The window then
    holds at most one row per day and store of a customer, however many sales there are. Sales
    at the same moment are ordered by store.
    """
    merged = (
        ledger.orders(period)
        .groupBy("customer_id", "day", "store")
        .agg(F.count("*").alias("sales"), F.min("order_ts").alias("first_ts"))
    )
    buyer = ["customer_id", "store"] if same_store else ["customer_id"]
    in_time = Window.partitionBy(*buyer).orderBy("day", "first_ts", "store")
    before = F.lag("day").over(in_time)
    return (
        merged.select(
            "store",
            F.coalesce(F.datediff("day", before), F.lit(0)).alias("days"),
            (F.col("sales") - F.when(before.isNull(), 1).otherwise(0)).alias("pairs"),
        )
        .groupBy("store")
        .agg(F.sum("days").alias("days"), F.sum("pairs").alias("pairs"))
        .filter(F.col("pairs") > 0)
        .select(
            "store",
            rounded_ratio("days", "pairs").cast("double").alias("mean_interval_days"),
            "pairs",
        )
        .orderBy("mean_interval_days", "store")
    )
