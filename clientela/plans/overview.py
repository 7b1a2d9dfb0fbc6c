"""Overview: headline figures, new versus returning, revenue, categories, payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela import constants as K
from clientela.functions.labels import category_label, channel_label
from clientela.functions.numbers import percent
from clientela.operators.ledger import KEEP, Ledger
from clientela.operators.rollup import sales_figures
from clientela.params import Channel, Period


def overview_kpis(ledger: Ledger, period: Period, channel: Channel | None = None) -> DataFrame:
    """Identified customers, orders, revenue, mean sale and discount; anonymous sales included."""
    return sales_figures(ledger.orders(period, channel, anonymous=KEEP))


def new_vs_returning(ledger: Ledger, period: Period, channel: Channel | None = None) -> DataFrame:
    """Customers of the period by whether their first purchase ever, in the channel, fell into it.

    One pass: each customer is reduced to first day and "bought in the period" before anything
    is shuffled.
    """
    bought = F.max(period.contains(F.col("day")))
    first = F.col("first_purchase")
    return (
        ledger.orders(channel=channel)
        .groupBy("customer_id")
        .agg(F.min("day").alias("first_purchase"), bought.alias("in_period"))
        .filter("in_period")
        .agg(
            F.count("*").alias("total"),
            F.count_if(period.contains(first)).alias("new_customers"),
            F.count_if(period.begins_after(first)).alias("returning_customers"),
        )
    )


def new_vs_returning_shares(
    ledger: Ledger, period: Period, channel: Channel | None = None
) -> DataFrame:
    """:func:`new_vs_returning` with both groups in percent of the total."""
    return new_vs_returning(ledger, period, channel).withColumns(
        {
            "new_share": percent(F.col("new_customers"), F.col("total")),
            "returning_share": percent(F.col("returning_customers"), F.col("total")),
        }
    )


def monthly_revenue_by_store(
    ledger: Ledger, period: Period, channel: Channel | None = None
) -> DataFrame:
    """Revenue per month and store, anonymous sales included."""
    return (
        ledger.orders(period, channel, anonymous=KEEP)
        .groupBy(F.trunc("day", "MM").alias("month"), "store")
        .agg(F.sum("order_total").alias("revenue"))
        .orderBy("month", "store")
    )


def channel_share(ledger: Ledger, period: Period, channel: Channel | None = None) -> DataFrame:
    """Revenue and identified customers of the online shop and of each store."""
    return (
        ledger.orders(period, channel, anonymous=KEEP)
        .groupBy(channel_label(ledger.rules.online_system).alias("channel"))
        .agg(
            F.sum("order_total").alias("revenue"),
            F.count_distinct("customer_id").alias("customers"),
        )
        .orderBy(F.desc("revenue"), "channel")
    )


def top_categories(
    ledger: Ledger,
    period: Period,
    channel: Channel | None = None,
    n: int = K.TOP_CATEGORIES,
    by_store: bool = False,
) -> DataFrame:
    """Best-selling categories of invoiced orders, variants of a category merged by prefix; ties by name.

    An item belongs to an order by its id alone, or, with ``by_store``, by id and store where it carries one.
    """
    label = category_label(F.col("category"), ledger.rules.category_prefixes)
    lines = ledger.within(ledger.items, period).filter(F.col("category").isNotNull()).withColumn("category", label)
    return (
        ledger.of_invoiced_orders(lines, "category", ["line_total", "quantity"], channel, by_store)
        .groupBy("category")
        .agg(F.sum("line_total").alias("revenue"), F.sum("quantity").alias("units"))
        .orderBy(F.desc("revenue"), "category")
        .limit(n)
    )


def new_customers_by_month(
    ledger: Ledger, period: Period, channel: Channel | None = None, full_months: bool = True
) -> DataFrame:
    """Customers by month of their first purchase ever.

    With ``full_months`` the first day of that month has to lie in the period, so a period starting in
    mid-month leaves that month out; without, the day of the first purchase has to.
    """
    first = F.col("first_purchase")
    month = F.trunc(first, "MM")
    return (
        ledger.orders(channel=channel)
        .groupBy("customer_id")
        .agg(F.min("day").alias("first_purchase"))
        .filter(period.contains(month if full_months else first))
        .groupBy(month.alias("month"))
        .agg(F.count("*").alias("new_customers"))
        .orderBy("month")
    )


def payment_mix(
    ledger: Ledger, period: Period, channel: Channel | None = None, by_store: bool = False
) -> DataFrame:
    """Orders and amount per payment method, for payments with a status; ``by_store`` as in :func:`top_categories`."""
    paid = ledger.within(ledger.payments, period).filter(F.col("status").isNotNull()).drop("status")
    return (
        ledger.of_invoiced_orders(paid, "method", ["amount"], channel, by_store)
        .groupBy("method", "order_id")
        .agg(F.sum("amount").alias("amount"))
        .groupBy("method")
        .agg(F.count("*").alias("orders"), F.sum("amount").alias("total"))
        .orderBy(F.desc("total"), "method")
    )
