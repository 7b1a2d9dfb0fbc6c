"""Per-customer figures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela import constants as K
from clientela.functions.numbers import mean


def distinct_orders() -> Column:
    """Number of orders: an order id counts once per store, rows missing either part do not count."""
    return F.count_distinct("order_id", "store")


def sales_figures(orders: DataFrame, *keys: str) -> DataFrame:
    """Customers, orders, revenue, mean row and discount of all sales, or for each value of ``keys``.

    Customers and orders are counted in a branch each, reduced before it is shuffled, and the two meet
    as one row for each key; counting both sets at once would shuffle every sale three times over.
    """
    sums = {"revenue": "order_total", "discount": "discount"}
    per_customer = orders.groupBy(*keys, "customer_id").agg(
        *(F.sum(c).alias(n) for n, c in sums.items()), F.count("order_total").alias("priced_rows")
    )
    customers = per_customer.groupBy(*keys).agg(
        F.count("customer_id").alias("customers"), *(F.sum(n).alias(n) for n in (*sums, "priced_rows"))
    )
    pairs = orders.filter("order_id IS NOT NULL AND store IS NOT NULL")
    parts = list(dict.fromkeys((*keys, "order_id", "store")))
    per_order = pairs.select(*parts).distinct().groupBy(*keys).agg(F.count("*").alias("orders"))
    both = customers.unionByName(per_order, allowMissingColumns=True)
    counted = both.groupBy(*keys).agg(
        *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("customers", "orders")), *(F.sum(n).alias(n) for n in (*sums, "priced_rows"))
    )
    return counted.select(*keys, "customers", "orders", "revenue", mean(F.col("revenue"), F.col("priced_rows")).alias("mean_row_value"), "discount")


def customer_rollup(orders: DataFrame, as_of: date, latest_system: bool = False) -> DataFrame:
    """Orders, spend, mean row, first and last purchase, idle days and stores of each customer.

    Three levels: per order, per store, per customer. A customer with a huge share of all sales
    is spread by order id first and reaches the last level as one row per store; no level needs
    to keep a set of order ids.
    With ``latest_system`` also the source system of the latest sale; of several at the same
    moment the last by name.
    """
    figures = [
        F.sum("order_total").alias("spend"),
        F.count("order_total").alias("priced_rows"),
        F.min("day").alias("first_purchase"),
        F.max("day").alias("last_purchase"),
    ]
    merged = [
        F.sum("spend").alias("spend"),
        F.sum("priced_rows").alias("priced_rows"),
        F.min("first_purchase").alias("first_purchase"),
        F.max("last_purchase").alias("last_purchase"),
    ]
    keys = ["customer_id", "store", "order_id"]
    if latest_system:  # one more key keeps the aggregation of sales a plain maximum
        keys.append("source_system")
        figures.append(F.max("order_ts").alias("latest"))
    per_order = orders.groupBy(*keys).agg(*figures)
    if latest_system:
        merged.append(F.max(F.struct("latest", "source_system")).alias("latest"))
        per_order = per_order.groupBy("customer_id", "store", "order_id").agg(*merged)
        merged[-1] = F.max("latest").alias("latest")
    # a sale without order id or without store is no order
    is_order = F.col("order_id").isNotNull() & F.col("store").isNotNull()
    per_store = per_order.groupBy("customer_id", "store").agg(
        F.count_if(is_order).alias("orders"), *merged
    )
    per_customer = per_store.groupBy("customer_id").agg(
        F.sum("orders").alias("orders"),
        *merged,
        F.array_sort(F.collect_set("store")).alias("store_list"),
    )
    derived = {
        "mean_row_value": mean(F.col("spend"), F.col("priced_rows")),
        "idle_days": F.datediff(F.lit(as_of), F.col("last_purchase")),
        "stores": F.when(
            F.size("store_list") > 0, F.array_join("store_list", K.STORE_SEPARATOR)
        ),
    }
    if latest_system:
        derived["latest_system"] = F.col("latest.source_system")
    return per_customer.withColumns(derived).drop("latest")
