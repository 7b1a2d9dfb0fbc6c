"""Ledger over an order / line item star schema.

The star has no stores, phones, birthdays or own shops; they are derived from its keys by fixed
rules, so that the products can be tried on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.operators.ledger import Ledger
from clientela.params import Rules

STAR_RULES = Rules(
    own_shop_patterns=("%07",),
    category_prefixes=(("small", "Small"), ("red", "Red")),
)


def star_ledger(
    spark: SparkSession, folder: str, discount: bool = False, **options
) -> Ledger:
    """``discount`` adds the discount of each order, which has to be added up from its lines."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    return Ledger(
        customers=_customers(table("customer"), table("nation"), table("region")),
        sales=_sales(table("orders"), table("lineitem") if discount else None),
        items=_items(table("lineitem"), table("part")),
        payments=_payments(table("lineitem")),
        rules=STAR_RULES,
        **options,
    )


def _money(name: str):
    return F.col(name).cast("decimal(12,2)")


def _sales(orders: DataFrame, lineitem: DataFrame | None) -> DataFrame:
    online = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    key = F.col("o_orderkey")
    columns = [
        F.when(key % 20 != 0, F.col("o_custkey")).alias("customer_id"),
        key.cast("string").alias("order_id"),
        key.alias("order_number"),
        F.when(online, "Online")
        .when(F.col("o_orderpriority") == "5-LOW", "Store South")
        .otherwise("Store North")
        .alias("store"),
        F.when(online, "ECOM").otherwise("ERP").alias("source_system"),
        F.col("o_orderdate").alias("order_ts"),
        F.when(F.col("o_orderstatus") == "F", "Faturado")
        .when(F.col("o_orderstatus") == "O", "Aberto")
        .alias("status"),
        _money("o_totalprice").alias("order_total"),
    ]
    if lineitem is None:
        return orders.select(*columns)
    given = _money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")
    per_order = lineitem.groupBy("l_orderkey").agg(F.sum(given).alias("discount"))
    return orders.join(per_order, F.col("l_orderkey") == key, "left").select(*columns, "discount")


def _customers(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    area = (key % 80 + 11).cast("string")
    digits = (key + 10_000_000).cast("string")
    return (
        customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(
            key.alias("customer_id"),
            F.col("c_name").alias("full_name"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias(
                "email"
            ),
            F.when(key % 11 == 0, None)
            .when(key % 3 == 0, F.concat(F.lit("("), area, F.lit(")")))
            .otherwise(area)
            .alias("area_code"),
            F.when(key % 7 == 0, "n/d")
            .otherwise(
                F.concat(
                    F.lit("9"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 4)
                )
            )
            .alias("phone"),
            F.when(
                key % 13 != 0,
                F.date_add(F.lit("1950-01-01").cast("date"), (key * 7919 % 20000).cast("int")),
            ).alias("birth_date"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("state"),
        )
    )


def _items(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    return lineitem.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.when(F.col("p_partkey") % 50 != 0, F.col("p_name")).alias("category"),
        _money("l_extendedprice").alias("line_total"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_shipdate").alias("order_ts"),
    )


def _payments(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_returnflag").alias("method"),
        F.when(F.col("l_linestatus") == "F", "PAID").alias("status"),
        _money("l_extendedprice").alias("amount"),
        F.col("l_shipdate").alias("order_ts"),
    )
