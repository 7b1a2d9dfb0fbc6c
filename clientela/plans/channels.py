"""Channels: figures per store, omnichannel profiles, journeys from first to last store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientela import constants as K
from clientela.functions.numbers import format_share, percent
from clientela.operators.ledger import KEEP, Ledger
from clientela.operators.rollup import distinct_orders, sales_figures
from clientela.params import Period


def channel_kpis(ledger: Ledger, period: Period) -> DataFrame:
    """Figures per store and source system, anonymous sales included, by revenue."""
    figures = sales_figures(ledger.orders(period, anonymous=KEEP), "store", "source_system")
    return figures.orderBy(F.desc("revenue"), "store", "source_system")


def channel_monthly(ledger: Ledger, period: Period) -> DataFrame:
    """Revenue and orders per month and store, anonymous sales left out."""
    return (
        ledger.orders(period)
        .groupBy(F.trunc("day", "MM").alias("month"), "store")
        .agg(F.sum("order_total").alias("revenue"), distinct_orders().alias("orders"))
        .orderBy("month", "store")
    )


def omnichannel_profile(ledger: Ledger, period: Period) -> DataFrame:
    """Customers who bought in several systems, in several stores, or in one store, by that store."""
    several_systems = F.min("source_system") < F.max("source_system")
    several_stores = F.min("store") < F.max("store")
    return (
        ledger.orders(period)
        .select("customer_id", "store", "source_system")
        .distinct()
        .groupBy("customer_id")
        .agg(
            F.when(several_systems, K.OMNICHANNEL_LABEL)
            .when(several_stores, K.MULTI_STORE_LABEL)
            .otherwise(F.min("store"))
            .alias("profile")
        )
        .groupBy("profile")
        .agg(F.count("*").alias("customers"))
        .orderBy(F.desc("customers"), "profile")
    )


def omnichannel_share(profiles: DataFrame) -> DataFrame:
    """Customers of more than one channel, and their share of all."""
    several = F.coalesce(F.col("profile").rlike("Omnichannel|Multi"), F.lit(False))
    return profiles.agg(
        F.coalesce(F.sum(F.when(several, F.col("customers"))), F.lit(0)).alias("omnichannel"),
        F.sum("customers").alias("customers"),
    ).withColumn("share", percent(F.col("omnichannel"), F.col("customers")))


def channel_journey(ledger: Ledger, period: Period) -> DataFrame:
    """Customers by store of their first and of their last purchase.

    Of several stores at the same moment the first by name opens and the last by name closes
    the journey.
    """
    return (
        ledger.orders(period)
        .groupBy("customer_id", "store")
        .agg(F.min("order_ts").alias("opened"), F.max("order_ts").alias("closed"))
        .groupBy("customer_id")
        .agg(
            F.min(F.struct("opened", "store")).getField("store").alias("origin"),
            F.max(F.struct("closed", "store")).getField("store").alias("destination"),
        )
        .filter(F.col("origin").isNotNull() & F.col("destination").isNotNull())
        .groupBy("origin", "destination")
        .agg(F.count("*").alias("customers"))
        .orderBy(F.desc("customers"), "origin", "destination")
    )


def journey_matrix(journey: DataFrame, stores: list[str] | None = None) -> DataFrame:
    """Origin by destination, 0 where nobody went that way.

    Without ``stores`` Spark reads the destinations off the journeys first; with them, all other
    destinations share one more column.
    """
    columns = stores
    if stores is not None:
        columns = [*stores, K.OTHER_STORES]
        listed = F.when(F.col("destination").isin(stores), F.col("destination"))
        journey = journey.withColumn("destination", F.coalesce(listed, F.lit(K.OTHER_STORES)))
    matrix = journey.groupBy("origin").pivot("destination", columns).agg(F.sum("customers"))
    return matrix.na.fill(0).orderBy("origin")


def journey_share(journey: DataFrame) -> DataFrame:
    """Journeys with their share of all customers as text."""
    everyone = Window.partitionBy()  # one row per pair of stores
    share = F.col("customers") / F.sum("customers").over(everyone) * 100
    return journey.withColumn("share", format_share(share))
