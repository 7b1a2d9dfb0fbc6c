"""The customer base: figures per customer, search, order history."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela import constants as K
from clientela.functions.contact import phone_digits, whatsapp_number
from clientela.functions.numbers import mean
from clientela.operators.layout import of_customer
from clientela.operators.ledger import Ledger
from clientela.operators.rollup import customer_rollup
from clientela.params import Period


def customer_base(
    ledger: Ledger, period: Period, as_of: date, ordered: bool = True
) -> DataFrame:
    """Customers of the period with figures and profile, biggest spenders first.

    Only customers found in the master data; sales under an empty id are left out.
    """
    orders = ledger.orders(period).filter(F.col("customer_id").cast("string") != "")
    figures = customer_rollup(orders, as_of)
    base = ledger.with_contacts(figures, ledger.customers).select(
        "customer_id",
        "full_name",
        "email",
        phone_digits(F.col("area_code"), F.col("phone")).alias("phone_digits"),
        whatsapp_number(F.col("area_code"), F.col("phone")).alias("whatsapp"),
        "birth_date",
        "city",
        "state",
        "orders",
        "spend",
        "priced_rows",
        "mean_row_value",
        "last_purchase",
        "first_purchase",
        "idle_days",
        "stores",
        "store_list",
    )
    return base.orderBy(F.desc("spend"), "customer_id") if ordered else base


def _matches(text: str, pattern: str) -> Column:
    return F.coalesce(F.col(text).rlike(pattern), F.lit(False))


def customer_search(
    base: DataFrame,
    name: str | None = None,
    email: str | None = None,
    phone: str | None = None,
    stores: list[str] | None = None,
    min_orders: int = 1,
    only_phone: bool = False,
    order_by: str = "spend",
    literal: bool = False,
    store_parts: bool = False,
) -> DataFrame:
    """Narrow the base down. Name, e-mail and phone are regular expressions, or plain text to be
    contained if ``literal``; case matters in none of the first two. ``stores`` are names, one of which has to be
    among the customer's stores; with ``store_parts`` they match anywhere in the joined list instead. ``order_by`` is
    ``spend``, ``orders``, ``idle_days`` (all descending) or ``full_name``.
    """
    found = base.filter(F.col("orders") >= min_orders)
    for column, sought, cased in (("full_name", name, False), ("email", email, False), ("phone_digits", phone, True)):
        if sought and literal:
            text, part = (F.col(column), F.lit(sought)) if cased else (F.lower(column), F.lower(F.lit(sought)))
            found = found.filter(F.coalesce(F.contains(text, part), F.lit(False)))
        elif sought:
            found = found.filter(_matches(column, sought if cased else f"(?iu){sought}"))
    if stores and store_parts:
        found = found.filter(reduce(or_, (F.col("stores").contains(s) for s in stores)))
    elif stores:
        found = found.filter(F.arrays_overlap("store_list", F.array(*map(F.lit, stores))))
    if only_phone:
        found = found.filter(F.col("whatsapp") != "")
    ordering = {
        "spend": F.desc_nulls_last("spend"),
        "orders": F.desc_nulls_last("orders"),
        "idle_days": F.desc_nulls_last("idle_days"),
        "full_name": F.asc_nulls_last("full_name"),
    }[order_by]
    return found.orderBy(ordering, "customer_id")


def available_channels(base: DataFrame) -> DataFrame:
    """Store names that occur in the base, sorted."""
    names = base.select(F.explode("store_list").alias("store"))
    return names.select(F.trim("store").alias("store")).distinct().orderBy("store")


def base_kpis(base: DataFrame) -> DataFrame:
    """Number of customers, mean of their mean sale, mean idle days, all orders."""
    # means are added up as decimals: a sum of doubles would depend on the order of rows
    ticket = (F.col("spend") / F.nullif("priced_rows", F.lit(0))).cast("decimal(28,6)")
    return base.agg(
        F.count("*").alias("customers"),
        mean(F.sum(ticket), F.count(ticket)).alias("mean_ticket"),
        mean(F.sum("idle_days"), F.count("idle_days")).alias("mean_idle_days"),
        F.sum("orders").alias("orders"),
    )


def customer_picker(base: DataFrame) -> DataFrame:
    """Ids with the name to show for them."""
    return base.select("customer_id", F.coalesce("full_name", F.lit("")).alias("full_name"))


def customer_card(base: DataFrame, customer_id) -> DataFrame:
    """Profile and figures of one customer.

    One row, as ids are unique (or made so by :func:`~clientela.sources.tables.one_row_each`).
    """
    one = base.filter(F.col("customer_id") == F.lit(customer_id))
    return one.drop("phone_digits", "store_list", "priced_rows").limit(1)


def customer_card_of(ledger: Ledger, customer_id, period: Period, as_of: date) -> DataFrame:
    """:func:`customer_card` from the tables: only what can hold the customer is read of them."""
    return customer_card(customer_base(ledger.only(customer_id), period, as_of, ordered=False), customer_id)


def order_history(ledger: Ledger, customer_id, n: int = K.HISTORY_ROWS) -> DataFrame:
    """Latest sales of one customer: any status, any day, own shops too."""
    return (
        of_customer(ledger.sales, customer_id)
        .orderBy(F.desc("order_ts"), "order_id", "store")
        .limit(n)
        .select(
            F.to_date("order_ts").alias("day"), "store", "order_number", "status", "order_total"
        )
    )
