"""Birthdays: monthly list and daily outbox."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela import constants as K
from clientela.functions.contact import delivery_channel, first_name, whatsapp_number
from clientela.operators.ledger import BOTH, CONTACTS, Ledger
from clientela.operators.rollup import customer_rollup
from clientela.params import Channel


def birthdays_of_month(
    ledger: Ledger,
    month: int,
    as_of: date,
    channel: Channel | None = None,
    only_buyers: bool = True,
    only_phone: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """Customers born in the month with their figures, by day."""
    born = ledger.customers.filter(F.month("birth_date") == month).withColumns(
        {
            "birth_day": F.dayofmonth("birth_date"),
            "whatsapp": whatsapp_number(F.col("area_code"), F.col("phone")),
            "first_name": first_name(F.col("full_name")),
        }
    )
    if only_phone:
        born = born.filter(F.col("whatsapp") != "")
    orders = ledger.orders_of(born.select("customer_id"), channel=channel)
    figures = customer_rollup(orders, as_of, latest_system=True)
    listed = ledger.with_contacts(figures, born, BOTH if only_buyers else CONTACTS).select(
        "customer_id",
        "full_name",
        "email",
        "birth_date",
        "city",
        "birth_day",
        "orders",
        "spend",
        "last_purchase",
        "idle_days",
        "stores",
        "latest_system",
        "whatsapp",
        "first_name",
    )
    return listed.orderBy("birth_day", "customer_id") if ordered else listed


def birthday_metrics(birthdays: DataFrame, as_of: date) -> DataFrame:
    """Size of the list, birthdays today by month and day, how many can be reached by phone."""
    return birthdays.agg(
        F.count("*").alias("customers"),
        F.count_if((F.col("birth_day") == as_of.day) & (F.month("birth_date") == as_of.month)).alias("today"),
        F.count_if(F.col("whatsapp") != "").alias("with_whatsapp"),
    )


def birthday_histogram(birthdays: DataFrame) -> DataFrame:
    return birthdays.groupBy("birth_day").agg(F.count("*").alias("customers")).orderBy("birth_day")


def birthday_outbox(
    ledger: Ledger, as_of: date, lead_days: int = K.LEAD_DAYS, leap_births_on_28: bool = False
) -> DataFrame:
    """Messages due on ``as_of``: buyers with a phone whose birthday is ``lead_days`` ahead.

    The latest system is found on one row per customer and system, so no sale-sized sort runs.
    Births on 29 February come up in leap years only, or else with ``leap_births_on_28`` on the 28th.
    """
    target = as_of + timedelta(days=lead_days)
    days = [target.day]
    if leap_births_on_28 and (target + timedelta(days=1)).strftime("%m%d") == "0301" and target.day == 28:
        days.append(29)
    born = ledger.customers.filter(
        (F.month("birth_date") == target.month) & F.dayofmonth("birth_date").isin(days)
    ).select(
        "customer_id",
        "full_name",
        first_name(F.col("full_name")).alias("first_name"),
        whatsapp_number(F.col("area_code"), F.col("phone")).alias("whatsapp"),
    )
    born = born.filter(F.col("whatsapp") != "")
    latest = (
        ledger.orders_of(born.select("customer_id"))
        .groupBy("customer_id", "source_system")
        .agg(F.max("order_ts").alias("latest"))
        .groupBy("customer_id")
        .agg(F.max(F.struct("latest", "source_system")).alias("latest"))
        .select("customer_id", delivery_channel(F.col("latest.source_system")).alias("channel"))
    )
    payload = F.to_json(
        F.struct(
            F.col("whatsapp").alias("phone"),
            F.array("first_name").alias("variables"),
            F.col("channel").alias("canal"),
        )
    )
    return ledger.with_contacts(latest, born).select(
        F.lit(as_of).alias("run_date"),
        "customer_id",
        "full_name",
        "first_name",
        "whatsapp",
        "channel",
        payload.alias("payload"),
    )
