"""Recency, frequency, value: scores, segments and what is read off them."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela import constants as K
from clientela.functions.contact import whatsapp_number
from clientela.functions.labels import rfm_segment
from clientela.functions.numbers import mean, rounded_ratio
from clientela.operators.durable import durable
from clientela.operators.ledger import FIGURES, Ledger
from clientela.operators.ntile import add_tiles, descending
from clientela.operators.rollup import distinct_orders
from clientela.params import Channel


def scored_customers(
    ledger: Ledger,
    as_of: date,
    channel: Channel | None = None,
    tiles: int = K.TILES,
) -> DataFrame:
    """Metrics, tiles and segment per customer, without contact data.

    Enough for the summary, the headline and the segment names, which then need no join.
    Made once per ledger, day, channel and number of tiles: summary, headline, sample, list, export and
    campaign of a page all read one table. Ties between customers go by id.
    """
    key = ("scored customers", as_of, channel, tiles)
    return ledger.kept(key, lambda: _score(ledger, as_of, channel, tiles))


def _score(ledger: Ledger, as_of: date, channel: Channel | None, tiles: int) -> DataFrame:
    """Metrics are written once, since they are ranked three ways and read for every product."""
    metrics = (
        ledger.orders(channel=channel)
        .filter(F.col("order_total") > 0)
        .groupBy("customer_id")
        .agg(
            F.datediff(F.lit(as_of), F.max("day")).alias("recency_days"),
            distinct_orders().alias("frequency"),
            F.sum("order_total").alias("value"),
            F.count("order_total").alias("priced_rows"),
        )
    )
    tie = F.col("customer_id")
    tiled = add_tiles(
        durable(metrics),
        {
            "r": [*descending(F.col("recency_days")), tie],
            "f": [F.col("frequency"), tie],
            "m": [F.col("value"), tie],
        },
        tiles,
    )
    r, f, m = F.col("r"), F.col("f"), F.col("m")
    ticket_cents = rounded_ratio("cast(value * 100 as bigint)", "frequency").cast("decimal(20,0)")
    return tiled.withColumns(
        {
            "ticket_per_order": (ticket_cents * Decimal("0.01")).cast("decimal(20,2)"),
            "rfm_code": F.concat(*(c.cast("string") for c in (r, f, m))),
            "segment": rfm_segment(r, f, m, ledger.rules.segments),
        }
    )


def rfm_scores(
    ledger: Ledger,
    as_of: date,
    channel: Channel | None = None,
    tiles: int = K.TILES,
    ordered: bool = True,
) -> DataFrame:
    """Scores with contact data, best customers first. Customers without contact data stay."""
    scores = scored_customers(ledger, as_of, channel, tiles)
    contacts = ledger.customers.select(
        "customer_id", "full_name", "email", "area_code", "phone", "birth_date"
    )
    listed = ledger.with_contacts(scores, contacts, FIGURES).select(
        "customer_id",
        "recency_days",
        "frequency",
        "value",
        "ticket_per_order",
        "r",
        "f",
        "m",
        "rfm_code",
        "segment",
        "full_name",
        "email",
        "area_code",
        "phone",
        "birth_date",
    )
    return listed.orderBy(F.desc("value"), "customer_id") if ordered else listed


def rfm_segment_summary(rfm: DataFrame) -> DataFrame:
    """Customers, revenue and means per segment, by revenue."""
    ticket = F.col("ticket_per_order")
    return (
        rfm.groupBy("segment")
        .agg(
            F.count("customer_id").alias("customers"),
            F.sum("value").alias("revenue"),
            F.sum("frequency").alias("_orders"),
            F.sum(ticket).alias("_tickets"),
            F.count(ticket).alias("_with_ticket"),
        )
        .select(
            "segment",
            "customers",
            "revenue",
            mean(F.col("_orders"), F.col("customers")).alias("mean_frequency"),
            mean(F.col("_tickets"), F.col("_with_ticket")).alias("mean_ticket"),
            mean(F.col("revenue"), F.col("customers")).alias("mean_ltv"),
        )
        .orderBy(F.desc("revenue"), "segment")
    )


def rfm_headline(rfm: DataFrame) -> DataFrame:
    """All customers, Champions, and those in danger of leaving."""
    segment = F.col("segment")
    return rfm.agg(
        F.count("*").alias("customers"),
        F.count_if(segment == "Champions").alias("champions"),
        F.count_if(segment.isin(*K.SEGMENTS_IN_DANGER)).alias("at_risk"),
    )


def rfm_sample(scores: DataFrame, ledger: Ledger, n: int = K.SAMPLE_ROWS, seed: int = 0) -> DataFrame:
    """A random sample of exactly ``min(n, rows)`` scored customers, for plotting, with their names.

    Names are looked up for the drawn customers only.

    The random order is a digest of id and seed, so a retried task draws the same customers.
    """
    draw = F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(f":{seed}")))
    columns = ["customer_id", "full_name", "recency_days", "frequency", "value", "segment"]
    drawn = scores.select(*(c for c in columns if c != "full_name")).orderBy(draw, "customer_id").limit(n)
    names = ledger.customers.select("customer_id", "full_name")
    return ledger.with_contacts(drawn, names, FIGURES).select(*columns)


def segment_members(rfm: DataFrame, segment: str) -> DataFrame:
    """One segment with phone numbers, as exported."""
    return rfm.filter(F.col("segment") == segment).select(
        "full_name",
        "email",
        whatsapp_number(F.col("area_code"), F.col("phone")).alias("whatsapp"),
        "recency_days",
        "frequency",
        "value",
        "ticket_per_order",
        "segment",
    )


def segment_names(rfm: DataFrame) -> DataFrame:
    return rfm.select("segment").distinct().orderBy("segment")
