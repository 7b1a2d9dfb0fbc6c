"""Campaign lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela import constants as K
from clientela.functions.contact import first_name, whatsapp_number
from clientela.functions.numbers import mean
from clientela.operators.ledger import FIGURES, Ledger
from clientela.operators.rollup import customer_rollup
from clientela.params import Bounds, Channel
from clientela.plans.rfm import scored_customers

_PROFILE = [
    "customer_id",
    "full_name",
    "email",
    "area_code",
    "phone",
    "birth_date",
    "city",
    "state",
]


def campaign_custom(
    ledger: Ledger,
    as_of: date,
    bounds: Bounds = Bounds(),
    channel: Channel | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Customers within the bounds on idle days, orders and spend, biggest spenders first."""
    chosen = customer_rollup(ledger.orders(channel=channel), as_of).filter(bounds.predicate())
    listed = ledger.with_contacts(chosen, ledger.customers).select(
        *_PROFILE, "orders", "spend", "mean_row_value", "last_purchase", "idle_days", "stores"
    )
    return listed.orderBy(F.desc("spend"), "customer_id") if ordered else listed


def campaign_birthdays(
    ledger: Ledger, as_of: date, channel: Channel | None = None, ordered: bool = True
) -> DataFrame:
    """Buyers with a birthday in the month of ``as_of``, by day; bounds do not apply."""
    born = ledger.customers.filter(F.month("birth_date") == as_of.month)
    orders = ledger.orders_of(born.select("customer_id"), channel=channel)
    listed = ledger.with_contacts(customer_rollup(orders, as_of), born).select(
        *_PROFILE, "orders", "spend", "mean_row_value", "last_purchase", "stores"
    )
    return listed.orderBy(F.dayofmonth("birth_date"), "customer_id") if ordered else listed


def campaign_rfm(
    ledger: Ledger,
    segment: str,
    as_of: date,
    channel: Channel | None = None,
    ordered: bool = True,
) -> DataFrame:
    """One segment with contact data; the mean is per sale, not per order as in the scores."""
    members = scored_customers(ledger, as_of, channel).filter(F.col("segment") == segment)
    listed = ledger.with_contacts(members, ledger.customers, FIGURES).select(
        *_PROFILE,
        F.col("frequency").alias("orders"),
        F.col("value").alias("spend"),
        mean(F.col("value"), F.col("priced_rows")).alias("mean_row_value"),
        F.col("recency_days").alias("idle_days"),
        "segment",
    )
    return listed.orderBy(F.desc("spend"), "customer_id") if ordered else listed


def campaign_list(
    ledger: Ledger,
    objective: str,
    as_of: date,
    bounds: Bounds = Bounds(),
    channel: Channel | None = None,
    segment: str | None = None,
) -> DataFrame:
    """The list an objective asks for."""
    if objective == K.MONTH_BIRTHDAYS:
        return campaign_birthdays(ledger, as_of, channel)
    if objective == K.RFM_SEGMENT:
        return campaign_rfm(ledger, segment, as_of, channel)
    return campaign_custom(ledger, as_of, bounds.for_objective(objective), channel)


def campaign_tag(name: str, objective: str) -> str:
    return name.strip() or objective


def campaign_enrich(campaign: DataFrame, name: str, objective: str, as_of: date) -> DataFrame:
    """Phone number, first name and the tag that tells campaigns apart later."""
    tag = f"{campaign_tag(name, objective)} — {as_of:%d/%m/%Y}"
    return campaign.withColumns(
        {
            "whatsapp": whatsapp_number(F.col("area_code"), F.col("phone")),
            "first_name": first_name(F.col("full_name")),
            "campaign": F.lit(tag),
        }
    )


def campaign_metrics(enriched: DataFrame) -> DataFrame:
    """Size of the list, how many can be reached by phone, mean spend."""
    return enriched.agg(
        F.count("*").alias("customers"),
        F.count_if(F.col("whatsapp") != "").alias("with_whatsapp"),
        mean(F.sum("spend"), F.count("spend")).alias("mean_ltv"),
    )


def campaign_columns(enriched: DataFrame) -> DataFrame:
    """The list as exported: columns it has, in order, under their headings."""
    return with_headings(enriched, K.CAMPAIGN_HEADINGS)


def with_headings(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    """Project onto the columns that have a heading and are present, renamed."""
    present = set(df.columns)
    return df.select(*(F.col(c).alias(h) for c, h in headings.items() if c in present))
