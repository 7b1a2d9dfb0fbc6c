"""Every product as ``(spark, folder) -> DataFrame`` over the star schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.setting import AS_OF, BIRTHDAY_RUN, CUSTOMER, EVE, LEAP_EVE, LONG, MID_MONTH, STORES, YEAR
from clientela import constants as K
from clientela.functions.contact import first_name, phone_digits, whatsapp_number
from clientela.functions.numbers import format_brl, format_count
from clientela.operators.durable import durable, session_folder
from clientela.operators.ledger import AS_NOT_IN, DROP, KEEP, Ledger
from clientela.operators.ntile import add_tiles
from clientela.params import ONLINE, PHYSICAL, SEGMENTS_NARROW_FIRST, Bounds, Channel, Period
from clientela.plans import birthdays, campaigns, channels, customers, overview, retention, rfm
from clientela.plans.campaigns import with_headings
from clientela.sources.coercion import coerce_numeric
from clientela.sources.layout import layout_ledger, write_layout
from clientela.sources.sinks import read_outbox, segment_file_name, write_csv, write_outbox
from clientela.sources.star import star_ledger
from clientela.sources.tables import duplicate_customers, one_row_each, parquet_ledger

Query = Callable[[SparkSession, str], DataFrame]
SOUTH = Channel(store_fragment="south")


@lru_cache(maxsize=None)
def ledger(spark: SparkSession, folder: str, discount: bool = False) -> Ledger:
    return star_ledger(spark, folder, discount)


def plain(df: DataFrame) -> DataFrame:
    """Doubles for decimals, bigints for ints and text for days and lists, the same in both engines."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _on(product: Callable[[Ledger], DataFrame], discount: bool = False) -> Query:
    return lambda spark, folder: plain(product(ledger(spark, folder, discount)))


def _scores(book: Ledger) -> DataFrame:
    return rfm.rfm_scores(book, AS_OF, ordered=False)


def _scored(book: Ledger) -> DataFrame:
    return rfm.scored_customers(book, AS_OF)


def _base(book: Ledger) -> DataFrame:
    return customers.customer_base(book, YEAR, AS_OF, ordered=False)


def _born(book: Ledger) -> DataFrame:
    return birthdays.birthdays_of_month(book, AS_OF.month, AS_OF, ordered=False)


def _campaign(book: Ledger, objective: str, name: str = "") -> DataFrame:
    chosen = campaigns.campaign_list(book, objective, AS_OF)
    return campaigns.campaign_enrich(chosen, name, objective, AS_OF)


def _custom(objective: str, channel: Channel | None = None, bounds: Bounds = Bounds()) -> Query:
    return _on(lambda b: campaigns.campaign_list(b, objective, AS_OF, bounds, channel))


def _by_store(anonymous: str, period: Period | None = None) -> Query:
    """What is left of the invoiced sales under one reading of the own-shop exclusion."""
    return _on(
        lambda b: b.orders(period, anonymous=anonymous)
        .groupBy("store")
        .agg(
            F.count("*").alias("sales"),
            F.count("customer_id").alias("identified"),
            F.sum("order_total").alias("revenue"),
        )
    )


def _distributed_tiles(book: Ledger) -> DataFrame:
    """Tiles of customers by number of sales of any status."""
    counts = book.sales.filter("customer_id is not null").groupBy("customer_id").count()
    key = [F.col("count"), F.col("customer_id")]
    tiled = add_tiles(durable(counts), {"tile": key}, 7)
    return tiled.select("customer_id", F.col("count").alias("sales"), "tile")


def _presets(book: Ledger) -> DataFrame:
    """Sales of each named period, all counted in one pass."""
    day = F.col("day")
    counted = book.orders(anonymous=KEEP).agg(
        *(F.count_if(Period.preset(p, AS_OF).contains(day)).alias(p) for p in K.PERIOD_PRESETS)
    )
    return counted.unpivot([], list(K.PERIOD_PRESETS), "preset", "sales")


def _narrow_first(book: Ledger) -> DataFrame:
    """Scores under the order of segments in which the narrower of two comes first."""
    rules = replace(book.rules, segments=SEGMENTS_NARROW_FIRST)
    other = Ledger(book.customers, book.sales, book.items, book.payments, rules)
    return rfm.rfm_scores(other, AS_OF, ordered=False)


def _folder(book: Ledger) -> str:
    """A new folder beside the other intermediate tables."""
    return f"{session_folder(book.sales.sparkSession)}/{uuid.uuid4().hex}"


def _warehouse(book: Ledger) -> DataFrame:
    """Tables written under the warehouse's names and columns, and read back as a ledger."""
    folder = _folder(book)
    for name, df in (("customers", book.customers), ("sales", book.sales), ("items", book.items), ("payments", book.payments)):
        names = {ours: theirs for theirs, ours in K.WAREHOUSE_COLUMNS[name].items()}
        df.select(*(F.col(c).alias(names[c]) for c in df.columns if c in names)).write.parquet(f"{folder}/{K.WAREHOUSE_TABLES[name]}")
    again = parquet_ledger(book.sales.sparkSession, folder)
    counted = [
        df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct("customer_id").alias("ids"))
        for name, df in (("customers", again.customers), ("sales", again.sales))
    ]
    return counted[0].union(counted[1])


def _csv_list(book: Ledger) -> DataFrame:
    """A list written as CSV under its name, and read back."""
    path = f"{_folder(book)}/{segment_file_name('Champions')}"
    members = rfm.segment_members(_scores(book), "Champions").select("full_name", "email", "whatsapp", "frequency")
    write_csv(members, path)
    reader = members.sparkSession.read.schema(members.schema)
    return reader.option("header", True).option("escape", '"').csv(path)


def _outbox_written(book: Ledger) -> DataFrame:
    """Messages written twice, as by a rerun, and read back."""
    path = _folder(book)
    for _ in range(2):
        write_outbox(birthdays.birthday_outbox(book, BIRTHDAY_RUN), path, BIRTHDAY_RUN)
    return read_outbox(book.sales.sparkSession, path)


def _with_stores(book: Ledger) -> Ledger:
    """Lines that carry a store, by rules of their own, or none."""

    def store(number) -> Column:
        return F.when(number == 1, "Online").when(number == 2, "Store North").when(number == 3, "Store South")

    items = book.items.withColumn("store", store(F.col("quantity") % 4))
    payments = book.payments.withColumn("store", store(F.dayofmonth("order_ts") % 4))
    return Ledger(book.customers, book.sales, items, payments, book.rules, book.broadcast_rows)


def _copied_customers(book: Ledger) -> DataFrame:
    """The customer table with copies that are as full, less full or fuller, and one id that very many rows share."""
    key, people = F.col("customer_id"), book.customers
    gaps = people.filter(key % 2 == 0).withColumns({"email": F.lit(" "), "city": F.lit(None).cast("string")})
    later = people.filter(key % 3 == 0).withColumn("city", F.lit("ZZZ"))
    nobody = people.filter(key % 3 != 0).withColumn("customer_id", F.lit(-1).cast("long"))
    return people.unionByName(gaps).unionByName(later).unionByName(nobody)


def _one_row_each(book: Ledger) -> DataFrame:
    return one_row_each(_copied_customers(book))


def _card_of_copies(book: Ledger) -> DataFrame:
    """The card of a customer with copies, who has one row now."""
    single = Ledger(one_row_each(_copied_customers(book)), book.sales, rules=book.rules, broadcast_rows=book.broadcast_rows)
    return customers.customer_card_of(single, CUSTOMER, LONG, AS_OF)


def _laid_out(book: Ledger, by: str, customer_folders: int) -> Ledger:
    """Tables written into folders by day and customer, and read back."""
    path = _folder(book)
    write_layout(Ledger(book.customers, book.sales), path, by, customer_folders)
    return layout_ledger(book.sales.sparkSession, path, rules=book.rules, broadcast_rows=book.broadcast_rows)


def _contacts(book: Ledger) -> DataFrame:
    area, phone = F.col("area_code"), F.col("phone")
    return book.customers.select(
        "customer_id",
        whatsapp_number(area, phone).alias("whatsapp"),
        phone_digits(area, phone).alias("phone_digits"),
        first_name(F.col("full_name")).alias("first_name"),
    )


def _formatted_sales(book: Ledger) -> DataFrame:
    return book.sales.select(
        "order_id",
        format_brl(F.col("order_total")).alias("total_text"),
        format_count(F.col("order_total")).alias("whole_text"),
    )


def _coerced(book: Ledger) -> DataFrame:
    """``order_id`` is all digits and becomes a number, ``store`` stays text."""
    ids = coerce_numeric(book.sales.select("order_id", "store"))
    return ids.groupBy("store").agg(
        F.sum("order_id").alias("id_sum"), F.max("order_id").alias("id_max")
    )


QUERIES: dict[str, Query] = {
    "overview_kpis": _on(lambda b: overview.overview_kpis(b, YEAR), discount=True),
    "overview_kpis_online": _on(lambda b: overview.overview_kpis(b, YEAR, ONLINE), discount=True),
    "overview_kpis_store": _on(lambda b: overview.overview_kpis(b, YEAR, SOUTH), discount=True),
    "new_vs_returning": _on(lambda b: overview.new_vs_returning(b, YEAR)),
    "new_vs_returning_online": _on(lambda b: overview.new_vs_returning(b, MID_MONTH, ONLINE)),
    "new_vs_returning_shares": _on(lambda b: overview.new_vs_returning_shares(b, MID_MONTH)),
    "monthly_revenue_by_store": _on(lambda b: overview.monthly_revenue_by_store(b, YEAR)),
    "channel_share": _on(lambda b: overview.channel_share(b, YEAR)),
    "top_categories": _on(lambda b: overview.top_categories(b, YEAR)),
    "new_customers_by_month": _on(lambda b: overview.new_customers_by_month(b, LONG)),
    "payment_mix": _on(lambda b: overview.payment_mix(b, YEAR)),
    "rfm_scores": _on(lambda b: rfm.rfm_scores(b, AS_OF)),
    "rfm_scores_online": _on(lambda b: rfm.rfm_scores(b, AS_OF, ONLINE)),
    "rfm_segment_summary": _on(lambda b: rfm.rfm_segment_summary(_scored(b))),
    "rfm_headline": _on(lambda b: rfm.rfm_headline(_scored(b))),
    "rfm_sample": _on(lambda b: rfm.rfm_sample(_scored(b), b, n=500, seed=3)),
    "segment_members": _on(lambda b: rfm.segment_members(_scores(b), "At Risk")),
    "segment_members_headings": _on(
        lambda b: with_headings(rfm.segment_members(_scores(b), "Champions"), K.SEGMENT_HEADINGS)
    ),
    "segment_names": _on(lambda b: rfm.segment_names(_scored(b))),
    "cohort_retention": _on(lambda b: retention.cohort_retention(b, MID_MONTH)),
    "cohort_retention_long": _on(lambda b: retention.cohort_retention(b, LONG)),
    "cohort_matrix": _on(
        lambda b: retention.cohort_matrix(retention.cohort_retention(b, YEAR), YEAR)
    ),
    "period_buyers_new_vs_returning": _on(
        lambda b: retention.period_buyers_new_vs_returning(b, YEAR)
    ),
    "period_buyers_shares": _on(lambda b: retention.period_buyers_shares(b, MID_MONTH)),
    "new_vs_returning_by_store": _on(lambda b: retention.new_vs_returning_by_store(b, YEAR)),
    "new_vs_returning_by_store_long": _on(
        lambda b: retention.new_vs_returning_by_store_long(
            retention.new_vs_returning_by_store(b, YEAR)
        )
    ),
    "repurchase_interval": _on(lambda b: retention.repurchase_interval(b, LONG)),
    "channel_kpis": _on(lambda b: channels.channel_kpis(b, YEAR), discount=True),
    "channel_monthly": _on(lambda b: channels.channel_monthly(b, YEAR)),
    "omnichannel_profile": _on(lambda b: channels.omnichannel_profile(b, YEAR)),
    "omnichannel_share": _on(
        lambda b: channels.omnichannel_share(channels.omnichannel_profile(b, LONG))
    ),
    "channel_journey": _on(lambda b: channels.channel_journey(b, LONG)),
    "journey_matrix": _on(
        lambda b: channels.journey_matrix(channels.channel_journey(b, YEAR), STORES[:2])
    ),
    "journey_share": _on(lambda b: channels.journey_share(channels.channel_journey(b, YEAR))),
    "customer_base": _on(lambda b: customers.customer_base(b, YEAR, AS_OF)),
    "customer_base_headings": _on(lambda b: with_headings(_base(b), K.BASE_HEADINGS)),
    "customer_search": _on(
        lambda b: customers.customer_search(
            _base(b),
            name="customer#0*[1-9]*[24]",
            email="@EXAMPLE",
            phone="9100",
            stores=["Online", "South"],
            min_orders=2,
            only_phone=True,
            order_by="full_name",
            store_parts=True,
        )
    ),
    "available_channels": _on(lambda b: customers.available_channels(_base(b))),
    "base_kpis": _on(lambda b: customers.base_kpis(_base(b))),
    "customer_picker": _on(lambda b: customers.customer_picker(_base(b))),
    "customer_card": _on(
        lambda b: customers.customer_card(customers.customer_base(b, LONG, AS_OF, False), CUSTOMER)
    ),
    "order_history": _on(lambda b: customers.order_history(b, CUSTOMER)),
    "campaign_custom": _custom(K.CUSTOM, PHYSICAL, Bounds(max_orders=12, max_spend=3_000_000)),
    "campaign_reactivation": _custom(K.REACTIVATION),
    "campaign_repurchase": _custom(K.REPURCHASE),
    "campaign_vip": _custom(K.VIP, ONLINE),
    "campaign_birthdays": _on(lambda b: campaigns.campaign_birthdays(b, AS_OF)),
    "campaign_rfm": _on(lambda b: campaigns.campaign_rfm(b, "Loyal Customers", AS_OF)),
    "campaign_enrich": _on(lambda b: _campaign(b, K.VIP, "  Volta às aulas ")),
    "campaign_metrics": _on(
        lambda b: campaigns.campaign_metrics(_campaign(b, K.REACTIVATION))
    ),
    "campaign_columns": _on(
        lambda b: campaigns.campaign_columns(_campaign(b, K.MONTH_BIRTHDAYS))
    ),
    "birthdays_of_month": _on(lambda b: birthdays.birthdays_of_month(b, 8, AS_OF)),
    "birthdays_of_month_all": _on(
        lambda b: birthdays.birthdays_of_month(
            b, 2, AS_OF, ONLINE, only_buyers=False, only_phone=False
        )
    ),
    "birthdays_headings": _on(lambda b: with_headings(_born(b), K.BIRTHDAY_HEADINGS)),
    "birthday_metrics": _on(lambda b: birthdays.birthday_metrics(_born(b), AS_OF)),
    "birthday_histogram": _on(lambda b: birthdays.birthday_histogram(_born(b))),
    "birthday_outbox": _on(lambda b: birthdays.birthday_outbox(b, BIRTHDAY_RUN)),
    "birthday_outbox_next_year": _on(lambda b: birthdays.birthday_outbox(b, EVE)),
    "own_shops_dropped": _by_store(DROP),
    "own_shops_anonymous_kept": _by_store(KEEP),
    "own_shops_as_not_in": _by_store(AS_NOT_IN),
    "distributed_ntile": _on(_distributed_tiles),
    "sales_by_period_preset": _on(_presets),
    "contacts": _on(_contacts),
    "formatted_sales": _on(_formatted_sales),
    "coerce_numeric": _on(_coerced),
    "rfm_scores_ten_tiles": _on(lambda b: rfm.rfm_scores(b, AS_OF, tiles=10, ordered=False)),
    "rfm_scores_narrow_segments_first": _on(_narrow_first),
    "warehouse_tables": _on(_warehouse, discount=True),
    "csv_list": _on(_csv_list),
    "outbox_written": _on(_outbox_written),
    "period_custom": _by_store(KEEP, Period.custom(AS_OF)),
    "customer_search_literal": _on(
        lambda b: customers.customer_search(
            _base(b), name="CUSTOMER#0", email="@example", phone="91", order_by="idle_days", literal=True
        )
    ),
    "repurchase_interval_same_store": _on(lambda b: retention.repurchase_interval(b, LONG, same_store=True)),
    "period_buyers_per_customer": _on(
        lambda b: retention.period_buyers_new_vs_returning(b, YEAR, per="customer")
    ),
    "new_customers_by_part_month": _on(
        lambda b: overview.new_customers_by_month(b, MID_MONTH, full_months=False)
    ),
    "birthday_outbox_leap_births": _on(
        lambda b: birthdays.birthday_outbox(b, LEAP_EVE, leap_births_on_28=True)
    ),
    "duplicate_customers": _on(lambda b: duplicate_customers(b.sales)),
    "customer_search_stores": _on(
        lambda b: customers.customer_search(_base(b), stores=["Store S", "Store North"], min_orders=2, order_by="orders")
    ),
    "top_categories_by_store": _on(lambda b: overview.top_categories(_with_stores(b), YEAR, by_store=True)),
    "payment_mix_by_store": _on(lambda b: overview.payment_mix(_with_stores(b), YEAR, by_store=True)),
    "payment_mix_online": _on(lambda b: overview.payment_mix(b, YEAR, ONLINE)),
    "one_row_each": _on(_one_row_each),
    "customer_card_of_copies": _on(_card_of_copies),
    "layout_by_month": _on(lambda b: overview.monthly_revenue_by_store(_laid_out(b, "month", 0), MID_MONTH)),
    "layout_birthdays": _on(lambda b: birthdays.birthdays_of_month(_laid_out(b, "month", 4), 8, AS_OF, ordered=False)),
}
