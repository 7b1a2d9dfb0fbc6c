"""What the plans must and must not hold."""

import re
from datetime import date, datetime
from decimal import Decimal

import pytest

from checks import queries
from checks.queries import QUERIES
from checks.setting import AS_OF, YEAR
from clientela.plans import birthdays, campaigns, channels, customers, overview, retention, rfm
from clientela.sources.star import star_ledger
from clientela.sources.tables import SCHEMAS, parquet_ledger
from tests.star import write_hot_star

SMALL = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    """The plan as it ran, after adaptive changes."""
    df.collect()
    return physical(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    """Ledger straight over Parquet, with nothing derived in between."""
    folder = tmp_path_factory.mktemp("plain")
    when = datetime(2000, 2, 1, 12)
    rows = {
        "customers": ("1", "Ana", "a@x", "62", "999", date(1990, 8, 8), "Goiânia", "GO"),
        "sales": ("1", "a", "1", "Norte", "ERP", when, "Faturado", Decimal("10.00"), None),
        "items": ("a", "Saia", Decimal("10.00"), 2, when),
        "payments": ("a", "Pix", Decimal("10.00"), "ok", when),
    }
    for table, row in rows.items():
        own = [("2", "M A Confecções", *row[2:])] if table == "customers" else []
        spark.createDataFrame([row, *own], SCHEMAS[table]).write.parquet(f"{folder}/{table}")
    return parquet_ledger(spark, str(folder), names={t: t for t in rows}, columns={})


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_nested_loops_and_no_python(spark, name):
    plan = physical(QUERIES[name](spark, SMALL))
    for unwanted in ("NestedLoop", "Cartesian", "Python", "Pandas", "Arrow"):
        assert unwanted not in plan


def scans(plan):
    """Per scan: columns read and filters pushed."""
    found = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan)
    return [(set(re.findall(r"(\w+):", schema)), pushed) for pushed, schema in found]


def sales_scan(df):
    plan = physical(df)
    (scan,) = [s for s in scans(full(df)) if "status" in s[0]]
    assert "Exchange" in plan
    return scan


def full(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    again = df.select("*")
    try:
        return physical(again)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_period_reaches_the_scan(plain):
    columns, pushed = sales_scan(overview.monthly_revenue_by_store(plain, YEAR))
    assert columns == {"customer_id", "store", "order_ts", "status", "order_total"}
    assert "GreaterThanOrEqual(order_ts,2000-01-01" in pushed
    assert "LessThan(order_ts,2001-01-01" in pushed


@pytest.mark.parametrize(
    "product,columns",
    [
        (lambda b: overview.new_vs_returning(b, YEAR), {"customer_id", "order_ts", "status"}),
        (lambda b: retention.cohort_retention(b, YEAR), {"customer_id", "order_ts", "status"}),
        (
            lambda b: channels.channel_journey(b, YEAR),
            {"customer_id", "store", "order_ts", "status"},
        ),
        (
            lambda b: birthdays.birthday_outbox(b, AS_OF),
            {"customer_id", "source_system", "order_ts", "status"},
        ),
    ],
)
def test_only_needed_columns_are_read(plain, product, columns):
    assert sales_scan(product(plain))[0] == columns


def test_one_customer_is_looked_up_in_the_scan(plain):
    (scan,) = scans(full(customers.order_history(plain, "1")))
    assert "EqualTo(customer_id,1)" in scan[1]
    assert "TakeOrderedAndProject" in physical(customers.order_history(plain, "1"))
    card = customers.customer_card(customers.customer_base(plain, YEAR, AS_OF, False), "1")
    assert "EqualTo(customer_id,1)" in sales_scan(card)[1]


def exchanges(df):
    return re.findall(r" Exchange (\w+)", physical(df))


@pytest.mark.parametrize(
    "product,count",
    [
        # per customer, then one row
        (lambda b: overview.new_vs_returning(b, YEAR), 2),
        # per customer, per pattern of months, per cohort and age, cohort size, order of the report
        (lambda b: retention.cohort_retention(b, YEAR), 5),
        # per customer and store, per customer, one row
        (lambda b: retention.period_buyers_new_vs_returning(b, YEAR), 3),
        # per customer, day and store, per customer, per store, order of the report
        (lambda b: retention.repurchase_interval(b, YEAR), 4),
        # per customer and store, per customer, per journey, order of the report
        (lambda b: channels.channel_journey(b, YEAR), 4),
    ],
)
def test_number_of_shuffles(spark, product, count):
    book = queries.ledger(spark, SMALL)
    assert len(exchanges(product(book))) == count


def test_no_customer_sized_data_in_one_task(spark):
    book = queries.ledger(spark, SMALL)
    for product in (
        rfm.rfm_scores(book, AS_OF),
        campaigns.campaign_rfm(book, "At Risk", AS_OF),
        retention.repurchase_interval(book, YEAR),
        channels.channel_journey(book, YEAR),
        customers.customer_base(book, YEAR, AS_OF),
    ):
        plan = physical(product)
        assert "SinglePartition" not in plan and "ntile" not in plan


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    write_hot_star(folder)
    return folder


def test_hot_order_and_hot_customer_are_split(spark, conf, hot):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__files__maxPartitionBytes="60KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="8KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
    )
    book = star_ledger(spark, hot, broadcast_rows=0)
    plan = final(book.orders(anonymous="as_not_in").select("order_id", "store"))
    joins = re.findall(r"SortMergeJoin(\(skew=true\))? \[(\w+)#\d+L?\].*?, (\w+)", plan)
    assert ("(skew=true)", "customer_id", "LeftAnti") in joins
    # lines of the hot order are added up before they are joined, so there is nothing left to split
    plan = final(overview.top_categories(book, YEAR))
    joins = re.findall(r"SortMergeJoin(\(skew=true\))? \[(\w+)#\d+L?\].*?, (\w+)", plan)
    assert [j for j in joins if j[1] == "order_id"] == [("", "order_id", "LeftSemi")]


def test_long_lists_are_not_broadcast(spark, conf, hot):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    few, many = star_ledger(spark, hot), star_ledger(spark, hot, broadcast_rows=-1)
    assert "BroadcastHashJoin" in physical(few.orders())
    assert "BroadcastHashJoin" not in physical(many.orders())
    assert few.orders().count() == many.orders().count()
    run = date(2000, 1, 1)
    assert "LeftSemi" in physical(birthdays.birthday_outbox(few, run))
    assert "LeftSemi" in physical(birthdays.birthday_outbox(many, run))


def test_two_kinds_of_distinct_rows_are_not_multiplied(spark):
    book = queries.ledger(spark, SMALL, True)
    for product in (overview.overview_kpis(book, YEAR), channels.channel_kpis(book, YEAR)):
        assert "Expand" not in physical(product)


def test_month_of_birthdays_needs_no_sort_over_sales(spark):
    plan = physical(birthdays.birthdays_of_month(queries.ledger(spark, SMALL), 8, AS_OF, ordered=False))
    assert "LeftSemi" in plan
    # the two levels of one row per customer, store and system, and no more
    lowest = plan.rindex("HashAggregate(keys=[customer_id")
    assert "SortAggregate" not in plan[lowest:]
