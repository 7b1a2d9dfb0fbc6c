"""What products share, and what of the tables they read."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.setting import AS_OF, YEAR
from clientela.operators import membership
from clientela.operators.durable import durable
from clientela.operators.ledger import Ledger
from clientela.operators.layout import DAY_FOLDER
from clientela.operators.ntile import add_tiles, descending
from clientela.params import ONLINE, Period
from clientela.plans import birthdays, campaigns, customers, overview, retention, rfm
from clientela.sources.layout import layout_ledger, write_layout
from clientela.sources.star import star_ledger
from clientela.sources.tables import SCHEMAS, one_row_each
from tests.jobs import actions, scanned
from tests.star import write_hot_star

SMALL = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    write_hot_star(folder)
    return folder


# one tiling, one score table


def test_three_metrics_are_ranked_together(spark):
    df = durable(spark.range(5000).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 1000).cast("decimal(12,2)").alias("b"), F.hash("id").alias("c")))
    keys = {"x": [*descending(F.col("a")), F.col("id")], "y": [F.col("b"), F.col("id")], "z": [F.col("c"), F.col("id")]}
    with actions(spark) as ran:
        tiled = add_tiles(df, keys, 5)
    assert ran[0] <= 3  # write, count, look up
    for name, order in (("x", "a DESC"), ("y", "b"), ("z", "c")):
        wrong = tiled.withColumn("w", F.expr(f"ntile(5) OVER (ORDER BY {order}, id)")).filter(F.col("w") != F.col(name))
        assert wrong.isEmpty()


def test_products_of_a_ledger_share_their_scores(spark):
    book = star_ledger(spark, SMALL)
    with actions(spark) as first:
        rfm.scored_customers(book, AS_OF)
    assert first[0] > 0
    with actions(spark) as again:
        scores = rfm.rfm_scores(book, AS_OF, ordered=False)
        for product in (
            rfm.rfm_segment_summary(rfm.scored_customers(book, AS_OF)),
            rfm.rfm_headline(scores),
            rfm.rfm_sample(rfm.scored_customers(book, AS_OF), book),
            rfm.segment_members(scores, "At Risk"),
            rfm.segment_names(scores),
            campaigns.campaign_rfm(book, "At Risk", AS_OF, ordered=False),
        ):
            assert "order_total" not in physical(product)  # no sale is read again
    assert again[0] == 0
    with actions(spark) as other:
        rfm.scored_customers(book, AS_OF, ONLINE)
        rfm.scored_customers(book, AS_OF - timedelta(days=1))
        rfm.scored_customers(book, AS_OF, tiles=4)
    assert other[0] >= 3 * 4


# lines are added up before they move


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    """A ledger straight over Parquet, so that plans hold nothing but the products."""
    folder, when = str(tmp_path_factory.mktemp("plain")), datetime(2000, 2, 1, 12)
    rows = {
        "customers": [("1", "Ana", "a@x", "62", "999", date(1990, 8, 8), "Goiânia", "GO")],
        "sales": [("1", str(i), "1", "Norte", "ERP", when, "Faturado", Decimal("10.00"), None) for i in range(20)],
        "items": [(str(i % 40), f"Saia {i % 3}", Decimal("1.00"), 2, when) for i in range(400)],
        "payments": [(str(i % 40), f"m{i % 3}", Decimal("1.00"), "ok", when) for i in range(400)],
    }
    for table, given in rows.items():
        spark.createDataFrame(given, SCHEMAS[table]).write.parquet(f"{folder}/{table}")
    return lambda **options: Ledger(**{t: spark.read.parquet(f"{folder}/{t}") for t in rows}, **options)


@pytest.mark.parametrize("broadcast_rows,sketched", [(1_000_000, True), (0, True), (0, False)])
def test_no_raw_line_is_shuffled(spark, conf, plain, monkeypatch, broadcast_rows, sketched):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    if not sketched:
        monkeypatch.setattr("clientela.operators.ledger.SKETCHED_KEYS", -1)
    book = plain(broadcast_rows=broadcast_rows)
    for product, amount, column in ((overview.top_categories(book, YEAR), 30, "units"), (overview.payment_mix(book, YEAR), 60, "total")):
        lines = [line for line in physical(product).splitlines() if line.strip(" :+-")]
        below = [lines[i + 1] for i, line in enumerate(lines) if " Exchange hashpartitioning" in line]
        # whatever is shuffled by id or label was added up (or is a list of ids)
        assert below and all("HashAggregate" in line or "Filter" in line and "store" in line for line in below[:-1])
        raw = [text for i, text in enumerate(lines) if " Exchange " in text and any(w in lines[i + 1] for w in ("FileScan", "Project", "Filter")) and "order_ts" in "".join(lines[i + 1 : i + 5])]
        assert raw == []
        plan = "\n".join(lines)
        assert ("_bits" in plan) == (sketched and broadcast_rows == 0)
        assert ("SortMergeJoin" in plan) == (broadcast_rows == 0)
        assert sum(r[column] for r in product.collect()) > 0


@pytest.mark.parametrize("broadcast_rows,sketched", [(1_000_000, True), (0, True), (0, False)])
def test_ways_of_finding_invoiced_lines_agree(hot, spark, monkeypatch, broadcast_rows, sketched):
    if not sketched:
        monkeypatch.setattr("clientela.operators.ledger.SKETCHED_KEYS", -1)
    book, other = star_ledger(spark, hot, broadcast_rows=broadcast_rows), star_ledger(spark, hot)
    for product in (overview.top_categories, overview.payment_mix):
        for by_store in (False, True):
            assert product(book, YEAR, by_store=by_store).collect() == product(other, YEAR, by_store=by_store).collect()


def test_sketch_keeps_all_keys_and_few_others(spark):
    keys = spark.range(0, 20000, 2).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(40000).select(F.col("id").cast("string").alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id long"))
    found = membership.perhaps_in(rows, "k", membership.key_sketch(keys, "k"))
    assert found.columns == ["k", "id"]
    assert found.filter("id >= 0 AND id % 2 = 0 AND id < 20000").count() == 10000
    assert found.count() < 10000 + 100
    none = membership.perhaps_in(rows, "k", membership.key_sketch(keys.limit(0), "k"))
    assert none.count() == 0


def test_order_keys_are_found_once(spark):
    book = star_ledger(spark, SMALL)
    overview.payment_mix(book, YEAR)
    with actions(spark) as again:
        overview.top_categories(book, YEAR)
        overview.payment_mix(book, Period(date(1999, 1, 1), date(1999, 6, 1)))
    assert again[0] == 0


# cohorts


def test_customers_with_the_same_months_are_one_pattern(spark):
    book = star_ledger(spark, SMALL)
    plan = physical(retention.cohort_retention(book, YEAR))
    below = plan[plan.index("Generate explode") :]
    pattern = below[below.index("HashAggregate(keys=[") :].split("\n")[0]
    assert "cohort" in pattern and "w0" in pattern and "customer_id" not in pattern
    explode = plan.index("Generate explode")
    assert plan.index("HashAggregate(keys=[cohort", 0) < explode < plan.index("HashAggregate(keys=[cohort", explode)


# folders


@pytest.fixture(scope="module")
def twelve(spark, tmp_path_factory):
    """A year of sales, eighty customers a day and one that buys every day, in folders by month and by day."""
    people = [(str(c), f"Ana {c}", "a@x", "62", "9", date(1990, 1 + c % 12, 8), "Goiânia", "GO") for c in range(2000)]
    sales, lines = [], []
    for d in range(365):
        when = datetime(2000, 1, 1, 23, 30) + timedelta(days=d)
        for n, c in enumerate([*((d * 80 + k) % 2000 for k in range(80)), 399]):
            id = f"{d}-{n}"
            sales.append((None if n == 9 else str(c), id, id, "Norte", "ERP", when, "Faturado", Decimal("10.00"), None))
            lines.append((id, "Saia", Decimal("10.00"), 2, when))
    sales.append(("1", "z", "z", "Norte", "ERP", None, "Faturado", Decimal("1.00"), None))
    tables = {"customers": people, "sales": sales, "items": lines, "payments": []}
    book = Ledger(**{n: spark.createDataFrame(rows, SCHEMAS[n]).coalesce(2) for n, rows in tables.items()})
    folders = {}
    for by, of in (("month", 0), ("day", 0), ("month", 8)):
        folders[by, of] = str(tmp_path_factory.mktemp(f"{by}{of}"))
        write_layout(book, folders[by, of], by, of, tasks=4, **{"parquet.block.size": 4096, "parquet.page.size": 1024, "parquet.block.row.check.min": 10})
    return book, {key: layout_ledger(spark, path) for key, path in folders.items()}


JUNE = Period(date(2000, 6, 1), date(2000, 6, 30))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("key", [("month", 0), ("day", 0), ("month", 8)])
def test_products_over_folders(twelve, key):
    book, laid = twelve
    for product in (
        lambda b: overview.overview_kpis(b, JUNE),
        lambda b: overview.top_categories(b, JUNE),
        lambda b: overview.new_vs_returning(b, Period(None, date(2000, 3, 2))),
        lambda b: birthdays.birthdays_of_month(b, 5, date(2001, 1, 1)),
        lambda b: customers.order_history(b, "399"),
        lambda b: customers.customer_card_of(b, "17", JUNE, date(2001, 1, 1)),
        lambda b: b.sales.select("order_id", "customer_id", "order_ts"),
        lambda b: b.customers.select("customer_id", "birth_date"),
    ):
        assert rows(product(laid[key])) == rows(product(book))


def of_sales(found):
    return [s for s in found if "status" in s["columns"]]


def test_one_month_of_twelve_is_read(twelve):
    _, laid = twelve
    book = laid["month", 0]
    (whole,) = of_sales(scanned(book.orders().groupBy().count()))
    (one,) = of_sales(scanned(book.orders(JUNE).groupBy().count()))
    assert whole["numPartitions"] == 13  # and the sales without day
    # the zones of writer and reader may differ, so the days beside the month are looked at
    assert one["numPartitions"] <= 3 and one["numFiles"] <= whole["numFiles"] / 4
    (middle,) = of_sales(scanned(book.orders(Period(date(2000, 6, 5), date(2000, 6, 20))).groupBy().count()))
    assert middle["numPartitions"] == 1
    (days,) = of_sales(scanned(laid["day", 0].orders(JUNE).groupBy().count()))
    assert days["numPartitions"] == 30 + 4
    items = [s for s in scanned(overview.top_categories(book, Period(date(2000, 6, 5), date(2000, 6, 20)))) if "category" in s["columns"]]
    assert [s["numPartitions"] for s in items] == [1]


def test_other_time_zone_loses_no_sale(spark, conf, twelve):
    book, laid = twelve
    for zone in ("Pacific/Kiritimati", "Etc/GMT+12"):
        conf(spark__sql__session__timeZone=zone)
        for key in laid:
            assert laid[key].orders(JUNE).count() == book.orders(JUNE).count()


def test_folders_of_customers_are_pruned_when_the_list_has_arrived(spark, twelve):
    _, laid = twelve
    book = laid["month", 8]
    few = spark.createDataFrame([("17",)], "customer_id string")
    narrowed = book.orders_of(few)
    assert "dynamicpruning" in physical(narrowed)
    (read,) = of_sales(scanned(narrowed))
    (whole,) = of_sales(scanned(book.orders()))
    assert 0 < read["numFiles"] <= whole["numFiles"] / 4


def test_one_customer_is_found_by_statistics(twelve):
    _, laid = twelve
    for key in (("month", 0), ("month", 8)):
        book = laid[key]
        total = book.sales.count()
        (history,) = of_sales(scanned(customers.order_history(book, "17")))
        assert history["numOutputRows"] < total / 10
        book.own_shops, book._own_shops_size  # found for the first product
        read = scanned(customers.customer_card_of(book, "17", JUNE, date(2001, 1, 1)))
        assert [s["numOutputRows"] < total / 10 for s in of_sales(read)] == [True]
        assert [s["numOutputRows"] for s in read if "full_name" in s["columns"]][0] <= 2000 / 10
        assert customers.order_history(book, "17").count() > 0


def test_layout_by_week_is_refused(twelve, tmp_path):
    with pytest.raises(ValueError):
        write_layout(twelve[0], str(tmp_path), by="week")
    assert DAY_FOLDER not in twelve[1]["month", 0].sales.columns


# one row for each customer


def test_survivors(spark):
    def person(id, name=None, email=None, born=None, city=None):
        return (id, name, email, None, None, born, city, None)

    people = [
        person("1", "Ana", "a@x"),
        person("1", "Ana", "a@x", date(1990, 1, 1)),  # fuller
        person("2", "Bia", "b@x"),
        person("2", "Bia", "c@x"),  # as full, greater
        person("3", "Cai", " ", city=""),  # blanks are no content
        person("3", "Cai", None, city="X"),
        person(None, "n"),
        person(None, "n"),
        person("", "blank id"),
        *[person("9", f"p{i % 7}") for i in range(300)],
    ]
    df = spark.createDataFrame(people, SCHEMAS["customers"])
    kept = one_row_each(df.repartition(5))
    assert kept.schema == df.schema
    assert sorted(tuple(r) for r in kept.filter("customer_id IS NOT NULL").collect()) == sorted([people[1], people[3], people[5], people[8], person("9", "p6")])
    assert kept.filter("customer_id IS NULL").count() == 2
    assert one_row_each(df.limit(0)).count() == 0
    dated = df.withColumn("updated", F.when(F.col("birth_date").isNull(), "2024").otherwise("2020"))
    assert one_row_each(dated, latest="updated").filter("customer_id = '1'").first()["birth_date"] is None


def test_copies_are_compared_where_they_are(spark):
    df = spark.createDataFrame([("1",) + (None,) * 7] * 2, SCHEMAS["customers"])
    plan = physical(one_row_each(df))
    assert "partial_max" in plan and "Window" not in plan
