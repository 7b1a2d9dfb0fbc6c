"""Cases by hand that the generated tables do not hold."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from clientela.constants import WAREHOUSE_COLUMNS
from clientela.operators.ledger import AS_NOT_IN, DROP, KEEP, Ledger
from clientela.params import Bounds, Channel, Period
from clientela.plans import birthdays, campaigns, channels, customers, overview, retention, rfm
from clientela.sources.tables import SCHEMAS, check_customers, conform, duplicate_customers

AS_OF = date(2024, 6, 30)
YEAR = Period(date(2024, 1, 1), date(2024, 12, 31))


def person(id, name="Ana Lima", area="62", phone="99988-7766", born=None, email=None):
    return (id, name, email, area, phone, born, "Goiânia", "GO")


def sale(id, order, when, store="Norte", system="ERP", total="10.00", status="Faturado", discount=None):
    when = datetime.fromisoformat(when) if when else None
    total = None if total is None else Decimal(total)
    return (id, order, order, store, system, when, status, total, discount)


@pytest.fixture
def book(spark):
    def make(people=(), sales=(), items=(), payments=(), **options):
        given = dict(customers=people, sales=sales, items=items, payments=payments)
        tables = {n: spark.createDataFrame(list(rows), SCHEMAS[n]) for n, rows in given.items()}
        return Ledger(**tables, **options)

    return make


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


OWN = person("900", "m a confecções")
ORDERS = [
    sale("1", "a", "2024-02-01"),
    sale("900", "b", "2024-02-01"),
    sale(None, "c", "2024-02-01"),
    sale("1", "d", "2024-02-01", status=None),
    sale("1", "e", "2024-02-01", status="FATURADO"),
    sale("1", "f", "2024-02-01", status="cancelado"),
]


@pytest.mark.parametrize("rows", [1_000_000, 0])
@pytest.mark.parametrize(
    "people,anonymous,expected",
    [
        ([OWN], DROP, ["a", "e"]),
        ([OWN], KEEP, ["a", "c", "e"]),
        ([OWN], AS_NOT_IN, ["a", "e"]),
        # without own shop NOT IN an empty set is true for everybody
        ([person("1")], DROP, ["a", "b", "e"]),
        ([person("1")], KEEP, ["a", "b", "c", "e"]),
        ([person("1")], AS_NOT_IN, ["a", "b", "c", "e"]),
        # an own shop without id excludes nobody
        ([person(None, "N S CONFEC LTDA")], DROP, ["a", "b", "e"]),
        ([person(None, "N S CONFEC LTDA"), OWN], KEEP, ["a", "c", "e"]),
        ([person("1", None), OWN], DROP, ["a", "e"]),
    ],
)
def test_own_shop_exclusion(book, rows, people, anonymous, expected):
    ledger = book(people, ORDERS, broadcast_rows=rows)
    assert sorted(values(ledger.orders(anonymous=anonymous), "order_id")) == expected


def test_period_is_inclusive_by_day(book):
    ledger = book(
        [],
        [
            sale("1", "a", "2023-12-31T23:59:59"),
            sale("1", "b", "2024-01-01T00:00:00"),
            sale("1", "c", "2024-12-31T23:59:59.999999"),
            sale("1", "d", "2025-01-01T00:00:00"),
            sale("1", "e", None),
        ],
    )
    assert sorted(values(ledger.orders(YEAR), "order_id")) == ["b", "c"]


def test_channels(book):
    ledger = book(
        [],
        [
            sale("1", "a", "2024-02-01", store="Loja JARDIM", system="ERP"),
            sale("1", "b", "2024-02-01", store=None, system="ECOM"),
            sale("1", "c", "2024-02-01", store="Jardins", system="ECOM"),
        ],
    )
    assert values(ledger.orders(channel=Channel(store_fragment="jardim")), "order_id") == ["a"]
    assert sorted(values(ledger.orders(channel=Channel(system="ECOM")), "order_id")) == ["b", "c"]


def test_orders_count_once_per_store(book):
    ledger = book(
        [person("1")],
        [
            sale("1", "1", "2024-02-01", store="2X"),
            sale("1", "12", "2024-02-01", store="X"),  # same text when glued together
            sale("1", "1", "2024-02-01", store="X"),
            sale("1", "1", "2024-02-02", store="X"),  # a repeat
            sale("1", "3", "2024-02-02", store=None),
            sale(None, "1", "2024-02-02", store="X"),
        ],
    )
    assert values(overview.overview_kpis(ledger, YEAR), "customers", "orders") == [(1, 3)]
    assert values(customers.customer_base(ledger, YEAR, AS_OF), "orders", "spend", "priced_rows") == [
        (3, Decimal("50.00"), 5)
    ]
    assert values(rfm.scored_customers(ledger, AS_OF), "frequency") == [3]


def test_mean_is_per_row_with_a_total(book):
    ledger = book(
        [person("1")],
        [sale("1", "a", "2024-02-01", total="10"), sale("1", "b", "2024-02-01", total=None)],
    )
    assert values(overview.overview_kpis(ledger, YEAR), "mean_row_value", "discount") == [(10.0, None)]


def test_nothing_in_the_period(book):
    ledger = book([person("1")], [sale("1", "a", "2020-02-01")])
    assert values(overview.overview_kpis(ledger, YEAR), "customers", "revenue", "mean_row_value") == [
        (0, None, None)
    ]
    assert values(overview.new_vs_returning_shares(ledger, YEAR), "total", "new_share") == [(0, None)]
    assert values(retention.period_buyers_shares(ledger, YEAR), "buyers", "new_customers", "new_share") == [
        (0, 0, None)
    ]
    for empty in (
        retention.cohort_retention(ledger, YEAR),
        retention.repurchase_interval(ledger, YEAR),
        channels.channel_journey(ledger, YEAR),
        customers.customer_base(ledger, YEAR, AS_OF),
    ):
        assert empty.count() == 0


def test_first_purchase_ever_or_in_period(book):
    ledger = book(
        [],
        [
            sale("1", "a", "2023-11-05"),
            sale("1", "b", "2024-03-05"),
            sale("1", "c", "2024-05-05", store="Sul"),
            sale("2", "d", "2024-03-20"),
        ],
    )
    columns = ("total", "new_customers", "returning_customers")
    assert values(overview.new_vs_returning(ledger, YEAR), *columns) == [(2, 1, 1)]
    # in the south alone the first customer is new
    south = Channel(store_fragment="sul")
    assert values(overview.new_vs_returning(ledger, YEAR, south), *columns) == [(1, 1, 0)]
    # per customer and store
    assert values(
        retention.period_buyers_new_vs_returning(ledger, YEAR),
        "buyers", "new_customers", "returning_customers",
    ) == [(2, 1, 2)]
    by_store = retention.new_vs_returning_by_store(ledger, YEAR)
    assert values(by_store, "store", "new_customers", "returning_customers", "total") == [
        ("Norte", 1, 1, 2),
        ("Sul", 0, 1, 1),
    ]
    # the cohort starts with the first purchase within the period
    assert values(
        retention.cohort_retention(ledger, YEAR), "cohort_month", "age", "active_customers", "cohort_size"
    ) == [(date(2024, 3, 1), 0, 2, 2), (date(2024, 3, 1), 2, 1, 2)]


def test_month_of_first_purchase_has_to_begin_in_the_period(book):
    ledger = book([], [sale("1", "a", "2024-03-20"), sale("2", "b", "2024-04-02")])
    period = Period(date(2024, 3, 10), date(2024, 12, 31))
    assert values(overview.new_customers_by_month(ledger, period), "month") == [date(2024, 4, 1)]


def test_cohort_matrix_is_chronological(book):
    ledger = book([], [sale("1", "a", "2024-02-01"), sale("2", "b", "2024-01-31"), sale("2", "c", "2024-04-01")])
    period = Period(date(2024, 1, 5), date(2024, 4, 30))
    matrix = retention.cohort_matrix(retention.cohort_retention(ledger, period), period)
    assert [tuple(r)[1:] for r in matrix.collect()] == [
        ("Jan/2024", 100.0, None, None, 100.0),
        ("Feb/2024", 100.0, None, None, None),
    ]


def test_interval_with_several_sales_a_day(book):
    ledger = book(
        [],
        [
            sale("1", "a", "2024-01-01T09:00", store="Norte"),
            sale("1", "b", "2024-01-01T10:00", store="Sul"),  # 0 days, Sul
            sale("1", "c", "2024-01-01T11:00", store="Norte"),  # 0 days, Norte
            sale("1", "d", "2024-01-11T08:00", store="Sul"),  # 10 days, Sul
            sale("1", "e", "2024-01-11T09:00", store="Sul"),  # 0 days, Sul
            sale("2", "f", "2024-01-11T09:00", store="Oeste"),
        ],
    )
    got = retention.repurchase_interval(ledger, YEAR)
    assert values(got, "store", "mean_interval_days", "pairs") == [("Norte", 0.0, 1), ("Sul", 3.0, 3)]


def test_journey_ties_and_missing_store(book):
    ledger = book(
        [],
        [
            sale("1", "z", "2024-01-01T10:00", store="Sul"),
            sale("1", "a", "2024-01-01T10:00", store="Norte"),
            sale("2", "b", "2024-01-01", store=None),
            sale("2", "c", "2024-01-02", store="Sul"),
        ],
    )
    journey = channels.channel_journey(ledger, YEAR)
    assert values(journey, "origin", "destination", "customers") == [("Norte", "Sul", 1)]
    assert values(channels.journey_share(journey), "share") == ["100.0%"]
    assert channels.journey_matrix(journey).columns == ["origin", "Sul"]
    listed = channels.journey_matrix(journey, ["Norte"])
    assert values(listed, *listed.columns) == [("Norte", 0, 1)] and listed.columns[-1] == "Outras lojas"


def test_omnichannel_profiles(book):
    ledger = book(
        [],
        [
            sale("1", "a", "2024-01-01", store="Online", system="ECOM"),
            sale("1", "b", "2024-01-02", store="Norte", system="ERP"),
            *(sale("2", s, "2024-01-01", store=s) for s in ("Norte", "Sul", "Oeste")),
            sale("3", "c", "2024-01-01", store="Norte + Café"),
            sale("4", "d", "2024-01-01", store=None),
        ],
    )
    profiles = channels.omnichannel_profile(ledger, YEAR)
    assert dict(values(profiles, "profile", "customers")) == {
        "Omnichannel (online + loja)": 1,
        "Multi-loja (2 lojas físicas)": 1,
        "Norte + Café": 1,
        None: 1,
    }
    share = channels.omnichannel_share(profiles)
    assert values(share, "omnichannel", "customers", "share") == [(2, 4, 50.0)]


def test_base_skips_empty_ids_and_strangers(book):
    ledger = book(
        [person("007", "Zé"), person("", "Ninguém")],
        [
            sale("007", "a", "2024-02-01", store="Sul"),
            sale("007", "b", "2024-03-01", store="Norte"),
            sale("", "c", "2024-02-01"),
            sale("404", "d", "2024-02-01"),
        ],
    )
    base = customers.customer_base(ledger, YEAR, AS_OF)
    columns = ("customer_id", "stores", "store_list", "idle_days", "whatsapp", "phone_digits")
    assert values(base, *columns) == [
        ("007", "Norte / Sul", ["Norte", "Sul"], 121, "5562999887766", "6299988-7766")
    ]
    assert values(customers.available_channels(base), "store") == ["Norte", "Sul"]
    assert values(customers.customer_card(base, "007"), "full_name") == ["Zé"]
    assert customers.customer_card(base, "7").count() == 0


def test_search_treats_missing_as_no_match(book):
    people = [person("1", None), person("2", "ÉRICA", email="E@x.com"), person("3", "Rica", phone=None)]
    ledger = book(people, [sale(i, i, "2024-02-01", total=f"{i}0") for i in "123"])
    base = customers.customer_base(ledger, YEAR, AS_OF, ordered=False)
    search = customers.customer_search
    assert values(search(base), "customer_id") == ["3", "2", "1"]
    assert values(search(base, name="rica"), "customer_id") == ["3", "2"]
    assert values(search(base, name="^é"), "customer_id") == ["2"]
    assert values(search(base, email="e@X"), "customer_id") == ["2"]
    assert values(search(base, phone="62.*77"), "customer_id") == ["2", "1"]
    assert values(search(base, only_phone=True), "customer_id") == ["2", "1"]
    assert values(search(base, order_by="full_name"), "customer_id") == ["3", "2", "1"]
    assert search(base, stores=["Sul"]).count() == 0
    assert search(base, min_orders=2).count() == 0


def test_order_history_has_any_status_and_is_capped(book):
    sales = [sale("1", f"{i:03}", f"2024-02-01T{i // 60:02}:{i % 60:02}", status=None) for i in range(60)]
    history = customers.order_history(book([OWN], sales), "1")
    assert values(history, "order_number") == [f"{i:03}" for i in range(59, 9, -1)]


def test_rfm_keeps_customers_without_contact_data(book):
    ledger = book(
        [person("1")],
        [
            sale("1", "a", "2024-02-01", total="10.00"),
            sale("1", "b", "2024-02-01", total="10.01"),
            sale("2", "c", "2024-06-01", total="5"),
            sale("3", "d", "2024-06-01", total="0"),
            sale("3", "e", "2024-06-01", total="-4"),
            sale("3", "f", "2024-06-01", total=None),
        ],
    )
    scores = rfm.rfm_scores(ledger, AS_OF)
    columns = ("customer_id", "recency_days", "frequency", "value", "ticket_per_order", "full_name")
    assert values(scores, *columns) == [
        ("1", 150, 2, Decimal("20.01"), Decimal("10.01"), "Ana Lima"),
        ("2", 29, 1, Decimal("5.00"), Decimal("5.00"), None),
    ]
    assert rfm.rfm_sample(scores, ledger, 1).count() == 1
    assert sorted(values(rfm.rfm_sample(scores, ledger), "customer_id", "full_name")) == [("1", "Ana Lima"), ("2", None)]


def test_big_spenders_and_old_customers_stay_listed(book):
    people = [person("1"), person("2"), person("3")]
    sales = [sale("1", "a", "2024-06-01", total="12000000"), sale("2", "b", "1990-01-01", total="600")]
    sales += [sale("3", f"o{i}", "2024-06-01", total="1") for i in range(600)]
    ledger = book(people, sales)
    assert sorted(values(campaigns.campaign_custom(ledger, AS_OF), "customer_id")) == ["1", "2", "3"]
    assert values(campaigns.campaign_list(ledger, "Reativação (inativos)", AS_OF), "customer_id") == ["2"]
    assert values(campaigns.campaign_list(ledger, "VIPs / Champions", AS_OF), "customer_id") == ["3"]


def test_campaigns(book):
    ledger = book(
        [person("1", "maria josé", born=date(1990, 6, 9)), person("2", born=date(1990, 7, 1), phone="?")],
        [sale("1", "a", "2024-03-01", total="500"), sale("2", "b", "2024-06-29", total="100")],
    )
    assert values(campaigns.campaign_custom(ledger, AS_OF, Bounds(min_spend=100)), "customer_id") == ["1", "2"]
    assert values(campaigns.campaign_custom(ledger, AS_OF, Bounds(max_spend=499.99)), "customer_id") == ["2"]
    assert values(campaigns.campaign_list(ledger, "Reativação (inativos)", AS_OF), "customer_id") == ["1"]
    born = campaigns.campaign_list(ledger, "Aniversariantes do mês", AS_OF)
    enriched = campaigns.campaign_enrich(born, " ", "Aniversariantes do mês", AS_OF)
    assert values(enriched, "customer_id", "first_name", "campaign") == [
        ("1", "Maria", "Aniversariantes do mês — 30/06/2024")
    ]
    assert values(campaigns.campaign_metrics(enriched), "customers", "with_whatsapp", "mean_ltv") == [
        (1, 1, 500.0)
    ]
    assert campaigns.campaign_columns(enriched).columns[:4] == [
        "Nome Completo",
        "Primeiro Nome",
        "E-mail",
        "WhatsApp (55DDD...)",
    ]
    assert "Dias s/ comprar" not in campaigns.campaign_columns(enriched).columns
    segment = values(rfm.scored_customers(ledger, AS_OF), "customer_id", "segment")
    for customer, name in segment:
        listed = campaigns.campaign_list(ledger, "Segmento RFM", AS_OF, segment=name)
        assert customer in values(listed, "customer_id")
    assert campaigns.campaign_rfm(ledger, "Cannot Lose Them", AS_OF).count() == 0


def test_latest_system(book):
    ledger = book(
        [person("1", born=date(1990, 6, 9)), person("2", born=date(1990, 6, 8))],
        [
            sale("1", "a", "2024-03-01", system="ECOM"),
            sale("1", "b", "2024-03-02", system=None, store=None),
            sale("1", "c", None, system="ECOM"),
        ],
    )
    born = birthdays.birthdays_of_month(ledger, 6, AS_OF, only_buyers=False)
    columns = ("customer_id", "birth_day", "latest_system", "orders", "stores")
    assert values(born, *columns) == [("2", 8, None, None, None), ("1", 9, None, 2, "Norte")]
    assert values(birthdays.birthday_metrics(born, date(2024, 7, 8)), "customers", "today") == [(2, 0)]
    assert values(birthdays.birthday_metrics(born, date(2024, 6, 8)), "customers", "today") == [(2, 1)]
    outbox = birthdays.birthday_outbox(ledger, date(2024, 6, 2))
    assert values(outbox, "channel") == ["loja"]


@pytest.mark.parametrize("rows", [1_000_000, 0])
@pytest.mark.parametrize(
    "born,run,due",
    [
        (date(1990, 1, 4), date(2023, 12, 28), True),  # over the turn of the year
        (date(1992, 2, 29), date(2024, 2, 22), True),
        (date(1992, 2, 29), date(2023, 2, 21), False),
        (date(1992, 2, 28), date(2023, 2, 21), True),
        (None, date(2023, 2, 21), False),
    ],
)
def test_outbox_day(book, rows, born, run, due):
    ledger = book(
        [person("1", "ÂNGELA \"Gê\"", born=born)],
        [sale("1", "a", "2024-01-01", system="ecom")],
        broadcast_rows=rows,
    )
    outbox = birthdays.birthday_outbox(ledger, run)
    expected = ['{"phone":"5562999887766","variables":["Ângela"],"canal":"ecommerce"}']
    assert values(outbox, "payload") == (expected if due else [])


def test_lines_of_invoiced_orders(book):
    when = datetime(2024, 2, 1)
    items = [
        ("a", "Conjunto azul", Decimal("10"), 1, when),
        ("a", "CONJUNTO verde", Decimal("5"), 2, when),
        ("a", None, Decimal("99"), 9, when),
        ("b", "Saia", Decimal("7"), 1, when),  # of an own shop
        ("c", "Saia", Decimal("8"), 1, when),  # anonymous
        ("d", "Saia", Decimal("9"), 1, when),  # not invoiced
        ("a", "Saia", Decimal("1"), 1, datetime(2025, 1, 1)),
        (None, "Saia", Decimal("1"), 1, when),
    ]
    payments = [
        ("a", "Pix", Decimal("10"), "ok", when),
        ("a", "Pix", Decimal("2"), "ok", when),
        ("a", "Pix", Decimal("4"), None, when),
        ("c", "Cartão", Decimal("8"), "ok", when),
    ]
    sales = [
        sale("1", "a", "2020-02-01", store="Norte"),  # any day
        sale("1", "a", "2020-02-01", store="Sul"),
        sale("900", "b", "2024-02-01"),
        sale(None, "c", "2024-02-01"),
        sale("1", "d", "2024-02-01", status="Aberto"),
    ]
    ledger = book([OWN], sales, items, payments)
    top = overview.top_categories(ledger, YEAR)
    assert values(top, "category", "revenue", "units") == [("Conjunto", Decimal("15.00"), 3)]
    mix = overview.payment_mix(ledger, YEAR)
    assert values(mix, "method", "orders", "total") == [("Pix", 1, Decimal("12.00"))]
    # without any own shop the anonymous order counts too
    ledger = book([person("1")], sales, items, payments)
    assert values(overview.payment_mix(ledger, YEAR), "method") == ["Pix", "Cartão"]
    assert values(overview.top_categories(ledger, YEAR, n=1), "category") == ["Conjunto"]


def test_duplicate_customers(book, spark):
    people = [person("1"), person("1"), person("2"), person(None), person(None)]
    ledger = book(people, [sale("1", "a", "2024-02-01")])
    assert values(duplicate_customers(ledger.customers), "customer_id", "count") == [("1", 2)]
    with pytest.raises(ValueError, match="1"):
        check_customers(ledger.customers)
    check_customers(ledger.customers.filter("customer_id = '2'"))
    # a repeated customer repeats its row
    assert customers.customer_base(ledger, YEAR, AS_OF).count() == 2


def test_conform_keeps_leading_zeros(spark):
    given = spark.createDataFrame(
        [("007", "Zé", "a@b", 62, 999887766, date(1990, 1, 1), "Goiânia", "GO", "x")],
        "documento string, nome_completo string, email string, ddd int, telefone long,"
        "data_nascimento date, cidade string, estado string, outra string",
    )
    df = conform(given, "customers", WAREHOUSE_COLUMNS["customers"])
    assert df.schema == SCHEMAS["customers"]
    assert values(df, "customer_id", "phone") == [("007", "999887766")]


@pytest.mark.parametrize("copies", [None, 100_000, 1])
def test_copies_of_a_customer(book, copies):
    """An id with many copies, among them the empty one, takes another way to the same rows."""
    born = date(1990, 6, 9)
    people = [
        person("1", "Ana", born=born),
        *(person("2", f"Bia {i}", born=born) for i in range(3)),
        *(person("", f"Caio {i}", born=born) for i in range(3)),
        *(person("4", f"Davi {i}", born=born) for i in range(2)),
        *(person(None, f"Eva {i}", born=born) for i in range(2)),
    ]
    sales = [sale(i, f"o{i}", "2024-03-01") for i in ("1", "2", "", "5")]
    ledger = book(people, sales, many_copies=copies)
    assert (ledger.copied_ids is None) == (copies != 1)

    ids = lambda df: sorted(values(df, "customer_id"), key=str)
    buyers = ["", "", "", "1", "2", "2", "2"]
    assert ids(rfm.rfm_scores(ledger, AS_OF)) == [*buyers, "5"]
    assert ids(customers.customer_base(ledger, YEAR, AS_OF)) == ["1", "2", "2", "2"]
    assert ids(campaigns.campaign_custom(ledger, AS_OF)) == buyers
    assert ids(campaigns.campaign_birthdays(ledger, AS_OF)) == buyers
    month = birthdays.birthdays_of_month(ledger, 6, AS_OF, only_buyers=False)
    assert ids(month) == [*buyers, "4", "4", None, None]
    assert ids(month.filter("orders = 1")) == buyers
    assert ids(birthdays.birthdays_of_month(ledger, 6, AS_OF)) == buyers
    assert ids(birthdays.birthday_outbox(ledger, date(2024, 6, 2))) == buyers
