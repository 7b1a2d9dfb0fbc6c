import math

import pytest
from pyspark.sql import functions as F

from clientela.functions.contact import delivery_channel, first_name, whatsapp_number
from clientela.functions.labels import category_label, rfm_segment
from clientela.functions.numbers import (
    format_brl,
    format_count,
    format_share,
    mean,
    percent,
    rounded_ratio,
)

PHONES = [
    ("(62)", "99988-7766", "5562999887766"),
    ("062.0", "99988 7766", "5562999887766"),
    (" 62 ", " 3333-4444 ", "556233334444"),
    ("0", "0", "5500"),
    ("6.2e1", "3.0", "55623"),
    ("-62", "12", "55-6212"),
    ("62", "-12", "556212"),
    ("62.", ".9", "55620"),
    ("1_0", "1_000", "55101000"),
    ("1__0", "12", ""),
    ("inf", "12", ""),
    ("62", "nan", ""),
    ("1d", "12", ""),
    ("62", "n/d", ""),
    ("", "12", ""),
    ("62", "", ""),
    (None, "12", ""),
    ("62", None, ""),
    (" 62", "12\t", "556212"),
    ("62", "1e400", ""),
]


def test_whatsapp(spark):
    df = spark.createDataFrame(PHONES, "area string, phone string, expected string")
    df = df.withColumn("got", whatsapp_number(F.col("area"), F.col("phone")))
    assert [r["got"] for r in df.collect()] == [p[2] for p in PHONES]


def test_whatsapp_of_numbers(spark):
    df = spark.createDataFrame([(62.0, 999887766)], "area double, phone long")
    assert df.select(whatsapp_number(F.col("area"), F.col("phone"))).first()[0] == "5562999887766"


NAMES = [
    ("maria da silva", "Maria"),
    ("  JOSÉ  ", "José"),
    (" ÉRICA souza", "Érica"),
    ("ANA-MARIA lima", "Ana-maria"),
    ("\tzé\tninguém", "Zé"),
    ("d'ÁVILA", "D'ávila"),
    ("   ", ""),
    ("", ""),
    (None, ""),
]


def test_first_name(spark):
    df = spark.createDataFrame(NAMES, "name string, expected string")
    got = [r[0] for r in df.select(first_name(F.col("name"))).collect()]
    assert got == [n[1] for n in NAMES]


MONEY = [
    (1234.56, "R$ 1.234,56"),
    (1234567.891, "R$ 1.234.567,89"),
    (0.0, "R$ 0,00"),
    (0.125, "R$ 0,12"),
    (0.135, "R$ 0,14"),
    (2.675, "R$ 2,67"),
    (-0.001, "R$ -0,00"),
    (-1234.5, "R$ -1.234,50"),
    (math.nan, "R$ 0,00"),
    (None, "R$ 0,00"),
]


@pytest.mark.parametrize("value,expected", MONEY)
def test_format_brl(value, expected):
    """The expected texts are what Python's own formatting gives."""
    number = 0.0 if value is None or math.isnan(value) else value
    plain = f"{number:,.2f}"
    assert expected == "R$ " + plain.translate(str.maketrans(",.", ".,"))


def test_format_brl_in_spark(spark):
    df = spark.createDataFrame(MONEY, "value double, expected string")
    assert [r[0] for r in df.select(format_brl(F.col("value"))).collect()] == [m[1] for m in MONEY]


def test_format_count(spark):
    cases = [(1234567.9, "1.234.567"), (-1234.9, "-1.234"), (12.0, "12"), (math.nan, "0"), (None, "0")]
    df = spark.createDataFrame(cases, "value double, expected string")
    assert [r[0] for r in df.select(format_count(F.col("value"))).collect()] == [c[1] for c in cases]


def test_format_share(spark):
    values = [12.25, 12.35, 100.0, 0.05, 33.333]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(format_share(F.col("v"))).collect()]
    assert got == ["12.2%", "12.4%", "100.0%", "0.0%", "33.3%"]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 8), (5, 2), (1, 3), (0, 4), (7, 0)], "a long, b long")
    got = df.select(
        rounded_ratio("a", "b").alias("whole"),
        rounded_ratio("a", "b", 1000).alias("thousandth"),
        mean(F.col("a"), F.col("b")).alias("mean"),
        percent(F.col("a"), F.col("b")).alias("percent"),
    ).collect()
    assert [r["whole"] for r in got] == [0, 3, 0, 0, None]
    assert [r["thousandth"] for r in got] == [125, 2500, 333, 0, None]
    assert [r["mean"] for r in got] == [0.125, 2.5, 1 / 3, 0.0, None]
    assert [r["percent"] for r in got] == [12.5, 250.0, 1 / 3 * 100, 0.0, None]


def test_segments(spark):
    tiles = spark.range(1, 6)
    codes = tiles.toDF("r").crossJoin(tiles.toDF("f")).crossJoin(tiles.toDF("m"))
    labelled = codes.withColumn("s", rfm_segment(F.col("r"), F.col("f"), F.col("m")))
    assert {r["s"]: r["count"] for r in labelled.groupBy("s").count().collect()} == {
        "At Risk": 30,
        "Loyal Customers": 25,
        "Champions": 20,
        "Promising": 20,
        "About to Sleep": 12,
        "Potential Loyalist": 10,
        "Hibernating": 6,
        "Lost": 2,
    }


def test_labels(spark):
    df = spark.createDataFrame(
        [("CONJUNTO Linho", "ecom"), ("Vestidos", "ERP"), ("Saia vestido", None)],
        "category string, system string",
    )
    prefixes = (("conjunto", "Conjunto"), ("vestido", "Vestido"))
    got = df.select(
        category_label(F.col("category"), prefixes), delivery_channel(F.col("system"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Conjunto", "ecommerce"),
        ("Vestido", "loja"),
        ("Saia vestido", "loja"),
    ]
