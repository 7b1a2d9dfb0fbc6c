"""Table contracts, and reading them from a catalog or from Parquet folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientela import constants as K
from clientela.operators.ledger import Ledger
from clientela.params import Rules

_MONEY = T.DecimalType(18, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TEXT = T.StringType()

SCHEMAS = {
    "customers": _schema(
        customer_id=_TEXT,
        full_name=_TEXT,
        email=_TEXT,
        area_code=_TEXT,
        phone=_TEXT,
        birth_date=T.DateType(),
        city=_TEXT,
        state=_TEXT,
    ),
    "sales": _schema(
        customer_id=_TEXT,
        order_id=_TEXT,
        order_number=_TEXT,
        store=_TEXT,
        source_system=_TEXT,
        order_ts=T.TimestampType(),
        status=_TEXT,
        order_total=_MONEY,
        discount=_MONEY,
    ),
    "items": _schema(
        order_id=_TEXT,
        category=_TEXT,
        line_total=_MONEY,
        quantity=T.LongType(),
        order_ts=T.TimestampType(),
    ),
    "payments": _schema(
        order_id=_TEXT,
        method=_TEXT,
        amount=_MONEY,
        status=_TEXT,
        order_ts=T.TimestampType(),
    ),
}


# columns that a table may have besides
OPTIONAL = {"items": _schema(store=_TEXT), "payments": _schema(store=_TEXT)}


def conform(df: DataFrame, table: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename and cast onto the contract; ids stay text, so leading zeros survive.

    A timestamp without time zone is kept as it is. The store of items and payments is kept where they have it.
    """
    given = {new: old for old, new in (renames or {}).items()}
    kinds = dict(df.dtypes)

    def column(field: T.StructField):
        name = given.get(field.name, field.name)
        if isinstance(field.dataType, T.TimestampType) and kinds.get(name) == "timestamp_ntz":
            return F.col(name).alias(field.name)
        return F.col(name).cast(field.dataType).alias(field.name)

    more = [f for f in OPTIONAL.get(table, T.StructType()).fields if given.get(f.name, f.name) in kinds]
    return df.select(*(column(f) for f in [*SCHEMAS[table].fields, *more]))


def open_ledger(
    read: Callable[[str], DataFrame],
    names: dict[str, str] = K.WAREHOUSE_TABLES,
    columns: dict[str, dict[str, str]] = K.WAREHOUSE_COLUMNS,
    rules: Rules = Rules(),
    one_row_a_customer: bool = False,
) -> Ledger:
    """Ledger over four tables, each fetched by ``read(name)``.

    With ``one_row_a_customer`` copies of a customer are dropped by :func:`one_row_each`.
    """
    tables = {t: conform(read(names[t]), t, columns.get(t)) for t in SCHEMAS}
    if one_row_a_customer:
        tables["customers"] = one_row_each(tables["customers"])
    return Ledger(**tables, rules=rules)


def catalog_ledger(spark: SparkSession, schema: str, **options) -> Ledger:
    """Ledger over catalog tables of one schema, e.g. ``catalog.database``."""
    return open_ledger(lambda name: spark.table(f"{schema}.{name}"), **options)


def parquet_ledger(spark: SparkSession, folder: str, **options) -> Ledger:
    """Ledger over Parquet folders or files next to each other."""
    return open_ledger(lambda name: spark.read.parquet(f"{folder}/{name}"), **options)


def duplicate_customers(customers: DataFrame) -> DataFrame:
    """Customer ids that occur more than once; every list repeats their rows."""
    repeated = customers.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").count()
    return repeated.filter(F.col("count") > 1)


def one_row_each(customers: DataFrame, latest: str | None = None) -> DataFrame:
    """One row for each customer id: the latest by column ``latest`` if named, then the fullest.

    The fullest row has the most columns that are neither missing nor blank; of equally full rows the greatest stands,
    compared column by column in their order, missing values least. Rows without id are all kept. The
    copies of an id are compared where they are, so that an id with very many leaves a task as one row.
    """
    others = [c for c in customers.columns if c != "customer_id"]
    filled = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", 1).otherwise(0) for c in others]
    first = [F.col(f"`{latest}`").alias("_latest")] if latest else []
    rank = F.struct(*first, sum(filled, F.lit(0)).alias("_filled"), *(F.col(f"`{c}`") for c in others))
    known = customers.filter(F.col("customer_id").isNotNull())
    kept = known.groupBy("customer_id").agg(F.max(rank).alias("_row")).select("customer_id", *(F.col(f"_row.`{c}`") for c in others))
    return kept.select(*customers.columns).unionByName(customers.filter(F.col("customer_id").isNull()))


def check_customers(customers: DataFrame) -> None:
    """Fail where customer ids are not unique."""
    found = [row["customer_id"] for row in duplicate_customers(customers).limit(5).collect()]
    if found:
        raise ValueError(f"customer ids occur more than once, e.g. {found}")
