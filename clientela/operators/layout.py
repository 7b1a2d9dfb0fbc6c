"""Tables laid out in folders: by order day, and by groups of customer ids.

A folder column is added when a table is written and found again when it is read; the conditions that
products have on days and ids are then carried over to it, so that other folders are not read.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.params import Period

# folder columns; the last one's name ends in the number of folders
DAY_FOLDER, MONTH_FOLDER, CUSTOMER_FOLDER = "order_day_folder", "order_month_folder", "customer_folder_of_"
# the day of a moment differs by two at most between the time zones of writer and reader
_ZONES = timedelta(days=2)


def folder_predicate(rows: DataFrame, period: Period) -> Column | None:
    """What the period says about the folder column of days or months, if there is one.

    It never rules a row of the period out, whatever time zones the table was written and is read in;
    the period has to be asked of ``order_ts`` besides. Rows without a day lie in a folder of their own.
    """
    keep = None
    kind = dict(rows.dtypes).get("order_ts")
    slack = timedelta(0) if kind in ("date", "timestamp_ntz") else _ZONES
    for name in (DAY_FOLDER, MONTH_FOLDER):
        if name not in rows.columns:
            continue
        keep = F.col(name).isNotNull()
        if period.start is not None:
            first = period.start - slack
            keep = keep & (F.col(name) >= F.lit(first.replace(day=1) if name == MONTH_FOLDER else first))
        if period.end is not None:
            keep = keep & (F.col(name) <= F.lit(period.end + slack))
    return keep


def customer_folder(customer_id: Column, folders: int) -> Column:
    """Number of the folder that holds a customer; customers without id lie in folder 0."""
    return F.coalesce(F.pmod(F.xxhash64(customer_id.cast("string")), F.lit(folders)).cast("int"), F.lit(0))


def _customer_folders(rows: DataFrame) -> tuple[str, int] | None:
    """The folder column of customers, and how many folders there are."""
    for name in rows.columns:
        if name.startswith(CUSTOMER_FOLDER):
            return name, int(name.removeprefix(CUSTOMER_FOLDER))
    return None


def of_customer(rows: DataFrame, customer_id) -> DataFrame:
    """Rows of one customer, from the one folder that can hold them."""
    found = rows.filter(F.col("customer_id") == F.lit(customer_id))
    folders = _customer_folders(rows)
    if folders is None:
        return found
    name, count = folders
    return found.filter(F.col(name) == customer_folder(F.lit(customer_id).cast(rows.schema["customer_id"].dataType), count))


def of_customers(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the customers in ``ids`` (customer_id): a semi join, by folder too where there are folders.

    Where ``ids`` is broadcast, folders without any of them are pruned when it has arrived.
    """
    folders = _customer_folders(rows)
    if folders is None:
        return rows.join(ids, "customer_id", "left_semi")
    name, count = folders
    # Spark prunes by a list of keys that has a filter of its own
    placed = ids.withColumn(name, customer_folder(F.col("customer_id"), count)).filter(F.col(name) >= 0)
    return rows.join(placed, ["customer_id", name], "left_semi")
