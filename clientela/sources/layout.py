"""Writing the tables of a ledger into folders by day and customer, and opening them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.operators.layout import CUSTOMER_FOLDER, DAY_FOLDER, MONTH_FOLDER, customer_folder
from clientela.operators.ledger import Ledger

TABLES = ("customers", "sales", "items", "payments")


def write_layout(
    ledger: Ledger,
    path: str,
    by: str = "day",
    customer_folders: int = 0,
    tasks: int | None = None,
    mode: str = "errorifexists",
    **options,
) -> None:
    """Write a ledger's tables below ``path``: sales, items and payments in a folder for each order ``day`` or ``month``.

    With ``customer_folders`` customers and sales are also dealt to that many folders by customer id. Days and folders
    multiply: choose months, or no customer folders, where a folder would hold little. Files are sorted by
    customer id (or order id) and carry Bloom filters of it, so that the row groups of a customer or order are
    found by their statistics.

    Rows are dealt to ``tasks`` (the number of shuffle partitions, if not given) by ranges of folder and ids: a day that
    holds a third of all sales, or a customer, is written by many tasks, and small days share one. ``options`` go to
    the Parquet writer, such as ``parquet.block.size``.
    """
    if by not in ("day", "month"):
        raise ValueError(f"tables are laid out by day or month, not by {by!r}")
    spark = ledger.sales.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    day = F.to_date("order_ts")
    in_time = {DAY_FOLDER: day} if by == "day" else {MONTH_FOLDER: F.trunc(day, "MM")}
    of_customer = {f"{CUSTOMER_FOLDER}{customer_folders}": customer_folder(F.col("customer_id"), customer_folders)} if customer_folders else {}
    _write(ledger.customers, of_customer, ["customer_id"], f"{path}/customers", tasks, mode, options)
    _write(ledger.sales, in_time | of_customer, ["customer_id", "order_id"], f"{path}/sales", tasks, mode, options)
    for name, lines in (("items", ledger.items), ("payments", ledger.payments)):
        if lines is not None:
            _write(lines, in_time, ["order_id"], f"{path}/{name}", tasks, mode, options)


def _write(df: DataFrame, folders: dict[str, Column], ids: list[str], path: str, tasks: int, mode: str, options: dict) -> None:
    dealt = [*folders, *ids]
    # the rest of the row splits an id that has very many rows
    rest = [f.name for f in df.schema.fields if f.name not in dealt]
    placed = df.withColumns(folders) if folders else df
    # an empty table has no file to say what its columns are
    placed.limit(0).write.mode(mode).parquet(_columns(path))
    writer = placed.repartitionByRange(tasks, *dealt, *rest).sortWithinPartitions(*dealt).write.mode(mode)
    writer = writer.option(f"parquet.bloom.filter.enabled#{ids[0]}", True).option("parquet.bloom.filter.adaptive.enabled", True)
    writer = writer.options(**options)
    (writer.partitionBy(*folders) if folders else writer).parquet(path)


def _columns(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/_columns/{name}"


def layout_ledger(spark: SparkSession, path: str, **options) -> Ledger:
    """The ledger that :func:`write_layout` wrote. Products read only the folders that their days and ids allow."""
    return Ledger(**{name: _read(spark, f"{path}/{name}") for name in _written(spark, path)}, **options)


def _written(spark: SparkSession, path: str) -> list[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_columns")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {status.getPath().getName() for status in files.listStatus(folder)}
    return [name for name in TABLES if name in there]


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A table with the columns it was written with, whatever the session makes of folder names."""
    return spark.read.schema(spark.read.parquet(_columns(path)).schema).parquet(path)
