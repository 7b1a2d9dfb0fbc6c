"""Helpers of all operators: tables in the shared folder, plain document columns, bounded slices."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.operators.membership import SKETCHED_KEYS, key_sketch, perhaps_in, surely_out

# words of every operator: runs of anything but space, tab, line feed, vertical tab, form feed and return
WORD = r"[^\x20\x09-\x0D]+"
# bytes of text that a Python worker turns into arrays at a time
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``, removed when the driver ends.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    found = getattr(spark, "_clientela_llm_folder", None)
    if found:
        return found
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        top = tempfile.mkdtemp(prefix="clientela-llm-")
    folder = f"{top}/clientela-llm-{uuid.uuid4().hex}"
    spark._clientela_llm_folder = folder
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Compute once, as a Parquet table in the shared folder: a lost executor recomputes nothing."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents_of(df: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty) alone, so that further columns cannot clash.

    Rows without ``doc_id`` name no document and are left out.
    """
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")


def narrowed(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` may be in the table ``keys``: all that are and, of up to ``SKETCHED_KEYS`` keys, few others.

    A sketch is sent to the rows, so that those which it leaves out need not be shuffled for a join.
    """
    if keys.count() > SKETCHED_KEYS:
        return rows
    return perhaps_in(rows, key, stored(key_sketch(keys, key)))


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not in the table ``keys``; rows without a key stay.

    Of up to ``SKETCHED_KEYS`` keys a sketch is sent to the rows, which are read twice: only those that it does not rule out
    are shuffled.
    """
    if keys.count() > SKETCHED_KEYS:
        return rows.join(keys, key, "left_anti")
    sketch = stored(key_sketch(keys, key))
    return surely_out(rows, key, sketch).union(perhaps_in(rows, key, sketch).join(keys, key, "left_anti").select(rows.columns))


def fold(modulus: int) -> Column:
    """crc32 of the decimal ``doc_id``, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


# what this worker keeps from task to task, of one operator at a time
_held: dict = {}


def held(key: tuple, make: Callable):
    """``make()``, kept for this worker's next tasks until :func:`slices` begins a task that does not ask for it."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of at most ``limit`` bytes of ``column`` (one row at least).

    What the worker holds for another operator goes, unless ``keep``.
    """
    if not keep:
        _held.clear()
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, where they may not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_clientela_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="clientela-code-")) / "clientela_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._clientela_shipped = True


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
