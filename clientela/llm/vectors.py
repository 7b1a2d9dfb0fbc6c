"""Integer vectors as tables, and sets of query vectors in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.llm.shared import stored

# bytes of query vectors that every task holds at a time
CHUNK_BYTES = 16 << 20
# integers up to here are exact as doubles, and so are their sums
_EXACT = 1 << 53


def _quantised(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            values = np.asarray(lists.values.cast(pa.float64()).fill_null(float("nan")))
            starts = np.asarray(lists.offsets).astype(np.int64)
            with np.errstate(over="ignore"):
                values = np.floor(scale * values)
            # a row with a value that is no number takes no part
            wrong = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            fine = wrong[starts[1:]] == wrong[starts[:-1]]
            if np.abs(values[np.isfinite(values)]).max(initial=0) >= 2**62:
                raise OverflowError("a scaled component exceeds what a long holds")
            whole = np.where(np.isfinite(values), values, 0).astype(np.int64)
            vectors = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(whole))
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=batch.schema.names)
            yield out.filter(pa.array(fine))

    return run


def integer_vectors(df: DataFrame, scale: int, **columns: Column) -> DataFrame:
    """(*columns, vector): ``floor(scale * x)`` of every component of ``columns['vector']``, as a table.

    Rows with a null in one of ``columns``, or a null, infinite or NaN component, take no part; further
    columns of ``df`` cannot clash. An id (the first of ``columns``) names one vector: of rows that repeat it
    the least one by the other columns stands. Components beyond 2^62 are an error.
    """
    (key, *others) = columns
    rest = [c for c in others if c != "vector"]
    chosen = df.select(*(c.alias(n) for n, c in columns.items() if n != "vector"), columns["vector"].cast("array<double>").alias("vector"))
    chosen = chosen.dropna()
    schema = ", ".join([*(f"{n} {dict(chosen.dtypes)[n]}" for n in (key, *rest)), "vector array<bigint>"])
    table = stored(chosen.mapInArrow(_quantised(scale), schema))
    if table.groupBy(key).count().filter("count > 1").isEmpty():
        return table
    # copies of an id are reduced where they are before the id's rows meet
    one = table.groupBy(key).agg(F.min(F.struct("vector", *rest)).alias("r"))
    return stored(one.select(key, *(f"r.{n}" for n in rest), "r.vector"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, 0))
    for batch in batches:
        rows = matrix(batch.column("vector")).astype(np.float64)
        if rows.shape[1] > total.shape[1]:
            total = np.pad(total, ((0, 0), (0, rows.shape[1] - total.shape[1])))
        total[:, : rows.shape[1]] += [np.full(rows.shape[1], len(rows)), rows.sum(axis=0), np.square(rows).sum(axis=0)]
    columns = [np.arange(total.shape[1]), *total]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["axis", "n", "total", "squares"])


def axes_by_variance(vectors: DataFrame) -> list[int]:
    """Numbers of all coordinates, those of greatest variance first: one row a coordinate comes back."""
    sums = vectors.select("vector").mapInArrow(_moments, "axis long, n double, total double, squares double")
    rows = sums.groupBy("axis").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("s")).collect()
    return [r.axis for r in sorted(rows, key=lambda r: ((r.t / r.n) ** 2 - r.s / r.n, r.axis))]


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as a matrix of longs; shorter vectors end in zeros, longer ones are cut at ``width``.

    Cutting changes no inner product with vectors of ``width`` components.
    """
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    values = np.asarray(lists.flatten())
    most = int(sizes.max(initial=0))
    if len(sizes) and (sizes == most).all():
        full = values.reshape(len(sizes), most)
    else:
        full = np.zeros((len(sizes), most), np.int64)
        full[np.arange(most) < sizes[:, None]] = values
    if width is None or width == most:
        return full
    out = np.zeros((len(sizes), width), np.int64)
    out[:, : min(width, most)] = full[:, :width]
    return out


def arithmetic(a: np.ndarray, b: np.ndarray) -> type:
    """The type in which inner products of rows of ``a`` and ``b`` are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most >= 1 << 63:
        raise OverflowError("an inner product may exceed what a long holds")
    return np.float64 if most < _EXACT else np.int64


@dataclass
class Chunk:
    """Query vectors that travel to every task together: ids, further columns, and a matrix of longs."""

    ids: np.ndarray
    columns: dict[str, np.ndarray]
    rows: np.ndarray

    @property
    def width(self) -> int:
        return self.rows.shape[1]


def chunks(queries: DataFrame, key: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[DataFrame, Chunk]]:
    """Queries in groups by a hash of the id, of ``limit`` bytes each on average, and each group's vectors.

    Only one group at a time is at the driver. Their number grows with the queries, their size does not.
    """
    count, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    groups = -(-count * max(1, width or 1) * 8 // limit)
    for group in range(groups):
        part = queries.filter(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(groups)) == group)
        found = part.toArrow().combine_chunks()
        if not found.num_rows:
            continue
        lists = found.column("vector").combine_chunks()
        rows = matrix(lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists)
        columns = {n: found.column(n).to_numpy() for n in found.column_names if n not in (key, "vector")}
        yield part, Chunk(found.column(key).to_numpy(), columns, rows)
