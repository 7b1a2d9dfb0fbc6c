"""Byte-level BPE in DuckDB, inside each task: pieces become rows of token and position, a recursive
query contracts each piece's leftmost pair of least rank until none is left, and an ordered
aggregation turns ids back into bytes.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm.shared import documents_of, held, slices

SLICE = 2 << 20
# bytes that one recursive query contracts and rows it may keep, and pieces after which a worker forgets
QUERY_BYTES, QUERY_ROWS, REMEMBERED = 200_000, 6_000_000, 400_000
# ids that one query decodes
DECODED_IDS = 250_000
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

# k: piece and position in one number, nxt: the id behind, -1 at the end; positions stay without gaps. What comes out
# are the last rows of each piece
CONTRACT = """
WITH RECURSIVE tokens AS (
  SELECT 0::SMALLINT AS step, (w << 32) + generate_subscripts(ids, 1) AS k, unnest(ids)::INTEGER AS id,
    unnest(list_append(ids[2:], -1))::INTEGER AS nxt
  FROM pieces
  UNION ALL
  SELECT (step + 1)::SMALLINT, k - (k > first)::BIGINT, CASE WHEN k = first THEN merged ELSE id END,
    CASE WHEN k = first THEN behind WHEN k + 1 = first THEN merged ELSE nxt END
  FROM tokens t JOIN (
    SELECT w, first, merged, b.nxt AS behind
    FROM (
      SELECT w, (w << 32) + (best & 4294967295) AS first, (best >> 32)::INTEGER AS merged
      FROM (
        SELECT a.k >> 32 AS w, min((m.merged << 32) + (a.k & 4294967295)) AS best
        FROM tokens a JOIN merges m ON m.pair = (a.id::BIGINT << 32) + a.nxt
        GROUP BY a.k >> 32
      )
    ) JOIN tokens b ON b.k = first + 1
  ) s ON s.w = t.k >> 32
  WHERE k <> first + 1 AND step < {steps}
)
SELECT k >> 32 AS w, id, tokens.step
FROM tokens JOIN (SELECT k >> 32 AS w, max(step) AS step FROM tokens GROUP BY 1) last ON last.w = k >> 32 AND last.step = tokens.step
ORDER BY k
"""
DECODE = """
SELECT d, string_agg(text, '' ORDER BY pos) AS text
FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1)::INTEGER AS pos FROM docs) JOIN vocabulary USING (id)
GROUP BY d
"""


def read_ranks(path: str) -> bytes:
    """The rank file's content: one base64 token and its rank a line."""
    with open(path, "rb") as file:
        return file.read()


def _lists(sizes: list[int] | np.ndarray, values: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


class _Engine:
    """A worker's DuckDB with the vocabulary and the merge table, and the pieces it has met lately."""

    def __init__(self, content: bytes, pattern: str):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        # ids of pieces as bytes; when ``known`` is full it becomes ``before``, and what is met again returns
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '250MB'; SET temp_directory = ''; SET preserve_insertion_order = false")
        pairs = [(a, b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        self.table("vocabulary", id=pa.array(ranks.values(), pa.int32()), text=pa.array([t.decode("latin-1") for t in ranks]))
        self.table("merges", pair=pa.array([a << 32 | b for a, b, _ in pairs], pa.int64()), merged=pa.array([r for *_, r in pairs], pa.int64()))

    def table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("arrow_rows", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def contract(self, pieces: list[str]) -> None:
        """Remember the ids of pieces; one that is a token as a whole is that token."""
        raw = [p.encode() for p in pieces]
        whole = list(map(self.ranks.get, raw))
        self.known.update((p, r.to_bytes(4, sys.byteorder)) for p, r in zip(pieces, whole) if r is not None)
        # pieces as bytes, or as the ids that they have come to
        left: list[tuple[str, bytes | np.ndarray]] = [(p, b) for p, b, r in zip(pieces, raw, whole) if r is None]
        limit = QUERY_BYTES
        while left:
            some, size = [], 0
            while left and (not some or size + len(left[-1][1]) <= limit):
                some.append(left.pop())
                size += len(some[-1][1])
            try:
                left += self.contracted(some, size)
            except duckdb.OutOfMemoryException:
                if len(some) == 1:
                    raise
                left += some
                limit = size // 2  # nothing is spilled: fewer pieces at a time

    def contracted(self, some: list[tuple[str, bytes | np.ndarray]], size: int) -> list[tuple[str, np.ndarray]]:
        """Remember pieces by one query, which takes a bounded number of steps; those not at their end come back."""
        if all(type(ids) is bytes for _, ids in some):
            values = self.of_byte[np.frombuffer(b"".join(b for _, b in some), np.uint8)]
        else:
            values = np.concatenate([self.of_byte[np.frombuffer(b, np.uint8)] if type(b) is bytes else b for _, b in some])
        steps = max(1, min(QUERY_ROWS // size, 30_000))
        self.table("pieces", w=pa.array(np.arange(len(some))), ids=_lists([len(b) for _, b in some], values))
        done = self.db.sql(CONTRACT.format(steps=steps)).to_arrow_table()
        ids = done.column("id").to_numpy().astype(np.int32)
        ends = np.searchsorted(done.column("w").to_numpy(), np.arange(len(some) + 1))
        packed, bounds = ids.tobytes(), (4 * ends).tolist()
        ended = done.column("step").to_numpy()[ends[:-1]] < steps
        if ended.all():
            self.known.update((p, packed[a:b]) for (p, _), a, b in zip(some, bounds[:-1], bounds[1:]))
            return []
        self.known.update((p, packed[a:b]) for (p, _), a, b, e in zip(some, bounds[:-1], bounds[1:], ended.tolist()) if e)
        return [(some[i][0], ids[ends[i] : ends[i + 1]].astype(np.int64)) for i in np.flatnonzero(~ended).tolist()]

    def encode(self, texts: list[str]) -> pa.Array:
        found = [self.pattern.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        new = set().union(*found).difference(self.known)
        again = new & self.before.keys()
        self.known.update((p, self.before[p]) for p in again)
        self.contract(list(new - again))
        encoded = [b"".join(map(self.known.__getitem__, pieces)) for pieces in found]
        return _lists([len(e) // 4 for e in encoded], np.frombuffer(b"".join(encoded), np.int32))

    def rest(self) -> None:
        """Forget what was met longest ago: the worker may wait beside those of other stages."""
        self.before = {}

    def decode(self, ids: pa.Array) -> list[bytes]:
        """Bytes of each list of ids; a query takes a bounded number of ids, of long lists a range at a time."""
        sizes, values = pa.compute.list_value_length(ids).fill_null(0).to_pylist(), np.asarray(ids.flatten())
        out: list[list[bytes]] = [[] for _ in sizes]
        owners, bounds = [], [0]
        for owner, size in enumerate(sizes):
            cuts = range(bounds[-1] + DECODED_IDS, bounds[-1] + size, DECODED_IDS)
            end = bounds[-1] + size
            for cut in [*cuts, end] if size else []:
                owners.append(owner)
                bounds.append(cut)
        low = 0
        while low < len(owners):
            high = low + 1
            while high < len(owners) and bounds[high + 1] - bounds[low] <= DECODED_IDS:
                high += 1
            self.table("docs", d=pa.array(np.arange(low, high)), ids=_lists(np.diff(bounds[low : high + 1]), values[bounds[low] : bounds[high]]))
            done = self.db.sql(DECODE).to_arrow_table()
            texts = dict(zip(done.column("d").to_pylist(), done.column("text").to_pylist()))
            for d in range(low, high):
                out[owners[d]].append(texts[d].encode("latin-1"))
            low = high
        return [b"".join(parts) for parts in out]


def _engine(content: bytes, pattern: str) -> _Engine:
    return held((content, pattern), lambda: _Engine(content, pattern))


def _encoded(engine: _Engine, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE, keep=True):
        ids = engine.encode(part.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids.cast(_ENCODED.field("ids").type)], schema=_ENCODED)


def _decoded(engine: _Engine, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        ids = part.column("ids")
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(engine.decode(ids), pa.binary())], schema=_DECODED)


def encode(documents: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text, each match of ``pattern`` on its own.

    No special tokens: their strings are ordinary text. Null and empty texts have no ids; repeated rows
    come out as often; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(ranks, pattern)
        yield from _encoded(engine, batches)
        engine.rest()

    return documents_of(documents).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Add ``decoded`` (binary) to (doc_id, ids); null or no ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decoded(_engine(ranks, pattern), batches)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(documents: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): :func:`decode` of what :func:`encode` gives, by one worker for each task.

    Two steps in a row would be two workers at once, each with a DuckDB and the pieces it remembers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine(ranks, pattern)
        yield from _decoded(engine, _encoded(engine, batches))
        engine.rest()

    return documents_of(documents).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, *further: str) -> DataFrame:
    """(doc_id, n_tokens, further columns, ids_sha256, decoded_sha256) of (doc_id, ids, decoded)."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        *further,
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
