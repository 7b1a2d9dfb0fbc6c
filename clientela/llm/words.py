"""Words of many texts as numpy arrays of 64-bit hashes; used inside Arrow tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_ODD), -1, 1 << 64)
    up, down = np.full(_BLOCK + 1, _ODD), np.full(_BLOCK + 1, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers()
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


class Words:
    """Words of a run of texts: byte ranges in ``data``; text ``i`` begins at
    ``begins[i]`` and has words ``first[i]:first[i + 1]``."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        space = _SPACE[self.data]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            change = np.concatenate(([0], change))
        self.starts, self.ends = change[0::2], change[1::2]
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.begins)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold_case: bool) -> np.ndarray:
        """A hash of each word, of A-Z in lower case if ``fold_case``."""
        table, starts, ends = _FOLDED if fold_case else _BYTES, self.starts, self.ends
        out, low = np.empty(len(starts), np.uint64), 0
        while low < len(starts):
            base = starts[low]
            high = int(np.searchsorted(ends, base + _BLOCK, "right"))
            if high <= low:
                word = self.data[base : ends[low]].tobytes()
                word = word.translate(_LOWER) if fold_case else word
                out[low] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
                low += 1
                continue
            s, e = starts[low:high] - base, ends[low:high] - base
            sums = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(table[self.data[base : ends[high - 1]]] * _UP[: len(sums) - 1], out=sums[1:])
            out[low:high] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64))
            low = high
        return out


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each sequence ``hashes[starts[i]:ends[i]]``; ``starts`` must ascend."""
    out, low = np.empty(len(starts), np.uint64), 0
    while low < len(starts):
        base = starts[low]
        high = low + int(np.searchsorted(ends[low:] if len(ends) else ends, base + _BLOCK, "right"))
        if high <= low:
            whole = hashlib.blake2b(hashes[base : ends[low]].tobytes(), digest_size=8).digest()
            out[low] = int.from_bytes(whole, "little")
            low += 1
            continue
        s, e = starts[low:high] - base, ends[low:high] - base
        top = int(e.max())
        sums = np.zeros(top + 1, np.uint64)
        np.cumsum(hashes[base : base + top] * _UP[:top], out=sums[1:])
        out[low:high] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64) * _ODD)
        low = high
    return out


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all ``width``-word windows that stay inside a text, and the text of each."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][text] + offset, text


def texts_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sets_of(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles, A-Z in lower case.

    A text of fewer words has its whole sequence as the one shingle; one without words has none.
    """
    words = Words(texts)
    hashes = words.hashes(fold_case=True)
    starts, text = windows(words.first, width)
    grams = sequence_hashes(hashes, starts, starts + width)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        if bounds[i + 1] > bounds[i]:
            yield np.unique(grams[bounds[i] : bounds[i + 1]])
        else:
            low, high = words.first[i : i + 1], words.first[i + 1 : i + 2]
            yield sequence_hashes(hashes, low, high) if high[0] > low[0] else np.empty(0, np.uint64)
