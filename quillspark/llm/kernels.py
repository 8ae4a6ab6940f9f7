"""Vectorised byte kernels that run inside Arrow tasks: rolling hashes over many texts at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

CHUNK_BYTES = 1 << 19
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, CHUNK_BYTES + 4096)
            self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, self.base, np.uint64), dtype=np.uint64)])
            self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, self.inverse, np.uint64), dtype=np.uint64)])
        return self.up, self.down


class Hasher:
    """Polynomial hashes of any spans of a byte array, from one prefix sum."""

    def __init__(self, which: int):
        self.powers, self.values = Powers(BASES[which]), byte_values(which + 1)
        self.prefix = self.down = np.zeros(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        up, self.down = self.powers.to(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * up[: len(data)], out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """The rows of a batch as Python values, a few at a time."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(*(part.column(k).to_pylist() for k in range(part.num_columns)), strict=True)


def text_chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Groups texts into chunks of some `limit` bytes: ids, all bytes with a blank after each text, and the start offsets.

    The text is the last column; several before it give tuples as ids. A longer text is a chunk of its own, never cut.
    """
    own, parts, offsets, size = [], [], [0], 0
    for *i, text in rows_of(batch):
        raw = (text or "").encode("utf-8", "surrogatepass") if not isinstance(text, bytes) else text
        if own and size + len(raw) > limit:
            yield own, np.frombuffer(b"".join(parts), np.uint8), np.array(offsets, np.int64)
            own, parts, offsets, size = [], [], [0], 0
        own.append(i[0] if len(i) == 1 else tuple(i))
        parts += [raw, b" "]
        size += len(raw) + 1
        offsets.append(size)
    if own:
        yield own, np.frombuffer(b"".join(parts), np.uint8), np.array(offsets, np.int64)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
