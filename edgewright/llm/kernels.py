"""Vectorised text kernels that run inside tasks on Arrow batches.

Each works on the UTF-8 bytes of many texts laid end to end (``buf``) with ``offs``, the n + 1 places
where they begin and end. Word and shingle identities are keyed 64-bit hashes that are not linear in the bytes:
two different words meet with probability near 2**-64 under a key drawn at random, whatever the texts.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once, unless a single text is longer.
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buf, offs) of consecutive runs of whole texts of about ``limit`` bytes."""
    buf, offs = texts(column)
    first, rows = 0, len(offs) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield first, end, buf[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end
    give_back()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: workers stay between stages, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on one another."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longest span, in bytes, that is hashed side by side with the others; longer ones are digested one by one.
SHORT = 64
#: Low bytes of a 64-bit word, by how many of them belong to the span.
_LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Drawn anew in each process: nobody can choose texts whose words meet. Hashes that leave a task need a key of the job's own.
PROCESS_KEY = os.urandom(16)
#: Where hashes must be the same in every job, as in a model's buckets.
FIXED_KEY = bytes(range(16))


class Spans:
    """Keyed hashes of byte spans of one buffer: eight bytes a step through two mixers, or BLAKE2b of a long span."""

    def __init__(self, buf: np.ndarray, key: bytes = PROCESS_KEY):
        self._buf, self._key = np.zeros(len(buf) + 8, dtype=np.uint8), key
        self._buf[: len(buf)] = buf
        self._wide = np.ndarray(len(buf) + 1, "<u8", self._buf, strides=(1,))  # the eight bytes from each place on
        self._keys = np.frombuffer(key, "<u8")

    def block(self, starts: np.ndarray, size: int) -> np.ndarray:
        """The ``size`` bytes, eight at most, from each place on as one number."""
        return self._wide[starts] & _LOW[size]

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        out = mix(sizes.astype(np.uint64) + self._keys[0])
        long = np.flatnonzero(sizes > SHORT)
        for k in range(0, SHORT, 8):
            live = np.flatnonzero((sizes > k) & (sizes <= SHORT)) if len(long) or k else np.flatnonzero(sizes > k)
            if not len(live):
                break
            block = self._wide[starts[live] + k] & _LOW[np.minimum(sizes[live] - k, 8)]
            out[live] = mix(mix(block ^ self._keys[1]) + out[live])
        for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
            out[i] = int.from_bytes(hashlib.blake2b(self._buf[a:b], digest_size=8, key=self._key).digest(), "little")
        return out


def at(offs: np.ndarray, n: int) -> np.ndarray:
    """The places of ``offs`` that lie inside a buffer of n bytes."""
    return offs[offs < n]


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes not in ``gap``, and the n + 1 places where each text's words begin."""
    inside = ~gap[buf]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = at(offs, len(buf))
    opens[edge] = inside[edge]
    edge = offs[offs > 0] - 1
    closes[edge] = inside[edge]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offs)


def owners(offs: np.ndarray) -> np.ndarray:
    """For each item of ragged rows with these offsets, its row."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words of every text, and where each text's windows begin."""
    counts = np.maximum(np.diff(first) - (size - 1), 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    here = np.arange(begins[-1]) + np.repeat(first[:-1] - begins[:-1], counts)
    out = np.zeros(len(here), dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[here + k] + np.uint64(k + 1))
    return out, begins


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of the values of each ragged row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for every start and length, laid end to end."""
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]
