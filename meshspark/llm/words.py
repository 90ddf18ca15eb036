"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A batch's texts lie one after another in one buffer.  Words are found and hashed by array operations over the
whole buffer, so that no Python code runs per word.  A word's hash is a polynomial in its bytes modulo 2**64,
finished by a bijective mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are held as arrays at once; a longer text is still taken whole.
PIECE = 1 << 21

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers = np.ones(1, U)


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker outlives its task, and its next one may need less."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = x + U((seed * 0xD1B54A32D192ED03 + BASE) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    """At least n powers of BASE."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * U(pow(BASE, len(_powers), 1 << 64))])
    return _powers


def pieces(column: pa.Array, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) of runs of rows of about `piece` bytes; null is empty."""
    if not len(column):
        return
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + piece, "right")) - 1)
        j = min(j, len(column))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, space: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): byte spans of the words, and bounds[d]:bounds[d+1] the words of text d."""
    inside = ~space[data]
    first = np.empty(len(data), bool)
    if len(data):
        first[0] = True
        first[1:] = ~inside[:-1]
        heads = off[:-1][np.diff(off) > 0]
        first[heads] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(len(data), bool)
    if len(data):
        last[-1] = True
        last[:-1] = ~inside[1:]
        last[heads[heads > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes."""
    if not len(starts):
        return np.zeros(0, U)
    length = ends - starts
    total = int(length.sum())
    head = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=head[1:])
    at = np.arange(total, dtype=np.int64) - np.repeat(head, length)
    values = data[np.repeat(starts, length) + at]
    if lower:
        values = _lower[values]
    terms = (values.astype(U) + U(1)) * powers(int(length.max()))[at]
    return mixed(np.add.reduceat(terms, head) + length.astype(U))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words; windows may cross texts."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    out = np.zeros(count, U)
    for j in range(n):
        out = mixed(out * U(BASE) + hashes[j : j + count])
    return out


#: How often a key occurs in its batch: once; several times, of which this is the first; or again after that.
ONCE, FIRST, AGAIN = 0, 1, 2


def local_state(keys: np.ndarray) -> np.ndarray:
    """ONCE, FIRST or AGAIN of every key of a batch.

    A key that occurs again is known to be shared, so only its first row must meet those of other batches: a key that
    holds a third of all rows costs an exchange no more than one row a batch.
    """
    _, first, where, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    state = np.full(len(keys), AGAIN, np.int8)
    state[first] = np.where(count > 1, FIRST, ONCE)
    return state


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over every `width` consecutive values."""
    done, out = 1, x
    while done * 2 <= width:
        out = op(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return op(out[: len(out) - rest], out[rest:]) if rest else out
