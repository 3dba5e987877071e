"""Helpers that work on blocks of whole texts with numpy, inside Spark tasks.

A block is a list of texts laid end to end in one array. Spark decides which
rows meet in a task; a block only bounds the memory of one step of that task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text makes a block of its own.
BLOCK_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
#: Masks of the first 0 to 8 bytes of a piece.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _BASE, inverse
    with np.errstate(over="ignore"):
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
    return up, down


def _loaded(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of data on, as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[start:end] for each span, equal for equal contents."""
    return span_names(symbols, starts, ends, 1)[0]


def span_names(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int = 2, salt: int = 0) -> list[np.ndarray]:
    """`count` independent 64-bit hashes of symbols[start:end] for each span.

    A span is taken by pieces of eight bytes; each piece is mixed with its place and
    a salt, and the sum is mixed once more. No polynomial is involved, so that
    regular strings (of one long pattern and its complement) stay apart.
    """
    wide = symbols.dtype.itemsize
    words = _loaded(np.ascontiguousarray(symbols).view(np.uint8))
    at, size = starts * wide, (ends - starts) * wide
    head = words[at]
    head &= _LOW_BYTES[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        first = np.cumsum(more) - more
        turn = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        tail = words[np.repeat(at[long], more) + 8 * turn] & _LOW_BYTES[np.minimum(np.repeat(size[long], more) - 8 * turn, 8)]
    out = []
    for k in range(count):
        key = mix64(np.array([_BASE + 8 * (salt * count + k) + wide], np.uint64))[0]
        total = head ^ key
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
        if len(long):
            total[long] += np.add.reduceat(mix64(tail ^ mix64(turn.astype(np.uint64) + key)), first)
        total ^= size.astype(np.uint64) << np.uint64(40)
        out.append(mix64(total))
    return out


def window_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of symbols[i:i+width] for each i with a whole window."""
    n = len(symbols)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers(max(1 << 20, 1 << n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix64((total[width:] - total[:-width]) * down[: n - width + 1])


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, re-cut so that one batch holds about `limit` bytes of `column`."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        if batch.num_rows:
            col = batch.column(batch.schema.get_field_index(column))
            sizes[:] = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += size
        if at < batch.num_rows:
            yield batch.slice(at)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null text counts as an empty one."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points with one separator place after each text, and each text's start (plus the end)."""
    joined = "\0".join(texts) + "\0" if texts else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return points, bounds


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def byte_block(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with a line feed after each, and each text's start (plus the end)."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", np.uint8)
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in raw], out=bounds[1:])
    return data, bounds


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space; data ends with white space."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def csr_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs numbered `pick`; also the length of each."""
    n = lengths[pick]
    total = int(n.sum())
    before = np.cumsum(n) - n
    at = np.arange(total) + np.repeat(starts[pick] - before, n)
    return values[at], n
