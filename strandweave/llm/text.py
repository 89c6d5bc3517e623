"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than ASCII white space; A-Z are lower-cased. All hashes are 64-bit and depend on
the bytes alone, so they agree between tasks, machines and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SHINGLE = 5
_BASE = U(0x9E3779B97F4A7C15 | 1)
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=U)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i < n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows holding about `limit` bytes of the column each; a longer row comes alone."""
    sizes = np.cumsum(np.frombuffer(_lengths(batch.column(column)), dtype=np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def gathered(batches: Iterator[pa.RecordBatch], rows: int, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `rows` rows, or `most` bytes, for work whose cost is mostly by the batch."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= most:
            yield pa.concat_batches(held)
            held, n, size = [], 0, 0
    if n:
        yield pa.concat_batches(held)


def _lengths(column: pa.Array) -> bytes:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; nulls count as empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of words before each row (one more entry than rows)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = np.ones(len(data) + 2, dtype=bool)
    word[1:-1] = ~space
    word[0] = word[-1] = False
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    inside = word[1:-1]
    begins = np.flatnonzero(inside & (~word[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside & (~word[2:] | cut[1:])) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; the cost does not depend on how spans overlap."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(U) * _STEP[0])


def runs(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of words; the cost does not depend on overlaps."""
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(U))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word of every row, and the rows' bounds in them."""
    data, offsets = raw(column)
    data = lower(data)
    begins, ends, bounds = spans(data, offsets)
    return span_hashes(data, begins, ends), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` words and the rows' bounds; a row of fewer words has its whole sequence as one run."""
    count = np.diff(bounds)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    if not len(words):
        return np.zeros(0, U), out_bounds
    padded = np.concatenate([words, np.zeros(width, U)])
    rolling = np.zeros(len(words), dtype=U)
    for j in range(width):
        rolling += mix(padded[j : j + len(words)] + _STEP[j]) * _STEP[(j + 1) % 5]
    first = np.repeat(bounds[:-1] - out_bounds[:-1], made) + np.arange(out_bounds[-1])
    out = mix(rolling[first])
    for row in np.flatnonzero((count > 0) & (count < width)):
        h = U(0x5851F42D4C957F2D)
        for w in words[bounds[row] : bounds[row + 1]]:
            h = mix(np.array([h ^ w], dtype=U) * _STEP[3])[0]
        out[out_bounds[row]] = h
    return out, out_bounds


def least(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum of each row's values; rows without any get the largest value."""
    out = np.full(len(bounds) - 1, np.iinfo(values.dtype).max, dtype=values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.minimum.reduceat(values, bounds[:-1][full])
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """A 2-D array as one binary value for each row."""
    width = rows.shape[1] * rows.itemsize
    flat = np.ascontiguousarray(rows).tobytes()
    return pa.Array.from_buffers(pa.binary(), rows.shape[0], [None, pa.py_buffer(np.arange(0, (rows.shape[0] + 1) * width, max(width, 1), dtype=np.int32)[: rows.shape[0] + 1].tobytes()), pa.py_buffer(flat)])


def sets(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets of the values in each range, and the sets' values, sorted in each, one set after the other."""
    size = (ends - begins)[:, None]
    at = np.arange(int(size.max(initial=0)))
    rows = np.where(at < size, values[np.minimum(begins[:, None] + at, len(values) - 1)], np.iinfo(values.dtype).max)
    rows.sort(axis=1)
    keep = at < size
    keep[:, 1:] &= rows[:, 1:] != rows[:, :-1]
    return keep.sum(axis=1), rows[keep]


def lists_of_bytes(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive values, `sizes` of them at a time, as one binary value each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


#: What operators keep in a worker between tasks, by name.
stores: dict[str, dict] = {}


def tidied(run, own: str = ""):
    """A mapInArrow function that gives freed memory back to the system when its task ends; workers are reused.

    Stores that other operators left in the worker are emptied first; `own` names the store of this one.
    """

    def wrapped(batches):
        from strandweave.llm import text  # the worker's module, whose stores are filled

        for name, store in text.stores.items():
            if name != own:
                store.clear()
        try:
            yield from run(batches)
        finally:
            import contextlib
            import ctypes

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped
