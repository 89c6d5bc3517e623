"""Overlaps of all pairs of texts: the number of seed keys that two texts have in common, whatever a key's occurrence.

Texts of equal sequences are one class. A class is one row with its set of keys; rows are packed into blocks of bounded
size, and each pair of blocks is counted by itself: the blocks are read where they are counted, nothing that grows with
the number of pairs is shuffled or kept, and a count needs a bounded part of a block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators import seeds
from strandweave.session import cut, free

#: Keys and texts of a block, and matches or cells that are counted at once.
KEYS, TEXTS, CELLS = 1 << 20, 1 << 14, 1 << 20
SETS = "id long, length long, digest binary, n long, keys binary"
BLOCK = "block long, ids binary, lengths binary, ends binary, keys binary"
INDEX = "other long, other_ids binary, other_lengths binary, sorted binary, edges binary, members binary"
PAIRS = "a long, b long, shared long"


def key_sets(texts: DataFrame, id_column: str, text_column: str = "text", k: int = seeds.K, s: int = seeds.S) -> DataFrame:
    """(id, length, digest, n, keys): the distinct keys of each text (keys of 32 bits, k up to 16), in order, and what its
    sequence is told by. Rows without an id are left out."""
    return seeds.rows_of(texts, id_column, text_column).mapInArrow(_setter(k, s), SETS)


def _setter(k: int, s: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        ranks, back = seeds.smer_ranks(s), seeds.reversed_words(s)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a, codes, edges, row, _, key, _ in seeds.found(batch.column("text"), ranks, back, k, s):
                one = np.unique(row << 2 * k | key)
                ends = np.searchsorted(one, np.arange(1, len(edges)) << 2 * k)
                begins = np.concatenate([[0], ends[:-1]])
                keys = (one & (1 << 2 * k) - 1).astype(np.uint32)
                digests = [hashlib.sha256(codes[x:y].tobytes()).digest() for x, y in zip(edges[:-1], edges[1:], strict=True)]
                sets = [keys[x:y].tobytes() for x, y in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + len(sets)]), pa.array(np.diff(edges)), pa.array(digests, pa.binary()), pa.array(ends - begins), pa.array(sets, pa.binary())], ["id", "length", "digest", "n", "keys"])

    return run


def _packer(most: int) -> Callable:
    """Blocks of rows (id, length, n, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids, lengths, n, keys = zip(*held, strict=True)
            ends = np.cumsum(np.array(n, np.int64))
            values = [np.array(ids, np.int64).tobytes(), np.array(lengths, np.int64).tobytes(), ends.tobytes(), b"".join(keys)]
            return pa.RecordBatch.from_arrays([pa.array([ids[0]]), *[pa.array([x], pa.binary()) for x in values]], ["block", "ids", "lengths", "ends", "keys"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("id", "length", "n", "keys")], strict=True):
                if held and (size + row[2] > most or len(held) == TEXTS):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += row[2]
        if held:
            yield block()

    return run


def _turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The inverted index of each block: its distinct keys, where the texts of each begin, and those texts."""
    for batch in batches:
        for block, ids, lengths, ends, keys in zip(*[batch.column(c).to_pylist() for c in ("block", "ids", "lengths", "ends", "keys")], strict=True):
            ends, keys = np.frombuffer(ends, np.int64), np.frombuffer(keys, np.uint32)
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            edges = np.append(first, len(keys)).astype(np.int32)
            values = [ids, lengths, distinct.tobytes(), edges.tobytes(), owner[order].astype(np.int16).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([x], pa.binary()) for x in values]], ["other", "other_ids", "other_lengths", "sorted", "edges", "members"])


def _counts(row: dict[str, pa.Buffer], least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of the block, text of the other block, shared) of the pairs with `least` common keys or more."""
    ends, keys = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["keys"], np.uint32)
    known, edges, members = np.frombuffer(row["sorted"], np.uint32), np.frombuffer(row["edges"], np.int32), np.frombuffer(row["members"], np.int16)
    width = row["other_ids"].size // 8
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1).astype(np.int32)
    own = known[at] == keys
    at = at[own]
    text = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))[own]
    begin, n = edges[at], np.diff(edges)[at]
    matches = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    last = np.searchsorted(text, np.arange(1, len(ends) + 1))  # where the keys of each text end
    a = 0
    while a < len(ends):
        lo = int(last[a - 1]) if a else 0
        b = int(np.searchsorted(matches[last], matches[lo] + most, side="right"))
        b = max(a + 1, min(b, len(ends), a + max(1, most // width)))
        cells, hi, x = None, int(last[b - 1]), lo
        while x < hi:  # one piece, but for a single text of very many matches
            y = max(x + 1, min(hi, int(np.searchsorted(matches, matches[x] + most, side="right")) - 1))
            size = n[x:y]
            place = np.arange(int(matches[y] - matches[x])) + np.repeat(begin[x:y] - (matches[x:y] - matches[x]), size)
            found = np.bincount(np.repeat((text[x:y] - a) * width, size) + members[place], minlength=(b - a) * width)
            cells = found if cells is None else cells + found
            x = y
        if cells is not None:
            hit = np.flatnonzero(cells >= least)
            yield a + hit // width, hit % width, cells[hit]
        a = b


def _counter(least: int, both: bool, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                same = row.pop("block").as_py() == row.pop("other").as_py()
                row = {c: x.as_buffer() for c, x in row.items()}
                ids, others = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["other_ids"], np.int64)
                lengths, far = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["other_lengths"], np.int64)
                for x, y, shared in _counts(row, least, most):
                    if same:
                        own = x < y
                        x, y, shared = x[own], y[own], shared[own]
                    a, b = ids[x], others[y]
                    first = (lengths[x] < far[y]) | (lengths[x] == far[y]) & (a < b)
                    for p, q, shorter in ((a, b, first), (b, a, ~first)):
                        keep = slice(None) if both else shorter
                        p, q, n = p[keep], q[keep], shared[keep]
                        for z in range(0, len(p), 1 << 16):
                            yield pa.RecordBatch.from_arrays([pa.array(v[z : z + (1 << 16)]) for v in (p, q, n)], ["a", "b", "shared"])

    return run


def overlaps(texts: DataFrame, id_column: str, least: int = 5, both: bool = True, block: int = KEYS, cells: int = CELLS) -> DataFrame:
    """(a, b, shared, copy): pairs of texts with `least` common keys or more.

    A class of equal sequences stands as its smallest id, and each other text of it is linked with that one (copy; shared
    is the number of its keys). both: each pair in both orders, otherwise from the shorter text, ties by id.
    """
    sets = cut(key_sets(texts, id_column))
    one = lambda c: F.any_value(c).alias(c)  # noqa: E731  equal within a class
    classes = cut(sets.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("id"), one("length"), one("n"), one("keys")))
    first = classes.select("digest", F.col("id").alias("first"))
    copies = cut(sets.select("digest", "id", F.col("n").alias("shared")).join(first, "digest").where(F.col("id") != F.col("first")).select("id", "first", "shared").distinct())
    free(sets)
    size = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = cut(classes.select("id", "length", "n", "keys").coalesce(max(1, -(-size // block))).mapInArrow(_packer(block), BLOCK))
    free(classes)
    index = cut(blocks.mapInArrow(_turn, INDEX))
    pairs = blocks.crossJoin(index).where(F.col("block") <= F.col("other")).mapInArrow(_counter(least, both, cells), PAIRS)
    found = pairs.select("a", "b", "shared", F.lit(False).alias("copy"))
    link = lambda a, b: copies.select(F.col(a).alias("a"), F.col(b).alias("b"), "shared", F.lit(True).alias("copy"))
    found = found.unionByName(link("first", "id"))
    return found.unionByName(link("id", "first")) if both else found
