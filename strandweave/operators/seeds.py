"""Closed-syncmer seeds.

A k-mer is a seed where its first or its last s-mer has the least order of all its s-mers; s-mers are ordered by a mixing
hash of their canonical code. K-mers with N and palindromes are no seeds. The extractor is one vectorised pass over
Arrow batches that emits seeds only, so nothing like one row a base is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import hashes
from strandweave.session import ship

K, S = 15, 5
CODES = np.full(128, 4, dtype=np.int8)
CODES[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = np.arange(26) % 4
CODES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = np.arange(26) % 4
CODES[32] = 3


def smer_ranks(s: int) -> np.ndarray:
    """The rank of every s-mer's canonical code by a 64-bit mixing hash."""
    code = np.arange(4**s, dtype=np.uint64)
    h = hashes.mix(code)
    rank = np.empty(4**s, dtype=np.int64)
    rank[np.argsort(h)] = np.arange(4**s)
    other = np.zeros_like(code)
    for j in range(s):
        other |= (np.uint64(3) - (code >> np.uint64(2 * j) & np.uint64(3))) << np.uint64(2 * (s - 1 - j))
    return rank[np.minimum(code, other).astype(np.int64)]


def words(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of each run of `width` bases (12 at most), and the number of bad bases before each place."""
    n = len(codes) - width + 1
    code = np.zeros(n, np.int32)
    for j in range(width):
        code = code << 2 | (codes[j : j + n] & 3)
    bad = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(codes > 3, out=bad[1:])
    return code, bad


def least_of(order: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours, by doubling."""
    have = 1
    while have < span:
        step = min(have, span - have)
        order = np.minimum(order[:-step], order[step:])
        have += step
    return order


def reversed_words(s: int) -> np.ndarray:
    """The reverse complement of every s-mer's code."""
    code = np.arange(4**s, dtype=np.int64)
    other = np.zeros_like(code)
    for j in range(s):
        other = other << 2 | (3 - (code >> 2 * j & 3))
    return other


def extract(codes: np.ndarray, ranks: np.ndarray, k: int = K, s: int = S, back: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, key, orientation) of the seeds of a code array; back: reversed_words(s), if at hand.

    The k-mers themselves are put together at the places of seeds only, from their s-mers.
    """
    if len(codes) < k:
        return (np.zeros(0, np.int64),) * 3
    back = reversed_words(s) if back is None else back
    small, bad = words(codes, s)
    top = np.iinfo(np.int32).max
    order = np.where(bad[s:] == bad[: len(small)], ranks.astype(np.int32)[small], top)
    n, span = len(codes) - k + 1, k - s + 1
    least = least_of(order, span)
    at = np.flatnonzero((least < top) & ((order[:n] == least) | (order[span - 1 : span - 1 + n] == least)))
    at = at[bad[at + k] == bad[at]]
    forward, reverse = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for j in range(0, k - s + 1, s):
        word = small[at + j]
        forward = forward << 2 * s | word
        reverse |= back[word] << 2 * j
    for j in range(k - k % s, k):
        base = codes[at + j].astype(np.int64)
        forward = forward << 2 | base
        reverse |= (3 - base) << 2 * j
    own = forward != reverse
    at, forward, reverse = at[own], forward[own], reverse[own]
    return at, np.minimum(forward, reverse), (reverse < forward).astype(np.int64)


#: Codes of the bytes of UTF-8; a character beyond ASCII counts once, by its first byte.
BYTES = np.concatenate([CODES, np.full(128, 4, np.int8)])


def coded(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, codes, edges) of pieces of a text column, of about `most` bytes or one text; a null text is empty.

    Text i of a piece is codes[edges[i]:edges[i + 1]].
    """
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(edges, int(edges[a]) + most, side="right")) - 1)
        raw, own = text[edges[a] : edges[b]], (edges[a : b + 1] - edges[a]).astype(np.int64)
        codes = BYTES[raw]
        if len(raw) and raw.max() > 127:
            first = (raw & 0xC0) != 0x80
            own = np.concatenate([[0], np.cumsum(first)])[own]
            codes = codes[first]
        yield a, codes, own
        a = b


def found(column: pa.Array, ranks: np.ndarray, back: np.ndarray, k: int, s: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, codes, edges, row, position, key, orientation) of the seeds of each piece of a text column."""
    for a, codes, edges in coded(column):
        at, key, z = extract(codes, ranks, k, s, back)
        row = np.searchsorted(edges, at, side="right") - 1
        own = at + k <= edges[row + 1]  # not across two texts
        row, at = row[own], at[own]
        yield a, codes, edges, row, at - edges[row], key[own], z[own]


def _extractor(k: int, s: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, back = smer_ranks(s), reversed_words(s)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a, _, _, row, pos, key, z in found(batch.column("text"), ranks, back, k, s):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + row]), pa.array(pos.astype(np.int32)), pa.array(key), pa.array(z.astype(np.int32))], ["id", "pos", "key", "z"])

    return run


def _distinct(k: int, s: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, back = smer_ranks(s), reversed_words(s)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a, _, _, row, _, key, _ in found(batch.column("text"), ranks, back, k, s):
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                first = np.ones(len(row), bool)
                first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                at = np.flatnonzero(first)
                n = np.diff(np.append(at, len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(ids[a + row[at]]), pa.array(n.astype(np.int64))], ["key", "id", "n"])

    return run


def _counter(k: int, s: int, most: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, back = smer_ranks(s), reversed_words(s)
        parts: list[np.ndarray] = []
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            for a in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)].astype(np.int64))], ["key", "n"])

        for batch in batches:
            for _, _, _, _, _, key, _ in found(batch.column("text"), ranks, back, k, s):
                parts.append(key)
                held += len(key)
                if held >= most:
                    yield from counted()
                    parts, held = [], 0
        if parts:
            yield from counted()

    return run


def rows_of(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text) of the rows with an id."""
    ship(texts.sparkSession)
    return texts.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))


def seeds(texts: DataFrame, id_column: str, text_column: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(id, pos, key, z) of the closed syncmers of each text; rows without an id are left out."""
    return rows_of(texts, id_column, text_column).mapInArrow(_extractor(k, s), "id long, pos int, key long, z int")


def distinct_keys(texts: DataFrame, id_column: str, text_column: str = "text", k: int = K, s: int = S) -> DataFrame:
    """(key, id, n): how often each text has each of its keys, a row for each; texts that share an id have rows each."""
    return rows_of(texts, id_column, text_column).mapInArrow(_distinct(k, s), "key long, id long, n long")


def key_counts(texts: DataFrame, id_column: str, text_column: str = "text", k: int = K, s: int = S, most: int = 1 << 22) -> DataFrame:
    """(key, occ) of the seeds of all texts. A task counts up to `most` seeds at once, so a key is a row each time, not a
    row each seed."""
    counted = rows_of(texts, id_column, text_column).mapInArrow(_counter(k, s, most), "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("occ"))


def reverse_lane(query_seeds: DataFrame, lengths: DataFrame, k: int = K) -> DataFrame:
    """Seeds projected to the reverse lane's coordinates; key and z stay."""
    return query_seeds.join(lengths, "id").withColumn("pos", F.col("length") - k - F.col("pos")).drop("length")


def tandem(query_seeds: DataFrame) -> DataFrame:
    """Seeds with whether a neighbouring seed of the same text has the same key."""
    w = Window.partitionBy("id").orderBy("pos")
    same = F.coalesce(F.lag("key").over(w) == F.col("key"), F.lit(False)) | F.coalesce(F.lead("key").over(w) == F.col("key"), F.lit(False))
    return query_seeds.withColumn("tandem", same)


def drop_repeats(query_seeds: DataFrame, most: int = 3, share: float = 0.01) -> DataFrame:
    """Without keys that occur more than `most` times and in more than `share` of a query's seeds."""
    each, whole = Window.partitionBy("id", "key"), Window.partitionBy("id")
    counted = query_seeds.withColumn("_n", F.count("*").over(each)).withColumn("_all", F.count("*").over(whole))
    return counted.where(~((F.col("_n") > most) & (F.col("_n") > share * F.col("_all")))).drop("_n", "_all")


def thin(query_seeds: DataFrame, n: int) -> DataFrame:
    """Seeds whose key's mixing hash is a multiple of n: a sample of keys, whatever their letters."""
    return query_seeds.where(hashes.kept_by_hash(F.col("key"), n))


def stretch_count(length: Column, stretch: int) -> Column:
    """Number of stretches of a query: a remainder of less than half a stretch joins the last whole one."""
    whole = F.greatest(F.lit(1), F.floor(length / stretch).cast("int"))
    rest = length - whole * stretch
    return whole + F.when((rest > 0) & (2 * rest >= stretch), 1).otherwise(0)


def in_stretches(query_seeds: DataFrame, lengths: DataFrame, stretch: int) -> DataFrame:
    """query_seeds with the stretch of the query that each lies in."""
    at = F.least(F.floor(F.col("pos") / stretch).cast("int"), stretch_count(F.col("length"), stretch) - 1)
    return query_seeds.join(lengths, "id").withColumn("stretch", at).drop("length")


def window(query_seeds: DataFrame, begin: int, end: int, k: int = K, thinned: int = 1) -> DataFrame:
    """Seeds that lie wholly in [begin, end), with positions from begin, thinned by key where asked."""
    inside = query_seeds.where((F.col("pos") >= begin) & (F.col("pos") <= end - k)).withColumn("pos", F.col("pos") - begin)
    return thin(inside, thinned) if thinned > 1 else inside


def readmitted(query_seeds: DataFrame, occ: DataFrame, lengths: DataFrame, cap: int, dist: int, k: int = K, most: int = 128, highest: int = 4095) -> DataFrame:
    """(id, pos) of seeds over the cap that come back: of each streak of them the rarest, one for each `dist` bases.

    A streak runs between seeds within the cap; its length is that between their ends, or the query's ends. Seeds that
    the index lacks are not looked at.
    """
    rows = query_seeds.join(occ, "key").join(lengths, "id").withColumn("over", F.col("occ") > cap)
    order = Window.partitionBy("id").orderBy("pos")
    rows = rows.withColumns({"streak": F.sum(F.when(F.col("over"), 0).otherwise(1)).over(order), "end": F.col("pos") + k})
    before = F.last(F.when(~F.col("over"), F.col("end")), ignorenulls=True).over(order)
    after = F.first(F.when(~F.col("over"), F.col("end")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("room", F.coalesce(after, F.col("length")) - F.coalesce(before, F.lit(0))).where("over")
    take = F.least(F.lit(most), F.floor(F.col("room") / F.lit(float(dist)) + 0.499).cast("int"))
    rank = F.row_number().over(Window.partitionBy("id", "streak").orderBy("occ", "pos"))
    return rows.withColumns({"take": take, "rank": rank}).where((F.col("rank") <= F.col("take")) & (F.col("occ") <= highest)).select("id", "pos")


def rescued(tiles: DataFrame, budget: int = 65_536) -> DataFrame:
    """(id, tile, pos) of the over-cap seeds that fill empty tiles, in tile order; one beyond the budget is passed over.

    tiles: (id, tile, admitted, pos, occ), with the best over-cap seed of each tile. At most a row a tile of a query.
    """
    row = F.struct("tile", "pos", "occ")
    grouped = tiles.where("admitted = 0 and pos is not null").groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("all"))
    state = F.struct(F.lit(0).cast("long").alias("spent"), F.slice("all", 1, 0).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = s["spent"] + x["occ"] <= budget
        return F.struct((s["spent"] + F.when(fits, x["occ"]).otherwise(0)).cast("long").alias("spent"), F.when(fits, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    return grouped.select("id", F.explode(F.aggregate("all", state, step, lambda s: s["kept"])).alias("x")).select("id", "x.tile", "x.pos")
