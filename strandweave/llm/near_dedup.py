"""MinHash near-duplicates by a multi-index Hamming join.

A text's set holds its distinct five-word shingles. Its signature has SYMBOLS b-bit MinHash symbols (b = 16). Two sets
of Jaccard similarity 0.85 differ in a symbol with probability 0.15, so in more than RADIUS = 23 of 60 symbols with a
probability under 1e-5; every pair within RADIUS is found:

- The signature is split into 12 chunks of 5 symbols. By the pigeonhole principle a pair within 23 differing symbols has
  a chunk with at most one of them (12 chunks with two each make 24). Allowed errors are enumerated by masking each
  symbol of each chunk in turn: 60 keys a text, and the pair shares one of them.
- Equal sets are collapsed first; copies cost one row each.
- Components of close signatures are formed from links of each bucket's members with its smallest one. Where a bucket
  still holds several components, the members outside its largest one are compared with all members, in blocks of
  bounded size. A block gives only links that join components, so a group of n near copies gives about n rows.
- Within each component all full sets are compared by products of their incidence matrices: in one block where they fit
  into one. In a larger component about HUBS members are compared with all first, and what this leaves outside its
  largest part is then compared with all. Rows are dealt n + HUBS * n / SETS times, then n + m * n / SETS times for m
  members left outside, so that n near copies are n rows, not n squared / SETS, unless they hardly resemble each other.
  Every pair within RADIUS is confirmed or refused on its full sets, or lies in a part already joined; nothing is capped.

Nulls and texts without words have an empty set, are linked with nothing and stay. doc_id identifies a document; rows
with a null doc_id are returned without links. Repeated rows are linked as equal sets. An empty table gives no rows. Texts
of any length are read whole; a block of sets holds SET_BYTES or one set. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm import graph, text
from strandweave.session import cut, free, ship

U = np.uint64
CHUNKS, PER_CHUNK = 12, 5
SYMBOLS = CHUNKS * PER_CHUNK
RADIUS = 2 * CHUNKS - 1
BLOCK = 1024
#: A block of full sets holds about this many, and bytes.
SETS, SET_BYTES = 512, 8_000_000
#: Groups of as many sets are compared together with other groups, GATHERED bytes at a time.
SMALL, GATHERED = 16, 2_000_000
#: Members of a large component that are compared with all others first.
HUBS = 8
#: Salts of the join of large buckets (over BLOCK members) with their members; slots of keys that tell these buckets.
SALTS, SLOTS = 8, 1 << 16
_rng = np.random.RandomState(20240229)
_ADD = _rng.randint(0, 2**63 - 1, SYMBOLS).astype(U)
_MUL = (_rng.randint(0, 2**63 - 1, SYMBOLS).astype(U) << U(1)) | U(1)
_KEY = (_rng.randint(0, 2**63 - 1, (SYMBOLS, PER_CHUNK)).astype(U) << U(1)) | U(1)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, set_a, set_b, sig)."""
    for batch in batches:
        for part in text.pieces(batch, "text"):
            sh, bounds = text.shingles(*text.word_hashes(part.column("text")))
            sig = np.zeros((part.num_rows, SYMBOLS), dtype=np.uint16)
            for k in range(SYMBOLS):
                x = (sh + _ADD[k]) * _MUL[k]
                x ^= x >> U(32)
                sig[:, k] = (text.least(x, bounds) >> U(7)).astype(np.uint16)
            n, a, b = (np.zeros(part.num_rows, dtype=np.int64) for _ in range(3))
            for i in range(part.num_rows):
                own = np.unique(sh[bounds[i] : bounds[i + 1]])
                n[i] = len(own)
                a[i] = own.sum(dtype=U).astype(np.int64)
                b[i] = text.mix(own + U(0x1234567)).sum(dtype=U).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(a), pa.array(b), text.binary(sig)], ["doc_id", "n_shingles", "set_a", "set_b", "sig"])


def signatures(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=np.uint16).reshape(len(column), -1)


def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, sig) to (key, rid): a key for each chunk and masked symbol."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = signatures(batch.column("sig")).astype(U) + U(1)
        out = np.empty((batch.num_rows, SYMBOLS), dtype=U)
        for s in range(SYMBOLS):
            c, masked = divmod(s, PER_CHUNK)
            h = np.full(batch.num_rows, s, dtype=U)
            for j in range(PER_CHUNK):
                if j != masked:
                    h = (h + sig[:, c * PER_CHUNK + j]) * _KEY[s, j]
                    h ^= h >> U(29)
            out[:, s] = text.mix(h)
        rid = np.repeat(batch.column("rid").to_numpy(), SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).astype(np.int64)), pa.array(rid)], ["key", "rid"])


def closer(radius: int) -> Callable:
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, sig_a, sig_b) within the radius."""
        for batch in batches:
            if batch.num_rows:
                near = (signatures(batch.column("sig_a")) != signatures(batch.column("sig_b"))).sum(axis=1) <= radius
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    return close


def grouped(batches: Iterator[pa.RecordBatch], keys: int, names: list[str]) -> Iterator[list[tuple]]:
    """Rows of consecutive equal values in the first `keys` columns, whatever the batches' borders."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            if group and group[0][:keys] != row[:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def across(radius: int) -> Callable:
    """Rows (key, b, u, side, rid, label, sig) sorted by (key, b, u) to links (a, b) between labels.

    A group holds a block of a bucket's rows (side 0) and a block of those to compare with them (side 1), each of about
    BLOCK rows. Signatures of different labels within the radius join their labels, and only links that join are given:
    fewer than rows, however many pairs are close.
    """

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        side = np.array([r[3] for r in rows])
        rid, label = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        sig = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint16).reshape(len(rows), -1)
        root = np.unique(label, return_inverse=True)[1]
        every = np.flatnonzero(side == 0)
        out = []
        for i in np.flatnonzero(side == 1):
            at = every[root[every] != root[i]]
            at = at[(sig[at] != sig[i]).sum(axis=1) <= radius]
            while len(at):
                out.append((rid[i], rid[at[0]]))
                root[root == root[at[0]]] = root[i]
                at = at[root[at] != root[i]]
        return out

    return _groupwise(compare, ["key", "b", "u", "side", "rid", "label", "sig"])


def _groupwise(compare: Callable, names: list[str], together: Callable | None = None) -> Callable:
    """A mapInArrow function that gives the links `compare` finds in each group of the first three columns.

    Groups of SMALL rows at most, all of side 0, are given to `together`, many at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        small: list[list[tuple]] = []
        size = 0
        for rows in grouped(batches, 3, names):
            if together and 1 < len(rows) <= SMALL and not any(r[3] for r in rows):
                small.append(rows)
                size += sum(len(r[5]) for r in rows)
                if size > GATHERED:
                    held += together(small)
                    small, size = [], 0
            elif len(rows) > 1:
                held += compare(rows)
            if len(held) > 10_000:
                yield pairs_batch(held)
                held = []
        if small:
            held += together(small)
        if held:
            yield pairs_batch(held)

    return run


def common(sets: list[np.ndarray], first: np.ndarray | None = None) -> np.ndarray:
    """Sizes of the intersections of the sets at `first` (of all) with all sets, as products of their incidence matrix."""
    first = np.arange(len(sets)) if first is None else first
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = (np.cumsum(shared) - 1)[element]
    keep = shared[element]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(first), len(sets)), dtype=np.float32)
    for at in range(0, int(shared.sum()), 2048):
        b, e = np.searchsorted(column, [at, at + 2048])
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[owner[b:e], column[b:e] - at] = 1
        out += part[first] @ part.T
    return out


def verified(percent: int) -> Callable:
    """Rows (label, b, u, side, rid, shs) sorted by (label, b, u) to links (a, b) that stand for all links among them.

    The Jaccard similarity of each set of side 1 with each of side 0 is computed from the full sets, that of all pairs
    where there is no side 1. Of the links found, a star a component is given: fewer than rows.
    """

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r[5], dtype=U) for r in rows]
        side, rid = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        size = np.array([len(x) for x in sets], dtype=np.float64)
        first = np.flatnonzero(side == 1) if (side == 1).any() else np.arange(len(rows))
        both = common(sets, first).astype(np.float64)
        near = (both > 0) & (100 * both >= percent * (size[first, None] + size[None, :] - both)) & (rid[first, None] != rid[None, :])
        if len(first) < len(rows):
            near &= (side == 0)[None, :]
        out, root = [], np.unique(rid, return_inverse=True)[1]
        for i, at in zip(first, near, strict=True):
            at = np.flatnonzero(at)
            at = at[root[at] != root[i]]
            while len(at):
                out.append((rid[i], rid[at[0]]))
                root[root == root[at[0]]] = root[i]
                at = at[root[at] != root[i]]
        return out

    return _groupwise(compare, ["label", "b", "u", "side", "rid", "shs"], lambda groups: among(groups, percent))


def among(groups: list[list[tuple]], percent: int) -> list[tuple[int, int]]:
    """The links of `verified` inside groups (..., side 0, rid, shs) of a few sets, for all groups together."""
    rows = [r for rows in groups for r in rows]
    rid, n = np.array([r[4] for r in rows]), np.array([len(rows) for rows in groups])
    size = np.array([len(r[5]) // 8 for r in rows])
    group, place = np.repeat(np.arange(len(groups)), n), np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    owner = np.repeat(np.arange(len(rows)), size)
    # Shingles are told apart by group; equal ones stand side by side, at most as many as the group has sets.
    element = text.mix(np.frombuffer(b"".join(r[5] for r in rows), dtype=U) + text.mix(group.astype(U) + U(1))[owner])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    pair, at = [], np.arange(len(element))
    for by in range(1, int(n.max())):
        at = at[at + by < len(element)]
        at = at[element[at] == element[at + by]]
        pair.append(owner[at] * int(n.max()) + place[owner[at + by]])
    both = np.bincount(np.concatenate(pair), minlength=1)
    found = np.flatnonzero(both)
    a, shared = found // int(n.max()), both[found]
    b = found % int(n.max()) - place[a] + a
    near = (100 * shared >= percent * (size[a] + size[b] - shared)) & (rid[a] != rid[b])
    return [(x, y) for part in graph.joined([pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], ["a", "b"])]) for x, y in zip(*(rid[part.column(c).to_numpy()] for c in ("label", "node")), strict=True) if x != y]


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) to (rid, shs): the sorted distinct shingle hashes as bytes."""
    for batch in batches:
        for part in text.pieces(batch, "text"):
            sh, bounds = text.shingles(*text.word_hashes(part.column("text")))
            own = [np.unique(sh[bounds[i] : bounds[i + 1]]).tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(own, pa.binary())], ["rid", "shs"])


def in_blocks(rows: DataFrame, group: str, out: Column, blocks: Column, out_blocks: Column, carry: list[str]) -> DataFrame:
    """Rows (group, b, u, side, rid, ...) dealt so that each row with `out` meets all rows of its group, sorted by group.

    All rows of a group are dealt over `blocks` blocks, those with `out` once more over `out_blocks`; the groups (b, u)
    hold each pair of a block of the one and of the other kind. Without rows to meet (`out_blocks` 0) a group is one
    block. All rows are dealt out_blocks times, those with `out` blocks times.
    """
    dealt = rows.withColumns({"nb": blocks.cast("int"), "nu": out_blocks.cast("int"), "out": out, "h": F.xxhash64("rid")})
    every = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.greatest("nu", F.lit(1)) - 1)))
    every = every.select(group, F.pmod("h", "nb").cast("int").alias("b"), "u", F.lit(0).alias("side"), "rid", *carry)
    some = dealt.where("out and nu > 0").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    some = some.select(group, "b", F.pmod(F.xxhash64("h"), "nu").cast("int").alias("u"), F.lit(1).alias("side"), "rid", *carry)
    return every.union(some).repartition(group, "b", "u").sortWithinPartitions(group, "b", "u")


def outside(rows: DataFrame, group: str, part: str) -> DataFrame:
    """(group, top, n, n_out) of the groups of rows that hold several parts: the largest part, all rows, those outside it."""
    sizes = rows.groupBy(group, part).agg(F.count("*").alias("k"))
    tops = sizes.groupBy(group).agg(F.max_by(part, F.struct("k", part)).alias("top"), F.sum("k").alias("n"), F.max("k").alias("most"))
    return tops.where("n > most").select(group, "top", "n", (F.col("n") - F.col("most")).alias("n_out"))


def linked(keys: DataFrame, sig: DataFrame, sets: Callable[[DataFrame], DataFrame], radius: int, percent: int) -> DataFrame:
    """(node, label) of the ids that are linked with another.

    keys: (key, rid), the buckets; sig: (rid, sig), one row an id; sets: gives (rid, shs) for a table of ids (rid).
    Pairs that share a bucket, have signatures within the radius and sets of enough similarity are links.

    First the components of close signatures are found, then full sets are compared within each component.
    """
    coarse = near(keys, sig, radius)
    whole = labelled(coarse, sets)
    free(coarse)
    labels = confirmed(whole, percent)
    free(whole)
    return labels


def near(keys: DataFrame, sig: DataFrame, radius: int) -> DataFrame:
    """(node, label): components of close signatures, of ids with another.

    They are found from each bucket's members and its smallest one, then inside the buckets that still hold several.
    """
    hubs = cut(keys.groupBy("key").agg(F.min("rid").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    members = cut(joined_with(hubs, keys))
    free(hubs)
    star = members.where("rid <> hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()
    star = star.join(sig.select(F.col("rid").alias("b"), F.col("sig").alias("sig_b")), "b").join(sig.select(F.col("rid").alias("a"), F.col("sig").alias("sig_a")), "a")
    star = cut(star.select("a", "b", "sig_a", "sig_b").mapInArrow(text.tidied(closer(radius)), "a long, b long"))
    coarse = graph.components(star)
    free(star)
    # In a bucket of two the star was the only pair.
    rest = members.where("n > 2").join(coarse.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", F.coalesce("label", "rid").alias("label"))
    # Many rows of a bucket that is joined already are dropped before anything is dealt.
    mixed = cut(outside(rest, "key", "label"))
    if not mixed.isEmpty():
        open_rows = rest.join(mixed, "key").join(sig, "rid")
        dealt = in_blocks(open_rows, "key", F.col("label") != F.col("top"), F.ceil(F.col("n") / BLOCK), F.ceil(F.col("n_out") / BLOCK), ["label", "sig"])
        more = cut(dealt.mapInArrow(text.tidied(across(radius)), "a long, b long").distinct())
        if not more.isEmpty():
            old, coarse = coarse, graph.extended(coarse, more)
            free(old)
        free(more)
    free(members, mixed)
    return coarse


def joined_with(hubs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, rid, hub, n): the rows of keys (key, rid) whose key is in hubs (key, hub, n).

    Members of a bucket of over BLOCK are dealt over salts, so that one with a third of all rows is SALTS tasks. Which
    keys are dealt is told by slots of their hashes, a table of bounded size; a small bucket in such a slot is dealt, too.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int")
    large = F.broadcast(hubs.where(F.col("n") > BLOCK).select(slot.alias("slot"), F.lit(SALTS).alias("salts")).distinct())
    of = lambda rows: rows.withColumn("slot", slot).join(large, "slot", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).drop("slot")
    salted = of(keys).withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")).cast("int"))
    spread = of(hubs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return salted.join(spread, ["key", "salt"]).select("key", "rid", "hub", "n")


def labelled(coarse: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(label, rid, shs) of the ids of coarse (node, label)."""
    whole = sets(coarse.select(F.col("node").alias("rid"))).join(coarse.withColumnRenamed("node", "rid"), "rid")
    return cut(whole.select("label", "rid", "shs"))


def confirmed(whole: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the rows of whole (label, rid, shs) that have a similar set among those of their label."""
    blocks = F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum(F.octet_length("shs")) / SET_BYTES))
    load = cut(whole.groupBy("label").agg(blocks.cast("long").alias("blocks"), F.count("*").alias("n")))
    rows = whole.join(load, "label")
    # Hubs are picked by hash, about HUBS of a large component; there may be none, which the second step makes good.
    hub = F.pmod(F.xxhash64("rid", F.lit(1)), F.ceil(F.col("n") / HUBS)) == 0
    large = F.col("blocks") > 1
    dealt = in_blocks(rows, "label", large & hub, F.col("blocks"), large.cast("int"), ["shs"])
    links = cut(dealt.mapInArrow(text.tidied(verified(percent)), "a long, b long"))
    labels = graph.components(links)
    free(links)
    if load.where(large).isEmpty():
        free(load)
        return labels
    parts = rows.where(large).select("label", "rid", "blocks", "shs").join(labels.select(F.col("node").alias("rid"), F.col("label").alias("part")), "rid", "left")
    parts = cut(parts.select("label", "rid", "blocks", "shs", F.coalesce("part", "rid").alias("part")))
    free(load)
    mixed = cut(outside(parts, "label", "part"))
    if mixed.isEmpty():
        free(parts, mixed)
        return labels
    dealt = in_blocks(parts.join(mixed, "label"), "label", F.col("part") != F.col("top"), F.col("blocks"), F.ceil(F.col("n_out") * F.col("blocks") / F.col("n")), ["shs"])
    more = cut(dealt.mapInArrow(text.tidied(verified(percent)), "a long, b long"))
    free(parts, mixed)
    if not more.isEmpty():
        old, labels = labels, graph.extended(labels, more)
        free(old)
    free(more)
    return labels


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(base.mapInArrow(text.tidied(sign), "doc_id long, n_shingles long, set_a long, set_b long, sig binary"))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps = cut(full.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rid"), F.first("sig").alias("sig")))
    keys = reps.select("rid", "sig").mapInArrow(text.tidied(keys_of), "key long, rid long")
    texts = base.withColumnRenamed("doc_id", "rid")
    labels = linked(keys, reps.select("rid", "sig"), lambda used: texts.join(used, "rid").mapInArrow(text.tidied(sets_of), "rid long, shs binary"), RADIUS, percent)
    # membership: a class of equal sets takes its representative's label
    named = reps.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select("n_shingles", "set_a", "set_b", F.coalesce("label", "rid").alias("component_id"))
    keyset = ["n_shingles", "set_a", "set_b"]
    salted = signed.select("doc_id", *keyset).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(graph.SALTS)).cast("int"))
    spread = salted.select(*keyset, "_salt").distinct().join(named, keyset)
    out = salted.join(spread, [*keyset, "_salt"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
