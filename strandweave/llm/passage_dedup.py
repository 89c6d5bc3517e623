"""Substring dedup by winnowed word runs and by MinHash banding of paragraphs.

Equal passages are found wherever they begin and end, without regard to sentences: of the hashes of all runs of WORDS
words, the smallest of each STEP neighbours are taken (winnowing). Two texts that share WORDS + STEP - 1 = 50 words in a
row take a common run of WORDS words from them; a run taken in two documents is a repeat. Nothing shorter than WORDS is
one.

Edited passages are found as paragraphs. A text is read as sentences (cut at line ends, after a single . ! ? before white
space, and inside long runs where a word's hash says so). A paragraph is the shortest run of whole sentences from a given
one that has PARAGRAPH words or more.

1. Of the runs of SEED = 10 words in each SPAN = 24 words the smallest hash is a seed (winnowing); texts with 24 equal
   words in a row share one. A paragraph is a candidate if one of its seeds occurs in two documents, whatever its
   sentences: in 50 words at a similarity of 0.8 one word can be changed, and 24 equal words stand before or after it.
   Equal runs are looked for only where all seeds of a run occur in two documents, as those of a repeated run do.
2. Equal paragraphs are collapsed. Different ones are joined on an anchor, where it is that of FEW paragraphs at most,
   else on bands of MinHash symbols and the anchor: BANDS bands of ROWS symbol, a recall of 1 - (1 - 0.8)**5 = 0.9997 at
   a similarity of 0.8 of pairs with a common anchor. Anchors
   are the first and the last 24 words, and the smallest run of 10 words that leaves out 5 at either end, with its place
   from the begin and with that from the end. They keep overlapping paragraphs of one text apart, which would chain a
   whole text to what one part of it repeats. Pairs with changes in one place share the first or last words, pairs
   changed at both ends the inner run, as long as its place from one end is the same. What can be missed is a pair that
   does not begin and end alike: one begins with a short sentence that the other lacks and ends before its last one
   (mostly the paragraphs from the next sentence on are a pair then), or words are put in on both sides of all that is
   equal; or a pair with changes in the first words, the last ones and the inner run at once (in 90 words or more).
3. Colliding paragraphs are confirmed by the exact Jaccard similarity of their five-word shingles, and clustered by
   connected components. A cluster's paragraph in its smallest document stays, those in other documents are removed;
   overlapping spans with the same verdict are reported as one.

Repeats inside one document alone are not reported. Null and empty texts and those under WORDS words have none. Rows
with a null doc_id are left out; doc_id identifies a document, so that repeated rows are one. An empty table gives no
rows. Texts of any length are read whole, one at a time where they are long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm import graph, text
from strandweave.llm.near_dedup import confirmed, labelled, near
from strandweave.session import cut, free, ship

U = np.uint64
WORDS = 43
STEP = 8
#: Least words of a paragraph: one changed word in 50 leaves a similarity of 0.8 of five-word shingles.
PARAGRAPH = 50
LONG = 48
#: Words of a seed, and of a stretch whose smallest seed is taken: of 50 words or more with one changed, 24 in a row are equal.
SEED, SPAN = 10, 24
#: Words at either end of a paragraph that the inner seed leaves out; bits for a seed's place in its text.
EDGE, PLACE = 5, U(28)
BANDS, ROWS = 5, 1
#: The paragraphs of an anchor that has no more are all compared, without bands.
FEW = 16
#: Shingles whose sets are sorted at once.
CELLS = 1 << 20
SYMBOLS = 24
#: Differing symbols of a pair to confirm; a pair of similarity 0.8 has 4.8 of 24 on average.
RADIUS = 14
PERCENT = 80
_rng = np.random.RandomState(99173)
_ADD = _rng.randint(0, 2**63 - 1, SYMBOLS).astype(U)
_MUL = (_rng.randint(0, 2**63 - 1, SYMBOLS).astype(U) << U(1)) | U(1)


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the rows' bounds in them, sentence bounds (words), the rows' bounds in sentences, sentence hashes."""
    data, offsets = text.raw(column)
    data = text.lower(data)
    begins, ends, bounds = text.spans(data, offsets)
    words = text.span_hashes(data, begins, ends)
    n = len(words)
    if not n:
        return words, bounds, np.zeros(1, np.int64), np.zeros(len(bounds), np.int64), np.zeros(0, U)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.zeros(n, dtype=bool)
    last[:-1] = lines[begins[1:]] > lines[ends[:-1]]
    stop = np.isin(data, np.frombuffer(b".!?", np.uint8))
    last |= stop[ends - 1] & ~stop[np.maximum(ends - 2, 0)]
    last[bounds[1:][bounds[1:] > 0] - 1] = True
    # Long runs are cut where the words themselves say so.
    size = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    last |= np.repeat(size > LONG, size) & (words % U(24) == 0)
    cuts = np.concatenate([[0], np.flatnonzero(last) + 1])
    return words, bounds, cuts, np.searchsorted(cuts, bounds), text.runs(words, cuts[:-1], cuts[1:])


def winnowed(hashes: np.ndarray, step: int = STEP) -> np.ndarray:
    """Places of the smallest hash (the first of equal ones) of each `step` neighbours; of all, where there are fewer."""
    if len(hashes) <= step:
        return np.array([hashes.argmin()] if len(hashes) else [], dtype=np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, step).argmin(axis=1) + np.arange(len(hashes) - step + 1))


def winnowed_rows(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, step: int = STEP) -> np.ndarray:
    """`winnowed` of each row's own hashes, those from its begin to its end; places in all hashes."""
    few = [b + winnowed(hashes[b:e], step) for b, e in zip(begins, ends, strict=True) if b < e <= b + step]
    begins, ends = begins[ends > begins + step], ends[ends > begins + step]
    at = np.arange(max(len(hashes) - step + 1, 0))
    row = np.searchsorted(begins, at, side="right") - 1
    at = at[(row >= 0) & (at + step <= ends[row])] if len(begins) else at[:0]
    most = np.lib.stride_tricks.sliding_window_view(hashes, step)[at].argmin(axis=1) if len(at) else at
    return np.unique(np.concatenate([at + most, *few]).astype(np.int64))


def least_of(hashes: np.ndarray, step: int) -> np.ndarray:
    """The smallest of each `step` neighbours."""
    out, width = hashes, 1
    while width < step:
        by = min(width, step - width)
        out = np.minimum(out[: len(out) - by], out[by:])
        width += by
    return out


def _seeds(least: int) -> Callable:
    """(doc_id, text) to (wid, doc_id): the seed of each SPAN words in a row of texts of `least` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "text"):
                words, bounds = text.word_hashes(part.column("text"))
                at = np.arange(max(len(words) - SEED + 1, 0))
                if len(words) < least:
                    continue
                seeds = least_of(text.runs(words, at, at + SEED), SPAN - SEED + 1)
                row = np.searchsorted(bounds, np.arange(len(seeds)), side="right") - 1
                own = (np.arange(len(seeds)) + SPAN <= bounds[row + 1]) & (np.diff(bounds)[row] >= least)
                first = np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (row[1:] != row[:-1])])
                at = np.flatnonzero(own & first)
                yield pa.RecordBatch.from_arrays([pa.array(seeds[at].astype(np.int64)), pa.array(part.column("doc_id").to_numpy()[row[at]])], ["wid", "doc_id"])

    return run


def _candidates(least: int, paragraph: int) -> Callable:
    """(doc_id, text, marks) to (kind, wid, anchors, doc_id, b, e): the runs (kind 0) and paragraphs (kind 1) with shared seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "text"):
                words, bounds, cuts, _, _ = sentences(part.column("text"))
                n = len(words)
                if n < SPAN:
                    continue
                docs, long = part.column("doc_id").to_numpy(), np.diff(bounds) >= SPAN
                row = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                tens = text.runs(words, np.arange(n - SEED + 1), np.arange(SEED, n + 1))
                # A seed that another text of the piece shares is one that this text shares, too, where it has it.
                marks = part.column("marks").flatten().to_numpy(zero_copy_only=False).astype(U)
                shared = np.concatenate([[0], np.cumsum(np.isin(least_of(tens, SPAN - SEED + 1), marks))])
                kind, wid, anchors, begin, end = [], [], [], [], []
                if n >= least:  # a run that two documents hold has shared seeds only
                    at = np.arange(n - least + 1)
                    hashes, inside = text.runs(words, at, at + least), max(least - SPAN + 1, 0)
                    b = winnowed_rows(hashes, bounds[:-1][long], bounds[1:][long] - least + 1)
                    b = b[shared[b + inside] - shared[b] == inside]
                    kind, wid, anchors, begin, end = [np.zeros(len(b), np.int32)], [hashes[b]], [np.zeros((len(b), 0), U)], [b], [b + least]
                b = cuts[:-1][long[row[cuts[:-1]]]]
                e = cuts[np.minimum(np.searchsorted(cuts, b + paragraph), len(cuts) - 1)]  # the first sentence bound with enough words
                inside = (e >= b + paragraph) & (e <= bounds[row[b] + 1])
                b, e = b[inside], e[inside]
                some = shared[e - SPAN + 1] > shared[b]
                b, e = b[some], e[some]
                if len(b):
                    for held, x in ((kind, np.ones(len(b), np.int32)), (wid, text.runs(words, b, e)), (anchors, _anchors(words, tens, b, e)), (begin, b), (end, e)):
                        held.append(x)
                if kind:
                    b, e = np.concatenate(begin), np.concatenate(end)
                    own = bounds[row[b]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kind)), pa.array(np.concatenate(wid).astype(np.int64)), _lists(anchors), pa.array(docs[row[b]]), pa.array(b - own), pa.array(e - own)], ["kind", "wid", "anchors", "doc_id", "b", "e"])

    return run


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """The rows of the arrays as lists of long."""
    sizes = np.concatenate([np.full(len(x), x.shape[1]) for x in rows])
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(np.concatenate([x.reshape(-1) for x in rows]).astype(np.int64)))


def _anchors(words: np.ndarray, tens: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The four anchors of the paragraphs (b, e), a row each: first SPAN words, last SPAN words, the inner seed by its place from either end."""
    place = np.arange(len(tens), dtype=np.int64).astype(U)
    packed = np.append((tens >> PLACE << PLACE) | place, U(0))
    inner = np.minimum.reduceat(packed, np.stack([b + EDGE, e - EDGE - SEED + 1], axis=1).reshape(-1))[::2]
    at = (inner & ((U(1) << PLACE) - U(1))).astype(np.int64)
    out = [text.runs(words, b, b + SPAN), text.runs(words, e - SPAN, e), tens[at] + (at - b).astype(U) * _MUL[7], tens[at] + (e - at).astype(U) * _MUL[7]]
    return np.stack([text.mix(x + _MUL[8 + k]) for k, x in enumerate(out)], axis=1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans of b, e, wid) to (rid, sig, shs): signature and shingles of each listed paragraph."""
    for batch in batches:
        for part in text.pieces(batch, "text"):
            sh, bounds = text.shingles(*text.word_hashes(part.column("text")))
            spans = part.column("spans")
            of, flat = np.repeat(bounds[:-1], spans.value_lengths().to_numpy()), spans.flatten()
            rid, b, e = (flat.field(k).to_numpy() for k in ("wid", "b", "e"))
            b, e = of + b, of + e - text.SHINGLE + 1
            ends, sig = np.stack([b, e], axis=1).reshape(-1), np.empty((len(b), SYMBOLS), dtype=np.uint16)
            for k in range(SYMBOLS):
                y = (np.append(sh, U(0)) + _ADD[k]) * _MUL[k]
                y ^= y >> U(32)
                sig[:, k] = (np.minimum.reduceat(y, ends)[::2] >> U(7)).astype(np.uint16) if len(b) else 0
            order, done = np.argsort(b - e, kind="stable"), 0  # the longest first, so that rows sorted at once have about one length
            while done < len(order):
                at = np.sort(order[done : done + max(1, CELLS // int(e[order[done]] - b[order[done]]))])
                done += len(at)
                sizes, shs = text.sets(sh, b[at], e[at])
                yield pa.RecordBatch.from_arrays([pa.array(rid[at]), text.binary(sig[at]), text.lists_of_bytes(shs, sizes)], ["rid", "sig", "shs"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, anchor, sig) to (key, rid): the bands under an anchor of many paragraphs."""
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(U)
            key = np.zeros(sig.shape[:2], dtype=U)
            for r in range(ROWS):
                key = (key + sig[:, :, r] + U(1)) * _MUL[r]
                key ^= key >> U(30)
            anchor = batch.column("anchor").to_numpy().astype(U)
            key = text.mix(key + anchor[:, None] * _MUL[5] + np.arange(BANDS).astype(U) * _MUL[6])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).astype(np.int64)), pa.array(np.repeat(batch.column("rid").to_numpy(), BANDS))], ["key", "rid"])


def repeats(docs: DataFrame, least: int = WORDS, percent: int = PERCENT, paragraph: int = PARAGRAPH) -> DataFrame:
    """(doc_id, begin_word, end_word, n_words, cluster_id, keep_doc_id, removed): the repeated spans of all documents.

    Words are counted from 0 in each text. keep_doc_id holds the copy that stays; removed is false for that copy.
    """
    ship(docs.sparkSession)
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # They are computed twice rather than written; most of them are of one document.
    seeds = base.mapInArrow(text.tidied(_seeds(min(least, paragraph))), "wid long, doc_id long")
    shared = cut(seeds.groupBy("wid").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("wid"))
    # A document's own seeds are gathered, as many as its text has.
    marks = seeds.join(shared, "wid").groupBy("doc_id").agg(F.collect_set("wid").alias("marks"))
    candidates = cut(base.join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(text.tidied(_candidates(least, paragraph)), "kind int, wid long, anchors array<long>, doc_id long, b long, e long"))
    free(shared)
    found = candidates.where("kind = 1").drop("kind")
    # Equal paragraphs: one row each, with a document that holds it.
    kinds = cut(found.groupBy("wid").agg(F.min("anchors").alias("anchors"), F.min(F.struct("doc_id", "b", "e")).alias("at"), F.max("doc_id").alias("hi")))
    # Most paragraphs have no anchor in common with one of another document; only the others are signed.
    anchored = kinds.select(F.col("wid").alias("rid"), F.col("at.doc_id").alias("lo"), "hi", F.explode("anchors").alias("anchor"))
    both = anchored.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("rid").alias("low"), F.max("rid").alias("high"), F.count("*").alias("n")).where("lo < hi and low < high")
    used = cut(anchored.join(both.select("anchor", "n"), "anchor").select("rid", "anchor", (F.col("n") <= FEW).alias("few")))
    open_kinds = kinds.join(used.select(F.col("rid").alias("wid")).distinct(), "wid", "left_semi")
    holders = open_kinds.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("wid", F.col("at.b").alias("b"), F.col("at.e").alias("e"))).alias("spans"))
    signed = cut(base.join(holders, "doc_id").select("text", "spans").mapInArrow(text.tidied(_signed), "rid long, sig binary, shs binary"))
    keys = signed.select("rid", "sig").join(used.where("not few"), "rid").mapInArrow(text.tidied(_bands), "key long, rid long")
    keys = keys.unionByName(used.where("few").select(F.col("anchor").alias("key"), "rid"))
    coarse = near(keys, signed.select("rid", "sig"), RADIUS)
    free(used)
    whole = labelled(coarse, lambda ids: signed.select("rid", "shs").join(ids, "rid"))
    free(signed, coarse)
    labels = confirmed(whole, percent)
    free(whole)
    named = kinds.join(labels.select(F.col("node").alias("wid"), "label"), "wid", "left").select("wid", F.coalesce("label", "wid").alias("cluster_id"), F.col("at.doc_id").alias("lo"), "hi")
    named = cut(named)
    free(kinds, labels)
    several = named.groupBy("cluster_id").agg(F.min("lo").alias("keep_doc_id"), F.max("hi").alias("last")).where("keep_doc_id < last")
    of = cut(named.select("wid", "cluster_id").join(several.select("cluster_id", "keep_doc_id"), "cluster_id"))
    free(named)
    spans = found.join(of, "wid").select("doc_id", "b", "e", "cluster_id", "keep_doc_id", (F.col("doc_id") != F.col("keep_doc_id")).alias("removed"))
    # Equal runs of words, whatever the sentences around them.
    windows = candidates.where("kind = 0").select("wid", "doc_id", "b", "e")
    equal = windows.groupBy("wid").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("wid", "lo")
    spans = spans.unionByName(windows.join(equal, "wid").select("doc_id", "b", "e", F.col("wid").alias("cluster_id"), F.col("lo").alias("keep_doc_id"), (F.col("doc_id") != F.col("lo")).alias("removed")))
    order = Window.partitionBy("doc_id", "keep_doc_id").orderBy("b", "e")
    island = F.sum((F.col("b") > F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")).over(order)
    out = spans.withColumn("island", island).groupBy("doc_id", "keep_doc_id", "removed", "island")
    out = out.agg(F.min("b").alias("begin_word"), F.max("e").alias("end_word"), F.min("cluster_id").alias("cluster_id"))
    return out.select("doc_id", "begin_word", "end_word", (F.col("end_word") - F.col("begin_word")).alias("n_words"), "cluster_id", "keep_doc_id", "removed")


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the removed spans cut out of `text`; what remains of a text keeps its bytes, spans go with the space after them."""
    spans = found.where("removed").groupBy("doc_id").agg(F.collect_list(F.struct("begin_word", "end_word")).alias("_spans")).withColumnRenamed("doc_id", "_d")
    joined = docs.join(spans, F.col("doc_id") == F.col("_d"), "left").drop("_d")

    @F.pandas_udf("string")
    def clear(texts, lists):
        import pandas as pd

        return pd.Series([drop_words(t, s) if s is not None and t is not None else t for t, s in zip(texts, lists, strict=True)])

    return joined.withColumn("text", clear("text", "_spans")).drop("_spans")


def drop_words(body: str, spans: list) -> str:
    """The text without the words of the spans."""
    data, offsets = text.raw(pa.array([body]))
    begins, _, _ = text.spans(data, offsets)
    starts = np.append(begins, len(data))
    keep = np.ones(len(data), dtype=bool)
    for s in spans:
        keep[starts[s["begin_word"]] : starts[s["end_word"]]] = False
    return data[keep].tobytes().decode()
