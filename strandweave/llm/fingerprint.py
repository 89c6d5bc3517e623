"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its five-word shingles (a text of fewer words: its whole sequence) with their numbers of
occurrences. For each of SAMPLES registers every term draws r and c from Gamma(2, 1) and b uniformly, from hashes of
term and register alone; with t = floor(ln w / r + b) and y = exp(r (t - b)), the term with the least c / (y e^r) is
sampled. Two texts sample the same (term, t) with a probability equal to their generalised Jaccard similarity, which the
share of equal registers estimates with a standard error of at most 0.5 / sqrt(SAMPLES).

Registers keep 16 bits. A text without words (null, empty, white space) has the empty fingerprint; its likeness is 1
to another such text and 0 to any other. Order of neighbours: descending doc_id, null last, ties by text; a table of one
document is followed by itself. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import text
from strandweave.session import ship, shared_dir

U = np.uint64
SAMPLES = 64
BLOCK = 2048
_rng = np.random.RandomState(77001)
_SEED = [(_rng.randint(0, 2**63 - 1, SAMPLES).astype(U) << U(1)) | U(1) for _ in range(4)]
_UNIT = np.float32(2.0**-24)
_LOW = U((1 << 24) - 1)


def terms(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct terms, weights) of each text."""
    sh, bounds = text.shingles(*text.word_hashes(column))
    return [np.unique(sh[bounds[i] : bounds[i + 1]], return_counts=True) for i in range(len(bounds) - 1)]


def draws(term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each term and register."""
    x = (term[:, None] ^ _SEED[0]) * _SEED[1]
    x ^= x >> U(31)
    y = (x ^ _SEED[2]) * _SEED[3]
    y ^= y >> U(29)
    unit = lambda v: ((v & _LOW).astype(np.float32) + np.float32(0.5)) * _UNIT
    r = -np.log(unit(x >> U(3)) * unit(x >> U(30)))
    c = np.log(-np.log(unit(y >> U(3)) * unit(y >> U(30))))
    return r, c, unit((x >> U(40)) ^ (y << U(1)))


def samples(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """Fingerprints of weighted sets; what they share is drawn once."""
    every = np.unique(np.concatenate([s[0] for s in sets])) if len(sets) > 1 else sets[0][0]
    weights = []
    for t, w in sets:
        full = np.zeros(len(every), dtype=np.int64)
        full[np.searchsorted(every, t)] = w
        weights.append(full)
    best = [np.full(SAMPLES, np.inf, dtype=np.float32) for _ in sets]
    mark = [np.zeros(SAMPLES, dtype=U) for _ in sets]
    column = np.arange(SAMPLES)
    for at in range(0, len(every), BLOCK):
        term = every[at : at + BLOCK]
        r, c, b = draws(term)
        single = c + r * (b - 1)  # ln of c / (y e^r) for weight 1, where t = 0
        for k, full in enumerate(weights):
            w = full[at : at + BLOCK]
            own = np.flatnonzero(w)
            if not len(own):
                continue
            value = single[own] if len(own) < len(term) else single.copy()
            level = None
            more = np.flatnonzero(w[own] > 1)
            if len(more):
                rr, bb = r[own[more]], b[own[more]]
                t = np.floor(np.log(w[own[more]].astype(np.float32))[:, None] / rr + bb)
                value[more] = c[own[more]] - rr * (t - bb) - rr
                level = np.zeros((len(own), SAMPLES), dtype=np.int32)
                level[more] = t.astype(np.int32)
            low = value.argmin(axis=0)
            found = value[low, column]
            better = found < best[k]
            tag = text.mix(term[own[low]] + (level[low, column].astype(np.int64).astype(U) if level is not None else U(0)) * U(0x9E3779B97F4A7C15))
            best[k] = np.where(better, found, best[k])
            mark[k] = np.where(better, tag, mark[k])
    return [m.astype(np.uint16).tobytes() if len(t) else b"" for m, (t, _) in zip(mark, sets, strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal registers."""
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean())


def edit(one: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following text."""
    half = len(one) // 2
    return one[: len(one) - half] + following[:half]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, ghost, doc_id, text) in order: each row but ghosts is held against the row after it in its bucket."""
    import hashlib

    held: list = []  # the row before, and its own fingerprints once its follower is known
    waiting: tuple | None = None
    ghost_seen = None
    for batch in batches:
        out: list[tuple] = []
        for bucket, ghost, doc_id, body in zip(*[batch.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text")], strict=True):
            body = body or ""
            if ghost and ghost_seen == bucket:
                continue
            if held and held[0] == bucket:
                one = held[2]
                changed = edit(one, body)
                first, second = samples(terms(pa.array([one, changed], pa.large_string())))
                if waiting:
                    out.append((*waiting, first))
                waiting = (held[1], len(one), hashlib.sha256(changed.encode()).hexdigest(), first, second)
            if ghost:
                ghost_seen = bucket
                (own,) = samples(terms(pa.array([body], pa.large_string())))
                if waiting:
                    out.append((*waiting, own))
                waiting, held = None, []
            else:
                held = [bucket, doc_id, body]
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    ids, n, sha, own, edited, following = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array([x.hex() for x in own]), pa.array([x.hex() for x in edited]), pa.array([likeness(a, b) for a, b in zip(own, edited, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, following, strict=True)], pa.float64())],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses to the edited and to the next text.

    Texts are shuffled once: into ranges of doc_id, whose bounds are quantiles. The first document of each range also
    goes to the end of the range before it, as a ghost.
    """
    spark = ship(docs.sparkSession)
    shared_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)) if parts > 1 else [], reverse=True)
    # Bucket 0 has the largest ids; nulls come last.
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds)))
    for i, b in enumerate(bounds) if len(bounds) <= 16 else ():
        bucket = bucket.when(F.col("doc_id") >= b, F.lit(i))
    if len(bounds) > 16:
        marks = F.array(*[F.lit(float(b)) for b in bounds])
        bucket = bucket.otherwise(F.size(F.filter(marks, lambda m: F.col("doc_id") < m)))
    else:
        bucket = bucket.otherwise(F.lit(len(bounds)))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    # One head a bucket, as many as shuffle partitions.
    heads = sorted((r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return rows.drop("bucket", "text").select("doc_id", F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[F.lit(0.0).alias(c) for c in ("near_edited", "near_next")])
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    ghost = F.lit(None).cast("int")
    pairs = F.create_map(*[x for b, h in heads for x in (F.lit(b), F.struct(F.lit(h).cast("long").alias("head"), F.lit(before[b]).alias("to")))])
    entry = pairs[F.col("bucket")]
    ghost = F.when(F.col("doc_id").eqNullSafe(entry["head"]), entry["to"])
    own, extra = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")), F.struct(ghost.alias("bucket"), F.lit(True).alias("ghost"))
    places = F.when(ghost.isNull(), F.array(own)).otherwise(F.array(own, extra))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("place")).select("place.bucket", "place.ghost", "doc_id", "text")
    dealt = dealt.repartitionByRange(len(heads), "bucket").sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(text.tidied(_walk), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
