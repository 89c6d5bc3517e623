"""Quality classifier by positive-unlabelled learning.

A linear model over whole texts minimises the non-negative unbiased risk
    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])
with the logistic loss, from trusted positives, unlabelled documents and a class prior; labelled negatives are not used.
The prior is estimated from positives and unlabelled documents alone: half of each train a first model, and the prior is
the least ratio of the shares of the other unlabelled documents and positives above a score (the best bin), repeated
from the estimate. The score is the logistic function of the margin, 0.7 of it the decision.

Features are of the text alone: square roots of the frequencies of pairs of byte classes, and shares of repeated words
and lines. They are taken over all of every text; training uses bounded samples by hash order (POSITIVES, UNLABELLED),
whose size does not depend on the input, in one task of an executor; the driver gets the weights.

A null text counts as empty and gets the score of the empty text. Repeated rows get equal scores; of rows with one
doc_id one is a training row. Without any trusted positive every score is 0.5 (0.0 where negatives are labelled). Of
several labels of a document each counts. Labels other than 0 and 1, or null, are ignored. Texts of any length are
scored whole: memory is a few times a batch of about 1 MB, or the longest text. Extra columns are carried by `score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm import text
from strandweave.session import ship

POSITIVES, UNLABELLED = 6_000, 10_000
#: Rounds of prior estimation, the prior of the first one, and the fewest positives above a score that bounds it.
PRIOR_ROUNDS, FIRST_PRIOR, LEAST_ABOVE = 3, 0.5, 30
THRESHOLD = 0.7
GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!", b"?", b"|", b"*", b"$", b"%", b"&", b"#", b"@", b":;", b"'\"`", b"()[]{}<>", b"-_/\\", b"+=~^"]
CLASS = np.full(256, len(GROUPS), dtype=np.int64)
for _i, _g in enumerate(GROUPS):
    CLASS[list(_g)] = _i
CLASS[128:] = len(GROUPS) + 1
KINDS = len(GROUPS) + 2
WIDTH = KINDS * KINDS + 8


def features(column: pa.Array) -> np.ndarray:
    """One row of WIDTH numbers for each text."""
    data, offsets = text.raw(column)
    rows = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((rows, WIDTH), dtype=np.float32)
    if len(data):
        row = np.repeat(np.arange(rows), size)
        kind = CLASS[data]
        same = row[1:] == row[:-1]
        pair = row[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
        counts = np.bincount(pair[same], minlength=rows * KINDS * KINDS).reshape(rows, -1)
        out[:, : KINDS * KINDS] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])
    low = text.lower(data)
    begins, ends, bounds = text.spans(low, offsets)
    words = text.span_hashes(low, begins, ends)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(rows), n)
    again = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=rows) if len(words) else np.zeros(rows)
    for i in range(rows):
        own = words[bounds[i] : bounds[i + 1]]
        window = own[:512]  # the share of distinct words falls with length, so it is averaged over windows of equal size
        shares = [len(np.unique(own[a : a + 512])) / len(own[a : a + 512]) for a in range(0, len(own), 512)] if len(own) > 512 else [len(np.unique(window)) / max(1, len(window))]
        out[i, -1] = float(np.mean(shares))
        lines = bytes(data[offsets[i] : offsets[i + 1]]).split(b"\n")
        out[i, -2] = 1 - len(set(lines)) / len(lines)
    k = KINDS * KINDS
    out[:, k] = np.sqrt(again / np.maximum(n, 1))
    out[:, k + 1] = np.log1p(n) / 10
    out[:, k + 2] = (ends - begins).sum() and np.minimum(np.bincount(owner, weights=ends - begins, minlength=rows) / np.maximum(n, 1), 30) / 10
    out[:, k + 3] = n == 0
    out[:, k + 4] = 1
    return out


@dataclass
class Model:
    weight: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float = 0.5
    constant: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.weight[:-1] + self.weight[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margin(x).astype(np.float64), -30, 30)))


def constant_model(score: float) -> Model:
    return Model(np.zeros(1), np.zeros(1), np.zeros(1), constant=score)


def train(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk by full-batch Adam; deterministic."""
    mean, scale = unl.mean(axis=0), 1 / (unl.std(axis=0) + 0.02)
    p, u = (np.hstack([(x - mean) * scale, np.ones((len(x), 1), np.float32)]).astype(np.float32) for x in (pos, unl))
    w = np.zeros(p.shape[1], dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    best, kept = np.inf, w
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))  # derivative of l(-g) by g; that of l(g) is s - 1
        loss_p, loss_np, loss_u = np.logaddexp(0, -gp).mean(), np.logaddexp(0, gp).mean(), np.logaddexp(0, gu).mean()
        negative = loss_u - prior * loss_np
        grad_negative = su @ u / len(u) - prior * (sp @ p) / len(p)
        # Where the estimate of the negative risk falls below 0, the step undoes the overfitting instead.
        grad = prior * ((sp - 1) @ p) / len(p) + grad_negative if negative >= 0 else -grad_negative
        grad = grad + decay * w
        risk = prior * loss_p + max(0.0, negative)
        if risk < best:
            best, kept = risk, w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(kept, mean, scale, prior)


def best_bin(pos: np.ndarray, unl: np.ndarray) -> float:
    """The class prior from margins of positives that did not train the model, and of unlabelled rows.

    Above any margin the unlabelled share is at least the prior times the positives' share; the ratio is read where it
    is least, allowing for the spread of both shares.
    """
    cut = np.sort(pos)[::-1]
    above_pos = np.arange(1, len(cut) + 1) / len(cut)
    above_unl = 1 - np.searchsorted(np.sort(unl), cut, side="left") / len(unl)
    spread = np.sqrt(np.log(40) / 2) * (len(unl) ** -0.5 + len(pos) ** -0.5)
    some = slice(min(LEAST_ABOVE, len(cut)) - 1, None)
    at = int(np.argmin((above_unl[some] + spread) / above_pos[some]))
    return float(np.clip(above_unl[some][at] / above_pos[some][at], 0.01, 0.99))


def learn(pos: np.ndarray, unl: np.ndarray) -> Model:
    """The model of these samples, with the prior that they give."""
    prior = FIRST_PRIOR
    if len(pos) >= 4:
        for _ in range(PRIOR_ROUNDS):
            first = train(pos[::2], unl[::2] if len(unl) > 1 else unl, prior)
            prior = best_bin(first.margin(pos[1::2]), first.margin(unl[1::2] if len(unl) > 1 else unl))
    return train(pos, unl, prior)


def in_fold(column: str = "doc_id", parts: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == fold, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text.pieces(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("use"), part.column("doc_id"), text.binary(features(part.column("text")))], ["use", "doc_id", "x"])


MODEL = "weight binary, mean binary, scale binary, prior double"


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(use, doc_id, x) of the samples, in any order, to one row of MODEL; none without positives or unlabelled rows."""
    use, ids, xs = [], [], []
    for batch in batches:
        use.append(batch.column("use").to_numpy())
        ids.append(batch.column("doc_id").to_numpy())
        column = batch.column("x")
        xs.append(np.frombuffer(column.buffers()[2], dtype=np.float32)[column.offset * WIDTH : (column.offset + len(column)) * WIDTH].reshape(-1, WIDTH).copy())
    if not use:
        return
    use, x = np.concatenate(use), np.concatenate(xs)
    order = np.lexsort((np.concatenate(ids), use))
    use, x = use[order], x[order]
    if (use == 0).any() and (use == 1).any():
        m = learn(x[use == 1], x[use == 0])
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(v, dtype=np.float32).tobytes()]) for v in (m.weight, m.mean, m.scale)] + [pa.array([m.prior])], ["weight", "mean", "scale", "prior"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on rows outside the held-out fold."""
    ship(docs.sparkSession)
    known = labels.where("quality in (0, 1)").where(~in_fold()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    tally = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not tally.get(1):
        return constant_model(0.5 if not tally else 0.0)
    ordered = lambda df, seed, n: df.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picks = ordered(known.where("quality = 1"), 1, POSITIVES).select("doc_id", F.lit(1).alias("use"))
    picks = picks.union(ordered(rows.where(~in_fold()).select("doc_id"), 2, UNLABELLED).select("doc_id", F.lit(0)))
    # At most POSITIVES + UNLABELLED ids, so the broadcast is bounded; rows that repeat an id are one training row.
    picked = rows.join(F.broadcast(picks.distinct()), "doc_id").select("use", "doc_id", "text")
    featured = picked.mapInArrow(text.tidied(_featured), "use int, doc_id long, x binary").groupBy("use", "doc_id").agg(F.min("x").alias("x"))
    found = featured.repartition(1).mapInArrow(text.tidied(_learned), MODEL).collect()
    if not found:
        return constant_model(0.5)
    weight, mean, scale = (np.frombuffer(bytes(found[0][c]), dtype=np.float32) for c in ("weight", "mean", "scale"))
    return Model(weight, mean, scale, found[0]["prior"])


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """docs' columns in `carry`, then score and predicted, for whole texts.

    Where `carry` has a column of one of these names, the carried one comes first and `scored_names` tells the new names.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    # Inside, columns go by position, so that names in `carry` cannot clash with ours.
    inner = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(carry, inner, strict=True)], F.col("text").cast("string").alias("body"))
    fields = "".join(f"{i} {rows.schema[i].dataType.simpleString()}, " for i in inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.pieces(batch, "body"):
                s = shared.value.score(features(part.column("body")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in inner], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], [*inner, "score", "predicted"])

    return rows.mapInArrow(text.tidied(run), f"{fields}score double, predicted int").toDF(*carry, *scored_names(carry))


def scored_names(carry: list[str]) -> tuple[str, str]:
    """Names of the score and of the decision beside the carried columns."""
    return tuple(n + "_" * next(k for k in range(len(carry) + 1) if n + "_" * k not in carry) for n in ("score", "predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with their columns, whose predicted class is 1."""
    scored = score(docs, model, docs.columns)
    return scored.where(F.col(f"`{scored_names(docs.columns)[1]}`") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return score(docs, fit(docs, labels), ["doc_id"]).select("doc_id", in_fold().alias("held_out"), "score", "predicted")
