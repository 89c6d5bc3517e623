"""Anchors, dense runs, collinear chains and ownership of the query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.seeds import K
from strandweave.session import ship

GROUP = ["id", "contig", "lane"]


def anchors(matches: DataFrame) -> DataFrame:
    """Distinct (r, q) of each query, contig and lane."""
    return matches.select(*GROUP, "r", "q").distinct()


def harvest(matches: DataFrame, peaks: DataFrame, pad: int = 500) -> DataFrame:
    """Hits whose diagonal lies within `pad` of a peak's median start, once each."""
    near = matches.withColumn("_d", F.floor((F.col("r") - F.col("q")) / pad))
    spread = peaks.select(*GROUP, "median_start", F.explode(F.sequence(F.floor(F.col("median_start") / pad) - 1, F.floor(F.col("median_start") / pad) + 1)).alias("_d"))
    found = near.join(spread, [*GROUP, "_d"]).where(F.abs(F.col("r") - F.col("q") - F.col("median_start")) <= pad)
    return found.select(*GROUP, "r", "q").distinct()


def runs(points: DataFrame, k: int = K) -> DataFrame:
    """Dense runs: anchors of one diagonal whose reference steps are k or less; extents, weight (bases) and size."""
    d = points.withColumn("d", F.col("r") - F.col("q"))
    w = Window.partitionBy(*GROUP, "d").orderBy("r")
    marked = d.withColumn("_new", F.when(F.col("r") - F.lag("r").over(w) <= k, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    grouped = marked.groupBy(*GROUP, "d", "_run").agg(F.min("r").alias("r_lo"), F.max("r").alias("r_hi"), F.min("q").alias("q_lo"), F.max("q").alias("q_hi"), F.count("*").alias("n"))
    return grouped.drop("_run").withColumn("weight", F.col("r_hi") + k - F.col("r_lo"))


def step_score(dq: np.ndarray, dd: np.ndarray, weight: float, gap: float = 0.168) -> np.ndarray:
    """Gain of putting a run after another: its weight less what they share, less the drift's price."""
    own = np.minimum(weight, np.maximum(dq, 0))
    price = np.where(dd > 0, gap * dd + 0.5 * np.log2(dd + 1.0), 0.0)
    return np.floor(own - price)


def linked(rl: np.ndarray, rh: np.ndarray, ql: np.ndarray, qh: np.ndarray, w: np.ndarray, reach: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(chain, score) of each run of a group, by an exact predecessor scan; runs are sorted by (r_hi, q_hi, r_lo, q_lo).

    A chain's score is the highest of its runs; each run belongs to one chain.
    """
    n = len(rl)
    score, before = w.copy(), np.full(n, -1)
    for i in range(n):
        first = int(np.searchsorted(rh, rl[i] - reach, side="left"))
        if first == i:
            continue
        dr, dq = rh[i] - rh[first:i], qh[i] - qh[first:i]
        dd = np.abs(dr - dq)
        ok = (dr > 0) & (dq > 0) & (ql[i] - qh[first:i] <= reach) & (dd <= band) & (rl[i] >= rl[first:i]) & (ql[i] >= ql[first:i])
        if not ok.any():
            continue
        total = np.where(ok, score[first:i] + step_score(np.minimum(dr, dq), dd, w[i]), -np.inf)
        top = int(np.argmax(total))
        if total[top] > score[i]:
            score[i], before[i] = total[top], first + top
    used, chain, at = np.zeros(n, bool), np.full(n, -1), 0
    for i in np.lexsort((np.arange(n), -score)):
        if used[i]:
            continue
        j = i
        while j >= 0 and not used[j]:
            used[j], chain[j] = True, at
            j = before[j]
        # A chain that runs into an earlier one keeps what it adds to it.
        score[i] -= score[j] if j >= 0 else 0
        at += 1
    return chain, score


RUN = ["r_lo", "r_hi", "q_lo", "q_hi", "weight", "n"]


def chain_groups(runs_of: dict[str, np.ndarray], reach: int, band: int, k: int) -> dict[str, np.ndarray]:
    """The chains of the runs (GROUP and RUN) of whole groups, in the columns of CHAINS."""
    order = np.lexsort([runs_of[c] for c in ("q_lo", "r_lo", "q_hi", "r_hi", *reversed(GROUP))])
    own = {c: runs_of[c][order] for c in (*GROUP, *RUN)}
    size = len(order)
    new = np.ones(size, bool)
    new[1:] = np.any([own[c][1:] != own[c][:-1] for c in GROUP], axis=0)
    edges = np.append(np.flatnonzero(new), size)
    chain, score = np.zeros(size, np.int64), own["weight"].astype(np.float64)
    rl, rh, ql, qh = (own[c].astype(np.float64) for c in ("r_lo", "r_hi", "q_lo", "q_hi"))
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        if y - x > 1:
            chain[x:y], score[x:y] = linked(rl[x:y], rh[x:y], ql[x:y], qh[x:y], score[x:y], reach, band)
    group = np.cumsum(new) - 1
    by = np.lexsort((chain, group))
    fresh = np.ones(size, bool)
    fresh[1:] = (group[by][1:] != group[by][:-1]) | (chain[by][1:] != chain[by][:-1])
    at = np.flatnonzero(fresh)
    fold = lambda f, x: f.reduceat(x[by], at) if size else x
    head = by[at]
    out = {c: own[c][head] for c in GROUP} | {"chain": chain[head], "score": fold(np.maximum, score), "n_runs": np.diff(np.append(at, size)), "n_anchors": fold(np.add, own["n"]), "bases": fold(np.add, own["weight"])}
    out |= {"q_lo": fold(np.minimum, own["q_lo"]), "q_hi": fold(np.maximum, own["q_hi"]) + k, "r_lo": fold(np.minimum, own["r_lo"]), "r_hi": fold(np.maximum, own["r_hi"]) + k}
    return out


CHAINS = "id long, contig long, lane int, chain int, score double, n_runs long, n_anchors long, bases long, q_lo long, q_hi long, r_lo long, r_hi long"


def chain_group(pdf: pd.DataFrame, reach: int, band: int, k: int) -> pd.DataFrame:
    """The chains of one group's runs."""
    return pd.DataFrame(chain_groups({c: pdf[c].to_numpy(np.int64) for c in (*GROUP, *RUN)}, reach, band, k))


def _chainer(reach: int, band: int, least: int, k: int) -> Callable:
    """Chains of rows that come group by group; a group that the next batch may continue waits for it."""
    columns = [*GROUP, *RUN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict[str, np.ndarray]] = []

        def done(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
            out = chain_groups({c: np.concatenate([x[c] for x in parts]) for c in columns}, reach, band, k)
            kept = out["score"] >= least
            kinds = {"lane": np.int32, "chain": np.int32, "score": np.float64}
            names = [f.split()[0] for f in CHAINS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(out[c][kept].astype(kinds.get(c, np.int64))) for c in names], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy().astype(np.int64) for c in columns}
            same = np.all([rows[c] == rows[c][-1] for c in GROUP], axis=0)
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last:
                yield done([*waiting, {c: x[:last] for c, x in rows.items()}])
                waiting = []
            elif waiting and any(waiting[-1][c][-1] != rows[c][0] for c in GROUP):
                yield done(waiting)
                waiting = []
            waiting.append({c: x[last:] for c, x in rows.items()})
        if waiting:
            yield done(waiting)

    return run


def chains(dense: DataFrame, reach: int = 5000, band: int = 500, least: int = 40, k: int = K) -> DataFrame:
    """Collinear chains of each (query, contig, strand) with a score of `least` or more; coordinates along the lane.

    A chain scores no more than the weights of its runs together, so groups that cannot reach `least` go beforehand. Many
    groups are chained in one call. The number of partitions is given, since few bytes here are much work.
    """
    spark = ship(dense.sparkSession)
    able = F.sum("weight").over(Window.partitionBy(*GROUP))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dense.select(*GROUP, *RUN).repartition(parts, *GROUP).withColumn("_w", able).where(F.col("_w") >= least).drop("_w")
    return dealt.sortWithinPartitions(*GROUP).mapInArrow(_chainer(reach, band, least, k), CHAINS)


def forward(placed: DataFrame, lengths: DataFrame) -> DataFrame:
    """Chains with query intervals on the forward strand."""
    joined = placed.join(lengths, "id")
    rev = F.col("lane") == 1
    return joined.withColumns({"q_lo": F.when(rev, F.col("length") - F.col("q_hi")).otherwise(F.col("q_lo")), "q_hi": F.when(rev, F.col("length") - F.col("q_lo")).otherwise(F.col("q_hi"))})


def own_group(pdf: pd.DataFrame, mask: float) -> pd.DataFrame:
    """Parents of one query's chains: the best-ranked chain that covers more than `mask` of a chain owns it."""
    pdf = pdf.sort_values(["score", "contig", "r_lo", "lane", "q_lo"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
    lo, hi, score = (pdf[c].to_numpy(dtype=np.float64) for c in ("q_lo", "q_hi", "score"))
    owners = np.zeros(0, dtype=np.int64)
    parent, second, rivals = np.arange(len(pdf)), np.zeros(len(pdf)), np.zeros(len(pdf), dtype=np.int64)
    for i in range(len(pdf)):
        over = np.minimum(hi[i], hi[owners]) - np.maximum(lo[i], lo[owners])
        found = owners[over > mask * np.minimum(hi[i] - lo[i], hi[owners] - lo[owners])]
        if len(found):
            o = parent[i] = found[0]
            second[o] = max(second[o], score[i])
            rivals[o] += score[i] >= 0.8 * score[o]
        else:
            owners = np.append(owners, i)
    pdf["rank"], pdf["parent"], pdf["f2"], pdf["n_sub"] = range(len(pdf)), parent, second, rivals
    return pdf


def owners(placed: DataFrame, mask: float = 0.5) -> DataFrame:
    """Chains with rank, parent (equal to rank for owners), best rival score f2 and number of near rivals n_sub."""
    ship(placed.sparkSession)
    schema = f"{CHAINS}, length int, rank int, parent int, f2 double, n_sub int"
    return placed.groupBy("id").applyInPandas(lambda pdf: own_group(pdf, mask)[[f.split()[0] for f in schema.split(", ")]], schema)

