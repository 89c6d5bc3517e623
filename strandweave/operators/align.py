"""Base alignment of placed stretches, and replay of alignments to difference strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import sequence as sq
from strandweave.session import ship

MATCH, MISMATCH, AMBIGUOUS = 2, 8, 1
#: Open and extend of the two gap pieces; a gap costs the cheaper one.
GAPS = ((12, 2), (32, 1))
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def gap_cost(n):
    return np.minimum(*[o + e * n for o, e in GAPS])


def codes(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode(), dtype=np.uint8)


def align(query: str, target: str) -> tuple[int, str]:
    """Best global score and its alignment, written with = X I D.

    Rows are vectorised: a gap along a row starts from the best of all earlier cells, which a running maximum gives, since
    the costs are linear in the gap's length. N matches nothing and costs little. Ties go to the diagonal, then the shortest gap in the
    target, then in the query.
    """
    q, t = codes(query), codes(target)
    n, m = len(q), len(t)
    at = np.arange(m + 1)
    best = np.empty((n + 1, m + 1), dtype=np.int32)
    best[0] = -gap_cost(at)
    best[0, 0] = 0
    down = [np.full(m + 1, -(1 << 28), dtype=np.int64) for _ in GAPS]
    for i in range(1, n + 1):
        above = best[i - 1].astype(np.int64)
        step = np.where((t == ord("N")) | (q[i - 1] == ord("N")), -AMBIGUOUS, np.where(t == q[i - 1], MATCH, -MISMATCH))
        row = np.full(m + 1, -(1 << 28), dtype=np.int64)
        row[1:] = above[:-1] + step
        for k, (o, e) in enumerate(GAPS):
            down[k] = np.maximum(down[k], above - o) - e
            row = np.maximum(row, down[k])
        out = row.copy()
        for o, e in GAPS:
            run = np.maximum.accumulate(row + e * at)
            out[1:] = np.maximum(out[1:], run[:-1] - o - e * at[1:])
        best[i] = out
    ops: list[tuple[int, str]] = []
    i, j = n, m
    while i or j:
        if i and j:
            same = q[i - 1] == t[j - 1] and q[i - 1] != ord("N")
            unsure = ord("N") in (q[i - 1], t[j - 1])
            if best[i, j] == best[i - 1, j - 1] + (-AMBIGUOUS if unsure else MATCH if same else -MISMATCH):
                ops.append((1, "=" if same else "X"))
                i, j = i - 1, j - 1
                continue
        back = np.flatnonzero(best[i, :j][::-1] - gap_cost(np.arange(1, j + 1)) == best[i, j]) if j else []
        if len(back):
            ops.append((int(back[0]) + 1, "D"))
            j -= int(back[0]) + 1
        else:
            up = np.flatnonzero(best[:i, j][::-1] - gap_cost(np.arange(1, i + 1)) == best[i, j])
            ops.append((int(up[0]) + 1, "I"))
            i -= int(up[0]) + 1
    return int(best[n, m]), joined(ops[::-1])


def joined(ops: list[tuple[int, str]]) -> str:
    out: list[list] = []
    for n, op in ops:
        if out and out[-1][1] == op:
            out[-1][0] += n
        else:
            out.append([n, op])
    return "".join(f"{n}{op}" for n, op in out)


def ungapped(query: str, target: str) -> int | None:
    """Score of the ungapped alignment of equal lengths where no gapped one can beat it, else None.

    A gapped alignment of equal lengths needs a gap on each side, so it loses two gap costs and the matches of the bases
    that it leaves out.
    """
    if len(query) != len(target):
        return None
    q, t = codes(query), codes(target)
    unsure = (q == ord("N")) | (t == ord("N"))
    same = int(((q == t) & ~unsure).sum())
    score = MATCH * same - MISMATCH * (len(q) - same - int(unsure.sum())) - AMBIGUOUS * int(unsure.sum())
    return score if score >= MATCH * (len(q) - 1) - 2 * int(gap_cost(1)) else None


def replay(cigar: str, query: str, target: str) -> dict[str, object]:
    """Short cs and MD strings, edit distance and matches of an alignment; M, = and X compare bases; N
    equals nothing."""
    cs, md, run, equal, nm, matches, i, j = [], [], 0, 0, 0, 0, 0, 0
    for size, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        n = int(size)
        if op in "M=X":
            for a, b in zip(query[i : i + n], target[j : j + n], strict=True):
                if a == b != "N":
                    equal, run, matches = equal + 1, run + 1, matches + 1
                else:
                    cs += [f":{equal}"] * (equal > 0) + [f"*{b.lower()}{a.lower()}"]
                    md.append(f"{run}{b}")
                    equal = run = 0
                    nm += 1
            i, j = i + n, j + n
        elif op in "ID":
            cs += [f":{equal}"] * (equal > 0) + [("+" + query[i : i + n] if op == "I" else "-" + target[j : j + n]).lower()]
            equal, nm = 0, nm + n
            if op == "I":
                i += n
            else:
                md.append(f"{run}^{target[j : j + n]}")
                run, j = 0, j + n
        elif op == "N":
            cs += [f":{equal}"] * (equal > 0) + [f"~{target[j : j + 2].lower()}{n}{target[j + n - 2 : j + n].lower()}"]
            equal, j = 0, j + n
        elif op == "S":
            i += n
    cs += [f":{equal}"] * (equal > 0)
    return {"cs": "".join(cs), "md": "".join(md) + str(run), "nm": nm, "matches": matches}


def aligned(placements: DataFrame, reads: DataFrame, references: DataFrame) -> DataFrame:
    """Placements with dp_score, cigar, cs, md_tag, nm and matches of their stretch.

    reads: (id, seq); references: (contig, seq). Only the placed window of a reference goes to the aligner.
    """
    ship(placements.sparkSession)
    rev = F.col("lane") == 1
    own = F.when(rev, sq.reverse_complement(F.substring(F.col("seq"), (F.col("q_lo") + 1).cast("int"), (F.col("q_hi") - F.col("q_lo")).cast("int")))).otherwise(F.substring(F.col("seq"), (F.col("q_lo") + 1).cast("int"), (F.col("q_hi") - F.col("q_lo")).cast("int")))
    rows = placements.join(reads, "id").withColumn("q_seq", own).drop("seq")
    rows = rows.join(references, "contig").withColumn("t_seq", F.substring(F.col("seq"), (F.col("r_lo") + 1).cast("int"), (F.col("r_hi") - F.col("r_lo")).cast("int"))).drop("seq")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placements.schema) + ", dp_score int, cigar string, cs string, md_tag string, nm int, matches int"
    names = placements.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, t in zip(pdf.q_seq, pdf.t_seq, strict=True):
                score, cigar = align(q, t)
                r = replay(cigar, q, t)
                out.append((score, cigar, r["cs"], r["md"], r["nm"], r["matches"]))
            yield pd.concat([pdf[names], pd.DataFrame(out, columns=["dp_score", "cigar", "cs", "md_tag", "nm", "matches"], index=pdf.index)], axis=1)

    return rows.mapInPandas(run, schema)
