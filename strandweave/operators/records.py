"""Records: map quality, roles, PAF and SAM lines, and CIGAR functions, all as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONSUMES_QUERY, CONSUMES_TARGET = "MIS=X", "MDN=X"


def chain_quality(f1: Column, f2: Column, count: Column, n_sub: Column, minimum: float = 40.0) -> Column:
    """Map quality of a chain without base alignment."""
    penalty = F.least(F.lit(1.0), f1 * 0.01) * F.least(F.lit(1.0), count * 0.1)
    x = F.greatest(f2, F.lit(minimum)) / f1
    q = F.floor(penalty * 40.0 * (1.0 - F.least(x, F.lit(1.0))) * F.ln(f1)) - F.floor(4.343 * F.ln(n_sub + 1.0) + 0.499)
    return F.greatest(F.lit(0), F.least(F.lit(60), q)).cast("int")


def role(rank: Column, parent: Column) -> Column:
    """primary, supplementary or secondary of an owned chain."""
    return F.when(parent != rank, "secondary").when(rank == 0, "primary").otherwise("supplementary")


def flag(role_name: Column, reverse: Column, mapped: Column | None = None) -> Column:
    """SAM FLAG bits."""
    bits = F.when(reverse, 16).otherwise(0) + F.when(role_name == "secondary", 256).otherwise(0) + F.when(role_name == "supplementary", 2048).otherwise(0)
    return bits if mapped is None else F.when(mapped, bits).otherwise(4)


def paf_type(role_name: Column) -> Column:
    return F.when(role_name == "secondary", "S").otherwise("P")


def clean_field(x: Column) -> Column:
    """Tabs and line ends to _, empty to *."""
    cleaned = F.translate(x, "\t\n\r", "___")
    return F.when(F.coalesce(F.length(x), F.lit(0)) == 0, "*").otherwise(cleaned)


def paf_line(name: Column, qlen: Column, qb: Column, qe: Column, reverse: Column, target: Column, tlen: Column, tb: Column, te: Column, matches: Column, block: Column, mapq: Column, tags: list[Column]) -> Column:
    """Twelve columns and tags; tags that are null are left out."""
    strand = F.when(reverse, "-").otherwise("+")
    return F.concat_ws("\t", *[c.cast("string") for c in (clean_field(name), qlen, qb, qe, strand, clean_field(target), tlen, tb, te, matches, block, mapq)], *tags)


def paf_no_hit(name: Column, qlen: Column) -> Column:
    return F.concat_ws("\t", clean_field(name), qlen.cast("string"), F.lit("0\t0\t*\t*\t0\t0\t0\t0\t0\t0"))


def tag(name: str, kind: str, value: Column) -> Column:
    """name:kind:value, null where the value is."""
    return F.concat(F.lit(f"{name}:{kind}:"), value.cast("string"))


def cigar_ops(cigar: Column) -> Column:
    """CIGAR text to an array of (n, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)), lambda t: F.struct(F.substring(t, F.lit(1), F.length(t) - 1).cast("int").alias("n"), F.right(t, F.lit(1)).alias("op")))


def op_sum(ops: Column, kinds: str) -> Column:
    """Total length of the operations in `kinds`."""
    return F.aggregate(ops, F.lit(0), lambda acc, o: acc + F.when(F.lit(kinds).contains(o["op"]), o["n"]).otherwise(0))


FIELDS = {"query_span": "MI=X", "target_span": CONSUMES_TARGET, "block_len": "MID=X", "matches": "M=", "gap_bases": "ID", "gap_opens": "ID", "clipped": "SH"}


def _account() -> Callable:
    """A function of its own, so that workers need no package: sums of a whole column of CIGARs at once."""
    fields = dict(FIELDS)

    def run(cigars: pd.Series) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        text = np.frombuffer(("\n".join(["", *cigars.fillna("")]) + "\n").encode("ascii", "replace"), np.uint8)
        stops = np.flatnonzero((text < 48) | (text > 57))  # all but digits
        before = np.diff(stops, prepend=-1) - 1  # digits before each
        row = np.cumsum(text[stops] == 10) - 1  # a line end opens each row
        value, high = np.zeros(len(stops), np.int64), int(before.max(initial=0))
        for j in range(high):
            own = before > j
            value[own] += (text[stops[own] - 1 - j].astype(np.int64) - 48) * 10**j
        kind = np.where(before > 0, text[stops], 0)
        out = {}
        for name, kinds in fields.items():
            own = np.isin(kind, np.frombuffer(kinds.encode(), np.uint8))
            n = np.bincount(row[own], weights=None if name == "gap_opens" else value[own], minlength=len(cigars) + 1)
            out[name] = n[: len(cigars)].astype(np.int32)
        return pd.DataFrame(out)

    return run


def accounted(cigar: Column) -> Column:
    """Spans, block length, matches, gap bases and gap opens of a CIGAR as one struct: a column is parsed once, as bytes."""
    sums = F.pandas_udf(_account(), ", ".join(f"{n} int" for n in FIELDS))
    return F.when(cigar.isNotNull(), sums(cigar))


def strip_clips(cigar: Column) -> Column:
    """CIGAR without terminal soft clips."""
    return F.regexp_replace(cigar, r"^\d+S|\d+S$", "")


def hard_clip(cigar: Column) -> Column:
    """Terminal soft clips to hard clips."""
    return F.regexp_replace(F.regexp_replace(cigar, r"^(\d+)S", "$1H"), r"(\d+)S$", "$1H")


def merged_runs(cigar: Column) -> Column:
    """CIGAR text with neighbouring equal operations joined."""
    start = F.slice(cigar_ops(cigar), 1, 0)

    def put(acc: Column, o: Column) -> Column:
        same = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == o["op"])
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(same, F.concat(head, F.array(F.struct((F.try_element_at(acc, F.lit(-1))["n"] + o["n"]).alias("n"), o["op"].alias("op"))))).otherwise(F.concat(acc, F.array(o)))
    return F.array_join(F.transform(F.aggregate(cigar_ops(cigar), start, put), lambda o: F.concat(o["n"].cast("string"), o["op"])), "")


def divergence(mismatches: Column, gap_opens: Column, matches: Column) -> Column:
    """Gap-compressed divergence as text: 0, or four decimals."""
    d = (mismatches + gap_opens) / (matches + mismatches + gap_opens)
    return F.when(mismatches + gap_opens == 0, "0").otherwise(F.format_string("%.4f", F.bround(d, 4)))


def chain_divergence(matched: Column, total: Column, k: int) -> Column:
    """Divergence that a share of matched seeds of k bases stands for."""
    return 1.0 - F.pow(matched.cast("double") / total, F.lit(1.0 / k))


def max_segment(ops: Column, match: int = 2, mismatch: int = 8, gap_open: int = 12, gap_extend: int = 2) -> Column:
    """Best score of any stretch of an alignment written with = and X."""
    gain = lambda o: F.when(o["op"] == "=", o["n"] * match).when(o["op"] == "X", o["n"] * -mismatch).when(o["op"].isin("I", "D"), -(o["n"] * gap_extend + gap_open)).otherwise(0)
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(s: Column, o: Column) -> Column:
        now = F.greatest(F.lit(0), s["now"] + gain(o))
        return F.struct(now.alias("now"), F.greatest(s["top"], now).alias("top"))
    return F.aggregate(ops, state, step, lambda s: s["top"])


def placements(owned: DataFrame, secondaries: int = 5, ratio: float = 0.8) -> DataFrame:
    """Owned chains with role and mapq; secondaries of at least `ratio` of their owner's score, `secondaries` at most."""
    top = owned.where("rank = parent").select("id", F.col("rank").alias("parent"), F.col("score").alias("own"))
    joined = owned.join(top, ["id", "parent"]).withColumn("role", role(F.col("rank"), F.col("parent")))
    w = Window.partitionBy("id", "parent", "role").orderBy("rank")
    kept = joined.withColumn("_n", F.row_number().over(w)).where((F.col("role") != "secondary") | ((F.col("score") >= ratio * F.col("own")) & (F.col("_n") <= secondaries)))
    quality = chain_quality(F.col("score"), F.col("f2"), F.col("n_anchors").cast("double"), F.col("n_sub").cast("double"))
    return kept.withColumn("mapq", F.when(F.col("role") == "secondary", 0).otherwise(quality)).drop("_n", "own")


def supplementary_tag(records: DataFrame) -> DataFrame:
    """records (id, seg, target, pos, strand, cigar, mapq, nm) with the SA tag: the other segments of the same query."""
    item = F.concat_ws(",", "target", (F.col("pos") + 1).cast("string"), "strand", "cigar", F.col("mapq").cast("string"), F.col("nm").cast("string"))
    all_of = F.array_sort(F.collect_list(F.struct("seg", item.alias("sa"))).over(Window.partitionBy("id")))
    others = F.filter(all_of, lambda x: x["seg"] != F.col("seg"))
    text = F.array_join(F.transform(others, lambda x: F.concat(x["sa"], F.lit(";"))), "")
    return records.withColumn("sa", F.when(F.size(others) > 0, F.concat(F.lit("SA:Z:"), text)))
