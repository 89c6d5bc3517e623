"""Lines of placements: integer least squares of a winner's seeds, and whether a rival lies on the winner's line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.session import cut, free

#: Slopes are whole numbers of 2**-20, between -6 % and +10 %; a line rests on 8 seeds over a quarter of
#: its read; reach and trim have floors in bases.
ONE = 1 << 20
LOW, HIGH = -(6 * ONE // 100), 10 * ONE // 100
LEAST_PAIRS, REACH_FLOOR, TRIM_FLOOR = 8, 256, 64
LIMIT = (1 << 31) - 1
#: Fixed values of the shadow rule: share of the shorter span, floor of the slack in bases, its part of the read.
SHADOW_SHARE, SLACK_FLOOR, SLACK_PART = 0.5, 2000, 5


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def floor_div(a: Column, b: Column) -> Column:
    """Floor of a / b for whole numbers of any width, b positive."""
    whole = F.call_function("div", _wide(a), _wide(b))
    return whole - F.when(_wide(whole) * _wide(b) > _wide(a), 1).otherwise(0)


def fitted(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, sum_q, sum_d, slope) of the least-squares line of pairs (q, d); groups without a slope are left out.

    Sums are whole numbers of 38 digits, so the line does not depend on the order of rows. The slope is rounded half up
    to 2**-20.
    """
    q, d = _wide(F.col("q")), _wide(F.col("d"))
    sums = pairs.groupBy(*by).agg(_wide(F.count("*")).alias("n"), _wide(F.sum(q)).alias("sum_q"), _wide(F.sum(d)).alias("sum_d"), _wide(F.sum(q * q)).alias("qq"), _wide(F.sum(q * d)).alias("qd"))
    den, num = F.col("n") * F.col("qq") - F.col("sum_q") * F.col("sum_q"), F.col("n") * F.col("qd") - F.col("sum_q") * F.col("sum_d")
    rows = sums.withColumns({"den": _wide(den), "num": _wide(num)}).where("den > 0")
    slope = floor_div(F.col("num") * F.lit(2 * ONE) + F.col("den"), F.col("den") * F.lit(2))
    return rows.select(*by, "n", "sum_q", "sum_d", F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), slope)).cast("long").alias("slope"))


def on_line(q: Column) -> Column:
    """d of the line (n, sum_q, sum_d, slope) at q, rounded down."""
    n = _wide(F.col("n"))
    return floor_div(F.col("sum_d") * F.lit(ONE) + _wide(F.col("slope")) * (n * _wide(q) - F.col("sum_q")), n * F.lit(ONE))


def nearest_pairs(points: DataFrame, by: list[str], centre: Column, lo: Column, hi: Column) -> DataFrame:
    """(by, q, d): for each seed (by, q) its posting d in [lo, hi] nearest the centre, the smaller one on ties."""
    inside = points.where((F.col("d") >= lo) & (F.col("d") <= hi))
    return inside.groupBy(*by, "q").agg(F.min(F.struct(F.abs(F.col("d") - centre).alias("cost"), "d"))["d"].alias("d"))


def winner_lines(points: DataFrame, winners: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, span, slope, intercept, gate) for every winner (by, bin, start, width, length).

    points (by, q, d) are the postings of the winner's seeds on its contig and strand. A first line goes through the seeds
    within a bin of the winner's, a second through those along the first; the seeds within three median deviations of the
    second give the line. Its slope is held between -6 and +10 percent; `gate` says that it is the read's own. A winner
    without a line has zeros. All steps are aggregations by winner, rows of one read are gathered only for the medians.
    """
    width = F.greatest("width", F.lit(1))
    own = points.join(winners.select(*by, "bin", "start", width.alias("width")), by)
    first = fitted(nearest_pairs(own, by, F.col("start"), (F.col("bin") - 1) * F.col("width"), (F.col("bin") + 2) * F.col("width") - 1), by)
    along = own.join(first, by).withColumn("centre", on_line(F.col("q")))
    reach = F.greatest(F.col("width"), F.lit(REACH_FLOOR))
    # Each step reads the rows of the one before more than once, so they are written.
    pairs = cut(nearest_pairs(along, by, F.col("centre"), F.col("centre") - reach, F.col("centre") + reach))
    off = cut(pairs.join(fitted(pairs, by), by).select(*by, "q", "d", (F.col("d") - on_line(F.col("q"))).alias("off")))
    free(pairs)
    # A median is the upper middle element.
    middle = lambda sorted_: F.element_at(sorted_, F.floor(F.size(sorted_) / 2).cast("int") + 1)
    centres = off.groupBy(*by).agg(F.array_sort(F.collect_list("off")).alias("offs")).withColumn("median", middle(F.col("offs")))
    trims = centres.withColumn("devs", F.array_sort(F.transform("offs", lambda x: F.abs(x - F.col("median"))))).select(*by, F.greatest(3 * middle(F.col("devs")), F.lit(TRIM_FLOOR)).alias("trim"))
    kept = off.join(trims, by).where(F.abs("off") <= F.col("trim"))
    spans = kept.groupBy(*by).agg(F.count("*").alias("pairs"), (F.max("q") - F.min("q")).alias("reached"))
    line = fitted(kept, by).withColumn("slope", F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("slope"))).cast("long"))
    line = line.select(*by, "slope", on_line(F.lit(0)).alias("intercept"))
    out = winners.select(*by, "length").join(spans, by, "left").join(line, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.withColumns({"span": zero(F.when(F.col("slope").isNotNull(), F.col("reached"))), "fits": F.col("slope").isNotNull()})
    gate = F.col("fits") & (F.col("pairs") >= LEAST_PAIRS) & (4 * F.col("span") >= F.col("length")) & (F.col("slope") != LOW) & (F.col("slope") != HIGH)
    return out.select(*by, zero(F.col("pairs")).alias("n"), "span", zero(F.col("slope")).alias("slope"), zero(F.col("intercept")).alias("intercept"), F.coalesce(gate, F.lit(False)).alias("gate"))


def slack(length: Column) -> Column:
    """How far a shadow may lie off the winner's line on a read of `length` bases."""
    return F.greatest(F.lit(SLACK_FLOOR), F.floor(F.greatest(length, F.lit(0)) / SLACK_PART)).cast("long")


def shadow(winner: dict[str, Column], rival: dict[str, Column], length: Column, off: Column) -> dict[str, Column]:
    """half, contained, on_diagonal and shadow: whether a rival lies on the winner's locus.

    winner and rival hold r_lo, r_hi (target span), q_lo, q_hi (query span) and reverse. A rival is a shadow if more than
    half of the shorter target span is common, its span lies in the winner's widened by `off`, and both its ends lie on
    the diagonals of the winner's ends widened likewise. Empty or negative spans are on no diagonal and cast no shadow.
    """
    ends = []
    for x in (winner, rival):
        lo, hi = (F.when(x["reverse"], length - b).otherwise(a) for a, b in ((x["q_lo"], x["q_hi"]), (x["q_hi"], x["q_lo"])))
        ends.append((x["r_lo"] - lo, x["r_hi"] - hi))
    (w0, w1), (r0, r1) = ends
    spans = lambda lo, hi: (winner[lo] >= 0) & (winner[hi] > winner[lo]) & (rival[lo] >= 0) & (rival[hi] > rival[lo])
    placed = spans("r_lo", "r_hi")
    common = F.least(winner["r_hi"], rival["r_hi"]) - F.greatest(winner["r_lo"], rival["r_lo"])
    shorter = F.least(winner["r_hi"] - winner["r_lo"], rival["r_hi"] - rival["r_lo"])
    half = placed & (common > 0) & (common > SHADOW_SHARE * shorter)
    contained = placed & (rival["r_lo"] >= winner["r_lo"] - off) & (rival["r_hi"] <= winner["r_hi"] + off)
    low, high = F.least(w0, w1) - off, F.greatest(w0, w1) + off
    diagonal = placed & spans("q_lo", "q_hi") & r0.between(low, high) & r1.between(low, high)
    return {"half": half, "contained": contained, "on_diagonal": diagonal, "shadow": half & contained & diagonal}


def kept_records(rows: DataFrame, least_anchors: int = 3, least_matches: int = 40, least_score: int = 40) -> DataFrame:
    """Records (inversion, anchors, matches, dp_max) that reach all floors; inversions need no anchors."""
    return rows.where((F.col("inversion") | (F.col("anchors") >= least_anchors)) & (F.col("matches") >= least_matches) & (F.col("dp_max") >= least_score))
