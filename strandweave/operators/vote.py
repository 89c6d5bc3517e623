"""Diagonal voting: hits, bins, folds, peaks, suppression, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.sequence import floor_div
from strandweave.operators.seeds import K

WIDTH, FLOOR = 64, 3


def hits(query_seeds: DataFrame, reference_seeds: DataFrame, lengths: DataFrame, k: int = K) -> DataFrame:
    """(id, contig, lane, q, r): seed matches on each strand, q oriented along the lane.

    One equi-join serves both lanes: a match belongs to lane z XOR z', where q is the position or its mirror image.
    """
    r = reference_seeds.select("key", F.col("id").alias("contig"), F.col("pos").alias("r"), F.col("z").alias("rz"))
    joined = query_seeds.join(lengths, "id").join(r, "key")
    lane = F.col("z").bitwiseXOR(F.col("rz"))
    q = F.when(lane == 0, F.col("pos")).otherwise(F.col("length") - k - F.col("pos"))
    return joined.select("id", "contig", lane.alias("lane"), q.cast("int").alias("q"), "r")


def votes(matches: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, lane, contig, bin, support, start): distinct query positions of each diagonal bin, least reference start."""
    binned = matches.withColumn("bin", floor_div(F.col("r") - F.col("q"), width))
    return binned.groupBy("id", "lane", "contig", "bin").agg(F.countDistinct("q").alias("support"), F.min("r").alias("start"))


def folded(ballot: DataFrame, floor: int = FLOOR) -> DataFrame:
    """ballot with `score`, the support of a bin and its neighbours, where the support reaches the floor."""
    w = Window.partitionBy("id", "lane", "contig").orderBy("bin").rangeBetween(-1, 1)
    return ballot.withColumn("score", F.sum("support").over(w)).where(F.col("score") >= floor)


def ranked(peaks: DataFrame) -> DataFrame:
    """peaks with `rank` in draining order inside each query and lane."""
    w = Window.partitionBy("id", "lane").orderBy(F.desc("score"), F.desc("support"), "contig", "bin")
    return peaks.withColumn("rank", F.row_number().over(w))


def suppressed(peaks: DataFrame, apart: int = 2, limit: int = 16) -> DataFrame:
    """Ranked peaks left by non-maximum suppression: a peak within `apart` bins of a better one kept on its contig goes.

    Greedy in rank order over the peaks of one query and lane, as an aggregate over their sorted array; a query has a
    peak a diagonal bin at most that reached the floor.
    """
    row = F.struct("rank", "contig", "bin", "support", "score", "start")
    grouped = peaks.groupBy("id", "lane").agg(F.array_sort(F.collect_list(row)).alias("all"))
    empty = F.slice("all", 1, 0)
    near = lambda kept, p: F.exists(kept, lambda x: (x["contig"] == p["contig"]) & (F.abs(x["bin"] - p["bin"]) <= apart))
    kept = F.aggregate("all", empty, lambda acc, p: F.when(near(acc, p) | (F.size(acc) >= limit), acc).otherwise(F.concat(acc, F.array(p))))
    return grouped.select("id", "lane", F.explode(kept).alias("p")).select("id", "lane", "p.*")


def refined(peaks: DataFrame, matches: DataFrame, width: int = WIDTH, radius: int = 1) -> DataFrame:
    """Peaks with exact support, evidence range and upper-median start of the hits within `radius` bins."""
    binned = matches.withColumn("bin", floor_div(F.col("r") - F.col("q"), width))
    near = peaks.select("id", "lane", "contig", F.col("bin").alias("peak"), F.explode(F.sequence(F.col("bin") - radius, F.col("bin") + radius)).alias("bin"))
    own = near.join(binned, ["id", "lane", "contig", "bin"])
    starts = F.array_sort(F.collect_list(F.col("r") - F.col("q")))
    agg = own.groupBy("id", "lane", "contig", F.col("peak").alias("bin"))
    return agg.agg(F.countDistinct("q").alias("exact"), F.min("q").alias("q_lo"), F.max("q").alias("q_hi"), F.min("r").alias("r_lo"), F.max("r").alias("r_hi"), F.element_at(starts, F.floor(F.size(starts) / 2).cast("int") + 1).alias("median_start"))


def best(peaks: DataFrame) -> DataFrame:
    """The first peak of each query and lane."""
    return peaks.where("rank = 1")


def ratio_admitted(catalogue: DataFrame, ratio: float = 4.0) -> DataFrame:
    """Peaks without a peak of the same query that is `ratio` times as strong and covers half of their query span."""
    a, b = catalogue.alias("a"), catalogue.alias("b")
    over = F.least(F.col("a.q_hi"), F.col("b.q_hi")) - F.greatest(F.col("a.q_lo"), F.col("b.q_lo"))
    beaten = (F.col("a.id") == F.col("b.id")) & (F.col("b.exact") >= ratio * F.col("a.exact")) & (2 * over >= F.col("a.q_hi") - F.col("a.q_lo"))
    return a.join(b, beaten, "left_anti")


def tile_representatives(query_seeds: DataFrame, occ: DataFrame, lengths: DataFrame, tiles: int = 16) -> DataFrame:
    """The rarest seed of each query tile, ties by distance to the tile's centre, then position."""
    length = F.greatest("length", F.lit(1))
    t = F.least(F.floor(F.col("pos") * tiles / length).cast("int"), F.lit(tiles - 1))
    rows = query_seeds.join(lengths, "id").join(occ, "key").withColumn("tile", t)
    centre = F.floor((2 * F.col("tile") + 1) * F.col("length") / (2 * tiles)).cast("int")
    w = Window.partitionBy("id", "tile").orderBy("occ", F.abs(F.col("pos") - centre), "pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("id", "tile", "pos", "key", "occ")
