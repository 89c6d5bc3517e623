"""Mixing sources to target weights.

Words are counted for each source, targets are shared out by weight under a cap, and a document is emitted
floor(rate) times plus once more with probability equal to the rate's fraction, by a hash of seed and doc_id.

A null or empty text has size 0 and is emitted like any other of its source, adding no words. Sources are ordered by
code point, null last; null is a source of its own. A source whose documents hold no words has target 0 and rate 0, so
its documents are not taken. Rows with a null doc_id share one hash; repeated rows are taken alike. Texts of any length
are counted whole. An empty table gives no rows. `emit` carries extra columns, whatever their names; `taken` ignores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0


def words(column: str = "text") -> Column:
    """Number of words: places where a word begins, counted without building the words."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size), one row a source.

    Resharing until no source is above its cap ends where capped sources are those of least cap/weight: with sources
    in that order, a source is capped when giving the remainder of the total to it and all later ones by weight would
    exceed its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("_w", cases).withColumn("_cap", F.col("source_size") * F.lit(cap))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("_total", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    rows = rows.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    rows = rows.withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    # The level at the first source that is not full holds for all later ones.
    level = F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("_w")).alias("_r"), "_level")))
    rows = rows.withColumn("_free", level.over(Window.partitionBy()))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_free").getField("_level") * F.col("_w"))
    rows = rows.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", "target", rate.alias("rate"))


def uniform(seed: int, column: str = "doc_id") -> Column:
    """A number in [0, 1) for each document, from 52 bits of an MD5 digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs with _size, _source_size, _target and _copies; documents are not shuffled.

    Sources are aggregated before their one small shuffle, so a source with a third of the rows is one row a task.
    The rates go to the documents by a join that Spark broadcasts only under its size threshold.
    """
    sized = docs.withColumn("_size", words())
    rates = targets(sized.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, cap)
    rates = rates.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    rated = sized.join(rates, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.floor("_rate")
    copies = (whole + F.when(uniform(seed) < F.col("_rate") - whole, 1).otherwise(0)).cast("int")
    return rated.withColumn("_copies", copies).drop("_rate")


def emit(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    inner = [f"c{i}" for i in range(len(docs.columns))]  # names of docs cannot clash with ours
    of = dict(zip(docs.columns, inner, strict=True))
    work = docs.toDF(*inner).withColumns({c: F.col(of[c]) for c in ("doc_id", "text", "source")})
    planned = plan(work, seed).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
    return planned.select(*inner).toDF(*docs.columns)


def taken(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    p = plan(docs.select("doc_id", "text", "source"), seed)
    return p.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))
