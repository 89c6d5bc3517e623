"""Row numbers over a whole table without putting it into one task, and budgets along an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import cut


def numbered(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """rows with their place (from 0) in the order; the rows are dealt by range, and only sizes of ranges meet.

    The rows are written once, so that ranges are the same when sizes are counted and when rows are numbered.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    begin = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a range; the join is broadcast under Spark's size threshold.
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(sizes.withColumn("_begin", begin).drop("_n"), "_range").withColumn(name, (F.col("_begin") + inside - 1).cast("int")).drop("_range", "_begin")


def budgeted(lengths: Column, budget: int, closing: bool) -> Column:
    """The batch number of each length along an array, in order.

    closing: a batch ends with the element that reaches the budget; otherwise before the one that would exceed it, and a
    larger element is a batch of its own.
    """
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def step(s: Column, n: Column) -> Column:
        if closing:
            full = s["sum"] + n >= budget
            return F.struct(F.when(full, 0).otherwise(s["sum"] + n).cast("long").alias("sum"), (s["at"] + full.cast("int")).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all"))
        fresh = (F.size(s["all"]) > 0) & (s["sum"] + n > budget)
        at = s["at"] + fresh.cast("int")
        return F.struct(F.when(fresh, n).otherwise(s["sum"] + n).cast("long").alias("sum"), at.alias("at"), F.concat(s["all"], F.array(at)).alias("all"))

    return F.aggregate(lengths, state, step, lambda s: s["all"])
