"""Known junctions from BED6 or BED12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def junctions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(chrom, begin, end, strands): distinct introns; strands has bit 1 for + and bit 2 for -.

    A line of 12 columns gives the gaps between its blocks, one of 6 its own interval. Comments, track and browser lines
    are skipped; other lines of fewer than 6 columns raise an error.
    """
    lines = spark.read.text(paths).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)")).select(F.split("value", "\t").alias("c"))
    lines = lines.select(F.when(F.size("c") >= 6, F.col("c")).otherwise(F.raise_error(F.lit("a BED line needs 6 columns"))).alias("c"))
    number = lambda i: F.col("c")[i].cast("long")
    listed = lambda i: F.transform(F.split(F.regexp_replace(F.col("c")[i], ",+$", ""), ","), lambda x: x.cast("long"))
    base = lines.select(F.col("c")[0].alias("chrom"), number(1).alias("lo"), number(2).alias("hi"), F.when(F.col("c")[5] == "-", 2).otherwise(1).alias("strand"), F.when(F.size("c") >= 12, listed(10)).alias("sizes"), F.when(F.size("c") >= 12, listed(11)).alias("starts"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("starts") - 1), lambda i: F.struct((F.col("lo") + F.get("starts", i - 1) + F.get("sizes", i - 1)).alias("begin"), (F.col("lo") + F.get("starts", i)).alias("end")))
    own = F.array(F.struct(F.col("lo").alias("begin"), F.col("hi").alias("end")))
    introns = F.when(F.col("starts").isNull(), own).when(F.size("starts") > 1, gaps)
    return base.select("chrom", "strand", F.explode(introns).alias("i")).groupBy("chrom", "i.begin", "i.end").agg(F.bit_or("strand").alias("strands"))
