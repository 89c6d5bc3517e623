"""Text sinks of alignment records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """Lines in order over part files whose names sort alike; one_file gathers them, for results that fit a task."""
    out = lines.orderBy(*order).select("line")
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def sam_header(contigs: DataFrame, program: str = "strandweave", version: str = "0.1.0") -> DataFrame:
    """(n, line): @HD, an @SQ line a contig in order of name, @PG."""
    spark = contigs.sparkSession
    fixed = spark.createDataFrame([(0, "", "@HD\tVN:1.6\tSO:unsorted"), (2, "", f"@PG\tID:{program}\tPN:{program}\tVN:{version}")], "n int, name string, line string")
    sq = contigs.select(F.lit(1).alias("n"), "name", F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("line"))
    return fixed.unionByName(sq)


def sam_line(name, flag, target, position, mapq, cigar, seq, qual, tags):
    """Eleven columns and tags as a Column; position is 0-based, tags that are null are left out."""
    unmapped = target.isNull()
    cells = [name, flag.cast("string"), F.coalesce(target, F.lit("*")), F.when(unmapped, "0").otherwise((position + 1).cast("string")), F.coalesce(mapq, F.lit(0)).cast("string"), F.coalesce(cigar, F.lit("*")), F.lit("*"), F.lit("0"), F.lit("0"), F.coalesce(seq, F.lit("*")), F.coalesce(qual, F.lit("*"))]
    return F.concat_ws("\t", *cells, *tags)
