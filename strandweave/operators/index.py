"""The seed index: an inverted index over reference seeds, its statistics and its caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def postings(reference_seeds: DataFrame) -> DataFrame:
    """(key, contig, pos, z) in the order of the index. Sorted by range, so that a key of many postings is many tasks."""
    return reference_seeds.select("key", F.col("id").alias("contig"), "pos", "z").orderBy("key", "contig", "pos", "z")


def keys(reference_seeds: DataFrame) -> DataFrame:
    """(key, occ, first_contig, first_pos): one row a key with its first posting; partial results before the shuffle."""
    first = F.min(F.struct("id", "pos"))
    return reference_seeds.groupBy("key").agg(F.count("*").alias("occ"), first.alias("f")).select("key", "occ", F.col("f.id").alias("first_contig"), F.col("f.pos").alias("first_pos"))


def occurrences(reference_seeds: DataFrame) -> DataFrame:
    """(key, occ); partial counts are taken before the shuffle."""
    return reference_seeds.groupBy("key").agg(F.count("*").alias("occ"))


def histogram(occ: DataFrame) -> DataFrame:
    """(occ, n_keys)."""
    return occ.groupBy("occ").agg(F.count("*").alias("n_keys"))


def occurrence_cap(occ: DataFrame, fraction: float = 1.81e-4, floor: int = 200, ceiling: int | None = None) -> DataFrame:
    """One row (quantile, cap): the occurrence at rank floor((1 - fraction) n) plus one, held between floor and ceiling (none by default).

    The window runs over the histogram, whose rows are distinct occurrences, not keys.
    """
    h = histogram(occ)
    w = Window.orderBy("occ").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = h.withColumn("upto", F.sum("n_keys").over(w)).withColumn("n", F.sum("n_keys").over(Window.partitionBy()))
    found = ranked.where(F.col("upto") > F.floor((1 - fraction) * F.col("n"))).agg((F.min("occ") + 1).alias("quantile"))
    cap = F.greatest(F.lit(floor), F.col("quantile"))
    return found.select("quantile", (cap if ceiling is None else F.least(F.lit(ceiling), cap)).cast("long").alias("cap"))


def resolved_cap(occ: DataFrame) -> int:
    """The index's own occurrence cap: one number."""
    return int(occurrence_cap(occ).first()["cap"])


def admitted(reference_seeds: DataFrame, cap: int) -> DataFrame:
    """Reference seeds of keys within the cap, with occ."""
    return reference_seeds.join(occurrences(reference_seeds).where(F.col("occ") <= cap), "key")


def without_self(own: DataFrame) -> DataFrame:
    """(id, elsewhere, keys) of texts with (key, id, n): occurrences of a text's keys in other texts, and its keys.

    Rows are dealt by key once; the occurrences of a key are then summed where its texts are.
    """
    each = own.repartition("key").groupBy("key", "id").agg(F.sum("n").alias("n"))
    occ = F.sum("n").over(Window.partitionBy("key"))
    return each.withColumn("occ", occ).groupBy("id").agg(F.sum(F.col("occ") - F.col("n")).alias("elsewhere"), F.count("*").alias("keys"))


def accounting(reference_seeds: DataFrame) -> DataFrame:
    """(distinct_keys, postings, contigs)."""
    return reference_seeds.agg(F.countDistinct("key").alias("distinct_keys"), F.count("*").alias("postings"), F.countDistinct("id").alias("contigs"))


class SeedIndex:
    """A seed index on disk: seeds bucketed and sorted by key, so that lookups read it without a shuffle."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def build(cls, reference_seeds: DataFrame, name: str, buckets: int = 16) -> SeedIndex:
        spark = reference_seeds.sparkSession
        with_occ = reference_seeds.join(occurrences(reference_seeds), "key")
        with_occ.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key", "id", "pos").mode("overwrite").saveAsTable(name)
        return cls(spark, name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, keys: DataFrame, cap: int | None = None) -> DataFrame:
        found = self.table().where(F.col("occ") <= cap) if cap else self.table()
        return keys.join(found.withColumnsRenamed({"id": "contig", "pos": "r", "z": "rz"}), "key")
