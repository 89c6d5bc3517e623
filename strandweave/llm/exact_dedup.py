"""Exact dedup against a persistent digest index.

The index is a table (text_sha256, keep_id) bucketed and sorted by digest. A batch is aggregated to one row a digest,
anti-joined with the index by a sort-merge join that reads the index without a shuffle, and what is new is appended.

One table is taken in as two batches, the rows of larger doc_ids first: what the second one adds is new to the index,
and a digest that both hold stays with the first, which has its largest doc_id.

Texts are equal when their bytes are; null counts as empty and equals the empty text. Inside a batch the largest doc_id
of a digest stays (nulls last); a digest that the index already holds stays with the document that brought it.
Repeated doc_ids are separate rows of a group; of rows that tie on the kept doc_id each is marked kept, and `filter_new`
returns one. An empty batch adds nothing. Texts of any length are hashed whole. Extra columns are ignored by the index
and carried by `filter_new`, whatever their names.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.graph import SALTS
from strandweave.session import cut, shared_dir


def digest(column: str = "text"):
    return F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"), 256)


class DigestIndex:
    """A persistent set of digests; `name` is a table in the session's catalogue, `path` its folder if outside the warehouse."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    @classmethod
    def temporary(cls, spark: SparkSession) -> DigestIndex:
        """An index in the shared folder that goes when the driver ends."""
        name = f"digest_index_{uuid.uuid4().hex[:12]}"
        index = cls(spark, name, f"{shared_dir(spark)}/{name}")

        def end() -> None:
            with contextlib.suppress(Exception):  # the session may have ended, and the folder with it
                index.drop()

        atexit.register(end)
        return index

    def fresh(self, docs: DataFrame) -> DataFrame:
        """(text_sha256, keep_id) of the digests that docs hold and the index does not."""
        # Partial results are taken before the shuffle, so a digest with a third of the rows is one row a task.
        rows = docs.select(digest().alias("text_sha256"), F.col("doc_id"))
        new = rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"))
        if self.exists():
            new = new.join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        return new

    def add(self, docs: DataFrame) -> DataFrame:
        """Append what is new; returns the index."""
        return self.append(self.fresh(docs))

    def append(self, new: DataFrame) -> DataFrame:
        """Append entries of digests that the index lacks."""
        writer = new.repartition(self.buckets, "text_sha256").write.format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)
        return self.table()

    def drop(self) -> None:
        """Drop the table and, where it has a folder of its own, its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.path:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def newest_first(docs: DataFrame) -> list[DataFrame]:
    """docs as two batches, the larger doc_ids first; nulls come last."""
    middle = docs.agg(F.percentile_approx("doc_id", 0.5, 1000).alias("m")).first()["m"]
    upper = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    return [docs.where(upper), docs.where(~upper)]


def classes(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, with its digest's entry in the index.

    The rows of a digest are dealt over SALTS tasks; the index entry and the group's size are copied to the salts that
    occur.
    """
    rows = docs.select("doc_id", digest().alias("text_sha256"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    part = rows.groupBy("text_sha256", "_salt").agg(F.count("*").alias("n"))
    sizes = part.groupBy("text_sha256").agg(F.sum("n").alias("group_size"), F.collect_list("_salt").alias("_salts"))
    entries = sizes.join(index, "text_sha256").withColumn("_salt", F.explode("_salts")).drop("_salts")
    out = rows.join(entries, ["text_sha256", "_salt"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def filter_new(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs, with all their columns, that stay beside what the index holds; the index then holds them too.

    Of rows that tie on digest and doc_id one stays.
    """
    fresh = cut(index.fresh(docs))
    index.append(fresh)
    plain = [f"c{i}" for i in range(len(docs.columns))]  # names of docs cannot clash with ours
    renamed = docs.toDF(*plain)
    of = dict(zip(docs.columns, plain, strict=True))
    rows = renamed.withColumn("sha", digest(of["text"]))
    # Digest and doc_id together are unique but for repeated rows, so a large group is no large key.
    kept = rows.join(fresh, (F.col("sha") == F.col("text_sha256")) & F.col(of["doc_id"]).eqNullSafe(F.col("keep_id")))
    return kept.dropDuplicates(["sha"]).select(*plain).toDF(*docs.columns)


def exact_unique(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, by an index made for it."""
    index = DigestIndex.temporary(docs.sparkSession)
    newer, older = newest_first(docs)
    return filter_new(newer, index).union(filter_new(older, index))


def exact_classes(docs: DataFrame) -> DataFrame:
    """Classes of one table by an index made for it."""
    index = DigestIndex.temporary(docs.sparkSession)
    for batch in newest_first(docs):
        index.add(batch)
    return classes(docs, index.table())
