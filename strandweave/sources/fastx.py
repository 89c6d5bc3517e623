"""FASTA and FASTQ sources, plain or compressed, as DataFrames of (name, comment, seq, qual)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import ship
from strandweave.sources import bam, streams

SCHEMA = "file string, ordinal long, name string, comment string, seq string, qual string, tags array<string>"
TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
#: Bases and rows of a batch.
BASES, ROWS = 8_000_000, 1_000
#: The record types of a SAM header.
SAM_HEADS = (b"HD", b"SQ", b"RG", b"PG", b"CO")
#: A header: its mark, the name up to white space, and what follows one white space.
HEAD = re.compile(r".(\S*)\s?(.*)$", re.DOTALL)


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, comment, seq) of FASTA records; files are split between records, and read by JVM code alone.

    Sequences are upper-cased and their lines joined; an empty record keeps an empty sequence.
    """
    record = F.regexp_replace(F.col("value"), "^>", "")
    head = F.regexp_extract(record, r"^([^\r\n]*)", 1)
    body = F.upper(F.regexp_replace(F.substring(record, F.length(head) + 1, F.length(record)), r"[\r\n]", ""))
    rows = spark.read.option("lineSep", "\n>").text(paths).where(F.length(F.trim("value")) > 0)
    return rows.select(*named(head), body.alias("seq"))


def named(head: Column) -> list[Column]:
    """Name before the first white space, and the rest of a header."""
    return [F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment")]


def records(source: Iterator[bytes]) -> Iterator[tuple[str, str, str, str | None, list[str]]]:
    """(name, comment, seq, qual, tags) of FASTA or FASTQ bytes, of which one record is held at a time.

    A record that the end of the input cuts short is dropped: one whose qualities are fewer than its bases, and the last
    one of gzip data that end inside a member unless its qualities are whole. A FASTQ record of unequal lengths anywhere
    else is an error.
    """
    cut = False

    def upto() -> Iterator[bytes]:
        nonlocal cut
        try:
            yield from streams.lines(source)
        except streams.Cut:
            cut = True

    lines = upto()
    line = next(lines, None)
    while line is not None:
        if line[:1] not in (b">", b"@"):
            line = next(lines, None)
            continue
        name, comment = HEAD.match(line.decode("utf-8", "replace")).groups()
        seq: list[bytes] = []
        while (line := next(lines, None)) is not None and line[:1] not in (b">", b"@", b"+"):
            seq.append(line.strip())
        bases, qual = b"".join(seq).upper(), None
        if line is not None and line[:1] == b"+":
            got, size = [], 0
            while size < len(bases) and (line := next(lines, None)) is not None:
                got.append(line.strip())
                size += len(got[-1])
            if size < len(bases):
                return
            if size > len(bases):
                raise ValueError(f"read {name}: more qualities than bases")
            qual = b"".join(got).decode("latin-1")
            line = next(lines, None)
        if line is None and cut and qual is None:
            return
        yield name, comment, bases.decode("utf-8", "replace"), qual, []


def parsed(path: str) -> Iterator[tuple[str, str, str, str | None, list[str]]]:
    """Records of one file, told apart by its content: BAM, or FASTA and FASTQ, plain or compressed."""
    raw = streams.Bytes(streams.blocks(path))
    found = kind(raw.peek(4))
    if found in ("cram", "sam"):
        raise ValueError(f"{path}: {found.upper()} is not a source of reads; FASTA, FASTQ and BAM are")
    packed = raw.peek(2) == streams.GZIP
    # Until the content is known, its few first bytes are inflated as leniently as FASTA and FASTQ are.
    if packed and streams.Bytes(streams.inflated(streams.blocks(path))).peek(4) == bam.MAGIC:
        source = streams.Bytes(streams.inflated(raw.rest(), exact=True))
        bam.header(source)
        return bam.records(source)
    return records(streams.inflated(raw.rest()))


def budgeted(rows: Iterator[tuple], budget: int = BASES) -> Iterator[list[tuple]]:
    """Rows in batches that end with the record that reaches the budget of bases."""
    batch: list[tuple] = []
    size = 0
    for row in rows:
        batch.append(row)
        size += len(row[2])
        if size >= budget or len(batch) >= ROWS:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def reads(spark: SparkSession, paths: str | list[str], budget: int = BASES) -> DataFrame:
    """Records of FASTA, FASTQ and BAM files, one task a file, with memory for one batch of `budget` bases.

    Files are listed by Spark and opened by their tasks. An empty file has no records. Plain FASTA is better read by
    `fasta`, which splits files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                at = 0
                for part in budgeted(parsed(path), budget):
                    columns = [pa.array([path] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64())]
                    columns += [pa.array(c, t) for c, t in zip(zip(*part, strict=True), TYPES, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "ordinal", "name", "comment", "seq", "qual", "tags"])
                    at += len(part)

    files = ship(spark).read.format("binaryFile").load(paths).select("path")
    # Spark's listing packs small files together; here about as many tasks as files are made.
    return files.repartition(max(1, len(files.inputFiles())), "path").mapInArrow(run, SCHEMA)


def fastx(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """`reads` without tags."""
    return reads(spark, paths).drop("tags")


def kind(head: bytes) -> str:
    """What a file is by its first (inflated) bytes: bam, cram, sam, fasta, fastq or other."""
    for magic, name in ((bam.MAGIC, "bam"), (b"CRAM", "cram"), *((b"@" + tag + b"\t", "sam") for tag in SAM_HEADS), (b">", "fasta"), (b"@", "fastq")):
        if head.startswith(magic):
            return name
    return "other"
