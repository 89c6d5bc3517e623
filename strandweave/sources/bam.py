"""BAM and unaligned BAM as a source of reads: records as they left the sequencer, tags as SAM text."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandweave.session import ship
from strandweave.sources import streams

MAGIC = b"BAM\1"
#: Fixed values of the SAM specification: bases by 4-bit code, struct formats by the type letter of a tag.
BASES = "=ACMGRSVTWYHKDBN"
FORMATS = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4", "d": "<f8"}
#: Fixed value: tags that an aligner wrote; they no longer hold once a mapped read is mapped again.
ALIGNER_TAGS = {"NM", "MD", "AS", "XS", "SA", "cs", "ms", "md", "nn", "de", "dv", "tp", "cm", "s1", "s2", "zd", "rl", "bh", "TS", "XA"}
UNMAPPED, REVERSE, NOT_PRIMARY = 0x4, 0x10, 0x900
_PAIRS = np.array([[ord(a), ord(b)] for a in BASES for b in BASES], dtype=np.uint8)
#: Reverse complement of sequences that are restored: letters other than ACGT give N.
_COMPLEMENT = bytes(dict(zip(b"ACGT", b"TGCA", strict=True)).get(c, ord("N")) for c in range(256))


def number(value: float) -> str:
    """A float inside an array tag: six significant digits, rounded as a double, without trailing zeros."""
    size = abs(value)
    if value == 0 or not 1e-4 <= size <= 999999:
        return "%g" % value
    decimals = next(d for d, above in ((9, 1e-3), (8, 1e-2), (7, 0.1), (6, 1.0), (5, 10.0), (4, 100.0), (3, 1e3), (2, 1e4), (1, 1e5), (0, np.inf)) if size < above)
    whole, part = divmod(round(size * 10**decimals), 10**decimals)
    digits = f"{part:0{decimals}d}".rstrip("0") if decimals else ""
    return ("-" if value < 0 else "") + str(whole) + ("." + digits if digits else "")


def tags(data: bytes, name: str) -> list[str]:
    """The tag block of a record as SAM fields (XX:T:value); integers of any width are of type i."""
    out, at = [], 0
    fail = f"malformed BAM: tag block of read {name}"
    while len(data) - at >= 3:
        key, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind == "A" and at < len(data):
            out.append(f"{key}:A:{chr(data[at])}")
            at += 1
        elif kind in "ZH":
            end = data.find(b"\0", at)
            if end < 0:
                raise ValueError(f"{fail}: text without an end")
            out.append(f"{key}:{kind}:{data[at:end].decode('utf-8', 'replace')}")
            at = end + 1
        else:
            array = kind == "B"
            sub = chr(data[at]) if array and at < len(data) else kind
            if sub not in FORMATS or (array and sub == "d") or len(data) < at + 5 * array:
                raise ValueError(f"{fail}: unknown type {sub!r}")
            n = struct.unpack_from("<I", data, at + 1)[0] if array else 1
            at += 5 * array
            form = np.dtype(FORMATS[sub])
            if len(data) - at < n * form.itemsize:
                raise ValueError(f"{fail}: a tag runs past the block")
            values = np.frombuffer(data, form, n, at).tolist()
            at += n * form.itemsize
            if array:
                out.append(f"{key}:B:{sub}" + "".join("," + (number(v) if sub == "f" else str(v)) for v in values))
            else:
                out.append(f"{key}:{kind}:{values[0]:g}" if kind in "fd" else f"{key}:i:{values[0]}")
    return out


def _whole(source: streams.Bytes, n: int, what: str) -> bytes:
    out = source.read(n) if n >= 0 else b""
    if n < 0 or len(out) < n:
        raise ValueError(f"truncated or malformed BAM: {what}")
    return out


def header(source: streams.Bytes) -> str:
    """The SAM text of the header; the dictionary of references is passed over."""
    if _whole(source, 4, "magic") != MAGIC:
        raise ValueError("not a BAM file of version 1")
    size = lambda: struct.unpack("<i", _whole(source, 4, "header"))[0]
    text = _whole(source, size(), "header text").rstrip(b"\0").decode("utf-8", "replace")
    for _ in range(size()):
        _whole(source, size() + 4, "reference")
    return text


def records(source: streams.Bytes) -> Iterator[tuple[str, str, str, str | None, list[str]]]:
    """(name, comment, seq, qual, tags) of the records after the header.

    Secondary and supplementary records are passed over, reverse-mapped ones turned back, and mapped ones lose the tags
    of their aligner. Every size is checked against its record; a file that ends inside one is an error.
    """
    while length := source.read(4):
        if len(length) < 4:
            raise ValueError("truncated BAM: record size")
        size = struct.unpack("<i", length)[0]
        if size < 32:
            raise ValueError("malformed BAM: record size")
        data = _whole(source, size, "record")
        name_size, cigar, flag, bases = data[8], *struct.unpack_from("<HHi", data, 12)
        packed = 32 + name_size + 4 * cigar
        quality = packed + (max(bases, 0) + 1) // 2
        if bases < 0 or quality + bases > size:
            raise ValueError("malformed BAM: a field runs past its record")
        if flag & NOT_PRIMARY:
            continue
        name = data[32 : 32 + max(name_size - 1, 0)].decode("utf-8", "replace")
        seq = _PAIRS[np.frombuffer(data, np.uint8, quality - packed, packed)].tobytes()[:bases]
        score = np.frombuffer(data, np.uint8, bases, quality)
        qual = (score + np.uint8(33)).tobytes() if bases and score[0] != 0xFF else None
        if flag & REVERSE:
            seq, qual = seq.translate(_COMPLEMENT)[::-1], qual and qual[::-1]
        fields = tags(data[quality + bases :], name)
        if not flag & UNMAPPED:
            fields = [t for t in fields if t[:2] not in ALIGNER_TAGS]
        yield name, "", seq.decode("ascii"), qual and qual.decode("latin-1"), fields


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, header, complete) of BAM files: the SAM header text, and whether the file ends with the BGZF end block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("path").to_pylist()
            texts = [header(streams.Bytes(streams.inflated(streams.blocks(f), exact=True))) for f in files]
            ends = [streams.tail(f, len(streams.BGZF_END)) == streams.BGZF_END for f in files]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(texts, pa.string()), pa.array(ends, pa.bool_())], ["file", "header", "complete"])

    return ship(spark).read.format("binaryFile").load(paths).select("path").mapInArrow(run, "file string, header string, complete boolean")
