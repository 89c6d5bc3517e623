import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandweave.sources import bam, bed, fastx, sinks, streams
from strandweave.streaming import events


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first read\nacgt\nAC\n>two\nGGnn\n")
    got = fastx.fasta(spark, str(tmp_path / "a.fa")).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("one", "first read", "ACGTAC"), ("two", "", "GGNN")]


def test_fastq_drops_a_cut_record(spark, tmp_path):
    body = b"@r1 c\nacgt\n+\n@III\n@r2\nAC\n+\nII\n@r3\nACGT\n+\nII"
    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(body))
    got = fastx.fastx(spark, str(tmp_path / "a.fq.gz")).orderBy("ordinal").collect()
    assert [(r.name, r.comment, r.seq, r.qual) for r in got] == [("r1", "c", "ACGT", "@III"), ("r2", "", "AC", "II")]


def test_kind():
    assert [fastx.kind(x) for x in (b"BAM\1x", b"CRAM", b"@HD\tVN", b">a", b"@r", b"x")] == ["bam", "cram", "sam", "fasta", "fastq", "other"]


def test_fastx_records():
    read = lambda data, size=3: list(fastx.records(iter([data[i : i + size] for i in range(0, len(data), size)])))
    assert read(b"") == [] and read(b"no header\n") == []
    assert read(b">a\tb c\r\nac\r\n\r\ngt\r\n>b\n") == [("a", "b c", "ACGT", None, []), ("b", "", "", None, [])]
    assert read(b"@q x\nAC\nGT\n+q\n@@\n+I\n@r\nA\n+\n>") == [("q", "x", "ACGT", "@@+I", []), ("r", "", "A", ">", [])]
    assert read(b"@q\nACGT\n+\nII") == []
    with pytest.raises(ValueError, match="more qualities"):
        read(b"@q\nAC\n+\nIIII\n@r\nA\n+\nI\n")
    assert [len(b) for b in fastx.budgeted(iter([("", "", "A" * n) for n in (3, 3, 1, 9, 1)]), 6)] == [2, 2, 1]


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_inflate(monkeypatch, block):
    monkeypatch.setattr(streams, "BLOCK", block)
    body = bytes(range(256)) * 3 + b"a" * 5000
    data = gzip.compress(body) + gzip.compress(b"") + gzip.compress(b"end")
    fed = lambda d: iter([d[i : i + block] for i in range(0, len(d), block)])
    assert b"".join(streams.inflated(fed(data))) == body + b"end"
    assert b"".join(streams.inflated(fed(data + b"junk"))) == body + b"end"
    with pytest.raises(ValueError, match="after the last"):
        list(streams.inflated(fed(data + b"junk"), exact=True))
    assert b"".join(streams.inflated(fed(b"plain"))) == b"plain" and list(streams.inflated(iter([]))) == []
    got = []
    with pytest.raises(streams.Cut):
        got.extend(streams.inflated(fed(gzip.compress(body)[:-9])))
    with pytest.raises(ValueError, match="damaged"):
        list(streams.inflated(fed(data[:12] + b"\xff" * 40 + data[60:])))


def test_a_cut_member_ends_the_last_record(spark, tmp_path):
    fasta = gzip.compress(b">a\nAC\n") + gzip.compress(b">b\nACGTACGT\n>c\nGGTTCA\n")[:-9]
    (tmp_path / "a.fa.gz").write_bytes(fasta)
    assert [r.name for r in fastx.fastx(spark, str(tmp_path)).collect()] in (["a"], ["a", "b"])
    (tmp_path / "a.fa.gz").write_bytes(gzip.compress(b""))
    assert fastx.reads(spark, str(tmp_path)).count() == 0


def bgzf(data: bytes, size: int = 50, end: bool = True) -> bytes:
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)]:
        c = zlib.compressobj(wbits=-15)
        packed = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\4" + bytes(5) + b"\xff\6\0BC\2\0" + struct.pack("<H", len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
    return out + (streams.BGZF_END if end else b"")


def bam_record(name, flag, seq, qual, tags=b"", cigar=()):
    codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, len(cigar), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", c) for c in cigar) + packed + (bytes(qual) if qual else b"\xff" * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def bam_file(records, text=b"@HD\tVN:1.6\n@RG\tID:a\n", **how):
    return bgzf(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<ii", 1, 3) + b"c1\0" + struct.pack("<i", 100) + b"".join(records), **how)


def test_bam(spark, tmp_path):
    tags = b"RGZa\0" + b"NMC\5" + b"qsf" + struct.pack("<f", 12.5) + b"MLBC" + struct.pack("<I", 2) + b"\x01\xff" + b"xxBf" + struct.pack("<If", 1, 0.25) + b"nbs\xfe\xff" + b"chAQ"
    held = ["RG:Z:a", "NM:i:5", "qs:f:12.5", "ML:B:C,1,255", "xx:B:f,0.25", "nb:i:-2", "ch:A:Q"]
    rows = [
        bam_record("plain", 4, "ACGTN", [0, 1, 2, 3, 40], tags),
        bam_record("back", 16, "AACRG", [1, 2, 3, 4, 5], tags, cigar=(80,)),
        bam_record("second", 256, "ACGT", None),
        bam_record("supplementary", 2064, "ACGT", None),
        bam_record("bare", 4, "ACG", None),
        bam_record("empty", 4, "", None),
    ]
    (tmp_path / "x.bam").write_bytes(bam_file(rows))
    got = [(r.ordinal, r.name, r.seq, r.qual, r.tags) for r in fastx.reads(spark, str(tmp_path / "x.bam"), budget=4).orderBy("ordinal").collect()]
    assert got == [
        (0, "plain", "ACGTN", "!\"#$I", held),
        (1, "back", "CNGTT", "&%$#\"", [t for t in held if t[:2] != "NM"]),
        (2, "bare", "ACG", None, []),
        (3, "empty", "", None, []),
    ]
    (tmp_path / "y.bam").write_bytes(bam_file([], end=False))
    heads = {r.file[-5:]: (r.header, r.complete) for r in bam.headers(spark, [str(tmp_path / n) for n in ("x.bam", "y.bam")]).collect()}
    assert heads == {"x.bam": ("@HD\tVN:1.6\n@RG\tID:a\n", True), "y.bam": ("@HD\tVN:1.6\n@RG\tID:a\n", False)}


def test_damaged_bam_is_refused():
    def read(data, **how):
        source = streams.Bytes(streams.inflated(iter([data]), exact=True))
        bam.header(source)
        return list(bam.records(source))

    good = bam_record("r", 4, "ACGT", None)
    assert [r[0] for r in read(bam_file([good]))] == ["r"]
    for damaged, why in ((good[:-1], "record"), (good + b"\1", "size"), (struct.pack("<i", 8) + bytes(8), "size"), (good[:20] + struct.pack("<i", 999) + good[24:], "past")):
        with pytest.raises(ValueError, match=why):
            read(bam_file([damaged]))
    for block, why in ((b"XXZa", "without an end"), (b"XXq\0", "unknown type"), (b"XXBd" + bytes(12), "unknown type"), (b"XXi\0", "past"), (b"XXBS" + struct.pack("<I", 9), "past")):
        with pytest.raises(ValueError, match=why):
            bam.tags(block, "r")
    with pytest.raises(ValueError, match="version 1"):
        read(bgzf(b"BAM\2"))
    with pytest.raises(ValueError, match="inside a member"):
        read(bam_file([good], end=False)[:-3])


def test_other_formats_are_refused(spark, tmp_path):
    for name, head in (("a.cram", b"CRAM\3\0"), ("a.sam", b"@CO\tx\n")):
        (tmp_path / name).write_bytes(head)
        with pytest.raises(Exception, match="is not a source of reads"):
            fastx.reads(spark, str(tmp_path / name)).collect()


def test_numbers_in_arrays():
    values = [0.5, 1.0, 123456.7, 9.999996, 0.00012345678, 999999.0, 1e6, -2.25, 0.0, -0.0, 1e-5]
    assert [bam.number(v) for v in values] == ["0.5", "1", "123457", "10", "0.000123457", "999999", "1e+06", "-2.25", "0", "-0", "1e-05"]


def test_junctions(spark, tmp_path):
    p = tmp_path / "j.bed"
    p.write_text("# c\ntrack x\nc1\t10\t20\ta\t0\t+\nc1\t10\t20\tb\t0\t-\nc2\t100\t200\tt\t0\t+\t0\t0\t0\t3\t10,20,30,\t0,30,70,\n")
    got = sorted(map(tuple, bed.junctions(spark, str(p)).collect()))
    assert got == [("c1", 10, 20, 3), ("c2", 110, 130, 1), ("c2", 150, 170, 1)]
    p.write_text("c1\t1\t2\n")
    with pytest.raises(Exception, match="6 columns"):
        bed.junctions(spark, str(p)).collect()


def test_lines_keep_their_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"l{i}") for i in range(20)][::-1], "id int, line string")
    sinks.write_lines(rows, str(tmp_path / "out"), ["id"])
    parts = sorted(p for p in (tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == [f"l{i}" for i in range(20)]
    head = sinks.sam_header(spark.createDataFrame([("b", 5), ("a", 7)], "name string, length long")).orderBy("n", "name")
    assert [r.line.split("\t")[0] for r in head.collect()] == ["@HD", "@SQ", "@SQ", "@PG"]


def test_streams_equal_batches(spark):
    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/events.parquet")
    want = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")
    assert sorted(map(tuple, events.hourly_counts(spark, sf).collect())) == sorted(map(tuple, want.collect()))
    assert events.drain(events.deduplicated(events.source(spark, sf))).count() == e.select("event_id").distinct().count()
