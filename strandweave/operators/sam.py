"""SAM and PAF record sets: tags, clips, lines and headers of all records of a query, as DataFrame operators.

A record table has one row a record: id (query), alt (0, or the number of an alternative placement), seg (0 for the head
of a placement, then its other segments), mapped, target, pos, reverse, mapq, cigar, score, ms, nm, nn, cm, s1, s2,
inversion, all_chains. Roles follow from alt and seg.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions import sequence as sq
from strandweave.operators.records import accounted, clean_field, hard_clip, tag

#: Tags of one value a base: dropped where a record does not hold the whole sequence.
PER_BASE = ("MM", "ML", "MN")


def role(alt: Column, seg: Column) -> Column:
    return F.when((alt == 0) & (seg == 0), "primary").when(alt == 0, "supplementary").when(seg == 0, "secondary").otherwise("secondary_supplementary")


def flags(alt: Column, seg: Column, mapped: Column, reverse: Column) -> Column:
    """FLAG bits; an unmapped record has only its own."""
    bits = F.when(reverse, 16).otherwise(0) + F.when(alt > 0, 256).otherwise(0) + F.when(seg > 0, 2048).otherwise(0)
    return F.when(mapped, bits).otherwise(4)


def record_type(alt: Column, inversion: Column, all_chains: Column) -> Column:
    """P or S, I or i for inversions, S for every record of the all-chains lane."""
    return F.when(inversion, F.when(alt > 0, "i").otherwise("I")).when(all_chains | (alt > 0), "S").otherwise("P")


def divergence_text(matches: Column, denominator: Column) -> Column:
    """Gap-compressed divergence: 0, or four decimals; null where there is nothing to divide by."""
    d = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - matches / denominator))
    return F.when(denominator <= 0, F.lit(None).cast("string")).when(d == 0, "0").otherwise(F.format_string("%.4f", F.bround(d, 4)))


def with_margins(records: DataFrame) -> DataFrame:
    """records with md: the best segment score less that of the best alternative (of a primary; others have none)."""
    best = F.max(F.when((F.col("alt") > 0) & (F.col("seg") == 0) & F.col("mapped"), F.col("ms"))).over(Window.partitionBy("id"))
    rival = F.when((F.col("alt") == 0) & (F.col("seg") == 0), F.greatest(F.lit(0), F.coalesce(best, F.lit(0)))).otherwise(0)
    return records.withColumn("md", F.when((F.col("alt") == 0) & F.col("mapped") & (F.col("ms") >= 0), F.col("ms") - rival))


def _listed(records: DataFrame, name: str, taken: Column, by: str, item: Column, own: Column) -> DataFrame:
    """records with a tag that lists other records of the same query; a query's records are gathered in one row."""
    every = F.array_sort(F.collect_list(F.when(taken, F.struct(F.col(by).alias("k"), item.alias("v")))).over(Window.partitionBy("id")))
    others = F.filter(every, lambda x: x["k"] != F.col(by))
    text = F.concat(F.lit(f"{name}:Z:"), F.array_join(F.transform(others, lambda x: F.concat(x["v"], F.lit(";"))), ""))
    return records.withColumn(name.lower(), F.when(own & (F.size(others) > 0), text))


def with_links(records: DataFrame) -> DataFrame:
    """records with sa (the other segments of the primary placement) and xa (the heads of alternatives, on the primary)."""
    strand = F.when(F.col("reverse"), "-").otherwise("+")
    place = (F.col("pos") + 1).cast("string")
    nm = F.col("nm").cast("string")
    sa = F.concat_ws(",", clean_field(F.col("target")), place, strand, "cigar", F.col("mapq").cast("string"), nm)
    xa = F.concat_ws(",", clean_field(F.col("target")), F.concat(strand, place), "cigar", nm)
    segment = (F.col("alt") == 0) & F.col("mapped")
    listed = _listed(records, "SA", segment, "seg", sa, segment)
    head = (F.col("alt") > 0) & (F.col("seg") == 0) & F.col("mapped") & F.col("nm").isNotNull() & (F.length("cigar") > 0)
    return _listed(listed, "XA", head, "alt", xa, segment & (F.col("seg") == 0))


def clipped(body: Column, cigar: Column) -> Column:
    """A sequence or its qualities without the ends that the CIGAR clips softly."""
    ends = lambda pattern: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    lead, trail = ends(r"^(\d+)S"), ends(r"(\d+)S$")
    return F.substring(body, F.least(lead, F.length(body)) + 1, F.greatest(F.lit(0), F.length(body) - lead - trail))


def sam_lines(records: DataFrame, reads: DataFrame, hard: bool = True, read_group: str = "", secondaries: bool = True) -> DataFrame:
    """(id, alt, seg, line) of every record; reads: (id, name, seq, qual, tags), tags a map of TAG to TYPE:VALUE.

    Segments of the primary placement beside its head are clipped hard; alternatives have no sequence. Tags of one value
    a base go where the record does not hold the whole sequence.
    """
    rows = with_links(with_margins(records)).join(reads, "id")
    rows = rows if secondaries else rows.where("alt = 0")
    rows = rows.where((F.col("alt") == 0) | F.col("mapped"))
    mapped, reverse = F.col("mapped"), F.col("mapped") & F.col("reverse")
    hardened = F.lit(hard) & (F.col("alt") == 0) & (F.col("seg") > 0) & mapped & (F.length("cigar") > 0)
    oriented = F.when(reverse, sq.reverse_complement_strict(F.col("seq"))).otherwise(F.col("seq"))
    quality = F.when(reverse, F.reverse("qual")).otherwise(F.col("qual"))
    none = F.lit(None).cast("string")
    field = lambda whole: clean_field(F.when(F.col("alt") > 0, none).when(hardened, clipped(whole, F.col("cigar"))).otherwise(whole))
    a = F.col("_a")
    rows = rows.withColumn("_a", accounted(F.col("cigar")))
    denominator = a["block_len"] + F.col("nn") - a["gap_bases"] + a["gap_opens"]
    cigar = F.when(hardened, hard_clip(F.col("cigar"))).when(mapped, F.col("cigar"))
    kept = F.map_filter("tags", lambda k, v: ~((hardened | (F.col("alt") > 0)) & k.isin(*PER_BASE)))
    passed = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\t")
    only = lambda x: F.when(mapped, x)
    columns = [clean_field(F.col("name")), flags(F.col("alt"), F.col("seg"), mapped, reverse), F.when(mapped, clean_field(F.col("target"))).otherwise("*"), F.when(mapped, F.col("pos") + 1).otherwise(0)]
    columns += [F.when(~mapped | (F.col("alt") > 0), 0).otherwise(F.least(F.greatest("mapq", F.lit(0)), F.lit(255))), clean_field(cigar), F.lit("*"), F.lit(0), F.lit(0), field(oriented), field(quality)]
    columns += [F.lit(f"RG:Z:{read_group}" if read_group else None).cast("string"), only(tag("AS", "i", F.col("score"))), only(tag("ms", "i", F.col("ms"))), tag("md", "i", F.col("md")), only(tag("NM", "i", F.col("nm"))), only(tag("nn", "i", F.col("nn")))]
    columns += [only(tag("tp", "A", record_type(F.col("alt"), F.col("inversion"), F.col("all_chains")))), only(tag("cm", "i", F.col("cm"))), only(tag("s1", "i", F.col("s1"))), only(tag("s2", "i", F.when(F.col("alt") == 0, F.col("s2")))), only(tag("de", "f", divergence_text(a["matches"], denominator)))]
    columns += [F.nullif(passed, F.lit("")), F.col("sa"), F.col("xa")]
    return rows.select("id", "alt", "seg", F.concat_ws("\t", *[c.cast("string") for c in columns]).alias("line"))


def header_lines(references: DataFrame, program: str, version: str, command: str = "", program_id: str = "", previous: str = "") -> DataFrame:
    """(kind, contig_id, line): the first line, one a reference (contig_id, name, length), and the program's."""
    spark = references.sparkSession
    clean = lambda x: x.replace("\t", "_").replace("\n", "_").replace("\r", "_") or "*"
    parts = [f"@PG\tID:{clean(program_id or program)}", f"PN:{clean(program)}", *([f"PP:{clean(previous)}"] if previous else []), f"VN:{clean(version)}", *([f"CL:{clean(command)}"] if command else [])]
    ends = spark.createDataFrame([(0, -1, "@HD\tVN:1.6\tSO:unsorted"), (2, -1, "\t".join(parts))], "kind int, contig_id int, line string")
    return ends.unionByName(references.select(F.lit(1).alias("kind"), "contig_id", F.concat(F.lit("@SQ\tSN:"), clean_field(F.col("name")), F.lit("\tLN:"), F.col("length").cast("string")).alias("line")))


def merged_header(lines: DataFrame) -> DataFrame:
    """(input, n, line) of read groups, comments and programs to those of a merged header; equal groups and programs once.

    A read group that two inputs declare differently is refused.
    """
    kind = F.substring("line", 1, 4)
    own = F.regexp_extract("line", "\tID:([^\t]*)", 1)
    rows = lines.where(kind.isin("@RG\t", "@PG\t", "@CO\t")).select("input", "n", "line", kind.alias("kind"), F.when(kind != "@CO\t", own).alias("key"))
    # Comments have no key and are not grouped; the first of a group is found by partial results, not in a window.
    first = F.min(F.struct("input", "n", "line")).alias("f")
    groups = rows.where("key is not null").groupBy("kind", "key").agg(first, (F.min("line") != F.max("line")).alias("differ"))
    refused = F.when((F.col("kind") == "@RG\t") & F.col("differ"), F.raise_error(F.concat(F.lit("read group declared differently: "), F.col("key"))).cast("string")).otherwise(F.col("f.line"))
    return rows.where("key is null").select("input", "n", "line").unionByName(groups.select("f.input", "f.n", refused.alias("line")))


def target_end(pos: Column, end: Column, exact: Column, regions: Column, cigar: Column) -> Column:
    """End on the target: as accounted, else as given, else the last region's end, else by the CIGAR."""
    last = F.greatest(pos, F.coalesce(F.array_max(F.transform(regions, lambda r: r["hi"])), pos))
    return F.when(exact, F.greatest(pos, end)).when(end > pos, end).when(F.size(regions) > 0, last).otherwise(pos + accounted(cigar)["target_span"])


def forward_interval(cigar: Column, length: Column, reverse: Column) -> Column:
    """(q_lo, q_hi) of an alignment on the forward query, from the clips at its ends; null where they do not fit."""
    total = lambda pattern: F.aggregate(F.regexp_extract_all(F.regexp_extract(cigar, pattern, 0), F.lit(r"(\d+)"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
    lead, trail = total(r"^(\d+[SH])+"), total(r"(\d+[SH])+$")
    lo, hi = F.when(reverse, trail).otherwise(lead), length - F.when(reverse, lead).otherwise(trail)
    return F.when((F.length(cigar) > 0) & (hi >= lo), F.struct(lo.alias("q_lo"), hi.alias("q_hi")))


def inversion_quality(records: DataFrame) -> DataFrame:
    """records (id, target, pos, mapq, inversion) of one placement; an inversion between two others has the lesser mapq."""
    order = Window.partitionBy("id").orderBy("target", "pos", "seg")
    before, after = F.lag("mapq").over(order), F.lead("mapq").over(order)
    return records.withColumn("mapq", F.when(F.col("inversion") & before.isNotNull() & after.isNotNull(), F.least(before, after)).otherwise(F.col("mapq")))


def divergence_contrast(records: DataFrame, most: float = 8.0) -> DataFrame:
    """records (id, n, de, length) with z, the distance of each divergence from the family's least one, and divergent."""
    least = F.min(F.struct("de", "n", "length")).over(Window.partitionBy("id"))
    rows = records.withColumns({"_l": least, "_k": F.count("*").over(Window.partitionBy("id"))})
    size, best = F.col("length"), F.col("_l.length")
    pooled = (F.col("de") * size + F.col("_l.de") * best) / (size + best)
    variance = F.greatest(pooled * (1.0 - pooled), F.lit(1e-12)) * (1.0 / size + 1.0 / best)
    z = F.when((F.col("_k") > 1) & (F.col("n") != F.col("_l.n")), (F.col("de") - F.col("_l.de")) / F.sqrt(variance))
    return rows.withColumn("z", z).withColumn("divergent", F.coalesce(F.col("z") > most, F.lit(False))).drop("_l", "_k")


def routed_quality(alt: Column, seg: Column, own: Column, primary: Column, inversion: Column) -> Column:
    """Map quality of a record: 0 for alternatives and inversions, its own where it has one, else the primary's."""
    return F.when((alt > 0) | ((seg > 0) & inversion), 0).when(seg == 0, primary).otherwise(F.coalesce(own, primary))


def floor_promoted(records: DataFrame, least: int) -> DataFrame:
    """records (id, seg, score) of a placement that reach the floor; the first of them is the head (seg 0)."""
    kept = records.where(F.col("score") >= least)
    return kept.withColumn("seg", F.row_number().over(Window.partitionBy("id").orderBy("seg")) - 1)


def retained_alternatives(records: DataFrame, ratio: float = 0.8, near: int = 30, most: int = 5) -> DataFrame:
    """(id, alt, score) of alternatives that come within `ratio` or `near` points of their query's primary, `most` at most."""
    own = records.where("alt = 0 and seg = 0").select("id", F.col("score").alias("_own"))
    heads = records.where("alt > 0 and seg = 0").join(own, "id").where((F.col("score") >= ratio * F.col("_own")) | (F.col("score") + near >= F.col("_own")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "alt"))
    return heads.withColumn("_n", rank).where(F.col("_n") <= most).select("id", "alt", "score")
