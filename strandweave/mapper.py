"""Mapping of reads to references with the settings of a preset: the public interface over the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators import chain, index, ordering, records, seeds, vote
from strandweave.session import cut, ship

#: Seed length, syncmer length, chaining band and longest gap of each preset.
PRESETS = {
    "lr": (21, 9, 500, 5000),
    "lr:hq": (21, 5, 500, 5000),
    "asm5": (21, 9, 1000, 10000),
    "asm10": (21, 9, 1000, 10000),
    "asm20": (21, 9, 1000, 10000),
}
#: Presets with a seeding only; their lanes are not mapped here.
SEEDING_ONLY = {"splice": (15, 10), "splice:hq": (15, 10)}
REFUSED = ("ava-ont", "ava-hifi")


def preset_seeding(preset: str) -> tuple[int, int]:
    """(k, s) that a preset builds its index with; overlap presets and unknown names are refused."""
    if preset in REFUSED:
        raise ValueError(f"preset {preset} is for overlaps, which have operators of their own")
    found = PRESETS.get(preset) or SEEDING_ONLY.get(preset)
    if not found:
        raise ValueError(f"unknown preset {preset!r}; one of {', '.join([*PRESETS, *SEEDING_ONLY])}")
    return found[:2]


@dataclass(frozen=True)
class Config:
    """Options of map-only placement; None takes the preset's value.

    k and s are the seeding, downsample keeps one read seed key in n, occ_cap is the most occurrences of a seed (None: the
    index's own), band and gap bound a step of a chain, min_score is the least score of a chain.
    """

    preset: str = "lr"
    k: int | None = None
    s: int | None = None
    downsample: int = 1
    occ_cap: int | None = None
    band: int | None = None
    gap: int | None = None
    min_score: int = 40

    def resolved(self) -> Config:
        """All options with their values; contradictions are refused."""
        k, s = preset_seeding(self.preset)
        if self.preset not in PRESETS:
            raise ValueError(f"preset {self.preset} is not mapped here")
        band, gap = PRESETS[self.preset][2:]
        pick = lambda own, preset: preset if own is None else own
        out = replace(self, k=pick(self.k, k), s=pick(self.s, s), band=pick(self.band, band), gap=pick(self.gap, gap))
        if not 4 <= out.k <= 31 or not 1 <= out.s <= min(out.k - 1, 12):
            raise ValueError("k must be 4 to 31, s 1 to 12 and under k")
        if out.downsample < 1 or (out.occ_cap is not None and out.occ_cap < 1) or min(out.band, out.gap, out.min_score) < 0:
            raise ValueError("downsample and occ_cap must be positive, band, gap and min_score not negative")
        return out


def _letters(seq: Column) -> Column:
    """Bases as the letters that project to them; all but ACGT project to N."""
    return F.translate(F.regexp_replace(F.upper(F.coalesce(seq, F.lit(""))), "[^ACGT]", "N"), "ACGTN", "abcd#")


def identified(reads: DataFrame) -> DataFrame:
    """reads with a column `id`; they are written once, so that ids stay."""
    return cut(reads.withColumn("id", F.monotonically_increasing_id()))


class Mapper:
    """An index over references (name, seq) and the mapping of reads (id, name, seq) to it.

    The index holds the reference seeds within the occurrence cap, as a table in the shared folder. A reference without a
    name is left out; names must be distinct. Reads without an id are left out; an empty or null sequence has no
    placement.
    """

    def __init__(self, references: DataFrame, config: Config | None = None):
        ship(references.sparkSession)
        self.config = c = (config or Config()).resolved()
        named = references.where(F.col("name").isNotNull()).select("name", _letters(F.col("seq")).alias("text"))
        contigs = ordering.numbered(named, "contig", ["name"])
        self.contigs = cut(contigs.select("contig", "name", F.length("text").alias("length")))
        own = cut(seeds.seeds(contigs, "contig", k=c.k, s=c.s))
        cap = c.occ_cap
        if cap is None:
            cap = 0 if own.isEmpty() else index.resolved_cap(index.occurrences(own))
        self.index = cut(index.admitted(own, cap))

    def placements(self, reads: DataFrame) -> DataFrame:
        """Chains with their role, parent, rank and map quality."""
        c = self.config
        own = reads.where(F.col("id").isNotNull())
        lengths = own.select(F.col("id").cast("long").alias("id"), F.length("seq").alias("length"))
        found = seeds.seeds(own.select("id", _letters(F.col("seq")).alias("text")), "id", k=c.k, s=c.s)
        if c.downsample > 1:
            found = seeds.thin(found, c.downsample)
        dense = chain.runs(chain.anchors(vote.hits(found, self.index, lengths, c.k)), c.k)
        chains = chain.chains(dense, c.gap, c.band, c.min_score, c.k)
        return records.placements(chain.owners(chain.forward(chains, lengths)))

    def paf(self, reads: DataFrame) -> DataFrame:
        """(id, rank, line): PAF lines of all placements, and of reads without one."""
        own = reads.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("name").alias("qname"), F.coalesce(F.length("seq"), F.lit(0)).alias("qlen"))
        at = self.contigs.select("contig", F.col("name").alias("tname"), F.col("length").alias("tlen"))
        p = cut(self.placements(reads)).join(own, "id").join(at, "contig")
        tags = [records.tag("tp", "A", records.paf_type(F.col("role"))), records.tag("cm", "i", F.col("n_anchors")), records.tag("s1", "i", F.col("score").cast("int")), records.tag("s2", "i", F.when(F.col("role") != "secondary", F.col("f2").cast("int")))]
        block = F.greatest(F.col("q_hi") - F.col("q_lo"), F.col("r_hi") - F.col("r_lo"))
        line = records.paf_line(F.col("qname"), F.col("qlen"), F.col("q_lo"), F.col("q_hi"), F.col("lane") == 1, F.col("tname"), F.col("tlen"), F.col("r_lo"), F.col("r_hi"), F.least(F.col("bases"), block), block, F.col("mapq"), tags)
        hit = p.select("id", F.col("rank").cast("int").alias("rank"), line.alias("line"))
        lost = own.join(p.select("id").distinct(), "id", "left_anti")
        return hit.unionByName(lost.select("id", F.lit(0).alias("rank"), records.paf_no_hit(F.col("qname"), F.col("qlen")).alias("line")))
