"""Sequence functions as Column expressions: alphabet, complement, hashes, bins, tiles, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz #"
BASES = "ACGTACGTACGTACGTACGTACGTACTN"
# IUPAC codes and their complements, upper then lower case; U pairs with A.
IUPAC, COMPLEMENT = "ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"


def project(text: Column) -> Column:
    """Text as a sequence: letters become the four bases in turn, a space becomes T, anything else N."""
    return F.translate(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z ]", "#")), LETTERS, BASES)


def encode(seq: Column) -> Column:
    """Base codes as digits: A C G T and U to 0..3, anything else 4."""
    return F.translate(F.upper(F.regexp_replace(seq, "[^ACGTUacgtu]", "N")), "ACGTUN", "012334")


def reverse_complement(seq: Column) -> Column:
    """Of A C G T; N and anything else stays."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def reverse_complement_iupac(seq: Column) -> Column:
    """Of all IUPAC codes, case kept."""
    return F.translate(F.reverse(seq), IUPAC, COMPLEMENT)


def reverse_complement_strict(seq: Column) -> Column:
    """Of A C G T, anything else to N."""
    return reverse_complement(F.upper(F.regexp_replace(seq, "[^ACGTacgt]", "N")))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def orientation(kmer: Column) -> Column:
    """1 where the canonical form is the reverse complement."""
    return (reverse_complement(kmer) < kmer).cast("int")


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, the first base highest; null with other letters."""
    return F.when(kmer.rlike("^[ACGT]+$"), F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long"))


def low_complexity(kmer: Column, run: int = 8, trimers: int = 4) -> Column:
    """A run of one base of `run` or more, or fewer than `trimers` distinct trimers."""
    three = F.transform(F.sequence(F.lit(1), F.greatest(F.length(kmer) - 2, F.lit(1))), lambda i: F.substring(kmer, i, F.lit(3)))
    return kmer.rlike(r"([ACGT])\1{" + str(run - 1) + "}") | (F.size(F.array_distinct(three)) < trimers)


def floor_div(x: Column, w: Column | int) -> Column:
    """Division rounded toward minus infinity."""
    return F.floor(x / w).cast("long")


def bin_width(length: Column, base: int = 64, divisor: int = 128, widest: int = 2048) -> Column:
    """Adaptive width of a diagonal bin."""
    return F.greatest(F.lit(base), F.least(F.floor(length / divisor).cast("int"), F.lit(widest)))


def tile_of(position: Column, length: Column, tiles: int) -> Column:
    """The equal tile that a position of a query falls into."""
    return F.least(F.floor(position * tiles / F.greatest(length, F.lit(1))).cast("int"), F.lit(tiles - 1))


def stratum(occurrence: Column) -> Column:
    """floor(log2), 31 at most."""
    return F.least(F.lit(31), F.length(F.conv(occurrence.cast("string"), 10, 2)) - 1)


def saturate(x: Column) -> Column:
    """Double to int: truncated toward zero, held inside the int range, NaN to 0."""
    held = F.greatest(F.least(x, F.lit(2147483647.0)), F.lit(-2147483648.0))
    return F.when(F.isnan(x), F.lit(0)).otherwise(held.cast("int"))


def mirror(begin: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """A forward interval in the frame of the other strand."""
    return length - end, length - begin


def name_hash(name: Column) -> Column:
    """Multiplicative string hash with 31, 32 bits; the value of the empty name is 0."""
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))


def checked(x: Column) -> Column:
    """A coordinate, null outside 0 to 2**31 - 1."""
    return F.when((x >= 0) & (x <= 2147483647), x)


def query_tile(position: Column, length: Column, seed: int, tiles: int) -> Column:
    """The equal tile of the seed positions of a query that a position falls into."""
    span = F.greatest(F.lit(1), length - seed + 1)
    at = F.least(F.greatest(position, F.lit(0)), span - 1)
    return F.least(F.lit(tiles - 1), F.floor(at * tiles / span)).cast("int")


def tile_bounds(tile: Column, length: Column, seed: int, tiles: int) -> tuple[Column, Column, Column]:
    """Begin, end (with the last seed's bases) and centre of a tile."""
    span = F.greatest(F.lit(1), length - seed + 1)
    up = lambda t: F.floor((t * span + tiles - 1) / tiles)
    begin, end = F.floor(tile * span / tiles), F.least(length, up(tile + 1) + seed - 1)
    first, last = up(tile), F.greatest(up(tile), up(tile + 1) - 1)
    return begin.cast("int"), end.cast("int"), F.floor((first + last) / 2).cast("int")


def rivals(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Whether two intervals share half of the shorter one, rounded down, and at least a base."""
    over = F.least(e1, e2) - F.greatest(b1, b2)
    return (over > 0) & (over >= F.floor(F.least(e1 - b1, e2 - b2) / 2))


def size_of(text: Column) -> Column:
    """A size with an optional suffix k, m or g (thousands); null where it is none."""
    digits, unit = F.regexp_extract(text, r"(?i)^(\d+)([kmg]?)$", 1), F.lower(F.regexp_extract(text, r"(?i)^(\d+)([kmg]?)$", 2))
    scale = F.when(unit == "k", 10**3).when(unit == "m", 10**6).when(unit == "g", 10**9).otherwise(1)
    return F.when(digits != "", digits.cast("long") * scale)
