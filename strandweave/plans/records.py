"""Registered queries of the record operators over records made from `lineitem`, and of hashes and coordinate functions.

An order stands for a query, its lines for records: line 1 is the primary, 2 and 3 its other segments, 4 and 5 heads of
alternatives, 6 and 7 segments of the first alternative. RECORDS is one text for both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import hashes
from strandweave.functions import sequence as sq
from strandweave.operators import index, intervals, ordering, records, sam, seeds
from strandweave.plans.mapping import KEY_HASH, OCC, RANKS, READS, REF, query, read_lengths, read_seeds, reference, seed_sql
from strandweave.session import table

BODY = "concat(l_linenumber, 'S', CAST(l_quantity AS INT), '=', l_partkey % 3 + 1, 'X', CAST(l_quantity AS INT) + 5, '=', l_suppkey % 4 + 1, 'I', l_orderkey % 50 + 1, '=', l_orderkey % 7 + 1, 'D10=', l_linenumber, 'S')"
RECORDS = f"""SELECT l_orderkey AS id, CASE WHEN l_linenumber < 4 THEN 0 WHEN l_linenumber = 5 THEN 2 ELSE 1 END AS alt,
CASE WHEN l_linenumber IN (1, 4, 5) THEN 0 WHEN l_linenumber IN (2, 6) THEN 1 ELSE 2 END AS seg, l_orderkey % 17 <> 0 AS mapped,
concat('chr', l_suppkey % 5) AS target, l_partkey * 37 % 90000 AS pos, l_returnflag = 'R' AS reverse, l_partkey % 61 AS mapq, {BODY} AS cigar,
CAST(floor(l_extendedprice / 100) AS INT) AS score, CAST(floor(l_extendedprice / 90) AS INT) AS ms, CASE WHEN l_linenumber = 5 AND l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 9 END AS nm,
l_suppkey % 2 AS nn, l_partkey % 40 AS cm, CAST(floor(l_extendedprice / 80) AS INT) AS s1, CAST(floor(l_extendedprice / 160) AS INT) AS s2,
l_linenumber = 2 AND l_partkey % 11 = 0 AS inversion, l_orderkey % 29 = 0 AS all_chains
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS _k FROM lineitem) WHERE _k = 1"""
R = f"WITH r AS ({RECORDS})"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt by query once: the windows and joins of a query's records need no other shuffle.
    return spark.sql(RECORDS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem").repartition("l_orderkey"))


def reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence, qualities and tags for each order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    at = (F.col("id") % 10 + 1).cast("int")
    seq = F.substring(F.lit("ACGTNACGGTTRCA" * 16), at, F.lit(160))
    tags = F.create_map(F.lit("MM"), F.lit("Z:C+m,1"), F.lit("xs"), F.concat(F.lit("i:"), (F.col("id") % 5).cast("string")))
    return o.select("id", F.concat(F.lit("read\t"), F.col("id").cast("string")).alias("name"), seq.alias("seq"), F.substring(F.lit("FGHIJKLMNOPQRS" * 16), at, F.lit(160)).alias("qual"), tags.alias("tags"))


ACCOUNT = {n: f"coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[{k}]', 1), lambda x: x::INT)), 0)::INT" for n, k in (("block", "MID=X"), ("match", "M="), ("gap", "ID"), ("target", "MDN=X"))}
MARGINS = R + """, m AS (SELECT *, CASE WHEN alt = 0 AND mapped AND ms >= 0 THEN ms - CASE WHEN seg = 0 THEN greatest(0, coalesce(max(CASE WHEN alt > 0 AND seg = 0 AND mapped THEN ms END) OVER (PARTITION BY id), 0)) ELSE 0 END END AS md FROM r)"""
LINKS = MARGINS + """, ln AS (SELECT a.*,
 (SELECT 'SA:Z:' || string_agg(concat_ws(',', b.target, b.pos + 1, CASE WHEN b.reverse THEN '-' ELSE '+' END, b.cigar, b.mapq, b.nm) || ';', '' ORDER BY b.seg) FROM r b WHERE b.id = a.id AND b.alt = 0 AND b.mapped AND b.seg <> a.seg AND a.alt = 0 AND a.mapped) AS sa,
 (SELECT 'XA:Z:' || string_agg(concat_ws(',', b.target, concat(CASE WHEN b.reverse THEN '-' ELSE '+' END, b.pos + 1), b.cigar, b.nm) || ';', '' ORDER BY b.alt) FROM r b WHERE b.id = a.id AND b.alt > 0 AND b.seg = 0 AND b.mapped AND b.nm IS NOT NULL AND a.alt = 0 AND a.seg = 0 AND a.mapped) AS xa
FROM m a)"""
SAM = LINKS + f""", t AS (SELECT ln.*, {ACCOUNT['block']} AS block, {ACCOUNT['match']} AS ok, {ACCOUNT['gap']} AS gap, len(regexp_extract_all(cigar, '[ID]')) AS opens,
  alt = 0 AND seg > 0 AND mapped AS hard, regexp_extract(cigar, '^([0-9]+)S', 1)::INT AS lead, regexp_extract(cigar, '([0-9]+)S$', 1)::INT AS trail,
  substr(repeat('ACGTNACGGTTRCA', 16), (id % 10 + 1)::INT, 160) AS seq, substr(repeat('FGHIJKLMNOPQRS', 16), (id % 10 + 1)::INT, 160) AS qual FROM ln WHERE alt = 0 OR mapped),
u AS (SELECT *, CASE WHEN mapped AND reverse THEN translate(reverse(translate(seq, 'R', 'N')), 'ACGT', 'TGCA') ELSE seq END AS os, CASE WHEN mapped AND reverse THEN reverse(qual) ELSE qual END AS oq,
  1.0::DOUBLE - ok::DOUBLE / (block + nn - gap + opens) AS d FROM t)
SELECT id, alt, seg, concat_ws(chr(9), 'read_' || id, CASE WHEN NOT mapped THEN 4 ELSE CASE WHEN reverse THEN 16 ELSE 0 END + CASE WHEN alt > 0 THEN 256 ELSE 0 END + CASE WHEN seg > 0 THEN 2048 ELSE 0 END END,
 CASE WHEN mapped THEN target ELSE '*' END, CASE WHEN mapped THEN pos + 1 ELSE 0 END, CASE WHEN NOT mapped OR alt > 0 THEN 0 ELSE mapq END,
 CASE WHEN NOT mapped THEN '*' WHEN hard THEN regexp_replace(regexp_replace(cigar, '^([0-9]+)S', '\\1H'), '([0-9]+)S$', '\\1H') ELSE cigar END, '*', 0, 0,
 CASE WHEN alt > 0 THEN '*' WHEN hard THEN substr(os, lead + 1, 160 - lead - trail) ELSE os END, CASE WHEN alt > 0 THEN '*' WHEN hard THEN substr(oq, lead + 1, 160 - lead - trail) ELSE oq END, 'RG:Z:g1',
 CASE WHEN mapped THEN 'AS:i:' || score END, CASE WHEN mapped THEN 'ms:i:' || ms END, 'md:i:' || md, CASE WHEN mapped THEN 'NM:i:' || nm END, CASE WHEN mapped THEN 'nn:i:' || nn END,
 CASE WHEN mapped THEN 'tp:A:' || CASE WHEN inversion THEN CASE WHEN alt > 0 THEN 'i' ELSE 'I' END WHEN all_chains OR alt > 0 THEN 'S' ELSE 'P' END END,
 CASE WHEN mapped THEN 'cm:i:' || cm END, CASE WHEN mapped THEN 's1:i:' || s1 END, CASE WHEN mapped AND alt = 0 THEN 's2:i:' || s2 END, CASE WHEN mapped THEN 'de:f:' || CASE WHEN d <= 0 THEN '0' ELSE printf('%.4f', d) END END,
 CASE WHEN hard OR alt > 0 THEN '' ELSE 'MM:Z:C+m,1' || chr(9) END || 'xs:i:' || (id % 5), sa, xa) AS line FROM u"""


@query("op_K03_K04_sam_records", SAM)
def sam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All SAM lines of all queries: clips, sequences, tags and links to other records."""
    return sam.sam_lines(rows(spark, sf_dir), reads_of(spark, sf_dir), read_group="g1")


@query("op_K11_score_margins", MARGINS + " SELECT id, alt, seg, md FROM m")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.with_margins(rows(spark, sf_dir)).select("id", "alt", "seg", "md")


@query("op_K06_alternatives_tag", LINKS + " SELECT id, xa FROM ln WHERE alt = 0 AND seg = 0")
def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.with_links(rows(spark, sf_dir)).where("alt = 0 and seg = 0").select("id", "xa")


@query("op_K10_record_types", R + " SELECT id, alt, seg, CASE WHEN inversion THEN CASE WHEN alt > 0 THEN 'i' ELSE 'I' END WHEN all_chains OR alt > 0 THEN 'S' ELSE 'P' END AS tp FROM r")
def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("id", "alt", "seg", sam.record_type(F.col("alt"), F.col("inversion"), F.col("all_chains")).alias("tp"))


@query("op_K08_header_lines", """SELECT 0 AS kind, -1 AS contig_id, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' AS line UNION ALL SELECT 2, -1, concat_ws(chr(9), '@PG', 'ID:weave', 'PN:weave', 'PP:old', 'VN:1', 'CL:map all')
UNION ALL SELECT 1, row_number() OVER (ORDER BY doc_id::VARCHAR)::INT - 1, '@SQ' || chr(9) || 'SN:' || doc_id || chr(9) || 'LN:' || coalesce(length(text), 0) FROM documents""")
def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.coalesce(F.length("text"), F.lit(0)).alias("length"))
    return sam.header_lines(ordering.numbered(d, "contig_id", ["name"]), "weave", "1", "map all", previous="old")


@query("op_K14_target_end", R + f""", e AS (SELECT *, CASE WHEN id % 3 = 0 THEN pos + 50 ELSE -1 END AS given, id % 5 = 0 AS exact, id % 2 = 0 AS regional FROM r)
SELECT id, alt, seg, CASE WHEN exact THEN greatest(pos, given) WHEN given > pos THEN given WHEN regional THEN pos + 70 ELSE pos + {ACCOUNT['target']} END AS target_end FROM e""")
def target_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos")
    region = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    given = F.when(F.col("id") % 3 == 0, pos + 50).otherwise(-1)
    regions = F.when(F.col("id") % 2 == 0, F.array(region(pos, pos + 30), region(pos + 40, pos + 70))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    return rows(spark, sf_dir).select("id", "alt", "seg", sam.target_end(pos, given, F.col("id") % 5 == 0, regions, F.col("cigar")).alias("target_end"))


@query("op_K17_passed_tags", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'MM:Z:C+m,1' || chr(9) ELSE '' END || 'xs:i:' || (o_orderkey % 5) AS tags FROM orders")
def passed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of reads on whole (even ids) and on clipped records."""
    kept = F.map_filter("tags", lambda k, v: (F.col("id") % 2 == 0) | ~k.isin(*sam.PER_BASE))
    return reads_of(spark, sf_dir).select("id", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\t").alias("tags"))


@query("op_X26_forward_intervals", R + ", x AS (SELECT *, regexp_extract(cigar, '^([0-9]+)S', 1)::INT AS lead, regexp_extract(cigar, '([0-9]+)S$', 1)::INT AS trail FROM r) SELECT id, alt, seg, CASE WHEN reverse THEN trail ELSE lead END AS q_lo, 400 - CASE WHEN reverse THEN lead ELSE trail END AS q_hi FROM x")
def forward_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rows(spark, sf_dir).select("id", "alt", "seg", sam.forward_interval(F.col("cigar"), F.lit(400), F.col("reverse")).alias("i"))
    return x.select("id", "alt", "seg", "i.q_lo", "i.q_hi")


@query("op_M05_divergence_contrast", R + """, d AS (SELECT id, alt * 10 + seg AS n, (mapq + 1) / 200.0::DOUBLE AS de, (score + 10)::DOUBLE AS length FROM r),
b AS (SELECT *, first_value(struct_pack(n := n, de := de, length := length)) OVER (PARTITION BY id ORDER BY de, n) AS l, count(*) OVER (PARTITION BY id) AS k FROM d),
p AS (SELECT *, (de * length + l.de * l.length) / (length + l.length) AS pooled FROM b), z AS (SELECT *, CASE WHEN k > 1 AND n <> l.n THEN (de - l.de) / sqrt(greatest(pooled * (1.0::DOUBLE - pooled), 1e-12::DOUBLE) * (1.0::DOUBLE / length + 1.0::DOUBLE / l.length)) END AS z FROM p)
SELECT id, n, de, length, round(z, 6) AS z, coalesce(z > 8, false) AS divergent FROM z""")
def divergence_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).select("id", (F.col("alt") * 10 + F.col("seg")).alias("n"), ((F.col("mapq") + 1) / F.lit(200.0)).alias("de"), (F.col("score") + 10).cast("double").alias("length"))
    return sam.divergence_contrast(r).withColumn("z", F.round("z", 6))


@query("op_M06_M07_routed_quality", R + """, q AS (SELECT *, CASE WHEN seg > 0 AND inversion THEN 0 WHEN seg = 0 OR nm % 2 = 0 THEN first_value(mapq) OVER (PARTITION BY id ORDER BY seg) ELSE mapq END AS routed FROM r WHERE alt = 0),
w AS (SELECT *, lag(routed) OVER o AS b, lead(routed) OVER o AS a FROM q WINDOW o AS (PARTITION BY id ORDER BY target, pos, seg)) SELECT id, seg, CASE WHEN inversion AND b IS NOT NULL AND a IS NOT NULL THEN least(a, b) ELSE routed END AS mapq FROM w""")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities of the segments of each primary placement, those of inversions from their flanks."""
    from pyspark.sql import Window

    r = rows(spark, sf_dir).where("alt = 0").withColumn("first", F.first("mapq").over(Window.partitionBy("id").orderBy("seg")))
    own = F.when(F.col("nm") % 2 != 0, F.col("mapq"))
    r = r.withColumn("mapq", sam.routed_quality(F.col("alt"), F.col("seg"), own, F.col("first"), F.col("inversion")))
    return sam.inversion_quality(r).select("id", "seg", "mapq")


@query("op_P05_floor_promotion", R + " SELECT id, row_number() OVER (PARTITION BY id ORDER BY seg)::INT - 1 AS seg, score FROM r WHERE alt = 0 AND score >= 300")
def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.floor_promoted(rows(spark, sf_dir).where("alt = 0").select("id", "seg", "score"), 300)


@query("op_S21_merged_header", """WITH h AS (SELECT o_orderkey % 3 AS input, o_orderkey AS n, CASE o_orderkey % 4 WHEN 0 THEN '@CO' || chr(9) || 'note ' || o_orderkey WHEN 1 THEN '@HD' || chr(9) || 'VN:1.6' WHEN 2 THEN '@RG' || chr(9) || 'ID:g' || (o_custkey % 20) ELSE '@PG' || chr(9) || 'ID:p' || (o_custkey % 30) || chr(9) || 'VN:' || o_orderkey END AS line FROM orders),
k AS (SELECT *, left(line, 3) AS kind, CASE WHEN left(line, 3) <> '@CO' THEN regexp_extract(line, chr(9) || 'ID:([^' || chr(9) || ']*)', 1) END AS key FROM h WHERE left(line, 3) IN ('@RG', '@PG', '@CO')),
f AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY input, n) AS r FROM k) SELECT input, n, line FROM f WHERE kind = '@CO' OR r = 1""")
def header_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda x: x.cast("string")
    line = F.when(k % 4 == 0, F.concat(F.lit("@CO\tnote "), text(k))).when(k % 4 == 1, F.lit("@HD\tVN:1.6")).when(k % 4 == 2, F.concat(F.lit("@RG\tID:g"), text(F.col("o_custkey") % 20))).otherwise(F.concat(F.lit("@PG\tID:p"), text(F.col("o_custkey") % 30), F.lit("\tVN:"), text(k)))
    return sam.merged_header(o.select((k % 3).alias("input"), k.alias("n"), line.alias("line")))


# --- hashes, coordinates and seed rules -------------------------------------------------------------------------------

WIDE, LOW = "18446744073709551616::UHUGEINT", "4294967296::UBIGINT"


def steps(source: str, start: str, moves: list[str]) -> str:
    """Nested selects that put `x` (from `start` over source) through each move."""
    sql = f"SELECT *, ({start}) AS x FROM {source}"
    for m in moves:
        sql = f"SELECT * EXCLUDE (x), ({m}) AS x FROM ({sql})"
    return sql


XOR = "xor(x, x >> {})".format
WANG64 = [f"((18446744073709551615::UHUGEINT - x::UHUGEINT) + x::UHUGEINT * 2097152) % {WIDE}", "x::UBIGINT", XOR(24), f"((x::UHUGEINT * 265) % {WIDE})::UBIGINT", XOR(14), f"((x::UHUGEINT * 21) % {WIDE})::UBIGINT", XOR(28), f"((x::UHUGEINT * 2147483649) % {WIDE})::UBIGINT"]
WANG32 = [f"(x + 4294967295 - (x * 32768) % {LOW}) % {LOW}", XOR(10), f"(x * 9) % {LOW}", XOR(6), f"(x + 4294967295 - (x * 2048) % {LOW}) % {LOW}", XOR(16)]
SPLIT = [f"((x::UHUGEINT + {hashes.SPLIT_STEP}::UHUGEINT) % {WIDE})::UBIGINT", XOR(30), f"((x::UHUGEINT * {hashes.SPLIT[0]}::UHUGEINT) % {WIDE})::UBIGINT", XOR(27), f"((x::UHUGEINT * {hashes.SPLIT[1]}::UHUGEINT) % {WIDE})::UBIGINT", XOR(31)]
BITS = 30
SHARD = ["x % 1073741824", XOR(10), f"((x::UHUGEINT * {hashes.SHARD[0]}::UHUGEINT) % 1073741824)::UBIGINT", XOR(15), f"((x::UHUGEINT * {hashes.SHARD[1]}::UHUGEINT) % 1073741824)::UBIGINT", XOR(10)]


@query("op_F16_key_mixes", f"SELECT p_partkey, a.x::VARCHAR AS split_mix, b.x::VARCHAR AS shard_mix FROM ({steps('part', 'p_partkey::UBIGINT * 1000003', SPLIT)}) a JOIN ({steps('part', 'p_partkey::UBIGINT * 1000003', SHARD)}) b USING (p_partkey)")
def key_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") * 1000003
    return table(spark, sf_dir, "part").select("p_partkey", hashes.split_hash(key).alias("split_mix"), hashes.shard_hash(key, BITS).alias("shard_mix"))


NAMED = "(SELECT c_custkey, c_nationkey, length(c_name) + c_custkey AS len, list_reduce(list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296) AS nh FROM customer)"
SEED0 = steps("(SELECT 11::UBIGINT AS k)", "k", WANG32)
OWN = steps(NAMED, "len::UBIGINT", WANG32)
READ_SEED = steps(f"(SELECT * EXCLUDE (x), xor(nh::UBIGINT, (x + (SELECT x FROM ({SEED0}))) % {LOW}) AS y FROM ({OWN}))", "y", WANG32)
LOCUS = steps(f"(SELECT c_custkey, x AS seed, ((c_custkey % 2)::UBIGINT << 63) + (c_nationkey::UBIGINT << 32) + ((c_custkey * 7 - 5000 + 4294967296) % 4294967296)::UBIGINT AS key FROM ({READ_SEED}))", "key", [*WANG64, "xor(x, seed::UBIGINT)", *WANG64])


@query("op_F17_tie_hashes", f"SELECT c_custkey, seed::BIGINT AS read_seed, x::VARCHAR AS locus_hash FROM ({LOCUS})")
def tie_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie seeds of queries by name and length, and ranks of one locus each."""
    c = table(spark, sf_dir, "customer")
    c = c.withColumn("read_seed", hashes.read_seed(sq.name_hash(F.col("c_name")), F.length("c_name") + F.col("c_custkey")))
    return c.select("c_custkey", "read_seed", hashes.locus_hash(F.col("read_seed"), F.col("c_nationkey"), F.col("c_custkey") % 2, F.col("c_custkey") * 7 - 5000).alias("locus_hash"))


@query("op_F19_read_identity", f"SELECT c_custkey, list_reduce(list_prepend({hashes.FNV_OFFSET}::UBIGINT, list_transform(string_split(upper(c_name || lower(c_mktsegment)), ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: ((xor(h, c)::UHUGEINT * {hashes.FNV_PRIME}::UHUGEINT) % {WIDE})::UBIGINT)::VARCHAR AS identity FROM customer")
def read_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hashes.identity(F.concat("c_name", F.lower("c_mktsegment"))).alias("identity"))


@query("op_F20_approximate_log2", "WITH e AS (SELECT o_orderkey, (o_orderkey + 1)::FLOAT AS x, floor(log2(o_orderkey + 1))::INT AS e FROM orders), f AS (SELECT *, (x / (1::BIGINT << e)::FLOAT)::FLOAT AS f FROM e) SELECT o_orderkey, round(((e - 1)::FLOAT + (((-0.34484843)::FLOAT * f + 2.02466578::FLOAT) * f - 0.67487759::FLOAT))::DOUBLE, 4) AS log2 FROM f")
def approximate_log2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(hashes.approximate_log2((F.col("o_orderkey") + 1).cast("float")).cast("double"), 4).alias("log2"))


@query("op_F22_checked_coordinates", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey * 400000 + l_partkey > 2147483647 OR l_partkey - 900 < 0 THEN NULL ELSE l_orderkey * 400000 + l_partkey END::BIGINT AS place FROM lineitem")
def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of coordinates, null where they or an operand leave the domain of coordinates."""
    total = sq.checked(F.col("l_orderkey") * 400000 + F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(sq.checked(F.col("l_partkey") - 900).isNotNull(), total).alias("place"))


@query("op_F25_tile_bounds", """WITH s AS (SELECT doc_id, n_chars AS n, greatest(1, n_chars - 14) AS span, least(15, least(greatest(n_chars // 3, 0), greatest(1, n_chars - 14) - 1) * 16 // greatest(1, n_chars - 14)) AS tile FROM documents WHERE n_chars IS NOT NULL)
SELECT doc_id, tile::INT AS tile, (tile * span // 16)::INT AS lo, least(n, ((tile + 1) * span + 15) // 16 + 14)::INT AS hi, (((tile * span + 15) // 16 + greatest((tile * span + 15) // 16, ((tile + 1) * span + 15) // 16 - 1)) // 2)::INT AS centre FROM s""")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").where(n.isNotNull()).withColumn("tile", sq.query_tile(F.floor(n / 3), n, 15, 16))
    lo, hi, centre = sq.tile_bounds(F.col("tile"), n, 15, 16)
    return d.select("doc_id", "tile", lo.alias("lo"), hi.alias("hi"), centre.alias("centre"))


@query("op_F15_stream_window", f"WITH {RANKS},\n{seed_sql('q', READS)} SELECT id, pos - 20 AS pos, key, z FROM q JOIN {KEY_HASH} USING (key) WHERE pos BETWEEN 20 AND 180 - 15 AND h % 2 = 0")
def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of bases 20 to 180, from there, thinned by half."""
    return seeds.window(read_seeds(spark, sf_dir), 20, 180, thinned=2).select("id", "pos", "key", "z")


CAP, DIST = 1, 60


@query("op_V02_readmitted_seeds", f"""{REF},
{seed_sql('q', READS)}, {OCC}, a AS (SELECT q.id, q.pos, occ, length(seq) AS n FROM q JOIN q_q USING (id) JOIN occ USING (key)),
b AS (SELECT *, count(*) FILTER (occ <= {CAP}) OVER w AS streak, max(pos + 15) FILTER (occ <= {CAP}) OVER w AS ps, min(pos + 15) FILTER (occ <= {CAP}) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS pe FROM a WINDOW w AS (PARTITION BY id ORDER BY pos)),
c AS (SELECT *, least(128, floor((coalesce(pe, n) - coalesce(ps, 0)) / {DIST}::DOUBLE + 0.499::DOUBLE)) AS take, row_number() OVER (PARTITION BY id, streak ORDER BY occ, pos) AS k FROM b WHERE occ > {CAP})
SELECT id, pos FROM c WHERE k <= take AND occ <= 4095""")
def readmitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-cap seeds that come back, at a low cap so that small tables have some."""
    return seeds.readmitted(read_seeds(spark, sf_dir), index.occurrences(reference(spark, sf_dir)), read_lengths(spark, sf_dir), CAP, DIST)


@query("op_V04_tile_rescue", """WITH RECURSIVE t AS (SELECT l_orderkey AS id, l_linenumber AS tile, (l_partkey % 3 = 0)::INT AS admitted, l_suppkey AS pos, l_partkey AS occ FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tile) AS i FROM t WHERE admitted = 0),
w AS (SELECT id, i, tile, pos, occ <= 2000 AS fits, CASE WHEN occ <= 2000 THEN occ ELSE 0 END AS spent FROM n WHERE i = 1 UNION ALL SELECT n.id, n.i, n.tile, n.pos, w.spent + n.occ <= 2000, CASE WHEN w.spent + n.occ <= 2000 THEN w.spent + n.occ ELSE w.spent END FROM w JOIN n ON n.id = w.id AND n.i = w.i + 1)
SELECT id, tile, pos FROM w WHERE fits""")
def tile_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescue over tiles made from order lines, under a budget of 2000."""
    r = spark.sql("SELECT l_orderkey AS id, l_linenumber AS tile, CAST(l_partkey % 3 = 0 AS INT) AS admitted, l_suppkey AS pos, l_partkey AS occ FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM {lineitem}) WHERE k = 1", lineitem=table(spark, sf_dir, "lineitem"))
    return seeds.rescued(r, 2000)


GREEDY = """WITH RECURSIVE n AS (SELECT s_suppkey AS id, round(s_acctbal * s_acctbal)::BIGINT % 1000 + 1 AS len, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
w AS (SELECT id, i, len AS total, 0 AS batch FROM n WHERE i = 1 UNION ALL SELECT n.id, n.i, CASE WHEN {cond} THEN n.len ELSE w.total + n.len END, w.batch + ({cond})::INT FROM w JOIN n ON n.i = w.i + 1) SELECT id, batch FROM w"""


@query("op_A04_reference_parts", GREEDY.format(cond="w.total + n.len > 3000"))
def reference_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budgeted(spark, sf_dir, False)


@query("op_S14_read_batches", GREEDY.format(cond="w.total >= 3000"))
def read_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budgeted(spark, sf_dir, True)


def _budgeted(spark: SparkSession, sf_dir: str, closing: bool) -> DataFrame:
    """Batches of 3000 along supplier keys. Lengths alone (a number an element) meet in one row."""
    square = F.col("s_acctbal") * F.col("s_acctbal")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.round(square).cast("long") % 1000 + 1).alias("len"))
    every = s.agg(F.array_sort(F.collect_list(F.struct("id", "len"))).alias("all"))
    batches = ordering.budgeted(F.transform("all", lambda x: x["len"]), 3000, closing)
    return every.select(F.explode(F.arrays_zip(F.col("all.id").alias("id"), batches.alias("batch"))).alias("x")).select("x.id", "x.batch")


@query("op_J15_query_relations", """WITH i AS (SELECT l_orderkey AS id, l_linenumber AS n, min(l_linenumber * 10) AS lo, min(l_linenumber * 10 + l_quantity::INT) AS hi FROM lineitem GROUP BY ALL)
SELECT a.id, a.n AS a, b.n AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) >= least(a.hi - a.lo, b.hi - b.lo) // 2 AS rival FROM i a JOIN i b ON a.id = b.id AND a.n < b.n""")
def query_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of intervals of one query: rivals share half of the shorter one."""
    line = F.col("l_linenumber") * 10
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n")).agg(F.min(line).alias("lo"), F.min(line + F.col("l_quantity").cast("int")).alias("hi"))
    a, b = i.alias("a"), i.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.n") < F.col("b.n")))
    return pairs.select("a.id", F.col("a.n").alias("a"), F.col("b.n").alias("b"), sq.rivals(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi")).alias("rival"))


@query("op_V21_evidence_score", """WITH p AS (SELECT o_custkey AS id, o_orderkey % 1000 AS lo, o_orderkey % 1000 + 20 + o_orderkey % 90 AS hi, o_orderkey % 60 AS covered, o_orderkey AS k FROM orders),
w AS (SELECT *, max(hi) OVER (PARTITION BY id ORDER BY lo, hi, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p)
SELECT id, sum(least(covered, greatest(0, hi - greatest(lo, coalesce(reach, -1)))))::BIGINT AS evidence FROM w GROUP BY id""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed evidence of envelopes, no query base counted twice; a customer stands for an envelope."""
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (k % 1000).alias("lo"), (k % 1000 + 20 + k % 90).alias("hi"), (k % 60).alias("covered"), k.alias("k"))
    return intervals.evidence(p, "id", ["k"])


SPANS = "(SELECT o_custkey AS id, o_orderkey % 1000 AS lo, o_orderkey % 1000 + 20 + o_orderkey % 90 AS hi, o_orderkey AS k FROM orders)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a customer's orders, which stand for anchors of a query."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (k % 1000).alias("lo"), (k % 1000 + 20 + k % 90).alias("hi"), k.alias("k"))


@query("op_C25_anchor_union", f"WITH w AS (SELECT *, max(hi) OVER (PARTITION BY id ORDER BY lo, hi, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {SPANS}) SELECT id, sum(greatest(0, hi - greatest(lo, coalesce(reach, lo))))::BIGINT AS bases FROM w GROUP BY id")
def anchor_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.covered(spans(spark, sf_dir), "id", ["k"])


@query("op_O10_C27_uncovered_intervals", f"""WITH w AS (SELECT *, max(hi) OVER (PARTITION BY id ORDER BY lo, hi, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {SPANS}),
g AS (SELECT id, greatest(coalesce(reach, 0), 0) AS lo, least(lo, 1200) AS hi FROM w UNION ALL SELECT id, greatest(max(hi), 0), 1200 FROM w GROUP BY id) SELECT id, lo, hi FROM g WHERE hi - lo >= 100""")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 100 bases or more of a query of 1,200 that no interval covers."""
    whole = intervals.merged(spans(spark, sf_dir), ["id"])
    return intervals.complement(whole, ["id"], "lo", "hi", F.lit(0), F.lit(1200), least=100)


@query("op_P04_retained_alternatives", R + """, o AS (SELECT id, score AS own FROM r WHERE alt = 0 AND seg = 0), n AS (SELECT r.id, alt, score, row_number() OVER (PARTITION BY r.id ORDER BY score DESC, alt) AS n FROM r JOIN o USING (id) WHERE alt > 0 AND seg = 0 AND (score >= 0.8::DOUBLE * own OR score + 30 >= own))
SELECT id, alt, score FROM n WHERE n <= 1""")
def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.retained_alternatives(rows(spark, sf_dir), most=1)


@query("op_X17_chain_divergence", "SELECT l_orderkey, l_linenumber, round(1 - pow(l_linenumber::DOUBLE / (l_linenumber + l_quantity), 1.0::DOUBLE / 15), 9) AS divergence FROM lineitem")
def chain_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(records.chain_divergence(F.col("l_linenumber"), F.col("l_linenumber") + F.col("l_quantity"), 15), 9).alias("divergence"))


@query("op_H33_size_suffixes", "SELECT p_partkey, (p_size::BIGINT * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1000000000 END)::BIGINT AS size FROM part")
def size_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes written with k, m and g."""
    unit = F.element_at(F.array(F.lit(""), F.lit("k"), F.lit("M"), F.lit("g")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sq.size_of(F.concat(F.col("p_size").cast("string"), unit)).alias("size"))
