"""Registered queries of winner lines, shadows and record floors over tables that stand for seeds and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import lines
from strandweave.plans.mapping import query
from strandweave.session import table

#: A supplier stands for a winner, its lines for postings: q from the order, d along a slope of 0 to 14 percent with noise.
POINTS = """SELECT l_suppkey AS id, l_orderkey % 20000 AS q, 5000 + CAST(floor((l_orderkey % 20000) * (l_suppkey % 15) / 100.0) AS BIGINT) + l_partkey % 90 + CASE WHEN l_linenumber = 7 THEN 300 ELSE 0 END AS d FROM lineitem"""
WINNERS = "SELECT s_suppkey AS id, 9 + s_suppkey % 3 AS bin, (9 + s_suppkey % 3) * 512 + 256 AS start, 512 AS width, 20000 + 1000 * (s_suppkey % 7) AS length FROM supplier"


def floor_sql(a: str, b: str) -> str:
    return f"(({a})::HUGEINT // ({b})::HUGEINT - CASE WHEN ({a})::HUGEINT % ({b})::HUGEINT < 0 THEN 1 ELSE 0 END)"


def at_sql(line: str, q: str) -> str:
    n, sq, sd, slope = (f"{line}.{c}" for c in ("n", "sq", "sd", "slope"))
    return floor_sql(f"{sd} * {lines.ONE} + {slope}::HUGEINT * ({n} * {q} - {sq})", f"{n} * {lines.ONE}")


def fit_sql(name: str, source: str) -> str:
    sums = f"SELECT id, count(*)::HUGEINT AS n, sum(q)::HUGEINT AS sq, sum(d)::HUGEINT AS sd, sum(q::HUGEINT * q)::HUGEINT AS qq, sum(q::HUGEINT * d)::HUGEINT AS qd FROM {source} GROUP BY id"
    slope = floor_sql(f"(n * qd - sq * sd) * {2 * lines.ONE} + (n * qq - sq * sq)", "2 * (n * qq - sq * sq)")
    return f"{name} AS (SELECT id, n, sq, sd, greatest({-lines.LIMIT}, least({lines.LIMIT}, {slope})) AS slope FROM ({sums}) WHERE n * qq - sq * sq > 0)"


LINE_SQL = f"""WITH p AS ({POINTS}), w AS ({WINNERS}),
s0 AS (SELECT id, q, arg_min(d, (abs(d - start), d)) AS d FROM p JOIN w USING (id) WHERE d BETWEEN (bin - 1) * width AND (bin + 2) * width - 1 GROUP BY id, q),
{fit_sql('f0', 's0')}, c AS (SELECT p.id, p.q, p.d, {at_sql('f0', 'p.q')} AS centre FROM p JOIN f0 ON p.id = f0.id),
s1 AS (SELECT id, q, arg_min(d, (abs(d - centre), d)) AS d FROM c WHERE abs(d - centre) <= 512 GROUP BY id, q),
{fit_sql('f1', 's1')}, o AS (SELECT s1.id, s1.q, s1.d, s1.d - {at_sql('f1', 's1.q')} AS off FROM s1 JOIN f1 ON s1.id = f1.id),
m AS (SELECT id, list_sort(list(off)) AS offs FROM o GROUP BY id), v AS (SELECT id, list_sort(list_transform(offs, lambda x: abs(x - offs[len(offs) // 2 + 1]))) AS devs FROM m),
k AS (SELECT o.* FROM o JOIN v USING (id) WHERE abs(off) <= greatest(3 * devs[len(devs) // 2 + 1], {lines.TRIM_FLOOR})),
{fit_sql('f2', 'k')}, h AS (SELECT id, n, sq, sd, greatest({lines.LOW}, least({lines.HIGH}, slope)) AS slope FROM f2),
r AS (SELECT id, count(*) AS pairs, max(q) - min(q) AS reached FROM k GROUP BY id)
SELECT w.id, coalesce(r.pairs, 0)::BIGINT AS n, CASE WHEN h.id IS NULL THEN 0 ELSE r.reached END::BIGINT AS span, coalesce(h.slope, 0)::BIGINT AS slope, CASE WHEN h.id IS NULL THEN 0 ELSE {at_sql('h', '0')} END::BIGINT AS intercept,
 coalesce(r.pairs >= {lines.LEAST_PAIRS} AND 4 * r.reached >= w.length AND h.slope NOT IN ({lines.LOW}, {lines.HIGH}), false) AS gate FROM w LEFT JOIN r ON w.id = r.id LEFT JOIN h ON w.id = h.id"""


@query("op_V12_winner_lines", LINE_SQL)
def winner_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.sql(POINTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    winners = spark.sql(WINNERS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    return lines.winner_lines(points, winners, ["id"])


#: An order stands for a read of 15,000 bases, its first line for the winner, the others for rivals.
SPANS = """SELECT l_orderkey AS id, l_linenumber AS n, min(l_partkey * 7 % 3000 - 20) AS r_lo, min(l_partkey * 7 % 3000 + CAST(l_quantity AS INT) * 60 - 100) AS r_hi,
min(l_suppkey * 5 % 900 - 10) AS q_lo, min(l_suppkey * 5 % 900 + CAST(l_quantity AS INT) * 60) AS q_hi, min(l_returnflag) = 'R' AS reverse FROM lineitem GROUP BY l_orderkey, l_linenumber"""
LENGTH = 15_000
_DIAGONAL = {f"{x}{e}": f"{x}.r_{e} - CASE WHEN {x}.reverse THEN {LENGTH} - {x}.q_{o} ELSE {x}.q_{e} END" for x in "ab" for e, o in (("lo", "hi"), ("hi", "lo"))}
SHADOW_SQL = f"""WITH s AS ({SPANS}), t AS (SELECT a.id, b.n, a.r_lo >= 0 AND a.r_hi > a.r_lo AND b.r_lo >= 0 AND b.r_hi > b.r_lo AS placed, a.q_lo >= 0 AND a.q_hi > a.q_lo AND b.q_lo >= 0 AND b.q_hi > b.q_lo AS lined,
 least(a.r_hi, b.r_hi) - greatest(a.r_lo, b.r_lo) AS common, least(a.r_hi - a.r_lo, b.r_hi - b.r_lo) AS shorter, b.r_lo >= a.r_lo - 3000 AND b.r_hi <= a.r_hi + 3000 AS inside,
 {_DIAGONAL['alo']} AS w0, {_DIAGONAL['ahi']} AS w1, {_DIAGONAL['blo']} AS r0, {_DIAGONAL['bhi']} AS r1 FROM s a JOIN s b ON a.id = b.id AND a.n = 1 AND b.n > 1),
u AS (SELECT id, n, placed AND common > 0 AND 2 * common > shorter AS half, placed AND inside AS contained, placed AND lined AND least(r0, r1) >= least(w0, w1) - 3000 AND greatest(r0, r1) <= greatest(w0, w1) + 3000 AS on_diagonal FROM t)
SELECT *, half AND contained AND on_diagonal AS shadow FROM u"""


@query("op_J17_shadows", SHADOW_SQL)
def shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each rival of a read lies on its winner's locus."""
    spans = spark.sql(SPANS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    a, b = spans.where("n = 1").alias("a"), spans.where("n > 1").alias("b")
    of = lambda x: {c: F.col(f"{x}.{c}") for c in ("r_lo", "r_hi", "q_lo", "q_hi", "reverse")}
    length = F.lit(LENGTH)
    found = lines.shadow(of("a"), of("b"), length, lines.slack(length))
    return a.join(b, F.col("a.id") == F.col("b.id")).select("a.id", "b.n", *[c.alias(n) for n, c in found.items()])


@query("op_X18_record_floors", "SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 90 AS matches FROM lineitem WHERE (l_suppkey % 11 = 0 OR l_suppkey % 7 >= 3) AND l_partkey % 90 >= 40 AND l_partkey % 200 >= 40")
def record_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, part, supplier = F.col("l_orderkey").alias("id"), F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(key, F.col("l_linenumber").alias("n"), (supplier % 11 == 0).alias("inversion"), (supplier % 7).alias("anchors"), (part % 90).alias("matches"), (part % 200).alias("dp_max"))
    return lines.kept_records(rows).select("id", "n", "matches")
