"""The relational surface over the driver's tables: joins, aggregates, windows, sets, functions, time, functions of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.operators import intervals
from strandweave.session import table as t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def micros(column: str):
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


@query("r01_inner_join", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "orders").join(t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("r02_full_outer_join", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN orders ON o_custkey = c_custkey")
def full_join(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "customer").where("c_acctbal > 0").join(t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "full").select("c_custkey", "o_orderkey")


@query("r03_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "customer").join(t(s, d, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("r03_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "customer").join(t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("r04_small_cross_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey <> r_regionkey")
def cross_join(s: SparkSession, d: str) -> DataFrame:
    """Two dimension tables of fixed size: 25 x 5 rows."""
    return t(s, d, "nation").crossJoin(t(s, d, "region")).where("n_regionkey <> r_regionkey").select("n_name", "r_name")


@query("r05_interval_join", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey % 64 = o_orderkey % 64 AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 1 DAY")
def interval_join(s: SparkSession, d: str) -> DataFrame:
    """Lines shipped within a day of an order of the same class, by bins of a day."""
    day = 86_400_000_000
    e = t(s, d, "lineitem").select("l_linenumber", "l_partkey", (F.col("l_orderkey") % 64).alias("k"), micros("l_shipdate").alias("at"))
    o = t(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 64).alias("k"), micros("o_orderdate").alias("lo")).withColumn("hi", F.col("lo") + day)
    return intervals.range_join(e, o, ["k"], "at", "lo", "hi", day).select("o_orderkey", "l_linenumber", "l_partkey")


@query("r06_as_of_join", "SELECT event_id, ts, o.o_orderdate AS o_orderdate FROM events e LEFT JOIN (SELECT o_orderdate FROM orders GROUP BY 1) o ON o.o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= e.ts)")
def as_of_join(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders").select("o_orderdate", F.col("o_orderdate").alias("_when"))
    return intervals.as_of(t(s, d, "events").select("event_id", "ts"), o, "ts", "_when", ["o_orderdate"])


@query("r07_band_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_acctbal >= s_acctbal - 100 AND c_acctbal < s_acctbal + 100")
def band_join(s: SparkSession, d: str) -> DataFrame:
    w = t(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_acctbal") - 100).alias("lo"), (F.col("s_acctbal") + 100).alias("hi"))
    p = t(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"))
    return intervals.range_join(p, w, ["k"], "x", "lo", "hi", 200).select("s_suppkey", "c_custkey")


BY_NATION = "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query("r08_join_strategies", f"SELECT s AS strategy, b.* FROM unnest(['broadcast', 'merge', 'shuffle_hash']) x(s), ({BY_NATION}) b")
def join_strategies(s: SparkSession, d: str) -> DataFrame:
    """One join by three physical strategies, with equal results; nation has 25 rows, so that its broadcast is bounded."""
    out = None
    for hint in ("broadcast", "merge", "shuffle_hash"):
        joined = t(s, d, "customer").join(t(s, d, "nation").hint(hint), F.col("c_nationkey") == F.col("n_nationkey"))
        part = joined.groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")).select(F.lit(hint).alias("strategy"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("r09_lateral_top_lines", "SELECT o_orderkey, l_extendedprice FROM (SELECT o_orderkey, l_extendedprice, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE n <= 2")
def top_lines(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey")
    top = t(s, d, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 2")
    return t(s, d, "orders").join(top, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_extendedprice")


@query("r10_filtered_aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, min(l_discount) AS lo, max(l_tax) AS hi, count(*) FILTER (WHERE l_discount > 0.05) AS many, round(avg(l_quantity), 6) AS mean_q FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def filtered_aggregates(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi"), F.count_if(F.col("l_discount") > 0.05).alias("many"), F.round(F.avg("l_quantity"), 6).alias("mean_q"))


@query("r11_distinct_aggregates", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_suppkey")
def distinct_aggregates(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("lines"))


@query("r12_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("r12_cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))


@query("r12_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::INT AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g"))


@query("r13_approximate_aggregates", "SELECT count(DISTINCT l_partkey) AS parts, true AS parts_close, true AS mid_close FROM lineitem")
def approximate(s: SparkSession, d: str) -> DataFrame:
    """Sketches differ between engines, so their stated errors are held against exact values: 5 % of the distinct parts,
    and a rank within 1 % of the middle."""
    rows = t(s, d, "lineitem")
    # Apart: beside a distinct count Spark would keep the sketches of each distinct value.
    parts = rows.agg(F.countDistinct("l_partkey").alias("parts"))
    sketches = rows.agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.percentile_approx("l_quantity", 0.5, 1000).alias("mid"), F.percentile("l_quantity", F.array(F.lit(0.49), F.lit(0.51))).alias("ranks"))
    found = parts.crossJoin(sketches)  # a row each
    close = F.abs(F.col("about") - F.col("parts")) <= F.greatest(F.lit(1.0), 0.05 * F.col("parts"))
    return found.select("parts", close.alias("parts_close"), F.col("mid").between(F.floor(F.col("ranks")[0]), F.ceil(F.col("ranks")[1])).alias("mid_close"))


@query("r14_ranking_windows", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS nt, round(percent_rank() OVER w, 9) AS pr FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)")
def ranking(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate")
    x = Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")
    return t(s, d, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(x).alias("nt"), F.round(F.percent_rank().over(w), 9).alias("pr"))


@query("r15_analytic_windows", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2) OVER w AS next2, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def analytic(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(s, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("prev"), F.lead("o_totalprice", 2).over(w).alias("next2"), F.first("o_orderkey").over(w).alias("f"), F.nth_value("o_orderkey", 2).over(w).alias("n2"))


@query("r16_window_frames", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS day_n, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s3 FROM events")
def frames(s: SparkSession, d: str) -> DataFrame:
    r = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return t(s, d, "events").withColumn("us", micros("ts")).select("event_id", F.count("*").over(r).alias("day_n"), F.round(F.sum("value").over(w), 6).alias("s3"))


@query("r17_top_k_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def top_k(s: SparkSession, d: str) -> DataFrame:
    """A top-k report; the limit is the feature."""
    return t(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").offset(10).limit(50)


@query("r18_set_operations", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def set_operations(s: SparkSession, d: str) -> DataFrame:
    a = t(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey")).distinct()
    return a.exceptAll(t(s, d, "nation").where("n_regionkey = 0").select("n_nationkey"))


@query("r18_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(t(s, d, "supplier").select("s_nationkey"))


@query("r19_pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS \"F\", count(*) FILTER (WHERE l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY l_returnflag")
def pivot(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("r19_unpivot", "SELECT p_partkey, 'size' AS what, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "what", "v")


@query("r20_string_functions", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, upper(substr(url, 1, 5)) AS head, length(url) AS n, translate(url, 'aeiou', '12345') AS tr, len(string_split(url, '/'))::INT AS parts FROM pages")
def strings(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return t(s, d, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"), F.upper(F.substring(u, 1, 5)).alias("head"), F.length(u).alias("n"), F.translate(u, "aeiou", "12345").alias("tr"), F.size(F.split(u, "/")).alias("parts"))


@query("r21_date_functions", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS m, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS days, extract(quarter FROM o_orderdate)::INT AS q, strftime(o_orderdate + INTERVAL 3 MONTH, '%Y-%m-%d') AS later FROM orders")
def dates(s: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderdate")
    return t(s, d, "orders").select("o_orderkey", F.date_format(F.date_trunc("month", o), "yyyy-MM").alias("m"), F.datediff(o, F.lit("1992-01-01").cast("date")).alias("days"), F.quarter(o).alias("q"), F.date_format(F.add_months(o, 3), "yyyy-MM-dd").alias("later"))


@query("r22_math_functions", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 8) AS ln_p, round(sqrt(l_quantity), 8) AS rt, floor(l_extendedprice / 7)::BIGINT AS fl, bit_count(l_partkey)::INT AS bits, xor(l_partkey, l_suppkey) AS x FROM lineitem")
def maths(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.ln("l_extendedprice"), 8).alias("ln_p"), F.round(F.sqrt("l_quantity"), 8).alias("rt"), F.floor(F.col("l_extendedprice") / 7).alias("fl"), F.bit_count("l_partkey").alias("bits"), F.col("l_partkey").bitwiseXOR(F.col("l_suppkey")).alias("x"))


@query("r23_array_functions", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 1000)::BIGINT * (x::DOUBLE * 1000)::BIGINT))::BIGINT AS norm2, len(embedding)::INT AS n, floor(list_max(embedding)::DOUBLE * 1000)::BIGINT AS top FROM embeddings")
def arrays(s: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    return t(s, d, "embeddings").select("vec_id", F.aggregate(F.transform(e, lambda x: x * x), F.lit(0).cast("long"), lambda a, x: a + x).alias("norm2"), F.size("embedding").alias("n"), F.floor(F.array_max("embedding").cast("double") * 1000).alias("top"))


@query("r24_json_functions", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("r25_map_functions", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def maps(s: SparkSession, d: str) -> DataFrame:
    per = t(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id")
    m = per.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).alias("clicks"), F.size("m").cast("long").alias("kinds"))


@query("r26_tumbling_windows", "SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("w"), "event_type", "n")


@query("r26_sliding_windows", "SELECT date_trunc('hour', ts) - i * INTERVAL 1 HOUR AS w, count(*) AS n FROM events, range(3) r(i) GROUP BY ALL")
def sliding(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").groupBy(F.window("ts", "3 hours", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("w"), "n")


SESSIONS = "WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS n FROM events), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM a)"


@query("r26_session_windows", SESSIONS + " SELECT user_id, min(ts) AS w, count(*) AS n FROM b GROUP BY user_id, g")
def sessions(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("w"), "n")


@query("r27_gap_sessions", SESSIONS + " SELECT event_id, g::INT AS g FROM b")
def gap_sessions(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(micros("ts") - F.lag(micros("ts")).over(w) < 21_600_000_000, 0).otherwise(1)
    return t(s, d, "events").withColumn("n", new).select("event_id", F.sum("n").over(w).cast("int").alias("g"))


@query("r28_vectorised_function", "SELECT s_suppkey, round(s_acctbal * 1.1::DOUBLE, 4) AS x FROM supplier")
def vectorised(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def scaled(x):
        return x * 1.1

    return t(s, d, "supplier").select("s_suppkey", F.round(scaled("s_acctbal"), 4).alias("x"))


@query("r28_grouped_function", "SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1")
def grouped(s: SparkSession, d: str) -> DataFrame:
    """A user-defined aggregate in two steps: Arrow partials a task, then a merge."""
    import pyarrow as pa

    def partial(batches):
        for b in batches:
            out = pa.Table.from_batches([b]).group_by("o_orderpriority").aggregate([("o_orderkey", "count"), ("o_orderkey", "max")])
            yield from out.select(["o_orderpriority", "o_orderkey_count", "o_orderkey_max"]).rename_columns(["o_orderpriority", "n", "last"]).to_batches()

    p = t(s, d, "orders").select("o_orderpriority", "o_orderkey").mapInArrow(partial, "o_orderpriority string, n long, last long")
    return p.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


@query("r28_table_function", "SELECT n_nationkey, i::INT AS i FROM nation, range(3) r(i)")
def table_function(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.functions import udtf

    @udtf(returnType="i: int")
    class Upto:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    s.udtf.register("upto", Upto)
    t(s, d, "nation").createOrReplaceTempView("r28_nation")
    return s.sql("SELECT n_nationkey, i FROM r28_nation, LATERAL upto(3)")


@query("r29_correlated_subquery", "SELECT s_suppkey FROM supplier s WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey) AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def correlated(s: SparkSession, d: str) -> DataFrame:
    t(s, d, "supplier").createOrReplaceTempView("r29_supplier")
    t(s, d, "nation").createOrReplaceTempView("r29_nation")
    return s.sql("SELECT s_suppkey FROM r29_supplier s WHERE s_acctbal > (SELECT avg(s_acctbal) FROM r29_supplier x WHERE x.s_nationkey = s.s_nationkey) AND s_nationkey IN (SELECT n_nationkey FROM r29_nation WHERE n_regionkey < 3)")


@query("r30_streaming_windows", "SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming(s: SparkSession, d: str) -> DataFrame:
    """The tumbling windows as a stream over the same files, run to its end."""
    from strandweave.streaming.events import hourly_counts

    return hourly_counts(s, d)
