"""Steps that must not meet in one task or be done over again, seen in plans and held against plain results."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandweave.operators import intervals, lines, sam


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comments_of_headers_meet_in_no_window(spark):
    rows = [(i % 3, i, f"@CO\tnote {i}") for i in range(40)] + [(2, 50, "@PG\tID:a\tVN:1"), (1, 60, "@PG\tID:a\tVN:2"), (1, 55, "@PG\tID:a\tVN:3"), (0, 61, "@RG\tID:g"), (1, 2, "@RG\tID:g"), (0, 1, "@HD\tVN:1.6"), (0, 3, "@PG\tVN:9")]
    df = spark.createDataFrame(rows, "input int, n int, line string")
    found = sam.merged_header(df)
    assert "Window" not in plan(found)
    assert sorted(map(tuple, found.collect())) == sorted([*rows[:40], rows[42], rows[43], rows[46]])
    with pytest.raises(Exception, match="declared differently"):
        sam.merged_header(df.union(spark.createDataFrame([(2, 9, "@RG\tID:g\tSM:x")], df.schema))).collect()


def test_as_of_cuts_the_time_axis_into_hours(spark):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    right = [(at(m), m) for m in (30, 70, 70 + 1, 60 * 24 * 40, 60 * 24 * 40 + 59)]
    left = [(i, at(m)) for i, m in enumerate((0, 29, 30, 31, 59, 60, 70, 71, 500, 60 * 24 * 39, 60 * 24 * 40, 60 * 24 * 40 + 60, 60 * 24 * 300))]
    r = spark.createDataFrame(right, "w timestamp_ntz, m int")
    found = intervals.as_of(spark.createDataFrame(left, "i int, t timestamp_ntz"), r, "t", "w", ["m"])
    assert {x.i: x.m for x in found.collect()} == {i: max((m for w, m in right if w <= t), default=None) for i, t in left}
    groups = plan(found).split("Window [")
    assert any("date_trunc(hour" in g for g in groups) and "date_trunc(month" not in plan(found)


def test_sketches_are_not_kept_for_each_distinct_value(spark):
    found = plan(entry.queries()["r13_approximate_aggregates"](spark, "/root/testdata/sf0.001"))
    assert not [line for line in found.splitlines() if "keys=[l_partkey" in line and "percentile" in line]


def test_winner_lines_take_their_points_once(spark):
    """The steps after the pairs read what is written; the points are in none of them."""
    points = spark.range(400).select((F.col("id") % 2).alias("w"), F.col("id").alias("q"), (600 + F.col("id") % 7).alias("d"))
    winners = spark.createDataFrame([(0, 1, 600, 512, 1000), (1, 1, 600, 512, 1000)], "w long, bin int, start int, width int, length int")
    found = lines.winner_lines(points, winners, ["w"])
    assert "Range" not in plan(found)
    assert sorted((r.w, r.n, r.span) for r in found.collect()) == [(0, 200, 398), (1, 200, 398)]
