"""Operators on small made-up inputs."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from strandweave.functions import sequence as sq
from strandweave.operators import chain, intervals, records, seeds, vote


def brute_seeds(seq, k=15, s=5):
    rank = seeds.smer_ranks(s)
    code = lambda x: sum("ACGT".index(c) << 2 * (len(x) - 1 - i) for i, c in enumerate(x))
    rc = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    out = []
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if "N" in w:
            continue
        order = [rank[code(w[j : j + s])] for j in range(k - s + 1)]
        if min(order) in (order[0], order[-1]) and w != rc(w):
            out.append((i, min(code(w), code(rc(w))), int(rc(w) < w)))
    return out


def test_seeds_match_brute_force(spark):
    rng = np.random.RandomState(5)
    texts = ["".join(rng.choice(list("abcdefgh ,"), 300)), "abcd" * 30, "", "short", None, "a" * 40]
    got = seeds.seeds(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()
    for i, t in enumerate(texts):
        seq = "".join("T" if c == " " else "ACGT"[(ord(c) - 97) % 4] if c.isalpha() else "N" for c in t or "")
        assert sorted((r.pos, r.key, r.z) for r in got if r.id == i) == brute_seeds(seq)


def test_key_counts_equal_counted_seeds(spark):
    """Keys are counted in parts of 50 seeds; characters beyond ASCII count once; texts do not run into each other."""
    rng = np.random.RandomState(9)
    rows = [(i, "".join(rng.choice(list("abcdé \U0001f600"), 90))) for i in range(40)] + [(7, "abcd wxyz hgf edcb afgdh jkl" * 3)] * 3 + [(None, "abcd wxyz hgf edcb"), (60, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    want = sorted((r.key, r.n) for r in seeds.seeds(df, "id").groupBy("key").agg(F.count("*").alias("n")).collect())
    assert sorted(map(tuple, seeds.key_counts(df, "id", most=50).collect())) == want and max(n for _, n in want) >= 3
    parts = list(seeds.coded(pa.array([t for _, t in rows]), most=100))
    assert len(parts) > 20 and sum(len(e) - 1 for _, _, e in parts) == len(rows)


def test_chains_of_a_group_that_comes_in_several_batches():
    """Groups are cut by batches anywhere, one of them over four; chains are those of whole groups."""
    names = ["id", "contig", "lane", "d", "r_lo", "r_hi", "q_lo", "q_hi", "n", "weight"]
    runs = pd.DataFrame(random_runs(5, 30) + [(99, 1, 0, 0, 100 * i, 100 * i + 20, 100 * i, 100 * i + 20, 3, 35) for i in range(25)], columns=names).sort_values(["id", "contig", "lane"], kind="stable")
    batches = pa.Table.from_pandas(runs[[*chain.GROUP, *chain.RUN]], preserve_index=False).to_batches(max_chunksize=7)
    got = pd.concat([b.to_pandas() for b in chain._chainer(5000, 500, -1000, 15)(iter(batches))])
    want = pd.concat([chain.chain_group(g, 5000, 500, 15) for _, g in runs.groupby(chain.GROUP)])
    assert len(batches) > 20 and len(got[got.id == 99]) == 1 and got[got.id == 99].n_runs.item() == 25
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want[got.columns].to_numpy().tolist()))


def test_smer_ranks_do_not_depend_on_strand():
    rank = seeds.smer_ranks(3)
    for code in range(64):
        other = sum((3 - (code >> 2 * j & 3)) << 2 * (2 - j) for j in range(3))
        assert rank[code] == rank[other]


def test_suppression_keeps_the_better_peak(spark):
    rows = [(1, 0, 7, 10, 5, 0, 9, 1), (1, 0, 7, 11, 4, 0, 8, 2), (1, 0, 7, 20, 4, 0, 8, 3), (1, 0, 8, 11, 4, 0, 7, 4)]
    peaks = spark.createDataFrame(rows, "id long, lane int, contig long, bin long, support long, start int, score long, rank int")
    assert sorted(r["rank"] for r in vote.suppressed(peaks).collect()) == [1, 3, 4]


def test_range_join_equals_a_nested_loop(spark):
    rng = np.random.RandomState(1)
    p = pd.DataFrame({"k": rng.randint(0, 3, 200), "x": rng.randint(-50, 50, 200), "p": range(200)})
    w = pd.DataFrame({"k": rng.randint(0, 3, 60), "lo": rng.randint(-60, 50, 60), "w": range(60)})
    w["hi"] = w.lo + rng.randint(0, 30, 60)
    got = intervals.range_join(spark.createDataFrame(p), spark.createDataFrame(w), ["k"], "x", "lo", "hi", 10).select("p", "w").collect()
    want = p.merge(w, on="k").query("lo <= x < hi")
    assert sorted(map(tuple, got)) == sorted(zip(want.p, want.w, strict=True))


def test_range_join_of_fractions(spark):
    """Points in the bin of a window's end, less than one under it."""
    p = pd.DataFrame({"k": 1, "x": [199.5, 200.0, 200.25, 200.5, -0.25, 10.0]})
    w = pd.DataFrame({"k": 1, "lo": [0.5, -199.75], "hi": [200.5, 0.25]})
    got = intervals.range_join(spark.createDataFrame(p), spark.createDataFrame(w), ["k"], "x", "lo", "hi", 200).select("x", "lo").collect()
    assert sorted(map(tuple, got)) == [(-0.25, -199.75), (10.0, 0.5), (199.5, 0.5), (200.0, 0.5), (200.25, 0.5)]


def test_merge_and_complement(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 3, 9), ("a", 20, 25), ("b", 1, 2)], "g string, lo long, hi long")
    merged = intervals.merged(rows, ["g"])
    assert sorted((r.g, r.lo, r.hi, r.members) for r in merged.collect()) == [("a", 0, 9, 2), ("a", 20, 25, 1), ("b", 1, 2, 1)]
    gaps = intervals.complement(merged, ["g"], "lo", "hi", F.lit(0), F.lit(30))
    assert sorted((r.g, r.lo, r.hi) for r in gaps.collect()) == [("a", 9, 20), ("a", 25, 30), ("b", 0, 1), ("b", 2, 30)]


def test_chain_prefers_the_collinear_runs():
    runs = pd.DataFrame({"id": 1, "contig": 2, "lane": 0, "r_lo": [0, 100, 5000], "r_hi": [40, 140, 5010], "q_lo": [0, 102, 50], "q_hi": [40, 142, 60], "n": [5, 5, 2], "weight": [55, 55, 25]})
    out = chain.chain_group(runs, 1000, 100, 15).sort_values("score", ascending=False)
    assert out.iloc[0].n_runs == 2 and (out.iloc[0].q_lo, out.iloc[0].q_hi) == (0, 157)
    assert out.n_runs.sum() == 3


def random_runs(seed, groups):
    """Runs of several groups, some of them too light for any chain."""
    rng = np.random.RandomState(seed)
    rows = []
    for g in range(groups):
        for _ in range(rng.randint(1, 9)):
            r, size = int(rng.randint(0, 900)), int(rng.randint(0, 30))
            d = int(rng.choice([0, 0, 3, 20, 200]))
            rows.append((g // 3, g % 3, g % 2, d, r, r + size, r - d, r - d + size, size // 5 + 1, size + 15))
    return list({(x[0], x[1], x[2], x[4], x[6]): x for x in rows}.values())


def brute_best(runs, reach=5000, band=500):
    """The best chain score of one group, by the definition: over all predecessors of each run, without any bound."""
    import functools
    import math

    @functools.lru_cache(None)
    def score(x):
        best = x[9]
        for y in runs:
            dr, dq = x[5] - y[5], x[7] - y[7]
            dd = abs(dr - dq)
            if y != x and dr > 0 and dq > 0 and x[4] >= y[4] and x[6] >= y[6] and x[4] - y[5] <= reach and x[6] - y[7] <= reach and dd <= band:
                best = max(best, score(y) + math.floor(min(x[9], min(dr, dq)) - (0.168 * dd + 0.5 * math.log2(dd + 1) if dd else 0)))
        return best

    return max(score(x) for x in runs)


def test_chains_of_groups_equal_brute_force(spark):
    """The best chain of every group that reaches the floor, and no chain of any other group."""
    rows = random_runs(3, 60)
    dense = spark.createDataFrame(rows, "id long, contig long, lane int, d int, r_lo int, r_hi int, q_lo int, q_hi int, n long, weight int")
    found = chain.chains(dense, least=60).groupBy("id", "contig", "lane").agg(F.max("score").alias("score")).collect()
    want = {}
    for key in {x[:3] for x in rows}:
        best = brute_best(tuple(x for x in rows if x[:3] == key))
        if best >= 60:
            want[key] = best
    assert 5 < len(want) < len({x[:3] for x in rows})
    assert {(r.id, r.contig, r.lane): r.score for r in found} == want


def test_owners_equal_a_plain_walk(spark):
    rng = np.random.RandomState(8)
    rows = []
    for i in range(12):
        for c in range(rng.randint(1, 8)):
            lo = int(rng.randint(0, 200))
            rows.append((i, c, 0, 0, float(rng.randint(40, 60)), 1, 3, 20, lo, lo + int(rng.randint(20, 120)), lo, lo + 50, 400))
    names = [f.split()[0] for f in chain.CHAINS.split(", ")] + ["length"]
    got = chain.owners(spark.createDataFrame(rows, f"{chain.CHAINS}, length int")).collect()
    for i in range(12):
        own = sorted((dict(zip(names, r, strict=True)) for r in rows if r[0] == i), key=lambda r: (-r["score"], r["contig"], r["r_lo"], r["lane"], r["q_lo"]))
        parent, second, rivals = {}, {}, {}
        for k, r in enumerate(own):
            parent[k] = k
            for o in range(k):
                p = own[o]
                if parent[o] == o and min(r["q_hi"], p["q_hi"]) - max(r["q_lo"], p["q_lo"]) > 0.5 * min(r["q_hi"] - r["q_lo"], p["q_hi"] - p["q_lo"]):
                    parent[k] = o
                    second[o], rivals[o] = max(second.get(o, 0), r["score"]), rivals.get(o, 0) + (r["score"] >= 0.8 * p["score"])
                    break
        for r in (r for r in got if r.id == i):
            assert own[r["rank"]]["contig"] == r.contig and (r.parent, r.f2, r.n_sub) == (parent[r["rank"]], second.get(r["rank"], 0), rivals.get(r["rank"], 0))


def test_numbers_by_range_and_budgets(spark):
    from strandweave.operators import ordering

    rows = [(f"n{i % 37:02d}", i) for i in range(500)]
    got = ordering.numbered(spark.createDataFrame(rows, "name string, i int"), "at", ["name", "i"]).collect()
    assert [(r.name, r.i) for r in sorted(got, key=lambda r: r.at)] == sorted(rows) and sorted(r.at for r in got) == list(range(500))
    lengths = [3, 9, 30, 1, 1, 8, 2]
    one = spark.createDataFrame([(lengths,)], "x array<bigint>").select(ordering.budgeted(F.col("x"), 10, True).alias("a"), ordering.budgeted(F.col("x"), 10, False).alias("b")).first()
    assert one.a == [0, 0, 1, 2, 2, 2, 3] and one.b == [0, 1, 2, 3, 3, 3, 4]


def test_hashes_against_plain_integers(spark):
    from strandweave.functions import hashes

    def split(x):
        x = (x + hashes.SPLIT_STEP) % 2**64
        x = (x ^ x >> 30) * hashes.SPLIT[0] % 2**64
        x = (x ^ x >> 27) * hashes.SPLIT[1] % 2**64
        return x ^ x >> 31

    some = np.array([0, 1, 12345, 2**40 + 7, 2**63, 2**64 - 1], dtype=np.uint64)
    assert hashes.split_mix(some).tolist() == [split(int(x)) for x in some]
    keys = np.arange(1 << 12, dtype=np.uint64)
    assert len(np.unique(hashes.shard_mix(keys, 12))) == 1 << 12  # one to one
    x = np.float32(2.0) ** np.arange(1, 20, dtype=np.float32) * np.float32(1.3)
    assert np.abs(hashes.log2_bits(x) - np.log2(x)).max() < 0.01


def test_cigar_functions(spark):
    row = spark.createDataFrame([("5S10M2I3D7M4S",)], "c string")
    a = row.select(records.accounted(F.col("c")).alias("a")).select("a.*").first()
    assert (a.query_span, a.target_span, a.block_len, a.gap_bases, a.gap_opens, a.clipped) == (19, 20, 22, 5, 2, 9)
    b = row.select(records.strip_clips(F.col("c")), records.hard_clip(F.col("c"))).first()
    assert tuple(b) == ("10M2I3D7M", "5H10M2I3D7M4H")
    m = spark.createDataFrame([("3=2=1X4=",)], "c string")
    assert m.select(records.merged_runs(F.col("c"))).first()[0] == "5=1X4="
    assert m.select(records.max_segment(records.cigar_ops(F.col("c")))).first()[0] == 10


def test_many_cigars_are_accounted_together(spark):
    """Rows do not run into each other; what is no operation is passed over; no CIGAR has no sums. No fold a row."""
    rows = [(0, "5S10M"), (1, None), (2, "12"), (3, "3M*7"), (4, ""), (5, "12Q5=2X1N6H"), (6, "MM7I100000D"), (7, "1é2D")]
    found = spark.createDataFrame(rows, "i int, c string").coalesce(1).select("i", records.accounted(F.col("c")).alias("a"))
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: None if r.a is None else tuple(r.a) for r in found.collect()}
    zero = (0,) * 7
    assert got == {0: (10, 10, 10, 10, 0, 0, 5), 1: None, 2: zero, 3: (3, 3, 3, 3, 0, 0, 0), 4: zero, 5: (7, 8, 7, 5, 0, 0, 6), 6: (7, 100000, 100007, 0, 100007, 2, 0), 7: (0, 2, 2, 0, 2, 1, 0)}


def test_paf_leaves_null_tags_out(spark):
    one = spark.range(1)
    line = records.paf_line(F.lit("r 1"), F.lit(10), F.lit(0), F.lit(5), F.lit(True), F.lit("c"), F.lit(99), F.lit(1), F.lit(6), F.lit(5), F.lit(5), F.lit(60), [records.tag("tp", "A", F.lit("P")), records.tag("s2", "i", F.lit(None).cast("int"))])
    assert one.select(line).first()[0] == "r 1\t10\t0\t5\t-\tc\t99\t1\t6\t5\t5\t60\ttp:A:P"


def test_saturating_cast(spark):
    df = spark.createDataFrame([(1e30,), (-1e30,), (float("nan"),), (-2.9,)], "x double")
    assert [r[0] for r in df.select(sq.saturate(F.col("x"))).collect()] == [2147483647, -2147483648, 0, -2]
