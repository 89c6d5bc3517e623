import random
from fractions import Fraction
from math import floor

from pyspark.sql import functions as F

from strandweave.operators import lines


def brute_line(points, winner):
    """(n, span, slope, intercept, gate) with exact fractions, a seed and a posting at a time."""

    def nearest(window):
        out = {}
        for q, d in sorted(points):
            centre, lo, hi = window(q)
            if lo <= d <= hi and (q not in out or abs(d - centre) < abs(out[q] - centre)):
                out[q] = d
        return list(out.items())

    def fit(pairs):
        n = len(pairs)
        if len({q for q, _ in pairs}) < 2:
            return None
        mq, md = Fraction(sum(q for q, _ in pairs), n), Fraction(sum(d for _, d in pairs), n)
        b = sum((q - mq) * (d - md) for q, d in pairs) / sum((q - mq) ** 2 for q, _ in pairs)
        return mq, md, floor(b * lines.ONE + Fraction(1, 2))

    at = lambda line, q: floor(line[1] + Fraction(line[2], lines.ONE) * (q - line[0]))
    w = max(1, winner["width"])
    first = fit(nearest(lambda q: (winner["start"], (winner["bin"] - 1) * w, (winner["bin"] + 2) * w - 1)))
    if first is None:
        return 0, 0, 0, 0, False
    reach = max(w, 256)
    pairs = nearest(lambda q: (at(first, q), at(first, q) - reach, at(first, q) + reach))
    second = fit(pairs)
    if second is None:
        return 0, 0, 0, 0, False
    off = sorted(d - at(second, q) for q, d in pairs)
    median = off[len(off) // 2]
    trim = max(3 * sorted(abs(x - median) for x in off)[len(off) // 2], 64)
    pairs = [(q, d) for q, d in pairs if abs(d - at(second, q)) <= trim]
    line = fit(pairs)
    if line is None:
        return len(pairs), 0, 0, 0, False
    span = max(pairs)[0] - min(pairs)[0]
    slope = max(lines.LOW, min(lines.HIGH, line[2]))
    gate = len(pairs) >= 8 and 4 * span >= winner["length"] and slope not in (lines.LOW, lines.HIGH)
    return len(pairs), span, slope, at((line[0], line[1], slope), 0), gate


def test_winner_lines_equal_brute_force(spark):
    rng = random.Random(5)
    points, winners = [], []
    for i in range(60):
        start, slope, far = rng.randrange(-500, 10**9), rng.choice([-0.3, -0.05, 0, 0.01, 0.09, 0.3]), rng.choice([3, 900, 40_000])
        width = rng.choice([0, 64, 300])
        for _ in range(rng.choice([0, 1, 2, 5, 12, 60])):
            q = rng.randrange(far)
            for _ in range(rng.choice([1, 1, 3])):
                points.append((i, q, start + int(q * slope) + rng.choice([0, 0, 0, 7, -7, 90, 5000, -260])))
        winners.append((i, start // max(1, width), start, width, rng.choice([100, 4 * far, 30_000])))
    points += points[:30]
    w = spark.createDataFrame(winners, "id long, bin long, start long, width long, length long")
    got = {r.id: (r.n, r.span, r.slope, r.intercept, r.gate) for r in lines.winner_lines(spark.createDataFrame(points, "id long, q long, d long"), w, ["id"]).collect()}
    want = {i: brute_line([p[1:] for p in points if p[0] == i], dict(bin=b, start=s, width=x, length=n)) for i, b, s, x, n in winners}
    assert got == want
    assert len({g[4] for g in got.values()}) == 2 and sum(g[0] > 0 for g in got.values()) > 20
    assert lines.winner_lines(spark.createDataFrame([], "id long, q long, d long"), w.limit(0), ["id"]).collect() == []


def test_shadow(spark):
    w = (1000, 9000, 0, 8000, False)
    cases = {
        (1000, 9000, 0, 8000, False): "yes", (2000, 8000, 1000, 7000, False): "yes", (1500, 9500, 0, 8000, False): "yes",
        (1000, 9000, 0, 8000, True): "yes",  # 10,000 bases read backwards: q 2000 to 10000, 2,000 bases off, as far as the slack
        (6000, 15000, 5000, 14000, False): "no", (-5, 9000, 0, 8000, False): "no", (1000, 1000, 0, 8000, False): "no",
        (1000, 9000, 0, 0, False): "no", (1000, 9000, 5000, 13000, False): "no",
    }
    rows = spark.createDataFrame([(*w, *c) for c in cases], "a long, b long, c long, d long, e boolean, f long, g long, h long, i long, j boolean")
    names = ("r_lo", "r_hi", "q_lo", "q_hi", "reverse")
    of = lambda cs: dict(zip(names, map(F.col, cs), strict=True))
    length = F.lit(10_000)
    found = lines.shadow(of("abcde"), of("fghij"), length, lines.slack(length))
    got = rows.select("f", "g", "h", "i", "j", found["shadow"].alias("s")).collect()
    assert {tuple(r)[:5]: "yes" if r.s else "no" for r in got} == cases
