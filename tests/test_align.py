import random

from strandweave.operators import align


def pair(a, b):
    return -align.AMBIGUOUS if "N" in (a, b) else align.MATCH if a == b else -align.MISMATCH


def brute(q, t):
    """Two-piece affine global score by the plain recurrence over all gap lengths."""
    best = {(0, 0): 0}
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            if i or j:
                options = [best[i - k, j] - int(align.gap_cost(k)) for k in range(1, i + 1)] + [best[i, j - k] - int(align.gap_cost(k)) for k in range(1, j + 1)]
                if i and j:
                    options.append(best[i - 1, j - 1] + pair(q[i - 1], t[j - 1]))
                best[i, j] = max(options)
    return best[len(q), len(t)]


def price(cigar, q, t):
    import re

    total = i = j = 0
    for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)([=XID])", cigar)):
        if op in "=X":
            assert all((q[i + k] == t[j + k] != "N") == (op == "=") for k in range(n))
            total += sum(pair(q[i + k], t[j + k]) for k in range(n))
            i, j = i + n, j + n
        else:
            total -= int(align.gap_cost(n))
            i, j = i + n * (op == "I"), j + n * (op == "D")
    assert (i, j) == (len(q), len(t))
    return total


def test_alignment_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        q = "".join(rng.choice("ACGTN"[: 4 + (rng.random() < 0.2)]) for _ in range(rng.randint(0, 14)))
        t = list(q)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.choice([0, 0, 1, 3])] = [rng.choice("ACGT") for _ in range(rng.choice([0, 1, 2]))]
        t = "".join(t)
        score, cigar = align.align(q, t)
        assert score == brute(q, t) == price(cigar, q, t)
        certain = align.ungapped(q, t)
        assert certain is None or certain == score


def test_replay():
    r = align.replay("2=1X2=1I2=2D2=", "ACGTAGCCAA", "ACTTACCTTAA")
    assert r == {"cs": ":2*tg:2+g:2-tt:2", "md": "2T4^TT2", "nm": 4, "matches": 8}
    assert align.replay("3S4M", "AAAACGT", "ACGT")["cs"] == ":4"
