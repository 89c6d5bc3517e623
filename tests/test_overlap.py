"""Overlaps of all pairs against a plain count."""

import numpy as np
import pytest

from strandweave.operators import overlap
from test_operators import brute_seeds


def sequence(text):
    return "".join("T" if c == " " else "ACGT"[(ord(c) - 97) % 4] for c in text)


def texts():
    """A passage that all texts hold, so that its keys occur far oftener than 200 times; copies; short and empty texts."""
    rng = np.random.RandomState(11)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    common = word(120)
    out = [(i, common + word(int(rng.randint(0, 60)))) for i in range(230)]
    other = word(150)
    return out + [(500, other + word(9)), (499, other), (498, other), (503, other), (504, "abc"), (505, "abc"), (506, ""), (507, other[:40])]


@pytest.mark.parametrize("both", [True, False])
@pytest.mark.parametrize("sizes", [(overlap.KEYS, overlap.CELLS), (300, 50)])
def test_overlaps_count_every_key_of_every_pair(spark, both, sizes):
    rows = texts()
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = overlap.overlaps(frame, "id", both=both, block=sizes[0], cells=sizes[1]).collect()
    first = {}
    for i, t in sorted(rows):
        first.setdefault(sequence(t), i)
    keys = {i: {key for _, key, _ in brute_seeds(s)} for s, i in first.items()}
    size = {i: len(t) for i, t in rows}
    want = {(a, b, len(keys[a] & keys[b]), False) for a in keys for b in keys if (size[a], a) < (size[b], b) and len(keys[a] & keys[b]) >= 5}
    want |= {(first[sequence(t)], i, len(keys[first[sequence(t)]]), True) for i, t in rows if first[sequence(t)] != i and len(keys[first[sequence(t)]]) >= 5}
    want |= {(b, a, n, c) for a, b, n, c in want} if both else set()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(not r.copy for r in got) > 20_000 and {(498, 499), (498, 503)} <= {(r.a, r.b) for r in got if r.copy}
