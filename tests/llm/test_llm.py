"""Operators of the training-data subpackage against brute force, exact round trips and the tokenizer libraries."""

import collections
import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave import session
from strandweave.llm import bpe, exact_dedup, fingerprint, graph, html_extract, lm_score, mixing, near_dedup, passage_dedup, quality, text, token_count, vocab

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASES = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "de", "b", 3), (5, "One", None, "b", 3), (5, "One", None, "b", 3), (None, "no id here at all", "en", "b", 1), (7, "é ß 中文 ́x", "en", "é", 9)]


def docs(spark, rows):
    """A table with clashing extra columns."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit(1), "key": F.lit("k"), "size": F.lit(0), "rid": F.lit(3), "label": F.lit("x")})


def words(x):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def shingle_set(x):
    w = words(x)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def corpus(seed=1, groups=12):
    """Texts with exact copies, near copies at many distances, and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out, shared = [], say(30)
    for g in range(groups):
        base = say(rng.randint(40, 160))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if g % 3 == 0:
                w += shared
            out.append(" ".join(w))
    rng.shuffle(out)
    return [(1000 + i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("rows", [CASES, corpus()])
def test_near_duplicates_equal_brute_force(spark, rows):
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    sets = {r[0]: shingle_set(r[1]) for r in rows if r[0] is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_verified_blocks_give_what_all_pairs_give():
    rng = np.random.RandomState(3)
    base = rng.randint(0, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.rand(60) < 0.05, rng.randint(0, 1 << 40, 60).astype(np.uint64), base)) for _ in range(25)]
    want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    got = near_dedup.common(sets)
    shared = np.array(want, dtype=float)
    np.fill_diagonal(shared, 0)
    np.fill_diagonal(got, 0)
    assert (got == shared).all()
    part = near_dedup.common(sets, np.array([3, 7]))
    part[[0, 1], [3, 7]] = 0
    assert (part == shared[[3, 7]]).all()


def near_group(n, seed=5, chained=False):
    """Sets (label, rid, shs): near copies of one set, or a chain in which only neighbours are similar, and another label."""
    rng = np.random.RandomState(seed)
    base = rng.randint(0, 1 << 60, 80 + (n if chained else 0)).astype(np.uint64)
    rows = []
    for i in range(n):
        own = base[i : i + 80].copy() if chained else base.copy()
        if not chained:
            own[rng.randint(0, 80, 3)] = rng.randint(0, 1 << 60, 3)
        rows.append((7, int(i), bytearray(np.unique(own).tobytes())))
    rows += [(8, 10**6 + i, bytearray(np.unique(rng.randint(0, 1 << 60, 80).astype(np.uint64)).tobytes())) for i in range(5)]
    return rows


def joined(rows, percent):
    sets = {r[1]: (r[0], set(np.frombuffer(bytes(r[2]), np.uint64).tolist())) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a][1] & sets[b][1])
            if sets[a][0] == sets[b][0] and both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    alone = collections.Counter(find(i) for i in ids)
    return {i: find(i) for i in ids if alone[find(i)] > 1}


@pytest.mark.parametrize("local", [0, 50_000])
def test_components(spark, monkeypatch, local):
    """In one task or in rounds, and with links that come later: the smallest node that can be reached."""
    monkeypatch.setattr(graph, "LOCAL", local)
    rng = random.Random(21)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    more = [(rng.randrange(200), rng.randrange(250)) for _ in range(25)] + [(310, 5), (700, 701)]

    def brute(edges):
        label = {x: x for e in edges if e[0] != e[1] for x in e}
        while True:
            before = dict(label)
            for a, b in edges:
                if a != b:
                    label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    table = lambda x: spark.createDataFrame(x, "a long, b long")
    found = graph.components(table(links))
    assert {r.node: r.label for r in found.collect()} == brute(links)
    after = {r.node: r.label for r in graph.extended(found, table(more)).collect()}
    assert {k: v for k, v in after.items() if k in brute(links + more)} == brute(links + more)
    assert graph.components(table([])).count() == 0


def test_components_rename_the_nodes_once_not_in_each_round(spark, monkeypatch):
    """Of the tables written, three have a row a node (parents, their parents, labels), however many rounds there are."""
    monkeypatch.setattr(graph, "LOCAL", 0)
    written, plain, n = [], graph.cut, 200
    monkeypatch.setattr(graph, "cut", lambda df: (lambda out: (written.append(out.count()), out)[1])(plain(df)))
    at = random.Random(5).sample(range(n), n)
    links = spark.createDataFrame(list(zip(at, at[1:], strict=False)), "a long, b long")
    assert {(r.node, r.label) for r in graph.components(links).collect()} == {(i, 0) for i in range(n)}
    assert sum(x >= n for x in written) == 3, written


@pytest.mark.parametrize("chained", [False, True])
def test_large_components_equal_brute_force(spark, monkeypatch, chained):
    monkeypatch.setattr(near_dedup, "SETS", 16)
    rows = near_group(180, chained=chained)
    got = near_dedup.confirmed(spark.createDataFrame(rows, "label long, rid long, shs binary"), 85)
    assert {r.node: r.label for r in got.collect()} == joined(rows, 85)


def test_rows_dealt_grow_with_the_group_not_its_square(spark, monkeypatch):
    """Near copies are dealt about once, twice as many rows for a group twice as large."""
    monkeypatch.setattr(near_dedup, "SETS", 64)
    counts, plain = [], near_dedup.in_blocks
    monkeypatch.setattr(near_dedup, "in_blocks", lambda *a: (lambda df: (counts.append(df.count()), df)[1])(plain(*a)))
    total = []
    for n in (2_000, 4_000):
        counts.clear()
        labels = near_dedup.confirmed(spark.createDataFrame(near_group(n), "label long, rid long, shs binary"), 80)
        assert labels.groupBy("label").count().collect()[0]["count"] == n
        total.append(sum(counts))
    assert total[0] < 2_000 * 1.6 and total[1] < 2.2 * total[0], total


def test_empty_tables(spark):
    empty = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = vocab.path_of(vocab.WORD_BPE)
    for df in (near_dedup.near_duplicates(empty), exact_dedup.exact_classes(empty), mixing.taken(empty), bpe.digests(empty, path), token_count.token_counts(empty, path), quality.quality(empty, labels), fingerprint.fingerprints(empty), html_extract.extract(pages), passage_dedup.repeats(empty), lm_score.lm_scores(empty, vocab.path_of(vocab.PIECES))):
        assert df.count() == 0


def test_long_texts_pass_whole(spark):
    """Texts of megabytes, with and without white space, beside short ones, through all operators."""
    rng = random.Random(33)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    spaced = " ".join(rng.choice(vocabulary) for _ in range(400_000))
    solid = "".join(rng.choice(vocabulary) for _ in range(40_000))
    rows = [(1, spaced, "en", "a", 0), (2, solid, "en", "a", 0), (3, spaced + " x", "en", "b", 0), (4, "short one", "en", "b", 0), (5, solid, "de", "b", 0)]
    table, path = docs(spark, rows).repartition(2), vocab.path_of(vocab.WORD_BPE)
    of = lambda df, c: {r.doc_id: r[c] for r in df.collect()}
    near = of(near_dedup.near_duplicates(table), "component_id")
    assert near == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2}
    assert of(exact_dedup.exact_classes(table), "keep_id") == {1: 1, 2: 5, 3: 3, 4: 4, 5: 5}
    assert of(mixing.taken(table), "size")[1] == 400_000
    lib = library()
    counts = {r[0]: len(lib.encode(r[1], add_special_tokens=False).ids) for r in rows}
    assert of(token_count.token_counts(table, path), "n_tokens") == of(bpe.digests(table, path), "n_tokens") == counts
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= x <= 1 for x in of(quality.quality(table, labels), "score").values())
    prints = of(fingerprint.fingerprints(table), "near_next")
    assert len(prints) == 5 and all(0 <= x <= 1 for x in prints.values())
    assert {r.doc_id for r in passage_dedup.repeats(table).collect()} == {1, 3}
    scores = of(lm_score.lm_scores(table, vocab.path_of(vocab.PIECES)), "score")
    assert len(scores) == 5 and all(math.isfinite(x) and x < 0 for x in scores.values()) and scores[2] == scores[5]
    page = lambda body: (1, "http://a.org/1", f"<html><nav>menu</nav><article><p>{body}</p></article></html>")
    pages = spark.createDataFrame([page(spaced), page(solid), page("&amp;" * 100_000)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_extract.extract(pages).collect()) == sorted([len(spaced), len(solid), 100_000])


def test_exact_classes_and_index(spark):
    rows = CASES + [(20 + i, "copy", "en", "a", 4) for i in range(50)]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    for r in exact_dedup.exact_classes(docs(spark, rows)).collect():
        (t,) = [t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in groups[t]]
        top = max((x for x in groups[t] if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (top, len(groups[t]), r.doc_id == top)
    index = exact_dedup.DigestIndex(spark, "test_digests", buckets=3)
    first = exact_dedup.filter_new(docs(spark, rows), index)
    assert sorted(r.text or "" for r in first.collect()) == sorted(groups)
    again = exact_dedup.filter_new(docs(spark, [(900, "copy", "", "", 0), (901, "new", "", "", 0), (902, "new", "", "", 0)]), index).collect()
    assert [(r.doc_id, r.text, r.rid) for r in again] == [(902, "new", 3)]
    assert index.table().count() == len(groups) + 1
    index.drop()
    # The registered form takes one table in as two batches: digests of the second that the first holds are not added again.
    taken = exact_dedup.DigestIndex.temporary(spark)
    newer, older = exact_dedup.newest_first(docs(spark, rows))
    assert newer.count() and older.count() and newer.count() + older.count() == len(rows)
    taken.add(newer)
    before = taken.table().count()
    plan = taken.fresh(older)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan
    taken.add(older)
    assert before < taken.table().count() == len(groups)
    assert sorted(map(str, exact_dedup.exact_unique(docs(spark, rows).withColumnRenamed("key", "text_sha256")).select("doc_id").collect())) == sorted(f"Row(doc_id={max((x for x in g if x is not None), default=None)})" for g in groups.values())


def test_mixing_targets_and_copies(spark):
    rng = random.Random(2)
    rows = CASES + [(100 + i, "w " * rng.randint(1, 60), "en", rng.choice(["a", "a", "a", "b", "é", None, "z"]), 0) for i in range(600)]
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:  # share by weight, hold at the cap, share the rest again
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    got = mixing.taken(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    total = collections.Counter()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, target[s]) and 0 <= r.taken <= 2 * r["size"]
        total[s] += r.taken
    for s in size:
        assert abs(total[s] - target[s]) <= 0.35 * target[s] + 120
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs(spark, rows)).collect()), key=str)
    emitted = collections.Counter(r.doc_id for r in mixing.emit(docs(spark, rows)).collect())
    assert emitted[150] in (0, 1, 2)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.path_of(vocab.WORD_BPE))


def odd_texts(n=400):
    rng = random.Random(4)
    alphabet = [chr(c) for c in (*range(1, 128), 0x85, 0xA0, 0xB2, 0xE9, 0x301, 0x130, 0x3A3, 0x3C2, 0x4E2D, 0xAC00, 0x1F600, 0x200D, 0x2028, 0x3000, 0x660, 0x212B)]
    out = ["", "a" * 300, "ab" * 200, "<|endoftext|>x<|startoftext|>", "it's we'll I'M"]
    for _ in range(n):
        out.append("".join(rng.choice(alphabet) if rng.random() < 0.5 else rng.choice("aabeinst th'") for _ in range(rng.randint(0, 60))))
    return out


def test_bpe_equals_the_library(spark):
    path, lib = vocab.path_of(vocab.WORD_BPE), library()
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([None, *odd_texts()])]
    encoded = bpe.decode(bpe.encode(docs(spark, rows), path), path).collect()
    short = {r.doc_id: r for r in bpe.digests(docs(spark, rows), path).collect()}
    for r in encoded:
        ids = lib.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        body = lib.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), body)
        assert r.ids_sha256 == short[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == short[r.doc_id].decoded_sha256 == hashlib.sha256(body.encode()).hexdigest()


def test_token_counts_equal_the_library_in_chunks():
    lib = library()
    counter = token_count.Counter(open(vocab.path_of(vocab.WORD_BPE), "rb").read(), huge=100, chunk=120, overlap=10)
    texts = [t + " " + u for t, u in zip(odd_texts(), odd_texts()[::-1], strict=True)] + ["x" * 2000, "word " * 500, " " * 900, "", "a b" * 300]
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [counter.by_chunks(t) for t in texts] == want
    assert counter.counts(pa.array([*texts, None]))[1] == [*want, 0]
    assert counter.widened > 0


def test_token_counts_of_long_texts_do_not_cost_the_square(monkeypatch):
    """Without white space the chunk doubles: all that is encoded stays within a few times the text."""
    lib = library()
    counter = token_count.Counter(open(vocab.path_of(vocab.WORD_BPE), "rb").read())
    encoded = []
    plain = counter._encode
    counter._encode = lambda t, a, b: (encoded.append(b - a), plain(t, a, b))[1]
    rng = random.Random(3)
    for n in (32_767, 32_768, 32_769, 200_000):
        for t in ("".join(rng.choice("abcdefg") for _ in range(n)), "".join(rng.choice("abcdefg ") for _ in range(n)), "ab " * 40 + "x" * n):
            encoded.clear()
            want = len(lib.encode(t, add_special_tokens=False).ids)
            assert counter.counts(pa.array([t]))[1] == [want] and counter.by_chunks(t) == want
            assert sum(encoded) <= 10 * len(t)


def test_quality_learns_from_its_folds_only(spark):
    rng = random.Random(9)
    rows, labels = list(CASES), []
    for i in range(100, 700):
        good = rng.random() < 0.8
        body = " ".join(rng.choice(["the", "river", "and", "stone", "was", "old"]) + str(rng.choice(["", "", ","])) for _ in range(60)).capitalize() + "."
        rows.append((i, body if good else " ".join(w.upper() + "!!" for w in body.split()), "en", "s", 0))
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(good) if not held else 1 - int(good), 0))  # wrong where they must not be used
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality(docs(spark, rows), table).collect()
    assert len(got) == len(rows)
    truth = {i: int(q) if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - q for i, q, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    seen = [(r.predicted == truth[r.doc_id]) for r in got if r.doc_id in truth]
    assert np.mean(seen) > 0.97
    none = quality.quality(docs(spark, rows), table.where("quality = 0")).collect()
    assert {r.score for r in none} == {0.0}


def test_quality_risk_equals_its_formula_and_prior_is_found():
    """The step's gradient is that of the stated risk; the prior comes out of positives and unlabelled rows alone."""
    rng = np.random.RandomState(4)
    make = lambda n, up: np.hstack([rng.randn(n, 3) + (2.5 if up else -2.5), rng.randn(n, 20) * 0.1, np.zeros((n, quality.WIDTH - 23))]).astype(np.float32)
    for prior in (0.3, 0.7):
        unl = np.vstack([make(int(3000 * prior), True), make(int(3000 * (1 - prior)), False)])
        model = quality.learn(make(800, True), unl)
        assert abs(model.prior - prior) < 0.06
        assert np.mean(model.score(make(500, True)) >= 0.5) > 0.97 and np.mean(model.score(make(500, False)) < 0.5) > 0.97
    pos, unl, prior = make(50, True), make(80, False), 0.4
    first = quality.train(pos, unl, prior, steps=1, rate=1.0, decay=0.0)
    mean, scale = unl.mean(axis=0), 1 / (unl.std(axis=0) + 0.02)
    p, u = (np.hstack([(x - mean) * scale, np.ones((len(x), 1))]) for x in (pos, unl))

    def risk(w):
        loss = lambda z: np.logaddexp(0, -z).mean()
        return prior * loss(p @ w) + max(0.0, loss(-(u @ w)) - prior * loss(-(p @ w)))

    w0 = np.zeros(p.shape[1])
    assert (first.weight == 0).all()  # the best of one step is the start
    second = quality.train(pos, unl, prior, steps=2, rate=1e-3, decay=0.0)
    assert risk(second.weight.astype(np.float64)) < risk(w0)
    grad = np.array([(risk(w0 + e) - risk(w0 - e)) / 2e-5 for e in np.eye(len(w0))[:6] * 1e-5])
    assert (np.sign(second.weight[:6]) == -np.sign(grad)).all()


def test_lm_scores(spark):
    rows = corpus(3, 4) + CASES
    got = {r.doc_id: r for r in lm_score.lm_scores(docs(spark, rows), vocab.path_of(vocab.PIECES)).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count, n_texts = collections.Counter(), 0
    for r in rows:
        if not held(r[0]):
            count.update(words(r[1]))
            n_texts += 1
    n, v = sum(count.values()) + n_texts, len(count) + 1
    for r in rows:
        if r[0] is None:
            continue
        w = words(r[1])
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((n_texts + 1) / (n + v + 1))
        g = got[r[0]]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r[0]), len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
        assert math.isclose(g.base_score, base, rel_tol=1e-9) and g.score < 0 and math.isfinite(g.score)


def test_lattice_sums_all_segmentations_and_is_a_distribution(monkeypatch):
    lattice = lm_score.Lattice.build(open(vocab.path_of(vocab.PIECES), "rb").read())
    weight = {int(h): (f, s) for h, f, s in zip(lattice.hashes, lattice.first[0], lattice.later[0], strict=True)}

    def brute(word):
        full = "▁" + word

        def after(at):
            if at == len(full):
                return float(lattice.stop[0])
            total = 0.0
            for end in range(at + 1, min(len(full), at + lattice.widest) + 1):
                h = int(lm_score._span_hash(np.array([ord(c) for c in full[at:end]]))[0])
                p = math.exp(weight[h][at > 0]) if h in weight else 0.0
                if at and end == at + 1:
                    p += lm_score.FALLBACK / 256 ** len(full[at].encode())
                total += p * (1 - float(lattice.stop[0]) if at else 1.0) * after(end)
            return total

        return math.log(after(0))

    some = ["a", "the", "thing", "zqxj", "été", "中"]
    assert np.allclose(lattice.score(some)[0], [brute(w) for w in some])
    assert np.exp(lattice.first[0]).sum() == pytest.approx(1) and np.exp(lattice.later[0]).sum() == pytest.approx(1 - lm_score.FALLBACK)
    seen = np.zeros((2, len(lattice.hashes)))
    lattice.expect(some, seen)
    assert seen[0].sum() == pytest.approx(len(some))
    # Long words go another way, whose sums and expected numbers are the same.
    monkeypatch.setattr(lm_score, "LONG_WORD", 3)
    monkeypatch.setattr(lm_score, "BLOCK", 2)
    assert np.allclose(lattice.score(some)[0], [brute(w) for w in some])
    far = np.zeros_like(seen)
    lattice.expect(some, far)
    assert np.allclose(far, seen)


def test_scores_of_documents_equal_brute_force_over_whole_lattices(spark):
    """Pieces, whole words, classes and ends put together again in plain Python, with a word of many characters."""
    rows = corpus(3, 3) + CASES + [(400, "ab" * 300 + " one", "fr", "s", 0), (401, "one deux deux", "fr", "s", 0), (402, "deux " + "中" * 70, "fr", "s", 0)]
    table, path = docs(spark, rows), vocab.path_of(vocab.PIECES)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts, stats, lattice = lm_score.fit(table, path, lm_score.in_fold("doc_id", 7, 2))
    train = [r for r in rows if not held(r[0])]
    by_lang = collections.Counter(r[2] for r in train)
    order = sorted(by_lang, key=lambda x: (-by_lang[x], x is not None, x or ""))
    assert len(order) == len(lattice.stop) <= lm_score.CLASSES
    own = [collections.Counter(w for r in train if r[2] == x for w in words(r[1])) for x in order]
    both = sum(own, collections.Counter())
    pieces = lambda w: np.exp(lattice.score([w])[:, 0])  # noqa: E731  tested above
    d, shared = stats.discount, lm_score.SHARED
    got = {r.doc_id: r.score for r in lm_score.lm_scores(table, path).collect()}
    for r in rows[::9] + rows[-12:]:
        logs = []
        for z, x in enumerate(order):
            n = sum(own[z].values()) + by_lang[x]
            total = math.log10(by_lang[x] / len(train)) + math.log10(by_lang[x] / n)
            for w in words(r[1]):
                free = max(d * len(own[z]) / n, 1e-9)
                total += math.log10(max(own[z][w] - d, 0) / n + free * (shared * both[w] / sum(both.values()) + (1 - shared) * pieces(w)[z]))
            logs.append(total)
        want = max(logs) + math.log10(sum(10 ** (x - max(logs)) for x in logs))
        assert math.isclose(got[r[0]], want, rel_tol=1e-9), r[0]


def test_fingerprints(spark):
    rows = corpus(5, 3) + [r for r in CASES if r[0] != 5] + [(5, "One", "", "", 3)]
    got = fingerprint.fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_id = {r.doc_id: r for r in got}
    bag = lambda x: collections.Counter(tuple(words(x)[i : i + 5]) for i in range(len(words(x)) - 4)) if len(words(x)) > 4 else collections.Counter([tuple(words(x))] if words(x) else [])
    like = lambda a, b: sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0
    errors = []
    for i, r in enumerate(ordered):
        own, following = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        changed = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        g = by_id[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
        errors += [g.near_edited - like(bag(own), bag(changed)), g.near_next - like(bag(own), bag(following))]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.08
    assert by_id[2].fingerprint == by_id[3].fingerprint == "" and len({r.fingerprint for r in got if r.n_chars > 50}) > 10


PAGE = '<html><head><title>no</title><script>if(a<b){"<p>"}</script></head><body><nav><a href="x">{nav}</a></nav><div class="cookie-notice">we use cookies here on this site now</div>{body}<footer>f</footer><div id="comments">said a reader</div></body></html>'


def test_html_main_text(spark):
    plain = lambda nav, body: PAGE.replace("{nav}", nav).replace("{body}", body)
    notice = "<div>subscribe to our site for more of these long texts every day</div>"
    rows = [
        (1, "http://a.org/1", plain("m", "<article><h1>T &amp; U</h1><p><b>one\n two<br>three<p>four&nbsp;five</article>")),
        (2, "http://b.org/1", plain("m", notice + "<p>the first unique text of page two is here</p>")),
        (3, "http://b.org/2", plain("m", notice + "<p>another quite different body of text for page three</p>")),
        (4, "http://c.org/1", None),
        (5, None, ""),
        (6, "nonsense", "<p>unclosed <i>tail"),
        (6, "nonsense", "<p>unclosed <i>tail"),
    ]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect())
    want = [(1, "T & U\none two three\nfour five"), (2, "the first unique text of page two is here"), (3, "another quite different body of text for page three"), (4, ""), (5, ""), (6, "unclosed tail"), (6, "unclosed tail")]
    assert got == [(i, t, len(t)) for i, t in want]


def test_repeated_runs_equal_brute_force():
    rng = np.random.RandomState(8)
    for _ in range(30):
        pages = [rng.randint(0, 4, rng.randint(0, 40)).astype(np.uint64) for _ in range(4)]
        for run in (2, 3, 5):
            seen = collections.defaultdict(set)
            for i, p in enumerate(pages):
                for a in range(len(p) - run + 1):
                    seen[tuple(p[a : a + run])].add(i)
            for i, (p, c) in enumerate(zip(pages, html_extract.repeated(pages, run), strict=True)):
                want = np.zeros(len(p), bool)
                for a in range(len(p) - run + 1):
                    if len(seen[tuple(p[a : a + run])]) > 1:
                        want[a : a + run] = True
                assert (want == c).all(), (i, run)


def test_html_malformed_quotes_and_names_inside_the_article():
    read = lambda page: html_extract.main_texts([html_extract.blocks(page)])[0]
    assert read('<article><p title="x>hello</p><p>there</p></article>') == "hello\nthere"
    assert read("<p class='a>one</p><p>two") == "one\ntwo"
    assert read('<p title="a > b">kept</p>') == "kept"
    assert read('<article><div class="related-work">prior art</div><section class="comment-policy">be kind</section><div class="comment-list">no</div><p>x</p></article>') == "prior art\nbe kind\nx"


def test_html_repetition_does_not_depend_on_parts(spark, monkeypatch):
    """A host dealt over many parts gives what one suffix array over all its pages gives."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    menu, notices = say(9), [say(12) for _ in range(12)]
    rows = []
    for i in range(60):
        own = f"<p>{say(20)}</p>"
        notice = f"<div>{notices[i % 12]}</div>" if i < 24 else ""  # each on two pages only
        shown = f"<div>{menu}</div>{notice}{own}<p>{say(3)}</p>"
        rows.append((i, f"http://h.org/{i}", f"<article>{shown}</article>" if i % 10 == 7 else f"<nav>{notices[i % 12]}</nav>{own}" if i in (30, 31) else shown))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = html_extract.main_texts([html_extract.blocks(r[2]) for r in rows])
    assert sum(n in t for n in notices for t in one) <= 4  # those inside articles
    want = {r[0]: t for r, t in zip(rows, one, strict=True)}
    for group in (256, 7, 1):
        monkeypatch.setattr(html_extract, "GROUP", group)
        assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want


def test_html_repetition_decides_inside_articles(spark, monkeypatch):
    """What a host puts into most of its articles goes; what a few articles share, and copies of an article, stay."""
    rng = random.Random(32)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    frame, passage, copied, rows, want = say(12), say(30), say(60), [], {}
    for host, n in (("h", 30), ("few", 3), ("copies", 12)):
        for i in range(n):
            own = copied if host == "copies" else say(40)
            shared = [passage] if host == "h" and i < 9 else []
            noted = [frame] if host == "few" or host == "h" and i % 5 else []
            rows.append((len(rows), f"http://{host}.org/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in [own, *noted, *shared]) + "</article>"))
            want[rows[-1][0]] = "\n".join([own, *([] if host == "h" else noted), *shared])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (256, 7):
        monkeypatch.setattr(html_extract, "GROUP", group)
        assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want


def test_passages(spark):
    rng = random.Random(6)
    sentence = lambda: (" ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(11)) + ".").capitalize()
    passage = [sentence() for _ in range(6)]
    near = [s if i != 3 else " ".join(s.split()[:-1]) + " changed." for i, s in enumerate(passage)]
    line = sentence()
    bodies = [[sentence() for _ in range(8)] for _ in range(10)]
    bodies[0][3:3] = passage
    bodies[4][5:5] = passage
    bodies[7][1:1] = near
    bodies[8] = bodies[8] + [line]
    bodies[9] = bodies[9] + [line]
    rows = [(i, " ".join(b), "en", "s", 0) for i, b in enumerate(bodies)] + [(r[0] + 100 if r[0] else r[0], *r[1:]) for r in CASES]
    table = docs(spark, rows)
    got = passage_dedup.repeats(table)
    found = {(r.doc_id, r.removed) for r in got.collect()}
    assert found == {(0, False), (4, True), (7, True)}
    left = {r.doc_id: r.text for r in passage_dedup.without_repeats(table, got).collect()}
    assert left[4] == " ".join(b for b in bodies[4] if b not in passage) and left[0] == rows[0][1] and left[8] == rows[8][1]


def test_passages_without_sentences(spark):
    """Runs of 50 words and more are found though no sentence of them stands alone in either text."""
    rng = random.Random(16)
    some = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    rows, want = [], set()
    for k in range(24):
        passage = some(50 + k % 6)
        if k % 2:
            passage = [w + "." if i % 16 == 9 else w for i, w in enumerate(passage)]  # its first and last sentence go on outside
        for d in (k, 100 + k):
            before = some(rng.randint(0, 70))
            rows.append((d, " ".join(before + passage + some(rng.randint(0, 70))), "en", "s", 0))
        want.add((100 + k, k))
    rows += [(200 + k, " ".join(some(120)), "en", "s", 0) for k in range(5)]
    rows += [(300 + k, " ".join(some(20) + rows[0][1].split()[:30] + some(20)), "en", "s", 0) for k in range(2)]
    got = passage_dedup.repeats(docs(spark, rows[:-1])).collect()
    assert {(r.doc_id, r.keep_doc_id) for r in got if r.removed} == want
    text_of = {r[0]: r[1].split() for r in rows}
    for r in got:
        run, other = (shingle_set(" ".join(x)) for x in (text_of[r.doc_id][r.begin_word : r.end_word], text_of[(r.doc_id + 100) % 200]))
        assert r.n_words >= 43 and len(run & other) >= 0.8 * len(run)


def test_passages_edited_in_the_first_sentence(spark):
    """One word changed in the first, the middle or the last of three sentences of 17 words; two copies or three."""
    rng = random.Random(26)
    sentence = lambda n=17: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(n)) + "."
    rows, want = [], set()
    for k in range(12):
        passage = [sentence() for _ in range(3)]
        edited = list(passage)
        w = edited[k % 3].split()
        w[8] = "edited"
        edited[k % 3] = " ".join(w)
        for d, body in ((k, passage), (100 + k, edited), (200 + k, passage))[: 2 + k // 6]:
            rows.append((d, " ".join([sentence(), sentence(), *body, sentence(), sentence()]), "en", "s", 0))
            want |= {(d, k)} if d > k else set()
    got = passage_dedup.repeats(docs(spark, rows)).collect()
    assert {(r.doc_id, r.keep_doc_id) for r in got if r.removed} == want
    assert all((r.begin_word, r.end_word) == (34, 85) for r in got)


def test_passages_equal_brute_force_over_runs_and_recall_of_edited_ones(spark):
    """Every document with a run of 50 equal words is found, none without one of 43; edited passages: recall is stated."""
    rng = random.Random(46)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(6, 14))) + "."
    say = lambda n: " ".join(sentence() for _ in range(n)).split()
    rows = []
    for k in range(60):  # equal runs of 40 to 59 words
        run = [word() + ("." if rng.random() < 0.1 else "") for _ in range(40 + k % 20)]
        rows += [(d, " ".join(say(6) + run + say(5)), "en", "s", 0) for d in (k, 1000 + k)]
    got = {r.doc_id for r in passage_dedup.repeats(docs(spark, rows)).select("doc_id").distinct().collect()}
    longest = {}
    for k in range(60):
        a, b = (words(r[1]) for r in rows[2 * k : 2 * k + 2])
        longest[k] = max(n for n in range(30, 75) if {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)})
    for k, n in longest.items():
        assert n < 50 or {k, 1000 + k} <= got, (k, n)
        assert n >= 43 or not {k, 1000 + k} & got, (k, n)
    rows, want = [], set()
    for k in range(60):  # passages of whole sentences, every 50th word or so changed
        passage = say(8)
        other = [word() if rng.random() < 0.02 else w for w in passage]
        rows += [(d, " ".join(say(6) + body + say(5)), "en", "s", 0) for d, body in ((k, passage), (1000 + k, other))]
        a, b = shingle_set(" ".join(passage)), shingle_set(" ".join(other))
        if len(a & b) >= 0.8 * len(a | b):
            want.add(1000 + k)
    got = {r.doc_id for r in passage_dedup.repeats(docs(spark, rows)).where("removed").select("doc_id").distinct().collect()}
    print("recall of edited passages", len(got & want) / len(want))
    assert len(want) > 25 and len(got & want) >= 0.9 * len(want)


def test_html_names_of_state_keep_the_article():
    """Page layout named in a class does not drop the page; elements named as a whole, first or last part are dropped."""
    for opening in ('<body class="single has-sidebar">', '<body><main class="content with-sidebar">', '<body><article class="post comment-open">', '<body><div class="layout no-sidebar">', '<body><div class="content-sidebar-wrap">', '<html id="share"><body>'):
        assert html_extract.main_texts([html_extract.blocks(opening + "<p>the text</p>")]) == ["the text"], opening
    for name in ("ad", "cookie-notice", "site-footer", "box ad1", "comment-list open"):
        assert html_extract.main_texts([html_extract.blocks(f'<body><div class="{name}">not this</div><p>the text</p>')]) == ["the text"], name


def test_passages_edited_where_no_sentence_is_shared(spark):
    """Every sentence of a passage changed: one long sentence, both ends of each paragraph, and text without sentence marks.

    All pairs of paragraphs of different documents are compared by brute force; each similar pair must be found.
    """
    rng = random.Random(56)
    some = lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    rows = []
    for k in range(40):
        passage = [*some(59), "end."]
        edited = ["edited" if i in ([20 + k], [0, 58], [1, 59], [30 + k])[k % 4] else w for i, w in enumerate(passage)]
        if k % 4 == 3:  # without sentence marks; two words are put in, none is replaced
            passage = [*some(80), "end"]
            edited = [*passage[: 20 + k], "put", "in", *passage[20 + k :]]
        for d, body in ((k, passage), (100 + k, edited)):
            rows.append((d, "\n".join(" ".join(x) for x in ([*some(20), "a."], body, [*some(20), "b."])), "en", "s", 0))
    paragraphs = {}
    for d, body, *_ in rows:
        _, _, cuts, _, _ = passage_dedup.sentences(pa.array([body]))
        ends = [(b, next((e for e in cuts if e >= b + 50), None)) for b in cuts[:-1]]
        paragraphs[d] = [shingle_set(" ".join(body.split()[b:e])) for b, e in ends if e is not None]
    want = {(100 + k, k) for k in range(40) if any(len(a & b) >= 0.8 * len(a | b) for a in paragraphs[k] for b in paragraphs[100 + k])}
    got = passage_dedup.repeats(docs(spark, rows)).collect()
    assert len(want) >= 30 and {(r.doc_id, r.keep_doc_id) for r in got if r.removed} >= want
    assert all(r.keep_doc_id == r.doc_id % 100 for r in got)


def test_passages_keep_on_disk_only_what_the_result_reads(spark):
    """Of the tables written on the way two stay, and no rows of a shuffle; the result can be read twice."""
    rng = random.Random(58)
    some = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage = f"{some(30)}. {some(30)}."
    table = docs(spark, [(d, f"{some(20)}. {passage} {some(d + 20)}.", "en", "s", 0) for d in range(8)])
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x and x.endswith(".data")}
    tables = lambda: set(os.listdir(session.shared_dir(spark).removeprefix("file:")))
    tables_before, shuffles_before = tables(), shuffles()
    got = passage_dedup.repeats(table)
    for _ in range(50):  # Spark removes files a little later
        if not shuffles() - shuffles_before:
            break
        time.sleep(0.1)
    assert len(tables() - tables_before) <= 2
    assert not shuffles() - shuffles_before
    first = sorted(got.collect())
    assert len({r.doc_id for r in first}) == 8 and first == sorted(got.select("*").collect())


def test_members_of_large_buckets_are_dealt_and_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    keys = spark.createDataFrame([(r.key, r.rid) for r in spark.range(400).selectExpr("id % 37 + if(id % 3 = 0, 1000, 0) AS key", "id AS rid").collect()] + [(7, 1000 + k) for k in range(100)], "key long, rid long")
    hubs = keys.groupBy("key").agg(F.min("rid").alias("hub"), F.count("*").alias("n")).where("n > 3")
    assert sorted(near_dedup.joined_with(hubs, keys).collect()) == sorted(keys.join(hubs, "key").collect())


def test_rows_and_groups_taken_together_equal_each_alone():
    rng = np.random.RandomState(61)
    values, bounds = rng.randint(0, 40, 600).astype(np.uint64), np.sort(np.append(rng.randint(0, 601, 60), [0, 600, 600]))
    begins, ends = bounds[:-1], bounds[1:]
    alone = [b + passage_dedup.winnowed(values[b:e]) for b, e in zip(begins, ends, strict=True)]
    assert passage_dedup.winnowed_rows(values, begins, ends).tolist() == np.concatenate(alone).tolist()
    sizes, flat = text.sets(values, begins, ends)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [np.unique(values[b:e]).tolist() for b, e in zip(begins, ends, strict=True)]
    pool = rng.randint(0, 2**62, 30).astype(np.uint64)  # all groups draw from the same shingles
    groups = [[(g, 0, 0, 0, 100 * g + i, np.unique(np.where(rng.rand(30) < 0.9, pool, rng.randint(0, 2**62, 30).astype(np.uint64))).tobytes()) for i in range(rng.randint(2, 9))] for g in range(80)]
    links = near_dedup.among(groups, 80)
    found = {r: label for part in graph.joined([near_dedup.pairs_batch(links)]) for r, label in zip(part.column("node").to_pylist(), part.column("label").to_pylist(), strict=True)}
    want = {}
    for rows in groups:
        want |= joined([(r[0], r[4], r[5]) for r in rows], 80)
    assert found == want and 20 < len(links) < sum(map(len, groups)) and near_dedup.among(groups[:1], 101) == []
