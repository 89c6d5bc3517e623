"""Every stage of the pipeline against brute force on its own input."""

import collections
import hashlib
import os
import random
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_llm import CASES, SCHEMA, corpus, library, shingle_set

import corpus_pipeline
from strandweave.session import cut


def near_groups(rows):
    """Smallest doc_id of each component of similarity 0.8, by all pairs."""
    sets = {r.doc_id: shingle_set(r.text) for r in rows if r.doc_id is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    good = corpus(7, 6)
    bad = [(5000 + i, " ".join(w.upper() + "!!" for w in rng.choice(good)[1].split()), "en", "s1", 0) for i in range(25)]
    rows = good + bad + [r for r in CASES if r[0] not in (5,)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {"documents": docs.collect()}
    before = seen["documents"]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, str(tmp_path)))
        after = docs.collect()
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "quality":
            kept = {r.doc_id for r in after}
            assert not kept & {r[0] for r in bad} and kept >= {r[0] for r in good}
        elif name == "exact_dedup":
            groups = collections.defaultdict(list)
            for r in before:
                groups[r.text or ""].append(r.doc_id)
            assert sorted((r.text or "", r.doc_id) for r in after if r.doc_id is not None) == sorted((t, max(x for x in ids if x is not None)) for t, ids in groups.items() if any(x is not None for x in ids))
        elif name == "near_dedup":
            assert {r.doc_id for r in after if r.doc_id is not None} == near_groups(before)
            assert [r for r in after if r.doc_id is None] == [r for r in before if r.doc_id is None]
        elif name == "mixing":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
            assert max(collections.Counter(r.doc_id for r in after).values()) <= 2
        else:
            lib = library()
            assert len(after) == len(before)
            for r in after:
                ids = lib.encode(r.text or "", add_special_tokens=False).ids
                assert r.ids == ids and r.n_tokens == len(ids)
                assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        before = after
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = F.concat_ws("|", "doc_id", "ids_sha256")
    assert sorted(r[0] for r in again.select(key).collect()) == sorted(r[0] for r in docs.select(key).collect())


CLASHES = ("score", "predicted", "_text", "body", "c0", "sha", "text_sha256", "keep_id", "_keep", "_kept", "n", "key", "rid", "label", "_size", "_source_size", "_target", "_copies", "_copy", "_s", "_rate", "n_shingles", "kept", "host", "h")


def test_stages_carry_columns_of_any_name_and_empty_tables(spark, tmp_path):
    """Extra columns whose names are those of working columns stay as they are; no rows give no rows."""
    rows = corpus(9, 3) + CASES[:4]
    plain = spark.createDataFrame(rows, SCHEMA)
    docs = plain.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in CLASHES})
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [*corpus_pipeline.COLUMNS, *CLASHES]
    before = len(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == names
        found = docs.collect()
        assert 0 < len(found) <= (2 * before if name == "mixing" else before)
        assert all(r[c] == c + ("" if r.doc_id is None else str(r.doc_id)) for r in found for c in CLASHES), name
        before = len(found)
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, str(tmp_path)).count() == before
    for table in (plain.where("false"), docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, str(tmp_path)).count() == 0
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    plain.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
