import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from inkwell.llm import simhash

from . import cases


def test_sketches_estimate_similarity():
    r = random.Random(1)
    for n in (20, 300, 3000):
        a = cases.words(n, n, 5000)
        b = [w if r.random() > 0.02 else w + "x" for w in a]
        x, y = (simhash.shingle_hashes(" ".join(w), 5) for w in (a, b))
        true = len(set(x) & set(y)) / len(set(x) | set(y))
        x, y = np.unique(x), np.unique(y)
        assert simhash.likeness(simhash.sketch(x), simhash.sketch(y)) == pytest.approx(true, abs=0.13)
    assert simhash.sketch(simhash.shingle_hashes("", 5)) == b"" and simhash.likeness(b"", b"") == 0.0


def near_copies():
    r = random.Random(2)
    out = []
    for g in range(30):
        base = cases.words(8000 + g, 250, 6000)
        for c in range(1 + g % 4):
            w = [x if c == 0 or r.random() > 0.008 else x + "y" for x in base]
            out.append((10 * g + c, " ".join(w), "en", "a", 1))
    return out


def test_near_copies_go_and_others_stay(spark):
    rows = near_copies()
    got = {x.doc_id for x in simhash.near_dedup(cases.table(spark, True, rows), shingle=5, similarity=0.8).collect()}
    assert got == {10 * g for g in range(30)}
    odd = simhash.near_groups(cases.table(spark, True), shingle=5, similarity=0.8).collect()
    assert Counter(x.doc_id for x in odd) == Counter(d for d, *_ in cases.rows())
    assert simhash.near_dedup(cases.empty(spark), shingle=5, similarity=0.8).count() == 0


def test_stages_on_their_own_input(spark, tmp_path):
    r = random.Random(3)
    rows = near_copies() + [(500 + i, " ".join(x + "$$$" for x in cases.words(i, 60)), "en", "b", 1) for i in range(40)]
    rows += [(600 + i, near_copies()[0][1], "en", "b", 1) for i in range(5)] + [(700, None, None, None, None), (701, "", "en", "a", 0)]
    rows += [(1000 + i, "\n".join(" ".join(cases.words(7000 + 10 * i + k, 12, 9000)) + "." for k in range(8)), "en", f"s{i % 3}", 1) for i in range(60)]
    labels = [(d, int("$" not in (t or "")), 0) for d, t, *_ in rows if r.random() < 0.8]
    docs = cases.table(spark, values=rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(now.collect())
    good, exact, near, mixed, packed = seen
    assert not any("$" in (x.text or "") for x in good) and {d for d, *_ in rows if d >= 1000} <= {x.doc_id for x in good}
    assert Counter(x.text or "" for x in exact) == Counter({x.text or "" for x in good})
    assert {x.doc_id for x in near if x.doc_id >= 1000} == {x.doc_id for x in exact if x.doc_id >= 1000}
    assert len([x for x in near if x.doc_id < 500 or 600 <= x.doc_id < 700]) == len({x.doc_id // 10 if x.doc_id < 500 else 0 for x in exact if x.doc_id < 500 or 600 <= x.doc_id < 700})
    assert {x.doc_id for x in mixed} <= {x.doc_id for x in near} and max(Counter(x.doc_id for x in mixed).values()) <= 2
    assert {x.doc_id for x in packed} == {x.doc_id for x in mixed}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(x.length for x in whole.collect()) == sum(x.length for x in packed)


def test_near_stage_equals_brute_force_on_the_driver_table(spark):
    """No document goes without a partner at 0.8, and at least nine tenths of the copies go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    rows = {x.doc_id: set(simhash.shingle_hashes(x.text or "", 5).tolist()) for x in docs.collect()}
    held = {}
    for i, h in rows.items():
        for v in h:
            held.setdefault(v, []).append(i)
    near = {(a, b) for ids in held.values() if len(ids) < 100 for k, a in enumerate(ids) for b in ids[k + 1 :]}
    pairs = [(a, b) for a, b in near if len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b])]
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    gone = set(rows) - kept
    assert gone <= {x for p in pairs for x in p} and pairs
    assert sum(a in kept and b in kept for a, b in pairs) <= 0.1 * len(pairs)


def test_the_pipeline_takes_empty_tables_and_clashing_names(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = cases.table(spark, True)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0, name
