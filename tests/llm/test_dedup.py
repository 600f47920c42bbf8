import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from inkwell.llm import common, exact, simhash, substring
from inkwell.llm.common import components, hot_keys, join_hot

from . import cases


def brute_exact(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    return {t: (max((d for d in ids if d is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("counters", [4, 4096])
def test_exact_groups_equal_brute_force(spark, counters):
    rows = cases.rows() + [(500 + i, "hot text", "en", "a", 1) for i in range(200)]
    got = exact.exact_groups(cases.table(spark, True, None).drop(*cases.CLASHES).unionByName(cases.table(spark, values=rows[len(cases.rows()):])), counters=counters).collect()
    want = brute_exact(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(by_sha))


def test_exact_dedup_keeps_whole_rows(spark):
    got = exact.exact_dedup(cases.table(spark, True)).collect()
    want = brute_exact(cases.rows())
    assert sorted(((r.text or ""), r.doc_id) for r in got if r.doc_id is not None) == sorted((t, d) for t, (d, _) in want.items() if d is not None)
    assert len(got) == len(want) and all(r["kept"] == "own kept" for r in got)
    assert exact.exact_dedup(cases.empty(spark)).count() == 0 and exact.exact_groups(cases.empty(spark)).count() == 0


def test_fingerprint_by_the_definition():
    def plain(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
        parts = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
        hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for text in [t or "" for _, t, *_ in cases.rows() if len(t or "") < 10_000] + ["A É b", "ÀB c D e"]:
        assert simhash.fingerprint(text) % (1 << 64) == plain(text)


def test_xxhash_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert r % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def union_find(fps, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_links_keep_all_components(spark):
    r = random.Random(3)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 5, 30])):
            fps.add(f)
            for _ in range(r.choice([1, 2, 2, 3])):
                f ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {x.node: x.root for x in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want = union_find(fps, 2)
    groups = defaultdict(set)
    for f, c in zip(signed, want):
        groups[c].add(f)
    for g in groups.values():
        assert {got.get(f, f) for f in g} == {min(g)}


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_near_groups_and_dedup(spark):
    rows = cases.rows()
    got = simhash.near_groups(cases.table(spark, True)).collect()
    fps = [simhash.fingerprint(t or "") % (1 << 64) for _, t, *_ in rows]
    least = {}
    for c, (d, *_) in zip(union_find(fps, 2), rows):
        least.setdefault(c, set()).add(d)
    want = Counter((d, f"{f:016x}", min((x for x in least[c] if x is not None), default=None)) for c, f, (d, *_) in zip(union_find(fps, 2), fps, rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    left = simhash.near_dedup(cases.table(spark, True)).collect()
    assert len(left) == len(least) and left[0]["fp"] == "own fp"
    assert simhash.near_dedup(cases.empty(spark)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(300)} == {1000}


def test_components_of_few_edges_take_two_jobs_and_equal_the_rounds(spark, monkeypatch):
    r = random.Random(4)
    edges = [(r.randrange(-200, 200), r.randrange(-200, 200)) for _ in range(180)] + [(None, 1), (3, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    written = []
    monkeypatch.setattr(common, "staged", lambda t, name, f=common.staged: written.append(name) or f(t, name))
    few = {tuple(x) for x in components(df).collect()}
    assert written == ["edges", "roots"]
    assert few == {tuple(x) for x in components(df, small=0).collect()} and len(few) > 100
    assert components(df.limit(0)).collect() == []


def test_a_grown_heap_of_the_driver_is_collected_before_a_table_is_staged(spark, monkeypatch):
    monkeypatch.setattr(common, "GROWN", 0.0)
    done = []
    monkeypatch.setattr(common, "settled", lambda s, f=common.settled: done.append(f(s)))
    assert common.staged(spark.range(3), "t").count() == 3 and done == [True]


def test_hot_keys_never_miss_and_join_hot_is_a_left_join(spark):
    left = spark.createDataFrame([(i % 50 if i % 3 else 7, i) for i in range(900)] + [(None, -1)], "k int, v int").repartition(7)
    right = spark.createDataFrame([(i, f"n{i}") for i in range(0, 50, 2)] + [(7, "n7")], "k int, name string")
    assert 7 in {r.k for r in hot_keys(left, "k", 4).collect()}
    assert cases.bag(join_hot(left, right, "k", 4)) == cases.bag(left.join(right, "k", "left"))


def brute_substring(rows, n):
    texts = [(t or "").encode().split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1))
    out = []
    for (d, *_), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return Counter(out)


@pytest.mark.parametrize(("window", "first"), [(35, 18), (35, 9), (7, 7), (5, 2)])
def test_substring_equals_brute_force(spark, window, first):
    r = random.Random(5)
    shared = [cases.words(900 + i, 60) for i in range(4)]
    rows = [x for x in cases.rows() if x[0] != 9]
    for i in range(60):
        w = cases.words(5000 + i, r.randrange(0, 150), 3 if i % 9 == 0 else 400)
        for _ in range(r.randrange(3)):
            s, at = r.choice(shared), r.randrange(len(w) + 1)
            a = r.randrange(20)
            w[at:at] = s[a : a + r.randrange(30, 60)]
        rows.append((600 + i, " ".join(w), "en", "a", 1))
    got = substring.substring_dedup(cases.table(spark, values=rows), window=window, first=first).collect()
    assert Counter(map(tuple, got)) == brute_substring(rows, window)


def test_substring_levels_and_edges(spark):
    assert substring.levels() == [18, 35] and substring.levels(35, 9) == [9, 18, 35] and substring.levels(5, 8) == [5]
    assert substring.substring_dedup(cases.empty(spark)).count() == 0
    got = substring.substring_dedup(cases.table(spark, True))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"] and got.count() == len(cases.rows())


def test_anchor_is_the_same_in_every_copy():
    h = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    h[200:260] = h[20:80]
    a = substring.anchors(h, 18)
    assert (a[200:243] - 200 == a[20:63] - 20).all()


def test_other_pairs_lose_none_that_is_similar(spark):
    """Of texts of one band, all pairs in different components that are similar are proposed, whatever shares their shingles."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(90):
        w = list(base[: r.choice([60, 100, 118, 120])])
        for _ in range(r.choice([0, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice([f"own{i}", f"pool{r.randrange(4)}"])
        texts.append(" ".join(w))
    texts = sorted(set(texts))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    comp = [r.choice([0, 0, i]) for i in range(len(texts))]
    band = [i % 3 for i in range(len(texts))]
    several = spark.createDataFrame([(i, comp[i], band[i], 0) for i in range(len(texts))], "t long, c long, band long, top long")
    sizes = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "t long, n int")
    docs = spark.createDataFrame(list(enumerate(texts)), "t long, body string")
    got = {(x.a, x.b) for x in simhash.other_pairs(several, sizes, docs, 0.8, 5).collect()}
    every = {(i, j) for i in range(len(texts)) for j in range(i) if comp[i] != comp[j]}
    want = {(i, j) for i, j in every if band[i] == band[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want and want <= got <= every and len(got) < len(every) // 2


def templated(seed, template, own, n=300, copies=40):
    """Pages that share a template, and near copies of some of them: (id, text) rows."""
    r = random.Random(seed)
    head = [f"head{r.randrange(10**6)}" for _ in range(template)]
    pages = [head + [f"w{r.randrange(10**6)}" for _ in range(own)] for _ in range(n)]
    near = [[*p[:-3], "one", "two", f"end{i}"] for i, p in enumerate(pages[:copies])]
    texts = [" ".join(p) for p in pages + near]
    r.shuffle(texts)
    return list(enumerate(texts))


def jaccard_groups(rows, similarity, shingle=5):
    sets = [set(simhash.shingle_hashes(t, shingle).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return Counter(find(i) for i in range(len(rows)))


def test_near_copies_in_a_templated_family_are_found(spark):
    rows = templated(4, 160, 90)
    groups = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, similarity=0.8).collect()
    assert sorted(Counter(r.component_id for r in groups).values()) == sorted(jaccard_groups(rows, 0.8).values())


def test_pages_below_the_similarity_are_not_linked(spark):
    rows = templated(6, 170, 30)
    groups = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, similarity=0.8).collect()
    want = jaccard_groups(rows, 0.8)
    assert sorted(Counter(r.component_id for r in groups).values()) == sorted(want.values()) and len(want) > 200
