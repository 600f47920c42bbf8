import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import mixing, packing, pii, quality, rules, tokens, toxicity

from . import cases

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, total, most):
    """Targets by resharing the excess until none is above."""
    full, out = set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        out = {s: most * sizes[s] if s in full else rest * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets_equal_repeated_resharing(spark):
    r = random.Random(1)
    for _ in range(5):
        sizes = {s: r.choice([0, 1, 10, 500, 4000]) + r.randrange(5) for s in ["A", "a", "é", "漢", "b", "🙂"]}
        weights = dict(zip(sorted(sizes), [3, 1, 2, 3, 1, 2]))
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = fill(sizes, weights, 1.5 * sum(sizes.values()), 2)
        for x in got:
            assert x.target == pytest.approx(want[x.source])


def test_mix_takes_the_target_and_no_more(spark):
    docs = cases.table(spark, True)
    got = mixing.mix(docs).collect()
    assert Counter(x.doc_id for x in got) == Counter(d for d, *_ in cases.rows())
    by = defaultdict(list)
    for x in got:
        assert 0 <= x.taken <= 2 * x.size and (x.first_position is None) == (x.taken == 0)
        by[x.source_size, x.target].append(x)
    for (size, target), xs in by.items():
        if len({x.size for x in xs}) > 1:
            assert sum(x.taken for x in xs) % math.floor(target) == 0 if target >= 1 else True
    places = [x.first_position for x in got if x.first_position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert cases.bag(mixing.mix(docs)) == cases.bag(mixing.mix(docs.repartition(5)))
    assert mixing.mix(cases.empty(spark)).count() == 0


def test_schedule_is_the_inverse_of_its_integral(spark):
    from pyspark.sql import functions as F

    for tilt in (-0.5, 0.0, 0.5):
        df = spark.range(101).select((F.col("id") / 100).alias("q")).withColumn("x", mixing.progress(F.col("q"), F.lit(tilt)))
        for q, x in df.collect():
            assert x * (1 - tilt) + tilt * x * x == pytest.approx(q)


def test_mixed_rows_are_whole_documents(spark):
    docs = cases.table(spark, True)
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    want = Counter()
    for x in mixing.mix(docs).collect():
        want[x.doc_id] += 1 if not x.size else (x.taken + x.size // 2) // x.size
    assert Counter(x.doc_id for x in got.collect()) == +want


def repeated(w, n=8):
    seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return len({j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})


def test_rules_counts_equal_plain_python(spark):
    rows = cases.rows() + [(700 + i, " ".join(cases.words(i, 90, 2 if i % 2 else 9)), "en", "a", 1) for i in range(20)]
    rows += [(800, "A b\n\n a\t b\nA b\nA b #$%\n \n", "en", "a", 1)]
    got = rules.judged(cases.table(spark, values=rows)).collect()
    want = []
    for d, t, *_ in rows:
        t = t or ""
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        n = repeated(w)
        want.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)))
    assert Counter(tuple(x)[:7] for x in got) == Counter(want)
    assert all(not (x.base_failed and x.kept) for x in got)
    assert rules.judged(cases.empty(spark)).count() == 0


def test_boilerplate_lines_deplete_a_document(spark):
    line = "this line stands on all pages of the site and says nothing at all about its subject here"
    rows = [(i, "\n".join([line] + [" ".join(cases.words(i, 40))]), "en", "a", 1) for i in range(40)]
    rows += [(100, "\n".join([line.upper()] * 1 + ["short end " + " ".join(cases.words(7, 3))] + [line + " " + str(k) for k in range(3)]), "en", "a", 1)]
    rows += [(200 + i, line + "\n" + line.replace("page", "leaf"), "en", "b", 1) for i in range(3)]
    got = {x.doc_id: x for x in rules.judged(cases.table(spark, True, rows), least_left=0.8).collect()}
    assert all(got[i].n_left == 40 and not got[i].kept for i in range(40))
    assert got[100].n_left == got[100].n_words - 18
    assert all(got[200 + i].n_left == got[200 + i].n_words for i in range(3))
    copies = [(i, line + "\n" + " ".join(cases.words(1, 40)), "en", "a", 1) for i in range(60)]
    assert all(x.kept for x in rules.judged(cases.table(spark, values=copies)).collect())


def test_token_lengths_equal_another_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = cases.table(spark, True)
    got = tokens.token_lengths(docs, keep=["doc_id"]).collect()
    want = Counter((d, len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, *_ in cases.rows())
    assert Counter(map(tuple, got)) == want


def test_histogram_answers_every_limit(spark):
    r = random.Random(2)
    n = [r.choice([0, 1, 1, 5, r.randrange(400), 9000]) for _ in range(500)]
    h = tokens.length_histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long"))
    for x in h.collect():
        assert x.docs == n.count(x.n_tokens) and x.docs_up_to == sum(k <= x.n_tokens for k in n)
        assert x.docs_beyond == len(n) - x.docs_up_to and x.tokens_up_to == sum(k for k in n if k <= x.n_tokens)
        assert x.truncated_total == sum(min(k, x.n_tokens) for k in n)
    for x in tokens.at_limits(h, [0, 1, 3, 128, 100_000]).collect():
        assert x.tokens_kept == sum(min(k, x.context) for k in n) and x.docs_cut == sum(k > x.context for k in n)
    assert tokens.quantile(h, 0.5).first().n_tokens == sorted(n)[249]
    assert tokens.length_histogram(tokens.token_lengths(cases.empty(spark))).count() == 0


def brute_segments(scores):
    """Maximal scoring segments by their definition: best segment, then both sides."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-9):
                best = (i, j + 1, total)
    if best is None:
        return []
    a, b, s = best
    return brute_segments(scores[:a]) + [best] + [(x + b, y + b, z) for x, y, z in brute_segments(scores[b:])]


def test_segments_equal_the_definition():
    r = random.Random(4)
    for _ in range(300):
        hits = {i: r.choice([3.37, 1.13, 0.59, -2.21, -0.83]) + r.random() / 100 for i in range(25) if r.random() < 0.4}
        got = toxicity.segments(sorted(hits.items()), 0.31)
        want = brute_segments([hits.get(i, -0.31) for i in range(25)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def toxic_rows(n=240):
    out, labels = [], []
    for i in range(n):
        w = cases.words(3000 + i, 80)
        bad = i % 5 == 0
        if bad:
            for k in range(4):
                w.insert(30 + k, ["Vile!", "rotten,", "filth"][(i + k) % 3])
        out.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, 1, int(bad)))
    return out, labels


def test_toxicity_held_out_accuracy_and_edges(spark):
    rows, labels = toxic_rows()
    docs = cases.table(spark, True, rows + [(1000 + i, *x[1:]) for i, x in enumerate(cases.rows())])
    labels = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(240))
    assert all(got[i].predicted == (i % 5 == 0) for i in held)
    assert all(got[i].passages for i in held if i % 5 == 0)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got.values())
    assert all(not got[1000 + i].predicted for i in range(len(cases.rows())))
    none = toxicity.fit(docs, labels.filter("doc_id < 0"))
    assert toxicity.score_toxicity(cases.empty(spark), none).count() == 0


def test_nothing_is_learnt_from_held_out_rows(spark):
    rows, labels = toxic_rows()
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    docs = cases.table(spark, values=rows)
    models = [toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flip)]
    assert models[0] == models[1]


def test_quality_rejects_junk_and_keeps_prose(spark):
    rows, labels = [], []
    for i in range(300):
        w = cases.words(4000 + i, 120, 4000)
        bad = i % 6 == 0
        text = " ".join(x + "$$$" for x in w[:60]) if bad else ". ".join(" ".join(w[k : k + 12]) for k in range(0, 120, 12)) + "."
        rows.append((i, text, "en", f"s{i % 7}" if i % 11 else None, 1))
        labels.append((i, int(not bad), 0))
    docs = cases.table(spark, True, rows + [(1000 + i, *x[1:]) for i, x in enumerate(cases.rows())])
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in quality.quality(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].kept == (i % 6 != 0) for i in held)
    kept = quality.good_rows(docs, model)
    assert kept.columns == docs.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(d for d, x in got.items() if x.kept)
    assert quality.quality(cases.empty(spark), model).count() == 0 and quality.good_rows(cases.empty(spark), model).count() == 0


def test_sparse_sites_shrink_toward_the_level_above(spark):
    big = [("a", "x", 3.0)] * 400 + [("b", "x", -3.0)] * 400 + [("c", None, -3.0)] + [("a", "y", -3.0)]
    got = {x.site: x for x in quality.posteriors(spark.createDataFrame(big, "host string, path string, logit double")).collect()}
    a, b, c, y = (got[k] for k in ('{"h":"a","p":"x"}', '{"h":"b","p":"x"}', '{"h":"c"}', '{"h":"a","p":"y"}'))
    assert a.path_posterior > 0.8 > c.path_posterior > b.path_posterior and b.path_posterior < 0.2
    assert b.host_posterior < c.host_posterior < a.host_posterior and y.path_posterior > c.path_posterior


def test_hosts_and_paths_of_addresses(spark):
    df = spark.createDataFrame([("https://WWW.Ex.org/news/a.html",), ("no address",), (None,)], "u string")
    got = df.select(quality.host_of(df.u).alias("h"), quality.path_of(df.u).alias("p")).collect()
    assert (got[0].h, got[0].p) == ("ex.org", "news") and got[2].h is None and got[2].p == ""


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_a_plain_scan(spark):
    r = random.Random(6)
    bits = ["a@b.c", "_d@e.f", "x.y+z%q@mail-1.ex.org", "@", "..", "1.2.3.4", "255.0.00.256", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "+44 20 7946 0958 1", "79927398713000", "é", "🙂", " ", "\n", "-", "word", "12", "0", "+", "(", "@b.c", "000000000001.2.3.4"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " ", "\n", ""]) for _ in range(r.randrange(40))), "en", "a", 1) for i in range(400)]
    rows += [(900, "9" * 50_000, "en", "a", 1), (901, "a" * 100_000 + "@", "en", "a", 1), (902, "a@b" + ".c" * 20_000, "en", "a", 1), (903, "1 " * 20_000, "en", "a", 1)]
    rows += [(1000 + i, *x[1:]) for i, x in enumerate(cases.rows())]
    got = {x.doc_id: x for x in pii.personal_data(cases.table(spark, True, rows)).collect()}
    for d, t, *_ in rows:
        want = plain_spans(t or "")
        assert [tuple(s)[:4] for s in got[d].found if s.base] == want, t
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in want) for k in pii.KINDS]
    assert pii.personal_data(cases.empty(spark)).count() == 0


def test_bootstrap_finds_what_contexts_agree_on(spark):
    rows = [(i, f"hello there call phone +1 (743) 555-{3000 + i} now. reach me +1 (200) 555-{1000 + i} please", "en", "a", 1) for i in range(12)]
    rows += [(100, "so call phone 0049-743-5553824, soon", "en", "a", 1), (101, "or reach me 0049-743-5553824 today", "en", "a", 1)]
    rows += [(102, "in the year 1999123456 nothing", "en", "a", 1)]
    got = {x.doc_id: x for x in pii.personal_data(cases.table(spark, values=rows)).collect()}
    new = [(d, s.kind, rows_text[s.start : s.end]) for d, rows_text in ((r[0], r[1]) for r in rows) for s in got[d].found if not s.base]
    assert (100, "phone", "0049-743-5553824") in new and (101, "phone", "0049-743-5553824") in new
    assert all(d in (100, 101) for d, *_ in new)


def test_bootstrap_finds_numbers_written_with_spaces(spark):
    rows = [(i, f"hello there call phone +1 (743) 555-{3000 + i} now. reach me +1 (200) 555-{1000 + i} please", "en", "a", 1) for i in range(40)]
    rows += [(100, "so call phone (555) 123 4567 12th", "en", "a", 1), (101, "or reach me 555) 123 4567, today", "en", "a", 1)]
    got = {x.doc_id: x for x in pii.personal_data(cases.table(spark, values=rows)).collect()}
    texts = {d: t for d, t, *_ in rows}
    assert {texts[d][s.start : s.end] for d in (100, 101) for s in got[d].found} == {"555) 123 4567"}


def test_bootstrap_goes_on_until_nothing_is_new(spark):
    # Instances of one hop seed the contexts of the next.
    sizes = [110, 44, 17, 7, 3, 1]
    tokens = [(f"{hop}00{i:04}", f"{side}{hop + k} ", "phone" if hop == 0 else None) for hop, n in enumerate(sizes) for i in range(n) for k in (0, 1) for side in "pq"]
    frame = spark.createDataFrame(tokens, "x string, left string, seed string")
    got = {r.x for r in pii.bootstrap(frame).collect()}
    assert got == {x for x, _, seed in tokens if seed is None}
    with pytest.raises(RuntimeError):
        pii.bootstrap(frame, 3)


def test_op8_columns(spark, tmp_path):
    rows = [(1, "mail a@b.co or 1.2.3.4", "en", "a", 1), (2, None, None, None, None)]
    cases.table(spark, values=rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in pii.op8_pii(spark, str(tmp_path)).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"email:5:11,ip:15:22").hexdigest() and got[1].spans == "email:5:11,ip:15:22"
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""


ODD = "a b Z İ ı ß ſ é é ́ ̇ ñ Ǆ Σ ς ΑΣ ﬁ 中 文 한 𝒜 🙂 0 7 ½ Ⅻ . , ! ' ’ - _ <| |> <|endoftext|> ( ) # ing The = ̸".split(" ")
ODD += [" ", "\n", "\t", "\x0b", "\x0c", "\r", "\x85", "\xa0", "\u2003", "\u200b", "\u3000", "\x00", "\x1f", "\ufeff", "w" * 30]


def test_ids_equal_the_tokenizers(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(11)
    texts = [x or "" for _, x, *_ in cases.rows()] + ["It's <|endoftext|> odd<|startoftext|>ly 12.5% Straße ΣΑΣ é x ́y\x0b\x1cz a don't　'll", "́ ́", "a\u0085b"]
    texts += ["İ.", "DİYARBAKIR'DA, İZMİR!", "İ" * 2000 + ".", "x" * 5000 + "!"]
    texts += ["".join(r.choice(ODD) for _ in range(r.randrange(30))) for _ in range(8000)]
    want = [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]
    monkeypatch.setattr(packing, "REMEMBERED", 500)  # words are forgotten and met again
    enc = packing.Encoder(packing.VOCABULARY)
    for i in range(0, len(texts), 100):
        got = enc.encode_batch(pa.array(texts[i : i + 100]), 1).to_pylist()
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want[i : i + 100]
    assert enc.encode_batch(pa.array(["x"] + texts[:3])[1:], 1).to_pylist() == enc.encode_batch(pa.array(texts[:3]), 1).to_pylist()


@pytest.mark.parametrize("shard", [(3, 10**9), (4096, 4_000_000)])
def test_packing_is_an_exact_round_trip(spark, shard):
    docs = cases.table(spark, True)
    got = packing.pack(docs, shard_docs=shard[0], shard_tokens=shard[1]).collect()
    texts = defaultdict(list)
    for d, t, *_ in cases.rows():
        texts[d].append(packing.encoder(packing.VOCABULARY).encode_batch(pa.array([t or ""]), 1)[0].as_py())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in got:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append(x)
        ids = np.frombuffer(x.ids, "<u2")
        assert len(ids) == x.length and zlib.crc32(ids.astype("<u4").tobytes()) == x.ids_crc32
    for d, want in texts.items():
        starts = defaultdict(list)
        for x in sorted(by_doc[d], key=lambda x: x.start):
            starts[x.doc_tokens].append(x)
        if len(set(map(len, want))) == len(want):
            assert sorted(b"".join(x.ids for x in xs) for xs in starts.values()) == sorted(want)
        assert sum(x.length for x in by_doc[d]) == sum(len(w) // 2 for w in want)
    for xs in by_sequence.values():
        at = 0
        for x in sorted(xs, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    assert packing.pack(cases.empty(spark)).count() == 0


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * k, 100 * k + 60, 300) for k in range(4)]
    pieces = [rng.permutation(topics[i % 4])[: 100 + i] for i in range(40)]
    held = np.zeros(501)
    for p in pieces:
        held[np.unique(p)] += 1
    idf = np.log1p((40 - held + 0.5) / (held + 0.5)).astype(np.float32)
    groups = list(packing.Shard(idf, 120.0, 512).order(pieces))
    assert sum(len({d % 4 for d, *_ in g}) == 1 for g in groups) >= len(groups) - 4
    done = Counter()
    for g in groups:
        for d, _, n in g:
            done[d] += n
    assert done == Counter({i: len(p) for i, p in enumerate(pieces)})


def plain_bootstrap(tokens):
    """The bootstrap of ``pii.bootstrap`` over lists: (x, contexts, seed)."""
    graph, known = set(), {}
    for x, left, seed in tokens:
        w = [t[-pii.WORD_END :] for t in left.lower().split()]
        if left[-1:].isspace() and w:
            graph.add((x, w[-1]))
            if len(w) > 1:
                graph.add((x, f"{w[-2]} {w[-1]}"))
        if seed:
            known[x] = min(seed, known.get(x, seed))
    seeds = dict(known)
    of = defaultdict(set)
    for x, p in graph:
        of[p].add(x)
    fits = lambda x, kind: re.search(pii.SHAPES[kind], x) is not None

    def scored(xs):
        votes = defaultdict(list)
        for p, members in of.items():
            for kind, f in Counter(known[x] for x in members if x in known).items():
                if f >= pii.LEAST_SEEDS and f / len(members) >= pii.LEAST_CONFIDENCE:
                    for x in members & xs:
                        if fits(x, kind):
                            votes[x, kind].append(f / len(members))
        best = {}
        for (x, kind), c in votes.items():
            score = 1 - math.prod(1 - min(v, 0.99) for v in c)
            if score >= pii.LEAST_SCORE and len(c) >= pii.LEAST_PATTERNS:
                best[x] = max(best.get(x, (0, 0, "")), (score, len(c), kind))
        return {x: k for x, (_, _, k) in best.items()}

    while new := scored({x for x, _ in graph} - set(known)):
        known |= new
    secret = {x for x, k in seeds.items() if k == pii.SECRET}
    return {x: k for x, k in known.items() if x not in seeds} | {x: k for x, k in scored(secret).items() if k == pii.SECRET}


def test_bootstrap_equals_plain_python(spark):
    r = random.Random(21)
    contexts = {"phone": ["please call ", "our phone ", "dial now "], "email": ["write to ", "e-mail "], "secret": ["token = ", "the key "], "none": ["in the year ", "page ", "call ", "sum of "]}
    make = {"phone": lambda: f"+{r.randrange(10**11, 10**12)}", "email": lambda: f"u{r.randrange(99)}@ex.org", "secret": lambda: "".join(r.choices("0123456789abcdef", k=40)), "none": lambda: str(r.randrange(10**5, 10**9))}
    tokens = []
    for _ in range(500):
        kind = r.choice(list(contexts))
        x = make[kind]()
        seed = kind if kind != "none" and r.random() < 0.8 else None
        for _ in range(r.randrange(1, 4)):
            tokens.append((x, r.choice(contexts[kind]) if r.random() < 0.9 else r.choice(contexts[r.choice(list(contexts))]), seed))
    got = {x.x: x.kind for x in pii.bootstrap(spark.createDataFrame(tokens, "x string, left string, seed string")).collect()}
    want = plain_bootstrap(tokens)
    assert got == want and {"phone", "email", "secret"} <= set(want.values())


def test_secrets_are_found_where_contexts_confirm_them(spark):
    rows = [(i, f'some prose token = "{i:040x}" and more prose\ntoken = "{i + 500:040x}"!!', "en", "a", 1) for i in range(8)]
    rows += [(100 + i, f"commit number{i} {i + 900:040x} here", "en", "a", 1) for i in range(2)]
    got = {x.doc_id: x for x in pii.personal_data(cases.table(spark, values=rows)).collect()}
    for d, t, *_ in rows:
        want = [m[0] for m in re.finditer("(?<=\")[0-9a-f]{40}", t)]
        assert [t[s.start : s.end] for s in got[d].found if s.kind == "secret"] == want


def test_posteriors_equal_plain_sums_without_the_own_document(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice(["x", "y", None]), r.gauss(0.5, 2)) for _ in range(120)] + [("lone", "z", 2.0)]
    sig = lambda x: 1 / (1 + math.exp(-x))
    scored = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, host string, path string, logit double")
    named = scored.withColumn("site", quality.site(scored.host, scored.path)).drop("host", "path")
    got = {x.doc_id: x.score for x in quality.with_sites(named, quality.posteriors(scored)).select("doc_id", quality.combined().alias("score")).collect()}
    base = sum(sig(x) for *_, x in rows) / len(rows)

    def spread(groups):  # (n, good, mean)
        n = sum(g[0] for g in groups)
        over = sum(k * (good / k - m) ** 2 for k, good, m in groups) / n - sum(m * (1 - m) for *_, m in groups) / n
        return max(1.0, min(1e6, sum(k * m * (1 - m) for k, _, m in groups) / n / over - 1)) if over > 0 else 1e6

    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, x in rows:
        hosts[h].append(sig(x))
        paths[h, p].append(sig(x))
    kh = spread([(len(v), sum(v), base) for v in hosts.values()])
    mean = {h: (sum(v) + kh * base) / (len(v) + kh) for h, v in hosts.items()}
    kp = spread([(len(v), sum(v), mean[h]) for (h, _), v in paths.items()])
    logit = lambda q: math.log(q / (1 - q))
    for i, (h, p, x) in enumerate(rows):
        host = (sum(hosts[h]) - sig(x) + kh * base) / (len(hosts[h]) - 1 + kh)
        path = (sum(paths[h, p]) - sig(x) + kp * host) / (len(paths[h, p]) - 1 + kp)
        assert got[i] == pytest.approx(sig(x + logit(path) - logit(base)))


def test_weights_and_extreme_value_law_by_hand(spark):
    docs = [("alpha beta", 0, 0)] * 30 + [("alpha gamma", 1, 0)] * 20 + [("alpha delta", 0, 2)] * 7
    counts = toxicity.token_counts(spark.createDataFrame(docs, "body string, y int, part int"))
    got = {bytes(x.w): (x.a0, x.b0, x.a2, x.b2) for x in counts.collect()}
    assert got[b""] == (30, 20, 7, 0) and got[b"alpha"] == (30, 20, 7, 0) and got[b"gamma"] == got[b"^gamma"] == (0, 20, 0, 0)
    weights = toxicity.learn_weights(counts, [0])
    alpha = toxicity.PRIOR * 20
    odds = lambda k, n, other: math.log((k + alpha) / ((1 + toxicity.PRIOR) * n + toxicity.PRIOR * other + 1 - k - alpha))
    assert weights[b"gamma"] == pytest.approx(odds(20, 20, 30) - odds(0, 30, 20) - toxicity.DRIFT)
    assert b"alpha" not in weights and weights[b"beta"] < 0 and b"^beta" not in weights
    best, n = np.array([0.0, 1.0, 2.0, 3.0]), np.array([10.0, 10.0, 20.0, 20.0])
    rate, size = toxicity.extreme_value_law(n, best)
    assert rate == pytest.approx(math.pi / math.sqrt(6) / best.std())
    assert np.mean(np.log(size * n) + np.euler_gamma) == pytest.approx(rate * best.mean())


def test_labels_that_repeat_or_contradict(spark):
    docs = cases.table(spark, values=[(i, f"text {i}", "en", "a", 1) for i in range(60)] + [(3, "again", "en", "a", 1)])
    labels = [(i, 1, i % 2) for i in range(60)] + [(6, 1, 0), (9, 1, 0), (3, 1, 1), (None, 1, 1)]
    got = toxicity.labelled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "toxic", (0, 1, 2), 1000).collect()
    assert Counter((x.body, x.y) for x in got) == Counter([(f"text {i}", i % 2) for i in range(60) if i != 9] + [("again", 1)])


def test_scores_are_bm25():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, 40, rng.integers(5, 60)).astype(np.uint16) for _ in range(30)]
    idf = rng.random(41).astype(np.float32)
    shard = packing.Shard(idf, 25.0, 512)
    shard.index(pieces)
    for seed in (0, 7):
        terms, tf = np.unique(pieces[seed], return_counts=True)
        w = packing.bm25(idf[terms], tf, len(pieces[seed]), 25.0)
        asked = terms[np.argsort(-w, kind="stable")[: packing.TERMS]]
        want = [sum(idf[t] * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(p) / 25.0)) for t in asked if (f := int((p == t).sum()))) for p in pieces]
        assert shard.scores(seed) == pytest.approx(np.array(want), rel=1e-5)


def test_documents_that_ask_for_the_same_stand_together():
    """In the order of signatures, over the whole corpus, neighbours are of one topic far more often than by chance."""
    rng = np.random.default_rng(7)
    common, topics = rng.integers(0, 300, 4000), [rng.integers(300, 4000, 25) for _ in range(40)]
    pieces = [np.concatenate([rng.choice(common, 60), rng.choice(topics[i % 40], 60)]).astype(np.uint16) for i in range(800)]
    held = np.zeros(4001)
    for p in pieces:
        held[np.unique(p)] += 1
    idf = np.log1p((800 - held + 0.5) / (held + 0.5)).astype(np.float32)
    order = sorted(range(800), key=lambda i: (*packing.signature(pieces[i], idf, 120.0), i))
    same = sum(a % 40 == b % 40 for a, b in zip(order, order[1:]))
    assert same > 0.4 * 799  # one in forty by chance


def test_all_neighbours_are_tried_before_others():
    rng = np.random.default_rng(1)
    small = [np.full(4, 1, np.uint16) for _ in range(400)]  # more than are sorted first, too small to fill a window by those
    others = [rng.integers(10, 40, 900).astype(np.uint16) for _ in range(2)]
    seed = np.concatenate([np.full(30, 1), np.full(971, 2)]).astype(np.uint16)
    idf = np.ones(41, np.float32)
    first = next(packing.Shard(idf, 50.0, 2048).order([seed, *small, *others]))
    assert first[0][0] == 0 and all(1 <= d <= 400 for d, *_ in first[1:])
    assert [n for *_, n in first[1:]] == [4] * 261 + [3]  # the last one is cut


def test_histogram_of_nothing_and_clashing_names(spark):
    h = tokens.length_histogram(tokens.token_lengths(cases.empty(spark)))
    assert [tuple(x) for x in tokens.at_limits(h, [5]).collect()] == [(5, 0, 0)] and tokens.quantile(h, 0.5).collect()[0][0] is None
    assert tokens.token_lengths(cases.table(spark, True), keep=["_body", "doc_id"]).count() == len(cases.rows())
    assert mixing.mixed_rows(cases.empty(spark)).count() == 0
