import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tickloom.llm import ann_forest, ngram_join
from tickloom.llm.components import components

rnd = random.Random(5)


def brute(rows, percent=85):
    """(n, component) of (id, text) rows by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = defaultdict(list)
    for (doc, _), c in zip(rows, comp):
        if doc is not None:
            least[c].append(doc)
    return [(doc, len(s), min(least[c]) if least[c] else None) for (doc, _), s, c in zip(rows, sets, comp)]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return words


def test_join_matches_brute_force(spark):
    rows = [(None, "one two three four five"), (500, "one two three four five"), (501, None), (502, ""), (503, "A b"), (504, "a B"), (505, "a b c"), (505, "x y z q"), (505, "x y z q")]
    i = 0
    for size in (5, 8, 20, 60, 130, 300):
        base = [f"b{rnd.randrange(10**6)}" for _ in range(size)]
        for _ in range(14):
            rows.append((i, " ".join(edited(base, rnd.choice((0, 0, 1, 2, size // 60, size // 30)))) + rnd.choice(("", " tail"))))
            i += 1
    common = [f"c{k}" for k in range(60)]
    rows += [(1000 + k, " ".join(common + [f"u{k}x{j}" for j in range(rnd.choice((4, 8, 12, 30)))])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'k' AS key")
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


@pytest.mark.parametrize("percent", [85, 80])
def test_group_without_its_centre(spark, percent):
    """Near copies of absent texts: replaced and dropped words, cut ends, copies of copies, and a shared passage."""
    rows = []
    for size in (12, 30, 60):
        base = [f"m{size}x{k}" for k in range(size)]
        for _ in range(70):
            words = edited(base, rnd.randrange(1, 2 + size // 8))
            for _ in range(rnd.choice((0, 0, 1, 2))):
                del words[rnd.randrange(len(words))]
            words = words[: rnd.choice((size, size, size * 9 // 10, size * 8 // 10))]
            rows.append((len(rows), " ".join(words)))
            for _ in range(rnd.choice((0, 0, 0, 3))):
                rows.append((len(rows), " ".join(edited(words, rnd.choice((1, 2))))))
    for _ in range(40):
        rows.append((len(rows), " ".join([f"o{rnd.randrange(10**6)}" for _ in range(8)] + [f"p{k}" for k in range(rnd.choice((8, 40)))])))
    rnd.shuffle(rows)
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect())
    assert got == sorted(brute(rows, percent))


def family(size, copies, tag, extra=()):
    base = [f"{tag}{k}" for k in range(size)]
    return [" ".join(edited(base, 1) + list(extra)) for _ in range(copies)]


@pytest.mark.parametrize("kind", ["two", "ten", "chain"])
def test_few_pairs_in_families(spark, monkeypatch, kind):
    """Families of near copies that share most of their words make no pairs within them, and few across; components are those of brute force."""
    if kind == "two":
        texts = family(200, 30, "t") + family(200, 30, "t", [f"e{k}" for k in range(70)])
    elif kind == "ten":
        texts = [t for j in range(10) for t in family(200, 10, "t", [f"e{j}x{k}" for k in range(50)])]
    else:
        texts = [t for j in range(6) for t in family(200, 10, "t", [f"e{k}" for k in range(30 * j)])]
    rows, counted, meetings = list(enumerate(texts)), [], ngram_join.NearDuplicates.meetings
    monkeypatch.setattr(ngram_join.NearDuplicates, "meetings", lambda self, r: (counted.append(meetings(self, r).count()), meetings(self, r))[1])
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows))
    assert sum(counted) <= (0 if kind == "two" else ngram_join.PAIRS_A_ROW * len(rows)), counted


@pytest.mark.parametrize("stars", [0, 6])
def test_stars_change_nothing(spark, monkeypatch, stars):
    """With as many stars as can be, and with none, components are the same."""
    monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", 0)
    monkeypatch.setattr(ngram_join, "STARS", stars)
    rows = list(enumerate(family(60, 12, "s") + family(60, 12, "s", [f"e{k}" for k in range(12)]) + family(60, 12, "s", [f"e{k}" for k in range(24)]) + [" ".join(edited([f"s{k}" for k in range(60)], 4)) for _ in range(25)]))
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows))


def test_join_at_80(spark):
    """Pairs of 80 to 85 %, of sizes on both sides of a band's end and within one."""
    rows = []
    for size in (62, 126, 254, 100, 200):
        for group in range(6):
            longer = [f"b{size}x{group}x{k}" for k in range(size + 3 + 24 * size // 100)]
            rows += [(len(rows), " ".join(longer)), (len(rows) + 1, " ".join(longer[: size + 3]))]
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect())
    assert got == sorted(brute(rows, 80)) and len({component for *_, component in got}) == len(rows) // 2


def test_pipeline_stage_takes_five_words_and_80(spark):
    """A long tail, isolated replacements, and texts just too far apart, against brute force."""
    base = [[f"b{g}x{k}" for k in range(1000)] for g in range(4)]
    spread = [{k * 1000 // n + 20: f"o{k}" for k in range(n)} for n in (21, 23)]
    texts = [*base, base[0] + [f"t{k}" for k in range(220)], [spread[0].get(k, w) for k, w in enumerate(base[1])]]
    texts += [base[2] + [f"t{k}" for k in range(260)], [spread[1].get(k, w) for k, w in enumerate(base[3])], ["a", "b", "c", "d"], ["A", "b", "c", "d"]]
    sets = [{tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))} for t in ([w.lower() for w in t] for t in texts)]
    kept = [i for i, s in enumerate(sets) if not any(10 * len(s & t) >= 8 * len(s | t) for t in sets[:i])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == kept == [0, 1, 2, 3, 6, 7, 8]


def test_null_id_bridges_and_one_id_of_many_texts(spark):
    words = [f"w{k}" for k in range(260)]
    rows = [(1, " ".join(words[:200])), (None, " ".join(words[:230])), (2, " ".join(words[:260]))]
    rows += [(7, " ".join([f"x{g}y{k}" for k in range(30)] + ["z"] * (g % 2 + j))) for g in range(20) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str) and (2, 257, 1) in got
    joined = ngram_join.NearDuplicates(df, "doc_id", "text")
    assert joined.texts(joined.classes.select("node")).count() == joined.classes.count() == len({t for _, t in rows})


def test_empty_join(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(df).count() == 0


def test_sketches_bound_the_difference():
    for _ in range(200):
        a = ngram_join.shingles(" ".join(str(rnd.randrange(50)) for _ in range(rnd.randint(1, 80))))
        b = ngram_join.shingles(" ".join(str(rnd.randrange(50)) for _ in range(rnd.randint(1, 80))))
        apart = len(np.setxor1d(a, b))
        bits = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(ngram_join.bit_sketch(a), ngram_join.bit_sketch(b)))
        assert bits <= apart


def test_bands_meet():
    for n in range(1, 400):
        for m in range(-(-85 * n // 100), n + 1):
            shared = set(ngram_join.bands(n)) & set(ngram_join.bands(m))
            assert any(apart >= ngram_join.most_apart(n, m) for _, apart in shared), (n, m)


@pytest.mark.parametrize("percent", [30, 80])
def test_bands_meet_at_other_similarities(percent):
    for n in range(1, 400):
        for m in range(-(-percent * n // 100), n + 1):
            shared = set(ngram_join.bands(n, percent)) & set(ngram_join.bands(m, percent))
            assert any(apart >= ngram_join.most_apart(n, m, percent) for _, apart in shared), (n, m)


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in sorted(ann_forest.op7_nearest(spark, sf).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    found = 0
    for q, near in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        found += len({v for v, _ in near} & set(ids[np.argsort(-s)[:5]]))
        assert [v for _, v in near] == sorted((v for _, v in near), reverse=True) and all(abs(s[ids == v][0] - c) < 1e-9 for v, c in near)
    assert len(got) == sum(ids % 50 == 0) and found >= 0.9 * 5 * len(got)


def test_ties_and_useless_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0])] + [(k, [2.0, 0.0]) for k in range(1, 9)] + [(10, None), (11, [0.0, 0.0]), (12, [nan, 1.0]), (13, [None, 1.0]), (None, [1.0, 0.0]), (50, [0.0, 1.0]), (100, [0.0]), (7, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS leaf")
    got = defaultdict(list)
    for r in sorted(ann_forest.nearest(df).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    assert got[0] == [(k, 1.0) for k in range(1, 6)]
    assert [v for v, _ in got[50]] == [0, 1, 2, 3, 4] and set(got) == {0, 50}
    assert ann_forest.nearest(df.limit(0)).count() == 0


def test_many_ties_and_an_id_of_two_vectors(spark):
    """More vectors of one direction than are asked for, in an order that is not that of their ids; and the nearer one of two."""
    rows = [(50, [1.0, 0.0])] + [(k, [float(2 ** (k * 7 % 31)), 0.0]) for k in range(1, 31)]
    got = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(k, 1.0) for k in range(1, 6)]
    rows = [(50, [1.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 0.1]), (8, [1.0, 0.5])]
    got = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).collect()
    assert [(r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"])] == [(7, round(1 / 1.01**0.5, 6)), (8, round(1 / 1.25**0.5, 6))]


@pytest.mark.parametrize("n", [1, 2])
def test_few_candidates(spark, n):
    df = spark.createDataFrame([(50 * k, [1.0, float(k)]) for k in range(n)], "vec_id long, embedding array<float>")
    assert ann_forest.nearest(df).count() == n * (n - 1)
