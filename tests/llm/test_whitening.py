from collections import defaultdict

import numpy as np

from tickloom.llm import whitening

nan, inf = float("nan"), float("inf")


def brute(vectors, k=32):
    """x, sums, components and eigenvalues by numpy, from clean vectors."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    base = [s // n for s in sums]
    y = np.array([[float(a - b) for a, b in zip(r, base)] for r in x]) - [(s % n) / n for s in sums]
    e, q = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:k]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    return y, e[order], q[:, order].T, deviation, e.sum()


def compare(rows, ids, vectors, k=32, close=1e-7):
    y, e, q, deviation, trace = brute(vectors, k)
    k = int((e > 1e-16 * e[0]).sum())
    z, dev, share = np.zeros((len(ids), k)), {}, {}
    place = {i: j for j, i in enumerate(ids)}
    assert len(rows) == k * len(ids) and len({(r.vec_id, r.component) for r in rows}) == len(rows)
    for r in rows:
        z[place[r.vec_id], r.component - 1] = r.whitened
        dev[r.vec_id], share[r.component] = r.deviation, r.explained
        assert r.n == len(ids) and r.identity_error <= 1e-4
    assert [dev[i] for i in ids] == deviation
    assert all(abs(share[j + 1] / (e[j] / trace) - 1) < 1e-9 for j in range(k))
    want = y @ q[:k].T / np.sqrt(e[:k])
    for j in range(k):
        assert min(np.abs(z[:, j] - want[:, j]).max(), np.abs(z[:, j] + want[:, j]).max()) < close, j


def test_query_matches_eigh(spark):
    sf = "/root/testdata/sf0.01"
    kept = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    rows = whitening.op13_whitening(spark, sf).collect()
    compare(rows, [r.vec_id for r in kept], [r.embedding for r in kept], min(32, len(kept) - 1), 1e-6)


def whitened(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS id", "2 AS x", "3 AS component")
    model = whitening.fit_whitening(df)
    return model, whitening.whitened(model).collect()


def test_useless_and_ragged_vectors(spark):
    rnd = np.random.default_rng(4)
    good = [(i, rnd.standard_normal(5).tolist()) for i in range(40)]
    bad = [(100, None), (101, [nan, 1.0, 1.0, 1.0, 1.0]), (102, [inf] * 5), (103, [None, 1.0, 1.0, 1.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    model, got = whitened(spark, good + bad, "double")
    assert {r.vec_id for r in got} == set(range(40)) and len(got) == 200 and model.rows.n == 40
    y, e, q, deviation, trace = brute([v for _, v in good])
    assert np.allclose(model.eigenvalues, e) and {r.vec_id: r.deviation for r in got} == dict(enumerate(deviation)) and abs(model.trace / trace - 1) < 1e-12


def test_equal_deviations_and_flat_directions(spark):
    """Repeated eigenvalues, dimensions without deviation, repeated ids and rows: the whitened covariance is the identity."""
    rows = [(j % 3, [float(s if k == j else 0) for k in range(4)] + [7.0, 0.0]) for j in range(4) for s in (1, -1)] * 3
    model, got = whitened(spark, rows)
    assert len(model.eigenvalues) == 4 and len(got) == 4 * len(rows) and model.identity_error < 1e-9
    assert np.allclose(model.components @ model.components.T, np.eye(4), atol=1e-12)


def test_few_vectors(spark):
    assert whitened(spark, [])[1] == [] and whitened(spark, [(1, [1.0, 2.0])])[1] == [] and whitened(spark, [(1, [1.0, 2.0])] * 5)[1] == []
    two = whitened(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])[1]
    by_id = defaultdict(list)
    for r in two:
        by_id[r.vec_id].append(r.whitened)
    assert sorted(map(len, by_id.values())) == [1, 1] and abs(by_id[1][0] + by_id[2][0]) < 1e-12 and abs(abs(by_id[1][0]) - 1) < 1e-12


def test_deviation_beyond_a_long(spark):
    _, got = whitened(spark, [(i, [float(i) * 2.0**40, 0.0]) for i in range(3)] + [(9, [0.0, 1.0])], "double")
    x = [[int(64 * float(i) * 2.0**40) + 10**6, 10**6] for i in range(3)] + [[10**6, 10**6 + 64]]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in zip((0, 1, 2, 9), x)}
    assert {r.vec_id: r.deviation for r in got} == {i: w if w < 1 << 63 else None for i, w in want.items()}


def test_bidiagonalisation_stops_early_when_settled():
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((500, 120)) * np.r_[np.linspace(300, 100, 8), np.full(112, 0.01)]
    calls = []
    found, s = whitening.bidiagonalise(lambda w: calls.append(1) or np.append((x @ w) @ x, (x @ w) @ (x @ w)), 120, 8)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert len(calls) < 40 and np.allclose(s, want[:8], rtol=1e-12) and np.allclose(np.abs(np.sum(found * vt[:8], axis=1)), 1, atol=1e-12)
