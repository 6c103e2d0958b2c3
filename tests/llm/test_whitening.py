import numpy as np
import pytest

from tracewright.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(rows):
    """{(vec_id, component): (n, deviation, whitened, explained)} by numpy's eigenvectors and Python's whole numbers."""
    x = [(i, [int(np.floor(64.0 * float(c))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n = len(fit)
    s = [sum(c) for c in zip(*fit)]
    y = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in fit])
    e, w = np.linalg.eigh(y.T @ y / n)
    out = {}
    for i, v in x:
        dev = sum((n * a - b) ** 2 for a, b in zip(v, s))
        z = np.array([(n * a - b) / n for a, b in zip(v, s)])
        for k in range(min(16, len(s))):
            out[i, k + 1] = (n, dev, float(z @ w[:, -1 - k]) / e[-1 - k] ** 0.5, e[-1 - k] / e.sum())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "old", 7) for i, v in rows], "vec_id long, embedding array<double>, x string, n int")


def run(spark, rows):
    points = whitening.points(frame(spark, rows).repartition(3))
    return whitening.whiten(points, whitening.fit(points)).collect()


def close(got, rows):
    want = brute(rows)
    assert len(got) == len(want) and {(r["vec_id"], r["component"]) for r in got} == set(want)
    signs = {}
    for r in got:
        n, dev, white, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev) and r["explained"] == pytest.approx(share, rel=1e-9) and r["identity_error"] < 1e-8
        if abs(white) > 1e-3:
            assert signs.setdefault(r["component"], r["whitened"] * white > 0) == (r["whitened"] * white > 0)
        assert abs(r["whitened"]) == pytest.approx(abs(white), rel=1e-6, abs=1e-6)


def test_equals_numpy(spark):
    r = np.random.default_rng(0)
    vectors = (r.standard_normal((400, 24)) * np.linspace(3, 0.4, 24)).tolist()
    close(run(spark, list(enumerate(vectors + vectors[:50] + [vectors[0]] * 200))), list(enumerate(vectors + vectors[:50] + [vectors[0]] * 200)))


def test_the_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    close(queries.op13_embedding_whitening(spark, SF).collect(), [(r["vec_id"], r["embedding"]) for r in table])


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    good = r.standard_normal((60, 5)).tolist()
    rows = list(enumerate(good)) + [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (104, [float("-inf")] * 5), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    close(run(spark, rows), list(enumerate(good)))


def test_few_directions_and_no_rows(spark):
    flat = [(i, [i / 8, -i / 8, 3.0, 3.0]) for i in range(40)]
    got = run(spark, flat)
    assert {r["component"] for r in got} == {1} and len(got) == 40
    assert all(r["explained"] == pytest.approx(1) and r["identity_error"] < 1e-9 for r in got)
    for rows in ([], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert run(spark, rows) == []
    twice = run(spark, [(None, [1.0]), (None, [1.0]), (2, [5.0])])
    assert sorted(round(abs(r["whitened"]), 9) for r in twice) == [1, 1, 1] and {r["deviation"] for r in twice} == {256**2}


def test_equal_eigenvalues_have_vectors_at_right_angles(spark):
    axes = [(2 * i + s, [0.0] * i + [4.0 - 8 * s] + [0.0] * (19 - i)) for i in range(20) for s in (0, 1)]
    got = run(spark, axes)
    assert len(got) == 40 * 16 and all(r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(1 / 20) for r in got)


def test_deviations_beyond_a_long(spark):
    got = {r["vec_id"]: r["deviation"] for r in run(spark, [(0, [2.0**25]), (1, [0.0]), (2, [-(2.0**25)]), (3, [2.0**50])])}
    assert got[3] is None and all(v is None or v >= 0 for v in got.values())
    s = [(1 << 31) + 10**6, 10**6, 10**6 - (1 << 31)]
    got = {r["vec_id"]: r["deviation"] for r in run(spark, [(0, [2.0**25]), (1, [0.0]), (2, [-(2.0**25)])])}
    assert got == {i: v if (v := (3 * x - sum(s)) ** 2) < 1 << 63 else None for i, x in enumerate(s)}


def test_counts_and_pairs_equal_numpys():
    r = np.random.default_rng(2)
    for d in (1, 2, 7, 40):
        for spread in (np.linspace(1, 2, d), np.geomspace(1, 1e-9, d), np.round(np.linspace(1, 3, d))):
            q = np.linalg.qr(r.standard_normal((d, d)))[0]
            a = q * spread @ q.T
            e = np.sort(spread)[::-1]
            assert [whitening.eigenvalues_above(a, s) for s in (*(e * (1 + 1e-6)), -1.0)] == [*((e > s).sum() for s in e * (1 + 1e-6)), d]
            values, vectors = whitening.leading_eigenpairs(a, 16)
            assert np.allclose(values, e[: len(values)], atol=1e-13) and len(values) == min(16, d)
            assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-10) and np.abs(a @ vectors.T - vectors.T * values).max() < 1e-12
    assert len(whitening.leading_eigenpairs(np.zeros((3, 3)), 2)[0]) == 0
