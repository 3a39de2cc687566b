import numpy as np
import pytest

from surveyspark.llm import whitening as W
from surveyspark.llm.queries import op11_whitening
from surveyspark.llm.common import table

SMOKE = "/root/testdata/sf0.001"


def expected(vectors, components=32):
    """n, S, deviations and the whitened rows up to sign, by a dense eigensolver."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), [int(a) for a in x.sum(axis=0)]
    dev = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    c = x - 1_000_000.0
    c = c - c.mean(axis=0)
    v = c.T @ c / n
    w, u = np.linalg.eigh(v)
    w, u = w[::-1], u[:, ::-1]
    k = min(components, int((w > len(w) * np.finfo(float).eps * np.abs(v).sum(axis=1).max()).sum()))
    return n, dev, (c @ u[:, :k]) / np.sqrt(w[:k]), w[:k] / np.trace(v)


def agrees(rows, ids, vectors, components=32):
    n, dev, want, explained = expected(vectors, components)
    got = sorted((r.vec_id is not None, r.vec_id, r.component, r) if r.vec_id is not None else (False, -1, r.component, r) for r in rows)
    got = [g[3] for g in got]
    k = want.shape[1]
    assert len(got) == len(ids) * k
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else -1))
    assert {r.n for r in got} == {n}
    white = np.array([r.whitened for r in got]).reshape(len(ids), k)
    sign = np.sign((white * want[order]).sum(axis=0))
    assert np.abs(white * sign - want[order]).max() < 1e-7
    assert [r.deviation for r in got[::k]] == [dev[i] for i in order]
    assert np.abs(np.array([r.explained for r in got[:k]]) / explained - 1).max() < 1e-10
    assert all(r.identity_error < 1e-9 for r in got) and [r.component for r in got[:k]] == list(range(1, k + 1))


def test_given_table_equals_a_dense_solver(ready):
    rows = op11_whitening(ready, SMOKE).collect()
    given = table(ready, SMOKE, "embeddings").select("vec_id", "embedding").collect()
    agrees(rows, [r.vec_id for r in given], [r.embedding for r in given])


def test_odd_vectors(ready):
    rng = np.random.default_rng(5)
    good = [(i, [float(a) for a in rng.normal(size=5)]) for i in range(60)] + [(7, [1.0, 2.0, 3.0, 4.0, 5.0]), (None, [0.0] * 5), (7, [1.0, 2.0, 3.0, 4.0, 5.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] + [0.0] * 4), (104, [float("inf")] + [0.0] * 4),
           (105, [1.0, 2.0])]
    df = ready.createDataFrame([(i, v, "kept") for i, v in good + bad], "vec_id long, e array<double>, whitened string")
    distinct = [g for g in good if g[0] != 7] + [g for g in good if g[0] == 7]
    rows = W.whiten(df, "vec_id", "e").collect()
    once = [r for r in rows if r.vec_id != 7]
    assert len(rows) == 5 * len(good) and sum(r.vec_id == 7 for r in rows) == 5 * 3
    n, dev, want, _ = expected([v for _, v in good])
    assert {r.n for r in rows} == {len(good)} and len(distinct) == len(good)
    ids = [i for i, _ in good]
    for r in once[:20]:
        assert abs(abs(r.whitened) - abs(want[ids.index(r.vec_id), r.component - 1])) < 1e-8 and r.deviation == dev[ids.index(r.vec_id)]


def test_no_variance_and_no_rows(ready):
    schema = "vec_id long, e array<float>"
    assert W.whiten(ready.createDataFrame([], schema), "vec_id", "e").collect() == []
    assert W.whiten(ready.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), "vec_id", "e").collect() == []
    line = W.whiten(ready.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], schema), "vec_id", "e").collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)


def test_too_large_numbers_raise(ready):
    schema = "vec_id long, e array<double>"
    with pytest.raises(Exception, match="64 bits"):
        W.whiten(ready.createDataFrame([(1, [1e300]), (2, [0.0])], schema), "vec_id", "e").collect()
    with pytest.raises(Exception, match="64 bits"):
        W.whiten(ready.createDataFrame([(i, [1e10 * i]) for i in range(9)], schema), "vec_id", "e").collect()


def test_inertia_counts_negative_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 30):
        for _ in range(10):
            a = rng.normal(size=(d, d))
            a = a + a.T
            assert W.ldl_negatives(a) == (np.linalg.eigvalsh(a) < 0).sum()
    assert W.ldl_negatives(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1 and W.ldl_negatives(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [2, 2, 2, 1, 1], [1, 1, 1, 1, 1], [1e8, 1, 1e-6, 1e-6, 0], [3, 3 * (1 + 1e-13), 1, 1, 0.5]])
def test_spectrum_slicing_finds_close_and_equal_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(5, 5)))
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, u = W.leading(v, 4)
    want = np.sort(np.array(values, float))[::-1]
    want = want[want > 5 * np.finfo(float).eps * np.abs(v).sum(axis=1).max()][:4]
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-9, atol=1e-14 * want[0])
    assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12)
    assert np.abs(v @ u - u * e).max() <= 1e-13 * want[0]
