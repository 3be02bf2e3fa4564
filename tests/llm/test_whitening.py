import math

import numpy as np
import pandas as pd
import pytest

from stageledger.llm import embedding_whitening as ew
from stageledger.llm import queries


def brute(rows, most=32):
    """Rows and covariance in exact integers, eigenvectors by numpy."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows]
    x = np.array([v for _, v in kept], dtype=object)
    n, total = len(x), x.sum(axis=0)
    far = n * x - total
    centred = (far / n).astype(float)
    covariance = centred.T @ centred / n
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1], u[:, ::-1]
    return n, [int((r * r).sum()) for r in far], e[:most], centred @ u[:, :most], covariance.trace()


def table(tmp_path, rows, **extra):
    frame = pd.DataFrame({"vec_id": pd.array([i for i, _ in rows], dtype="Int64"), "embedding": [v for _, v in rows], **extra})
    frame.to_parquet(tmp_path / "embeddings.parquet")
    return str(tmp_path)


def test_against_exact_sums(spark, tmp_path):
    rng = np.random.default_rng(3)
    d = 5
    rows = [(i, (rng.normal(size=d) * [1, 2, 3, 4, 5] + 7).astype(np.float32).tolist()) for i in range(300)]
    rows += [rows[0], (400, [1.0] * d), (400, [1.0] * d), (None, [-3.25] * d)]
    bad = [(500, None), (501, [float("nan")] * d), (502, [float("inf"), 1, 1, 1, 1]), (503, [None, 1.0, 1.0, 1.0, 1.0]), (504, []), (505, [1.0])]
    folder = table(tmp_path, rows + bad, n="clash", component=1, v=0.5)
    got = queries.queries()["op11_welford_qr"](spark, folder).toPandas()
    n, deviation, e, projected, trace = brute(rows)
    assert len(got) == len(rows) * d and set(got.n) == {n} == {len(rows)}
    share = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, e / trace, rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-12
    key = lambda i: -1 if i is None or pd.isna(i) else int(i)
    want = sorted((key(i), dev, *np.abs(y / np.sqrt(e)).round(8)) for (i, _), dev, y in zip(rows, deviation, projected, strict=True))
    wide = got.assign(vec_id=got.vec_id.map(key)).reset_index(drop=True)
    found = sorted((g.vec_id.iloc[0], g.deviation.iloc[0], *g.sort_values("component").whitened.abs().round(8)) for _, g in wide.groupby(wide.index // d))
    assert np.allclose(np.array(found, float), np.array(want, float), atol=1e-7)
    # One sign for all rows: components are uncorrelated and of variance one.
    assert abs(np.cov(wide.pivot_table(index=wide.index // d, columns="component", values="whitened").to_numpy().T, bias=True) - np.eye(d)).max() < 1e-10


def test_merging_is_as_good_as_one_pass(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, size=(3000, 7)) + 1_000_000
    whole = ew.Moments.none(7)
    whole.add(x, ew.OFFSET)
    parts = ew.Moments.none(7)
    for part in np.array_split(x, 41):
        one = ew.Moments.none(7)
        one.add(part, ew.OFFSET)
        parts = parts.merge(one)
    assert parts.n == whole.n and list(parts.total) == list(whole.total) == [int(s) for s in x.sum(axis=0)]
    exact = np.cov(x.T.astype(float) - 1_000_000, bias=True)
    for found in (whole, parts):
        assert np.allclose(found.m / found.n, exact, rtol=1e-12, atol=1e-8)
    frame = spark.createDataFrame([(r.astype(float).tolist(),) for r in x], "v array<double>").repartition(40)
    found = ew.moments(frame, 7, lambda v: v.astype(np.int64), 7, ew.OFFSET)  # 40 states: more than one merge holds
    assert found.n == 3000 and np.allclose(found.m / found.n, exact, rtol=1e-12, atol=1e-8)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    a = a @ a.T
    values, axes = ew.symmetric_qr(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * values[0])
    assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-13) and np.allclose(a @ axes, axes * values, atol=1e-12 * values[0])


def test_ties_and_missing_variance():
    values, axes = ew.symmetric_qr(np.diag([2.0, 2.0, 0.0, 2.0]))
    assert values.tolist() == [2, 2, 2, 0] and np.allclose(np.abs(axes).sum(axis=0), 1)
    assert ew.symmetric_qr(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_degenerate_tables(spark, tmp_path):
    got = queries.queries()["op11_welford_qr"](spark, table(tmp_path, [(1, [1.0, 5.0]), (2, [1.0, 7.0]), (2, [1.0, 7.0])])).collect()
    second = [r for r in got if r.component == 2]
    assert len(got) == 6 and all(r.whitened is None and r.explained == 0 for r in second) and got[0].identity_error < 1e-12
    for name, rows in (("none", [(1, None)]), ("hollow", [(1, [])])):
        folder = tmp_path / name
        folder.mkdir()
        frame = pd.DataFrame({"vec_id": [1], "embedding": pd.Series([r[1] for r in rows])})
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"vec_id": [1], "embedding": pa.array(frame.embedding.tolist(), pa.list_(pa.float32()))}), folder / "embeddings.parquet")
        assert queries.queries()["op11_welford_qr"](spark, str(folder)).collect() == []


def test_no_silent_overflow():
    with pytest.raises(OverflowError):
        ew.quantised(np.array([[1e30]]))
    x = np.array([[2**41], [-(2**41)]], dtype=np.int64)
    with pytest.raises(OverflowError):
        ew.deviations(x, 2, (0,))
    assert ew.deviations(np.array([[3, 4]]), 2, (2, 2)) == [16 + 36]
