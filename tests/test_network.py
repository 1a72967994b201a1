"""Blocked pair sums and the statistics on them against dense numpy."""

import numpy as np
import pytest

from meristem.operators import network, preprocess, stats


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(9)
    x = rng.poisson(1.2, (30, 17)).astype(float)
    rows = [(c, f"g{g:02d}", float(x[c, g])) for c in range(30) for g in range(17) if x[c, g]]
    return x, spark.createDataFrame(rows, "cell bigint, gene string, value double").persist()


@pytest.mark.parametrize("block,chunk", [(512, 4096), (4, 7), (1, 30)])
def test_pair_sums(counts, block, chunk):
    x, expr = counts
    h = (x > 0).astype(float)
    got = {(r.a, r.b): r for r in network.pair_sums(expr, block, chunk).collect()}
    for i in range(17):
        for j in range(i + 1, 17):
            if (h[:, i] * h[:, j]).any():
                r = got.pop((f"g{i:02d}", f"g{j:02d}"))
                want = [h[:, i] @ h[:, j], x[:, i] @ x[:, j], x[:, i] @ h[:, j], h[:, i] @ x[:, j], x[:, i] ** 2 @ h[:, j], h[:, i] @ x[:, j] ** 2]
                assert np.allclose([r.n, r.xy, r.x, r.y, r.xx, r.yy], want)
    assert not got


def test_bicor(counts):
    x, expr = counts
    z = np.zeros_like(x)
    for g in range(17):
        own = x[x[:, g] > 0, g]
        apart = own - np.median(own)
        mad = np.median(abs(apart))
        u = apart / (9 * mad) if mad else np.full(len(own), np.inf)
        t = apart * np.where(abs(u) < 1, (1 - u * u) ** 2, 0) if mad else np.zeros(len(own))
        z[x[:, g] > 0, g] = t / np.sqrt((t * t).sum()) if (t * t).sum() else 0
    for r in network.bicor(expr).collect():
        if r.r is not None:
            assert r.r == pytest.approx(z[:, int(r.a[1:])] @ z[:, int(r.b[1:])], abs=1e-9)


@pytest.mark.parametrize("gene_rows,size_rows", [(4096, 65536), (5, 3)])
def test_residual_variance(counts, gene_rows, size_rows):
    x, expr = counts
    mu = x.sum(1, keepdims=True) * x.sum(0) / x.sum()
    r = np.clip((x - mu) / np.sqrt(mu + mu * mu / 100), -np.sqrt(30), np.sqrt(30))
    got = {v.gene: v.residual_variance for v in preprocess.residual_variance(expr, 30, gene_rows=gene_rows, size_rows=size_rows).collect()}
    assert np.allclose([got[f"g{g:02d}"] for g in range(17)], r.var(0))


def test_no_entries(counts):
    expr = counts[1].where("false")
    assert network.pair_sums(expr).isEmpty() and network.gene_correlation(expr, 3).isEmpty() and preprocess.residual_variance(expr, 3).isEmpty()


@pytest.mark.parametrize("by", [None, ["grp"]])
def test_adjusted_p_values(spark, by):
    p = np.round(np.random.default_rng(5).random(60), 1)
    rows = [(i, 1, None if i % 17 == 0 else float(v)) for i, v in enumerate(p)]
    table = spark.createDataFrame(rows, "id bigint, grp bigint, p double")
    got = {r.id: r.q for r in stats.bh_adjust(table, by=by).collect()}
    own = sorted((v, i) for i, _, v in rows if v is not None)
    want, low = {}, 1.0
    for k in range(len(own), 0, -1):
        low = min(low, own[k - 1][0] * len(own) / k)
        want[own[k - 1][1]] = low
    assert got == {i: pytest.approx(want[i]) if i in want else None for i in range(60)}
    assert stats.bh_adjust(table.where("false"), by=by).isEmpty()
