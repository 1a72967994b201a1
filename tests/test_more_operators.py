"""Matching, splitting, placing, regressing and rank correlation against plain versions."""

import numpy as np
import pytest

from meristem.operators import geometry, graphs, labels, learning, neighbors, network, preprocess, register, tables, trajectory


def plain_tau(x, y):
    s = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, tx, ty = s + a * b, tx + abs(a), ty + abs(b)
    return s / (tx * ty) ** 0.5 if tx * ty else None


@pytest.mark.parametrize("spread", [1, 2, 5, 1000])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 60])
def test_tau(n, spread):
    rng = np.random.default_rng(n * 7 + spread)
    x, y = rng.integers(0, spread, n).astype(float), rng.integers(0, spread, n).astype(float)
    want = plain_tau(x, y)
    assert network._tau(x, y) == (None if want is None else pytest.approx(want))


def test_kendall_of_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), int(g), float(rng.integers(0, 4))) for g in range(9) for c in range(30) if rng.random() < 0.8]
    cells = {g: {c: v for c, h, v in rows if h == g} for g in range(9)}
    frame = spark.createDataFrame(rows, "cell bigint, gene bigint, value double")
    found = {(r.a, r.b): r.r for r in network.kendall(frame, block=2).collect()}
    assert found == {(r.a, r.b): r.r for r in network.kendall(frame).collect()} and len(found) == 36
    for (a, b), r in found.items():
        both = sorted(cells[a].keys() & cells[b].keys())
        assert r == pytest.approx(plain_tau([cells[a][c] for c in both], [cells[b][c] for c in both]))


def test_kendall_of_nothing(spark):
    assert network.kendall(spark.createDataFrame([], "cell bigint, gene string, value double")).collect() == []


def test_ratio_matches(spark):
    e = spark.createDataFrame([(1, 5, 1.0), (1, 6, 2.0), (2, 5, 1.0), (2, 6, 1.0), (3, 5, 1.0), (4, 7, 0.0), (4, 6, 0.0)], "src bigint, dst bigint, dist double")
    assert [tuple(r) for r in neighbors.ratio_matches(e, 0.7).collect()] == [(1, 5, 1.0, 2.0)]


def test_laplacian(spark):
    e = spark.createDataFrame([(1, 2, 2.0), (2, 1, 2.0), (1, 3, 1.0)], "src bigint, dst bigint, w double")
    found = {(r.src, r.dst): r.w for r in graphs.laplacian(e, spark.createDataFrame([(1,), (2,), (3,)], "id bigint")).collect()}
    assert found == {(1, 2): pytest.approx(-2 / 6**0.5), (2, 1): pytest.approx(-2 / 6**0.5), (1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0}


def test_split_labels(spark):
    """Label a lies at 0 to 3 and at 10 to 12, with a lone point at 20; label b fills the gap and joins nothing."""
    at = [(i, "a", x) for i, x in enumerate([0, 1, 2, 3, 10, 11, 12, 20])] + [(10 + i, "b", x) for i, x in enumerate(range(4, 10))]
    p = spark.createDataFrame([(i, g, float(x), 0.0) for i, g, x in at], "id bigint, label string, x double, y double")
    found = {r.id: r.part for r in graphs.split_labels(p, neighbors.radius(p, 1.0), 3).collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: 1, 4: 5, 5: 5, 6: 5, 7: None, 10: 11, 11: 11, 12: 11, 13: 11, 14: 11, 15: 11}


def test_split_points_equals_split_labels(spark):
    rng = np.random.default_rng(11)
    xy = np.vstack([rng.random((250, 2)) * 14, rng.random((60, 2)) * 2 - 6, [[3.0, 4.0]] * 9, [[k * 1.0, -20.0] for k in range(12)]])
    rows = [(i * 7 % 1009, "ab"[i % 5 == 0], float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(2000, "a", None, 1.0), (2001, None, 1.0, 1.0), (2002, "a", float("nan"), 1.0)]
    p = spark.createDataFrame(rows, "id bigint, label string, x double, y double")
    for least in (2, 3, 5):
        want = {r.id: r.part for r in graphs.split_labels(p, neighbors.radius(p.where("x IS NOT NULL AND NOT isnan(x) AND label IS NOT NULL"), 1.0), least).collect()}
        assert {r.id: r.part for r in graphs.split_points(p, 1.0, least).collect()} == want


def test_labels_split_makes_no_row_a_pair(spark, tmp_path, monkeypatch):
    """500 points within one radius have 249,500 pairs."""
    from meristem import catalogue

    def pairs(*_, **__):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(neighbors, "radius", pairs)
    spark.createDataFrame([(i, [i / 1e5, 0.0, 0.0], 0) for i in range(500)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [(r.part, r["count"]) for r in catalogue.QUERIES["labels_split"](spark, str(tmp_path)).groupBy("part").count().collect()] == [(0, 500)]


def test_density_clusters_of_single_points(spark):
    nodes, none = spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([], "src bigint, dst bigint")
    assert sorted(tuple(r) for r in graphs.density_clusters(none, nodes, 1).collect()) == [(1, 1), (2, 2)]
    assert sorted(tuple(r) for r in graphs.density_clusters(none, nodes, 2).collect()) == [(1, None), (2, None)]


def test_place_cells(spark):
    m = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.9), (2, 2, 0.8), (3, 1, 0.5), (3, 2, 0.5)], "cell bigint, spot bigint, score double")
    spots = spark.createDataFrame([(1, 1), (2, 2), (9, 4)], "spot bigint, n int")
    assert sorted((r.spot, r.cell, r.kind) for r in tables.place_cells(m, spots).collect()) == [(1, 1, "max"), (1, 2, "max"), (1, 3, "max"), (2, 1, "add"), (2, 2, "add")]


def test_unpivot_edges(spark):
    m = spark.createDataFrame([("a", 1.0, -2.0), ("b", 0.0, None)], "k string, u double, v double")
    rows = lambda **o: sorted((tuple(r) for r in tables.unpivot_edges(m, "k", **o).collect()), key=str)
    assert rows() == [("a", "u", 1.0), ("a", "v", -2.0), ("b", "u", 0.0), ("b", "v", None)]
    assert rows(drop_negative=True, drop_zero=True) == [("a", "u", 1.0)]


def test_regressed(spark):
    rng = np.random.default_rng(5)
    c, x = rng.normal(size=20), rng.poisson(1.5, (20, 3)).astype(float)
    x[:, 2] = 0
    x[3, 2] = 4
    frame = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(20) for g in range(3) if x[i, g]], "cell bigint, gene bigint, value double")
    found = preprocess.regressed(frame, spark.createDataFrame([(i, float(v)) for i, v in enumerate(c)], "cell bigint, c double")).collect()
    design = np.column_stack([np.ones(20), c])
    left = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
    want = left / left.std(axis=0, ddof=1)
    assert len(found) == (x > 0).sum()
    assert all(r.z == pytest.approx(want[r.cell, r.gene]) for r in found)


def test_over_folds(spark):
    rows = [(1, 0, [0.6, 0.4]), (1, 1, [0.3, 0.7]), (2, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5])]
    found = sorted(tuple(r) for r in learning.over_folds(spark.createDataFrame(rows, "id bigint, predicted int, p array<double>")).collect())
    assert found == [(1, 0, [pytest.approx(0.45), pytest.approx(0.55)], 1, pytest.approx(0.55)), (2, 1, [0.5, 0.5], 0, 0.5)]


def test_adaptive_ransac(spark):
    rng = np.random.default_rng(11)
    src = rng.uniform(-5, 5, (400, 2))
    turn = np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
    dst = src @ turn.T + [0.4, -0.2] + rng.normal(scale=0.01, size=(400, 2))
    dst[:80] += rng.uniform(2, 6, (80, 2))
    pairs = spark.createDataFrame(np.hstack([src, dst]).tolist(), "x double, y double, u double, v double")
    m, n, _ = register.adaptive_ransac(pairs, ("x", "y"), ("u", "v"), "rigid", least=50, sample=5)
    assert np.abs(m[:2, :2] - turn).max() < 5e-3 and np.abs(m[:2, 2] - [0.4, -0.2]).max() < 2e-2
    assert 150 <= n <= 320


def test_smoothed(spark):
    """Against the dense solution; id 6 has no edges, and an edge leads to an id without values."""
    rng = np.random.default_rng(2)
    q = rng.uniform(size=(7, 3))
    e = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 0), (0, 99), (2, 2)]
    w = np.zeros((7, 7))
    for a, b in e[:6]:
        w[a, b] += 0.5
        w[b, a] += 0.5
    want = np.linalg.solve(np.eye(7) + 2.0 * (np.diag(w.sum(axis=1)) - w), q)
    values = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id bigint, p array<double>")
    found = labels.smoothed(values, spark.createDataFrame([(a, b, 1.0) for a, b in e], "src bigint, dst bigint, w double"), 2.0).collect()
    assert {r.id for r in found} == set(range(7)) and all(r.p == pytest.approx(want[r.id], abs=1e-8) for r in found)
    assert labels.smoothed(values.where("false"), spark.createDataFrame([], "src bigint, dst bigint, w double")).collect() == []


def test_linear_weights(spark):
    """Three neighbours in three dimensions rebuild a point inside them; a point among copies of itself weighs them alike."""
    at = {0: [0.2, 0.3, 0.0], 1: [0.0, 0.0, 0.0], 2: [1.0, 0.0, 0.0], 3: [0.0, 1.0, 0.0], 4: [5.0] * 3, 5: [5.0] * 3, 6: [5.0] * 3}
    p = spark.createDataFrame(list(at.items()), "id bigint, vec array<double>")
    e = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (4, 5), (4, 6)], "src bigint, dst bigint")
    found = {(r.src, r.dst): r.w for r in graphs.linear_weights(p, e).collect()}
    assert found == {(0, 1): pytest.approx(0.5), (0, 2): pytest.approx(0.2), (0, 3): pytest.approx(0.3), (4, 5): pytest.approx(0.5), (4, 6): pytest.approx(0.5)}


def test_diffusion_components(spark):
    rng = np.random.default_rng(4)
    x = np.sort(rng.uniform(0, 4, 25))
    w = np.exp(-((x[:, None] - x[None]) ** 2))
    w /= np.sqrt(np.outer(w.sum(axis=1), w.sum(axis=1)))
    frame = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(25) for j in range(25)], "src bigint, dst bigint, w double")
    values, out = trajectory.diffusion_components(frame, 2, tolerance=1e-10)
    want, vectors = np.linalg.eigh(w)
    assert values == pytest.approx(want[::-1][:2], abs=1e-6)
    found = np.array([r.vec for r in out.orderBy("id").collect()])
    assert np.abs(np.abs((found * vectors[:, ::-1][:, :2]).sum(axis=0)) - 1).max() < 1e-4
    assert (found.sum(axis=0) >= 0).all()


def test_thinned(spark):
    visits = spark.createDataFrame([(i, p) for i, p in enumerate([0.0] * 50 + [1.0] * 50 + [0.5] * 400)], "id bigint, p double")
    found = {r.id: r.n for r in trajectory.thinned(visits, 20, 1).collect()}
    assert not any(i in found for i in range(50)) and all(found[i] == 20 for i in range(50, 100))
    rest = [n for i, n in found.items() if i >= 100]
    # A kept visit's n is size-biased: its mean is E[n^2] / E[n] = 10.5, and half of the visits stay.
    assert 150 < len(rest) < 250 and abs(np.mean(rest) - 10.5) < 0.6


def test_doublet_pairs(spark):
    cells = spark.range(7).withColumnRenamed("id", "id")
    found = preprocess.doublet_pairs(cells, 2).collect()
    assert sorted(r.id for r in found) == list(range(-14, 0))
    for turn in (range(-7, 0), range(-14, -7)):
        part = [r for r in found if r.id in turn]
        assert {r.a for r in part} == {r.b for r in part} == set(range(7)) and all(r.a != r.b for r in part)
    assert preprocess.doublet_pairs(cells.where("id > 9")).collect() == []


def test_matrices():
    m = np.array([[0.0, -1.0, 3.0], [1.0, 0.0, 4.0], [0.0, 0.0, 1.0]])
    assert geometry.mirrored(m, 10, 0) @ [2, 5, 1] == pytest.approx(m @ [7, 5, 1])
    x, y, _ = m @ [2, 5, 1]
    assert geometry.swapped_axes(m) @ [5, 2, 1] == pytest.approx([y, x, 1])
    assert geometry.rescaled_matrix(m, 2.0) @ [4, 10, 1] == pytest.approx([2 * x + 2, 2 * y + 2, 1])
    assert geometry.rescaled_matrix(m, [2.0, 3.0], back=False) @ [2, 5, 1] == pytest.approx([2 * x + 2, 3 * y + 3, 1])


def test_local_quadratic_works_on_distinct_x():
    """Against one regression a row over its q nearest rows; and many rows of few values take no longer than the values."""
    import math
    import time

    from meristem.operators import residual

    rng = np.random.default_rng(2)
    for x in (rng.integers(1, 40, 300) / 7.0, rng.normal(size=120)):
        y, q = np.sin(x) + rng.normal(size=len(x)), math.ceil(0.3 * len(x))
        got = residual.local_quadratic(x, y)
        for k in range(0, len(x), 9):
            d = np.abs(x - x[k])
            near = np.argsort(d, kind="stable")[:q]
            w = np.sqrt((1 - np.minimum(1, d[near] / d[near].max()) ** 3) ** 3 + 1e-9)
            a = np.column_stack([np.ones(q), x[near] - x[k], (x[near] - x[k]) ** 2]) * w[:, None]
            assert got[k] == pytest.approx(np.linalg.lstsq(a, y[near] * w, rcond=None)[0][0], abs=1e-6)
    x = rng.integers(1, 1500, 1_000_000) / 60_000
    began = time.perf_counter()
    residual.local_quadratic(x, x * x)
    assert time.perf_counter() - began < 20
