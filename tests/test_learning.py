"""Learning, descriptors, residual components and mixing proportions against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meristem.operators import decompose, descriptors, geometry, learning, register


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 3, 150)
    vec = rng.normal(size=(150, 4)) * 0.4 + np.eye(4)[label] * 2
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vec, label))]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, label bigint").persist()


def test_folds_part_every_repeat(labelled):
    got = learning.folds(labelled, 4, 2).groupBy("repeat").agg(F.countDistinct("id").alias("n"), F.count("*").alias("all"), F.countDistinct("fold").alias("f"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 150, 150, 4), (1, 150, 150, 4)]


def test_held_out_scores_equal_plain_ones(labelled):
    found, models = learning.held_out(labelled, "logistic", n=3)
    rows = found.collect()
    assert sorted(r.id for r in rows) == list(range(150)) and len(models) == 3
    true, said = np.array([r.label for r in rows]), np.array([r.predicted for r in rows])
    s = learning.class_scores(found).first()
    each = [((true == k) & (said == k)).sum() for k in range(3)]
    recall, precision = [e / (true == k).sum() for k, e in enumerate(each)], [e / (said == k).sum() for k, e in enumerate(each)]
    assert s.accuracy == pytest.approx((true == said).mean()) and s.accuracy > 0.9
    assert (s.balanced, s.precision) == (pytest.approx(np.mean(recall)), pytest.approx(np.mean(precision)))
    both = learning.together(models, labelled)
    assert both.count() == 150 and both.where("share < 1.0 / 3 OR abs(aggregate(probability, 0D, (a, x) -> a + x) - 1) > 1e-9").isEmpty()


def test_search_and_persistence(labelled, tmp_path):
    model, best = learning.search(labelled, "tree", grid={"maxDepth": [1, 4]})
    assert best == {"maxDepth": 4}
    learning.save(model, f"{tmp_path}/model")
    again = learning.load(f"{tmp_path}/model")
    said = lambda m: sorted((r.id, r.predicted) for r in learning.predict(m, labelled).collect())
    assert said(again) == said(model)
    assert learning.importances(again).shape == (1, 4) and learning.importances(again)[0, 3] < 0.2


@pytest.mark.parametrize("name,kind", [(n, "class") for n in learning.CLASSIFIERS] + [(n, "value") for n in learning.REGRESSORS])
def test_every_estimator_fits_and_explains(labelled, name, kind):
    if name in ("boosted", "factorisation") and kind == "class":
        model = learning.estimator(name)[0].setFeaturesCol("features").fit(learning._features(labelled.where("label < 2").limit(40)))
    else:
        model = learning.estimator(name, kind)[0].fit(learning._features(labelled))
    assert learning.importances(model).shape[1] == 4
    assert learning.predict(model, labelled.drop("label")).count() == 150


def test_no_rows_have_no_scores(labelled):
    empty = labelled.where("false").withColumn("predicted", F.lit(0.0))
    assert learning.class_scores(empty, ["id"]).isEmpty()


def test_residual_vectors_equal_dense_residuals(spark):
    x = np.random.default_rng(3).poisson(1.5, (12, 6)).astype(float)
    x[:, 0] += 1
    expr = spark.createDataFrame([(c, g, float(x[c, g])) for c in range(12) for g in range(6) if x[c, g]], "cell bigint, gene bigint, value double")
    mu = x.sum(1, keepdims=True) * x.sum(0) / x.sum()
    want = np.sign(x - mu) * np.sqrt(np.maximum(2 * (np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / mu), 0) - (x - mu)), 0))
    got = {r.cell: r.vec for r in decompose.residual_vectors(expr).collect()}
    assert np.allclose([got[c] for c in range(12)], want)
    got = {r.cell: r.vec for r in decompose.residual_vectors(expr, "pearson").collect()}
    assert np.allclose([got[c] for c in range(12)], (x - mu) / np.sqrt(mu))
    with pytest.raises(ValueError):
        decompose.residual_vectors(expr, most=5)
    assert decompose.residual_vectors(expr.where("false")).count() == 0


def test_mixing_proportions(spark):
    mass = np.array([2.0, 0.0, 1.0, 4.0])
    outlier, own = register.mixing(mass, 10)
    assert outlier == pytest.approx(0.3) and own.sum() == pytest.approx(7) and own[3] == pytest.approx(4)
    assert register.mixing(np.zeros(3), 5)[0] == pytest.approx(1 - 1e-4)
    rng = np.random.default_rng(6)
    xy = rng.random((80, 2))
    turn = np.array([[np.cos(0.1), -np.sin(0.1), 0.05], [np.sin(0.1), np.cos(0.1), -0.03], [0, 0, 1]])
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xy)], "id bigint, x double, y double")
    # A fifth of the moving points have no counterpart.
    fixed = geometry.transform_points(p.where("id >= 16"), turn)
    m, _ = register.em_register(fixed, p, "rigid", mixed=True)
    assert np.allclose(m, turn, atol=0.02)


def test_equal_proportions_change_nothing(spark):
    rng = np.random.default_rng(7)
    y = rng.random((20, 2))
    fixed = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.random((30, 2)))], "id bigint, x double, y double")
    plain = register.expectation(fixed, y, y, 0.05, 0.2, ("x", "y"))
    mixed = register.expectation(fixed, y, y, 0.05, 0.2, ("x", "y"), np.full(20, 0.8 * 30 / 20))
    assert np.allclose(plain["second"], mixed["second"]) and plain["residual"] == pytest.approx(mixed["residual"]) and np.allclose(plain["mass"], mixed["mass"])
    d2 = ((np.array([[r.x, r.y] for r in fixed.collect()])[:, None] - y[None]) ** 2).sum(2)
    p = np.exp(-d2 / 0.1)
    p /= p.sum(1, keepdims=True) + 2 * np.pi * 0.05 * 0.25 * 20 / 30
    assert np.allclose(plain["mass"], p.sum(0))


def test_normals_face_the_viewpoint(spark):
    p = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, -1.0, 0.0, 0.0)], "id bigint, x double, y double, z double")
    n = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], "id bigint, nx double, ny double, nz double")
    assert {r.id: r.nx for r in descriptors.facing(p, n).collect()} == {1: -1.0, 2: 1.0}


def test_gauss_sums_equal_the_dense_ones():
    from meristem.operators import gauss

    rng = np.random.default_rng(8)
    y, x, w = rng.normal(size=(400, 2)), rng.normal(size=(300, 2)) * 1.2, rng.random(400)
    low, high = np.minimum(x.min(0), y.min(0)), np.maximum(x.max(0), y.max(0))
    for s in (1.0, 0.2, 0.03, 1e-4):
        constant = 0.7 * s * s
        p = np.exp(-((x[:, None] - y[None]) ** 2).sum(2) / (2 * s * s)) * w
        p /= p.sum(1, keepdims=True) + constant
        reach = gauss.chosen(y, len(x), s * s, constant, low, high)[1]
        for form in (gauss.Grid, gauss.Near)[s < 0.1 :]:
            sums = form(y, s * s, low, high, reach)
            sums.begin(w)
            rows = np.concatenate([sums.add(x[:200], constant), sums.add(x[200:], constant)])
            mass, target = sums.end()
            assert np.allclose(rows, p.sum(1), atol=1e-11) and np.allclose(mass, p.sum(0), atol=1e-11) and np.allclose(target, p.T @ x, atol=1e-11)


def test_gauss_work_does_not_grow_with_the_product():
    from meristem.operators import gauss

    y = np.random.default_rng(9).normal(size=(100_000, 2)) * 0.125
    low, high = y.min(0), y.max(0)
    assert gauss.chosen(y, len(y), 0.03**2, 1e-4, low, high)[0] is gauss.Grid
    form, reach = gauss.chosen(y, len(y), 1e-8, 1e-9, low, high)
    assert form is gauss.Near and gauss.Near(y, 1e-8, low, high, reach).pairs() < len(y) ** 2 / 20


def test_expectation_in_space_and_with_no_fixed_points(spark):
    rng = np.random.default_rng(10)
    y, x = rng.random((30, 3)), rng.random((40, 3))
    fixed = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id bigint, x double, y double, z double")
    got = register.expectation(fixed, y, y, 0.01, 0.2, ("x", "y", "z"))
    d2 = ((x[:, None] - y[None]) ** 2).sum(2)
    p = np.exp(-d2 / 0.02)
    p /= p.sum(1, keepdims=True) + (2 * np.pi * 0.01) ** 1.5 * 0.25 * 30 / 40
    assert np.allclose(got["mass"], p.sum(0)) and got["residual"] == pytest.approx((p * d2).sum()) and got["w"] == pytest.approx(p.sum())
    assert register.expectation(fixed.where("false"), y, y, 0.01, 0.2, ("x", "y", "z"))["w"] == 0
