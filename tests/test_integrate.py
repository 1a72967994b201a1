"""Batch integration and continuity scores against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from meristem.operators import graphs, integrate, labels, scores


def batches(spark, n=60, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, 5)) * 4
    kind, grp = rng.integers(0, 3, n), rng.integers(0, 2, n)
    vec = centre[kind] + rng.normal(size=(n, 5)) * 0.2 + grp[:, None] * np.array([1.5, -1, 0, 0.5, 0])
    rows = [(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(grp, vec))]
    return spark.createDataFrame(rows, "id bigint, grp bigint, vec array<double>"), vec, kind, grp


def test_harmony_brings_batches_together(spark):
    p, vec, kind, grp = batches(spark)
    out = {r.id: r.vec for r in integrate.harmony(p, clusters=3).collect()}
    new = np.array([out[i] for i in range(len(vec))])
    gap = lambda x: np.mean([np.linalg.norm(x[(kind == k) & (grp == 0)].mean(0) - x[(kind == k) & (grp == 1)].mean(0)) for k in range(3)])
    assert gap(new) < 0.35 * gap(vec)
    assert integrate.harmony(p.where("grp = 0"), clusters=3).count() == int((grp == 0).sum())


def test_correction_is_the_ridge_solution():
    rng = np.random.default_rng(0)
    z, b, r = rng.normal(size=(40, 3)), rng.integers(0, 2, 40), rng.random((40, 1))
    counts = np.array([[r[b == k].sum() for k in (0, 1)]])
    sums = np.array([[(r * z)[b == k].sum(axis=0) for k in (0, 1)]])
    design = np.column_stack([np.ones(40), b == 0, b == 1]).astype(float)
    want = np.linalg.solve(design.T @ (r * design) + np.diag([0, 1.0, 1.0]), design.T @ (r * z))[1:]
    assert np.allclose(integrate.corrections(counts, sums, 1.0)[0], want)


def test_mnn_shift_is_the_weighted_mean_of_anchors(spark):
    p, vec, _, grp = batches(spark, 40)
    k, smooth = 3, 4
    d = np.sqrt(((vec[:, None] - vec[None]) ** 2).sum(-1))
    a, b = np.flatnonzero(grp == 1), np.flatnonzero(grp == 0)
    best = lambda i, pool: set(sorted(pool.tolist(), key=lambda j: (d[i, j], j))[:k])
    pairs = [(i, j) for i in a for j in best(i, b) if i in best(j, a)]
    shift = {i: np.mean([vec[j] - vec[i] for x, j in pairs if x == i], axis=0) for i in {i for i, _ in pairs}}
    out = {r.id: r.vec for r in integrate.mnn_correct(p, 0, k, smooth=smooth).collect()}
    for i in range(len(vec)):
        near = sorted(shift, key=lambda j: (d[i, j], j))[:smooth]
        w = np.exp(-d[i, near] ** 2 / 2)
        assert np.allclose(out[i], vec[i] + (w @ np.array([shift[j] for j in near]) / w.sum() if grp[i] else 0))


def test_normals_of_parallel_planes_go_on(spark):
    rng = np.random.default_rng(1)
    flat = [(i, i % 2, float(x), float(y), float(i % 2)) for i, (x, y) in enumerate(rng.random((60, 2)))]
    p = spark.createDataFrame(flat, "id bigint, grp bigint, x double, y double, z double")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(0, 60, 2)], "src bigint, dst bigint, w double")
    row = scores.normal_continuity(p, edges, k=6).first()
    assert row["n"] == 30 and abs(row["score"]) < 1e-9


def test_small_labels_follow_their_edges(spark):
    own = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d"), (6, "d")], "id bigint, label string")
    e = spark.createDataFrame([(3, 1, 1.0), (3, 2, 0.5), (3, 5, 1.2), (4, 3, 9.0)], "src bigint, dst bigint, w double")
    assert {r.id: r.label for r in labels.merge_small(e, own, 2).collect()} == {1: "a", 2: "a", 3: "a", 4: "c", 5: "d", 6: "d"}


def test_components_of_a_path_longer_than_any_cap(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(70)], "src bigint, dst bigint")
    assert {r.component for r in graphs.smallest_reachable(e).collect()} == {0}
    assert graphs.centrality(e.withColumn("w", F.lit(2.0))).where("id = 5").first()[1:] == (2, 4.0)


def test_mnn_makes_no_row_for_each_axis_and_keeps_to_the_reference(spark):
    from meristem import plans

    rng = np.random.default_rng(6)
    z = rng.normal(size=(90, 6))
    p = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(z)], "id bigint, grp bigint, vec array<double>")
    out = integrate.mnn_correct(p, 0, 4, 1.0, 5)
    assert "posexplode" not in plans.plan_text(out)
    got = {r.id: np.array(r.vec) for r in out.collect()}
    d, grp = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)), np.arange(90) % 3
    of = lambda i, g: [j for j in np.argsort(d[i]) if grp[j] == g][:4]
    shift = {}
    for i in range(90):
        if ends := [j for j in of(i, 0) if grp[i] and i in of(j, grp[i])]:
            shift[i] = (z[ends] - z[i]).mean(axis=0)
    for i in range(90):
        near = sorted((j for j in shift if grp[j] == grp[i]), key=lambda j: d[i, j])[:5] if grp[i] else []
        w = np.exp(-(d[i, near] ** 2) / 2)
        assert np.allclose(got[i], z[i] + (sum(a * shift[j] for a, j in zip(w, near, strict=True)) / w.sum() if near else 0))
