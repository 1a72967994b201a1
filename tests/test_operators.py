"""Operators without an exact SQL twin, against numpy or by their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meristem import plans
from meristem.operators import decompose, geometry, interp, neighbors, network, register, stats, tables, trajectory


def cloud(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    xy = rng.normal(size=(n, 2))
    return spark.createDataFrame([(i, float(x), float(y), [float(x), float(y)]) for i, (x, y) in enumerate(xy)], "id bigint, x double, y double, vec array<double>"), xy


def test_knn_blocks_agree(spark):
    p, xy = cloud(spark)
    one = {(r.src, r.rank): (r.dst, round(r.dist, 9)) for r in neighbors.knn(p, k=4).collect()}
    many = {(r.src, r.rank): (r.dst, round(r.dist, 9)) for r in neighbors.knn(p, k=4, block_bytes=16 * 20).collect()}
    assert one == many and len(one) == 60 * 4
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert all(one[(i, 1)][0] == int(d[i].argmin()) for i in range(60))


def test_knn_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(5)
    vectors = np.vstack([np.ones((100, 8)) * 0.1, rng.normal(size=(60, 8)), rng.normal(size=(30, 8)).round(0)])
    ids = rng.permutation(1000)[: len(vectors)]
    p = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "id bigint, vec array<double>")
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1))
    for parameters in ({}, {"block_bytes": 8 * 8 * 30, "query_rows": 40}):
        got = {(r.src, r.rank): r.dst for r in neighbors.knn(p, k=5, exclude_self=False, **parameters).collect()}
        for q in range(len(vectors)):
            assert [got[(int(ids[q]), k + 1)] for k in range(5)] == ids[np.lexsort((ids, d[q]))[:5]].tolist()


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
@pytest.mark.parametrize("k", [1, 7, 300])
def test_best_in_few_dimensions_leaves_nothing_out(dims, k):
    rng = np.random.default_rng(dims)
    ref = np.vstack([rng.normal(size=(900, dims)), rng.normal(size=(300, dims)).round(0), 1e9 + rng.normal(size=(200, dims)), np.full((3, dims), np.nan), np.full((2, dims), np.inf), np.full((2, dims), 1e200)])
    q = np.vstack([ref[::7], rng.normal(size=(50, dims)) * 50, np.full((2, dims), np.nan)])
    ids, kind = rng.permutation(len(ref)), rng.integers(0, 3, len(ref))
    for barred in (None, lambda r, c: (kind[r] == kind[c]) | (c < 40)):
        got = {}
        for r, c, dist in neighbors._best(q, ref, ids, k, barred):
            for row, *pair in zip(r.tolist(), c.tolist(), dist.tolist()):
                got.setdefault(row, []).append(tuple(pair))
        with np.errstate(over="ignore", invalid="ignore"):
            for i, own in enumerate(q):
                d = np.sqrt(((ref - own) ** 2).sum(axis=1))
                ok = np.flatnonzero(np.isfinite(d) & (True if barred is None else ~barred(np.full(len(ref), i), np.arange(len(ref)))))
                assert got.get(i, []) == [(int(c), float(d[c])) for c in ok[np.lexsort((ids[ok], d[ok]))][:k]]


def test_best_in_few_dimensions_meets_few_leaves(monkeypatch):
    """Pairs that are computed, counted by the barred ones asked for: with every pair of a leaf met, all 4e8 would be."""
    xy = np.random.default_rng(2).normal(size=(20_000, 2))
    asked = []

    def barred(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        asked.append(len(r))
        return r == c

    found = sum(len(r) for r, _, _ in neighbors._best(xy, xy, np.arange(len(xy)), 4, barred))
    assert found == 80_000 and sum(asked) < 20_000 * 400


@pytest.mark.parametrize("dims", [5, 64])
@pytest.mark.parametrize("odd", [None, np.nan, np.inf, 1e200])
def test_best_in_many_dimensions_leaves_nothing_out(dims, odd):
    rng = np.random.default_rng(dims)
    ref = np.vstack([rng.normal(size=(2400, dims)), rng.normal(size=(200, dims)).round(0)])
    if odd is not None:
        ref[[17, 22, 33], 2] = odd
    q = np.vstack([ref[::11], rng.normal(size=(30, dims)) * 5])
    ids, kind = rng.permutation(len(ref)), rng.integers(0, 3, len(ref))
    for k, barred in ((1, None), (7, lambda r, c: (kind[r] == kind[c]) | (c < 40)), (300, None)):
        got = {}
        for r, c, dist in neighbors._best(q, ref, ids, k, barred):
            for row, *pair in zip(r.tolist(), c.tolist(), dist.tolist()):
                got.setdefault(row, []).append(tuple(pair))
        with np.errstate(over="ignore", invalid="ignore"):
            for i, own in enumerate(q):
                d = np.sqrt(((ref - own) ** 2).sum(axis=1))
                ok = np.flatnonzero(np.isfinite(d) & (True if barred is None else ~barred(np.full(len(ref), i), np.arange(len(ref)))))
                assert got.get(i, []) == [(int(c), float(d[c])) for c in ok[np.lexsort((ids[ok], d[ok]))][:k]]


def test_best_in_many_dimensions_looks_through_few_distances(monkeypatch):
    """Distances that are looked through one by one: without strips, all 2.6e7 would be."""
    rng = np.random.default_rng(6)
    ref, looked, plain = rng.normal(size=(256 + 25 * 2048, 8)), [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda a: looked.append(np.size(a)) or plain(a))
    found = sum(len(r) for r, _, _ in neighbors._best(ref[:512], ref, np.arange(len(ref)), 3))
    assert found == 3 * 512 and sum(looked) < len(ref) * 512 / 5


def test_matched_score_has_no_row_for_each_neighbour_of_a_neighbour(spark):
    rng = np.random.default_rng(8)
    feature, place = rng.normal(size=(2, 40, 3)), rng.normal(size=(2, 40, 2))
    near = lambda a, b, k: np.argsort(((a[:, None] - b[None]) ** 2).sum(-1), axis=1)[:, :k]
    found = [near(feature[1], feature[0], 9), near(feature[0], feature[1], 9), near(place[0], place[0], 6), near(place[1], place[1], 6)]
    qr, rq, rr, qq = (spark.createDataFrame([(i, int(j), n + 1) for i, row in enumerate(e) for n, j in enumerate(row)], "src bigint, dst bigint, rank int") for e in found)
    out = neighbors.matched_score(qr, rq, rr, qq, 4, 9, 6)
    assert "via" not in plans.plan_text(out)
    want = {}
    for q in range(40):
        for r in found[0][q, :4].tolist():
            if q in found[1][r, :4]:
                a, b = sum(r in found[2][v] for v in found[0][q]), sum(q in found[3][v] for v in found[1][r])
                if a and b:
                    want[r, q] = np.sqrt(np.sqrt(a * b) / 6)
    assert {(x.r, x.q): x.score for x in out.collect()} == pytest.approx(want) and len(want) > 5


def test_mutual_computes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    e = spark.createDataFrame([(i, (i * 7) % 20) for i in range(20)], "src bigint, dst bigint").mapInArrow(seen, "src bigint, dst bigint")
    got = {(r.src, r.dst) for r in neighbors.mutual(e).collect()}
    assert got == {(i, (i * 7) % 20) for i in range(20) if (i * 49) % 20 == i} and made.value == 20


def test_shortest_is_a_global_rank(spark):
    rows = [(k % 7, k, float(k % 5)) for k in range(200)]
    e = spark.createDataFrame(rows, "src bigint, dst bigint, dist double")
    got = {(r.src, r.dst, r.dist) for r in neighbors.shortest(e, 0.45).collect()}
    assert got == set(sorted(rows, key=lambda r: (r[2], r[0], r[1]))[:90])
    assert neighbors.shortest(e.where("false"), 0.5).count() == 0


def test_knn_empty_and_nulls(spark):
    p, _ = cloud(spark, 5)
    assert neighbors.knn(p.where("id < 0"), k=3).count() == 0
    holes = p.unionByName(spark.createDataFrame([(None, 0.0, 0.0, [0.0, 0.0]), (9, 0.0, 0.0, None)], p.schema))
    assert neighbors.knn(holes, k=2).count() == 10


def test_radius_is_symmetric(spark):
    p, xy = cloud(spark)
    got = {(r.src, r.dst) for r in neighbors.radius(p, 0.5).collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.5))}


def test_procrustes_and_em_recover_a_rotation(spark):
    p, _ = cloud(spark, 80)
    t = geometry.compose([[np.cos(0.2), -np.sin(0.2)], [np.sin(0.2), np.cos(0.2)]], None, [0.1, -0.05])
    moved = geometry.transform_points(p.select("id", "x", "y"), t)
    m, s2 = register.em_register(moved, p.select("id", "x", "y"), "rigid")
    assert np.allclose(m, t, atol=1e-3) and s2 < 1e-3
    assert np.allclose(geometry.decompose(t)["rotation"], t[:2, :2])
    back = geometry.transform_points(moved, t, inverse=True).join(p.select("id", F.col("x").alias("u")), "id")
    assert back.agg(F.max(F.abs(F.col("x") - F.col("u")))).first()[0] < 1e-9


def test_ransac_survives_outliers(spark):
    p, _ = cloud(spark, 50)
    pairs = p.select("x", "y", (F.col("x") + 2).alias("u"), F.when(F.col("id") % 4 == 0, F.lit(9.0)).otherwise(F.col("y") - 1).alias("v"))
    m, n = register.ransac(pairs, ("x", "y"), ("u", "v"), 0.01, trials=60)
    assert np.allclose(m[:2, 2], [2, -1], atol=1e-6) and n >= 37


def test_ransac_counts_every_pair(spark):
    p = spark.range(70_000).select("id", (F.col("id") % 331).cast("double").alias("x"), (F.col("id") % 577).cast("double").alias("y"))
    pairs = p.select("x", "y", (F.col("x") + 2).alias("u"), F.when(F.col("id") % 7 == 0, -F.col("y") - 5).otherwise(F.col("y") - 1).alias("v"))
    m, n = register.ransac(pairs, ("x", "y"), ("u", "v"), 0.01, trials=60)
    assert np.allclose(m, [[1, 0, 2], [0, 1, -1], [0, 0, 1]], atol=1e-6) and n == 60_000


def test_sinkhorn_marginals(spark):
    c = spark.range(4).select(F.col("id").alias("a")).crossJoin(spark.range(5).select(F.col("id").alias("b"))).withColumn("cost", (F.col("a") - F.col("b")) ** 2 / 10.0)
    plan = register.sinkhorn(c, 0.5, 30)
    assert plan.groupBy("b").agg(F.sum("plan").alias("s")).agg(F.max(F.abs(F.col("s") - 0.2))).first()[0] < 1e-6


def test_sinkhorn_slices_plan_every_cell(spark):
    rng = np.random.default_rng(5)
    xy = [rng.normal(size=(n, 2)) * 0.3 for n in (60, 70, 55)]
    p = spark.createDataFrame([(100 * g + i, g, float(a), float(b)) for g, x in enumerate(xy) for i, (a, b) in enumerate(x)], "id bigint, grp bigint, x double, y double")
    got = {(r.pair, r.a, r.b): r.plan for r in register.sinkhorn_slices(p, 0.2, 25).collect()}
    assert len(got) == 60 * 70 + 70 * 55
    for g in (0, 1):
        k = np.exp(-np.sqrt(((xy[g][:, None] - xy[g + 1][None]) ** 2).sum(-1)) / 0.2)
        u = np.ones(len(k))
        for _ in range(25):
            v = 1 / k.shape[1] / (k.T @ u)
            u = 1 / k.shape[0] / (k @ v)
        want = u[:, None] * k * v
        assert np.allclose([[got[(g, 100 * g + i, 100 * (g + 1) + j)] for j in range(k.shape[1])] for i in range(len(k))], want, atol=1e-9)


def test_pca_and_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "vec array<double>")
    v, values, mean = decompose.pca(df, 5)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]) and np.allclose(mean, x.mean(0))
    y = x @ np.array([[1.0], [2.0], [0.0], [-1.0], [0.5]])
    both = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, y array<double>")
    assert np.allclose(decompose.ridge(both, "x", "y", 1e-9).ravel(), [1, 2, 0, -1, 0.5], atol=1e-5)
    assert decompose.gram(df.where("false"))[0] == 0


def test_dual_pca_factors(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 6)), rng.normal(size=(40, 6))
    make = lambda m: spark.createDataFrame([(r.tolist(),) for r in m], "vec array<double>")
    _, _, s = decompose.dual_pca(make(x), make(y), 3)
    assert np.allclose(s, np.linalg.svd(x @ y.T, compute_uv=False)[:3])


def test_kmeans_separates(spark):
    rows = [(i, [float(10 * (i % 3)), float(i % 2) / 10]) for i in range(60)]
    found, _ = decompose.kmeans(spark.createDataFrame(rows, "id bigint, vec array<double>"), 3)
    got = {(r.id % 3): r.cluster for r in found.collect()}
    assert len(set(got.values())) == 3 and found.groupBy((F.col("id") % 3).alias("m")).agg(F.count_distinct("cluster").alias("n")).where("n > 1").isEmpty()


def test_bh_invariants(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.2, 0.005))], "id bigint, p double")
    assert [r.q for r in stats.bh_adjust(df).orderBy("id").collect()] == pytest.approx([0.025, 0.05, 0.05, 0.2, 0.025])


def test_overlap_is_symmetric_and_bounded(spark):
    cor = spark.createDataFrame([(a, b, 0.1 * (a + b) / 2) for a in range(5) for b in range(a + 1, 5)], "a bigint, b bigint, r double")
    t = {(r.a, r.b): r.tom for r in network.overlap(network.adjacency(cor, 1)).collect()}
    assert all(abs(t[(b, a)] - v) < 1e-12 and 0 <= v <= 1 for (a, b), v in t.items())


def test_walks_end_at_the_ends(spark):
    t = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "src bigint, dst bigint, w double")
    w = trajectory.random_walks(t, [0], [6], 5)
    assert w.groupBy("walk").agg(F.max("id").alias("end")).where("end <> 6").isEmpty() and w.count() == 35


def test_flood_reaches_all(spark):
    t = spark.createDataFrame([(i, j, 1.0) for i in range(5) for j in (i - 1, i + 1) if 0 <= j < 5], "src bigint, dst bigint, p double")
    f = trajectory.flood_pseudotime(trajectory.flood(t, [0], 3, least=1))
    assert [round(r.pseudotime, 3) for r in f.orderBy("id").collect()] == [0.0, 0.25, 0.5, 0.75, 1.0]


def test_inside_mesh(spark):
    corners = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    faces = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    tri = [(k, *[float(c) for v in f for c in corners[v]]) for k, f in enumerate(faces)]
    cols = "tri int, " + ", ".join(f"{a}{i} double" for i in range(3) for a in "xyz")
    p = spark.createDataFrame([(0, 0.1, 0.12, 0.1), (1, 0.9, 0.8, 0.9), (2, 0.3, 0.31, 0.2), (3, 0.1, 0.1, -0.5)], "id bigint, x double, y double, z double")
    assert sorted(r.id for r in interp.inside_mesh(p, spark.createDataFrame(tri, cols), 0.5).collect()) == [0, 2]


def test_split_by_share(spark):
    m = spark.createDataFrame([("s", "a", 0.9), ("s", "b", 0.8), ("s", "c", 0.1)], "spot string, cell string, score double")
    ref = spark.createDataFrame([("a", "g", 3.0), ("b", "g", 1.0)], "cell string, gene string, value double")
    sp = spark.createDataFrame([("s", "g", 8.0), ("s", "h", 2.0)], "spot string, gene string, value double")
    got = {(r.cell, r.gene): r.value for r in tables.split_by_share(m, sp, ref, spark.createDataFrame([("s", 2)], "spot string, n int")).collect()}
    assert got == {("a", "g"): 6.0, ("b", "g"): 2.0, ("a", "h"): 1.0, ("b", "h"): 1.0}


def test_stack_score_falls_with_degradation(spark):
    """The one pass/fail property of the synthetic stack: the chamfer part of its score falls as slices are disturbed."""
    rng = np.random.default_rng(42)
    base = np.vstack([rng.normal(c, 0.3, size=(60, 2)) for c in ((0, 0), (2, 0), (1, 2))])
    totals = []
    for level in (0.0, 0.5, 1.5):
        noise = np.random.default_rng(7)
        rows = []
        for s in range(3):
            turn = 0.05 * s + level * noise.normal()
            r = np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
            xy = base @ r.T + level * noise.normal(size=2)
            rows += [(s * 1000 + i, s, [float(a), float(b)]) for i, (a, b) in enumerate(xy)]
        p = spark.createDataFrame(rows, "id bigint, grp bigint, vec array<double>")
        near = neighbors.knn(p, k=1, scope="next", exclude_self=False)
        totals.append(near.agg(F.exp(-F.avg(F.col("dist") ** 2))).first()[0])
    assert totals[0] > totals[1] > totals[2]


def test_tree_helpers(spark):
    assert tables.chain_edges(5, 1, 2) == [(2, 3), (3, 4), (2, 1), (1, 0)]
    e = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (5, 6), (4, 7)], "parent bigint, child bigint")
    assert {(r.parent, r.child, r.depth) for r in tables.tree_edges(spark, e, 4).collect()} == {(4, 5, 1), (4, 7, 1), (5, 6, 2)}


def test_deformable_follows_a_smooth_warp(spark):
    p, _ = cloud(spark, 60)
    p = p.select("id", "x", "y")
    warped = p.withColumn("y", F.col("y") + 0.15 * F.sin("x"))
    c, w, s2 = register.em_deformable(warped, p, beta=2.0, stiffness=0.5)
    out = geometry.kernel_displace(p, c, w, 2.0).join(warped.select("id", F.col("y").alias("v")), "id")
    before = p.join(warped.select("id", F.col("y").alias("v")), "id").agg(F.avg(F.abs(F.col("y") - F.col("v")))).first()[0]
    assert out.agg(F.avg(F.abs(F.col("y") - F.col("v")))).first()[0] < before / 2


def test_stack_registration(spark):
    p, _ = cloud(spark, 60)
    t = geometry.compose([[np.cos(0.1), -np.sin(0.1)], [np.sin(0.1), np.cos(0.1)]], None, [0.05, 0.02])
    a = p.select("id", "x", "y").withColumn("grp", F.lit(0))
    b = geometry.transform_points(a, t).withColumn("grp", F.lit(1))
    found = register.register_stack(a.unionByName(b), [(0, 1)], 0)
    assert np.allclose(found[1] @ t, np.eye(3), atol=1e-3)


def test_grids(spark):
    p = spark.createDataFrame([(0, 0.2, 0.9), (1, 5.0, 5.0)], "id bigint, x double, y double")
    v = spark.createDataFrame([(0, 1, "a")], "x bigint, y bigint, label string")
    assert {r.id: r.label for r in interp.voxel_label(p, v, {"x": 1.0, "y": 1.0}).collect()} == {0: "a", 1: None}
    img = spark.createDataFrame([(7, [[0.0, 2.0], [3.0, 0.0]])], "id bigint, image array<array<double>>")
    assert {(r.row, r.col, r.value) for r in interp.pixels(img).collect()} == {(0, 1, 2.0), (1, 0, 3.0)}
    z = spark.range(100).select((F.col("id") / 10.0).alias("z"))
    assert all(z.where(F.col("z").between(a, b)).count() >= 30 for a, b in interp.widened_bins(z, [0.0, 1.0, 9.0], least=30))
    field = spark.createDataFrame([(i, j, 1.0, 2.0) for i in range(3) for j in range(3)], "i bigint, j bigint, u double, v double")
    got = interp.displaced(p.where("id = 0"), field, 1.0).first()
    assert (round(got.x, 9), round(got.y, 9)) == (-0.8, -1.1)


def test_communities_and_linkage(spark):
    from meristem.operators import graphs

    e = [(i, j, 1.0) for g in (0, 10) for i in range(g, g + 5) for j in range(i + 1, g + 5)] + [(0, 10, 0.1)]
    got = {r.id: r.community for r in graphs.communities(spark.createDataFrame(e, "src bigint, dst bigint, w double")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and got[0] != got[10] and len(set(got.values())) == 2
    d = np.array([[0, 1, 8], [1, 0, 9], [8, 9, 0]], float)
    m = graphs.linkage(d, "average")
    assert m[:, 2].tolist() == [1.0, 8.5] and graphs.cut(m, 3, clusters=2).tolist() == [0, 0, 1]


def test_search_memory_and_ties():
    """A block's distances are never held whole, and neither are candidates among copies; single precision loses no neighbour."""
    import tracemalloc

    import pyarrow as pa

    def frame(v, i, g, p=""):
        vec = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.ravel())
        return pa.table({f"{p}id": pa.array(i, pa.int64()), f"{p}vec": vec, f"{p}grp": pa.array(g, pa.int64())})

    rng = np.random.default_rng(3)
    many = rng.normal(size=(200_000, 2))
    copies = np.repeat(rng.normal(size=(3, 64)), 10_000, axis=0)
    for x, q in ((many, many[:300]), (copies, copies[::100])):
        left, right = frame(q, np.arange(len(q)) + 1_000_000, np.zeros(len(q))), frame(x, np.arange(len(x)), np.ones(len(x)), "ref_")
        tracemalloc.start()
        got = neighbors._search(5, False, "next", 1)(left, right)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.num_rows == 5 * len(q) and peak < 150 << 20
        assert got.column("dist").to_numpy().reshape(-1, 5)[:, 0].max() == 0
    x = rng.normal(size=(3000, 64))
    got = neighbors._search(4, True, "global", 1)(frame(x, np.arange(3000), np.zeros(3000)), frame(x, np.arange(3000), np.zeros(3000), "ref_"))
    d = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(axis=2))
    want = {i: np.argsort(np.where(np.arange(3000) == i, np.inf, d[i]), kind="stable")[:4].tolist() for i in range(200)}
    src, dst = got.column("src").to_numpy(), got.column("dst").to_numpy()
    assert all(dst[src == i].tolist() == want[i] for i in range(200))


def test_each_pair_of_blocks_has_a_task_of_its_own(spark):
    slots = neighbors._slots(37)
    at = spark.createDataFrame([(s,) for s in slots], "s int").selectExpr("pmod(hash(s), 37) AS p")
    assert [r.p for r in at.collect()] == list(range(37))


def test_sums_within_radii_make_no_pairs(spark):
    """Against plain sums, with null values, points without entries and several chunks; no join of pairs in the plan."""
    from meristem.plans import plan_text

    rng = np.random.default_rng(4)
    xy = rng.random((600, 2))
    rows = [(int(c), f"g{g}", None if rng.random() < 0.05 else float(rng.integers(1, 9))) for c in range(0, 600, 2) for g in range(3) if rng.random() < 0.4]
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id bigint, x double, y double")
    e = spark.createDataFrame(rows, "cell bigint, gene string, value double")
    frame = neighbors.radius_sums(p, e, (0.1, 0.3), rows=250)
    assert "c0" not in plan_text(frame) and "Join" in plan_text(frame)
    got = {(r.src, r.gene, r.whole): (r.s0, r.n0, r.s1, r.n1) for r in frame.collect()}
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    want = {(i, None, True): tuple(x for r in (0.1, 0.3) for x in (float((d[i] <= r).sum()), int((d[i] <= r).sum()))) for i in range(600)}
    for i in range(600):
        for g in ("g0", "g1", "g2"):
            near = [[v for c, gene, v in rows if gene == g and d[i, c] <= r] for r in (0.1, 0.3)]
            if near[1]:
                sums = [sum(v for v in n if v is not None) if any(v is not None for v in n) else None for n in near]
                want[(i, g, False)] = (sums[0], len(near[0]), sums[1], len(near[1]))
    assert got == want
