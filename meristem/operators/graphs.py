"""Graph building blocks, community detection, fuzzy neighbourhoods and graph losses over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import settled
from .neighbors import _plane, _square, _squares_within


def asymmetry(edges: DataFrame) -> DataFrame:
    """One row: the largest |A - A^T| of an edge table (src, dst, w); absent edges are zero."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    zero = F.lit(0.0)
    return edges.join(back, ["src", "dst"], "full").agg(F.max(F.abs(F.coalesce("w", zero) - F.coalesce("v", zero))).alias("gap"))


def symmetrised(edges: DataFrame) -> DataFrame:
    """(A + A^T) / 2."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").unionAll(back).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))


def with_diagonal(edges: DataFrame, nodes: DataFrame, value: float = 1.0) -> DataFrame:
    """Self edges of every node set to ``value``."""
    own = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(float(value)).alias("w"))
    return edges.select("src", "dst", "w").where("src <> dst").unionAll(own)


def slice_pairs(spark: SparkSession, n: int, k: int, unordered: bool = False) -> DataFrame:
    """(i, j) with 0 < |i - j| <= k, or i < j only."""
    step = F.explode(F.array(*[F.lit(s) for s in range(-k, k + 1) if s > 0 or (s < 0 and not unordered)]))
    return spark.range(n).select(F.col("id").alias("i"), step.alias("step")).select("i", (F.col("i") + F.col("step")).alias("j")).where((F.col("j") >= 0) & (F.col("j") < n))


def common_members(lists: DataFrame, n_lists: int, rate: float = 1.0) -> DataFrame:
    """Members of at least ``rate`` of the lists (a repeated member counts as often as it is listed)."""
    return lists.groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") >= rate * n_lists)


def nearest_distance(edges: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: mean nearest distance inside its quantile band."""
    near = edges.groupBy("src").agg(F.min("dist").alias("d"))
    band = near.agg(F.percentile("d", F.lit(low)).alias("lo"), F.percentile("d", F.lit(high)).alias("hi"))
    return near.crossJoin(F.broadcast(band)).where("d >= lo AND d <= hi").agg(F.avg("d").alias("mean"), F.count("*").alias("n"))


def charbonnier(square: Column, weight: Column, eps: float = 1e-3) -> Column:
    """Weighted Charbonnier penalty, as an aggregate."""
    return F.sum(weight * F.sqrt(square + eps * eps))


def poisson_nll(y: Column, mu: Column, eps: float = 1e-8) -> Column:
    """Poisson negative log-likelihood without its constant, as an aggregate."""
    return F.sum(mu - y * F.ln(mu + eps))


def gaussian_nll(y: Column, mean: Column, sigma: Column, eps: float = 1e-8) -> Column:
    return F.sum(0.5 * F.pow((y - mean) / (sigma + eps), F.lit(2.0)) + F.ln(sigma + eps))


def fuzzy_connectivities(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, w): fuzzy neighbourhoods of kNN edges, each point's scale found so that its memberships sum to log2(k), joined by
    the probabilistic union A + A^T - A * A^T."""
    target = float(np.log2(k))

    def scales(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rho, sigma = [], []
            for d in batch.column("ds").to_pylist():
                d = np.sort(np.array(d, float))
                positive = d[d > 0]
                r = float(positive[0]) if len(positive) else 0.0
                lo, hi, s = 0.0, np.inf, 1.0
                for _ in range(64):
                    total = float(np.exp(-np.maximum(d - r, 0) / s).sum())
                    if abs(total - target) < 1e-5:
                        break
                    lo, hi = (lo, s) if total > target else (s, hi)
                    s = (lo + hi) / 2 if np.isfinite(hi) else s * 2
                rho.append(r)
                sigma.append(max(s, 1e-3 * float(d.mean()) if len(d) else 1e-3))
            yield pa.RecordBatch.from_pydict({"src": batch.column("src"), "rho": pa.array(rho, pa.float64()), "sigma": pa.array(sigma, pa.float64())})

    fitted = edges.groupBy("src").agg(F.collect_list("dist").alias("ds")).mapInArrow(scales, "src bigint, rho double, sigma double")
    one = edges.join(fitted, "src").select("src", "dst", F.exp(-F.greatest(F.col("dist") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("w"))
    back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("v"))
    a, b = F.coalesce("w", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    return one.join(back, ["src", "dst"], "full").select("src", "dst", (a + b - a * b).alias("w"))


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(id, component): connected components by smallest labels with pointer jumping, until nothing moves; state goes to the checkpoint
    folder where one is set."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = settled(both)  # every round reads them
    state = both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component"))
    while True:
        near = both.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("n"))
        step = state.join(near, "id").select("id", "component", F.least("component", "n").alias("m"))
        jump = step.join(state.select(F.col("id").alias("m"), F.col("component").alias("j")), "m", "left")
        new = jump.select("id", F.least("m", F.coalesce("j", "m")).alias("component"), (F.least("m", F.coalesce("j", "m")) != F.col("component")).alias("moved"))
        new = settled(new)
        state = new.select("id", "component")
        if new.where("moved").isEmpty():
            return state


def centrality(edges: DataFrame) -> DataFrame:
    """(id, degree, strength) of an undirected graph (src, dst, w); an edge that is given both ways counts once, with its larger
    weight."""
    both = edges.select("src", "dst", "w").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("src <> dst")
    return both.groupBy("src", "dst").agg(F.max("w").alias("w")).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def shared_neighbour_clusters(shared: DataFrame, least: int, min_points: int) -> DataFrame:
    """(id, cluster): density clusters on shared-neighbour counts (a, b, shared): points with at least ``min_points`` strong
    links are cores, linked cores share a cluster, other linked points join their smallest core's."""
    strong = shared.where(F.col("shared") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = strong.unionAll(strong.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    core = both.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select(F.col("src").alias("id"))
    among = both.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = core.join(smallest_reachable(among), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    edge = both.join(core.withColumnRenamed("id", "src"), "src", "left_anti").join(found.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("cluster").alias("cluster"))
    return found.unionAll(edge)


def communities(edges: DataFrame, group: str | None = None, resolution: float = 1.0, seed: int = 0, most: int = 5_000_000) -> DataFrame:
    """(grp, id, community): modularity communities of weighted undirected edges (src, dst, w), one task per group. Local moves and
    aggregation repeat until nothing improves. A group's size is checked against ``most`` edges."""
    rows = edges.withColumn("grp", F.col(group).cast("string") if group else F.lit("all"))
    top = rows.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    if top > most:
        raise ValueError(f"a group has {top} edges, over the bound of {most} for one task")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, flat = np.unique(np.concatenate([frame["src"], frame["dst"]]), return_inverse=True)
        a, b = flat[: len(frame)], flat[len(frame) :]
        w = frame["w"].to_numpy(float)
        member = np.arange(len(ids))
        rng = np.random.default_rng(seed)
        while True:
            n = int(max(a.max(), b.max())) + 1
            links: list[dict[int, float]] = [{} for _ in range(n)]
            loops = np.zeros(n)
            for i, j, x in zip(a, b, w, strict=True):
                if i == j:
                    loops[i] += x
                else:
                    links[i][j] = links[i].get(j, 0.0) + x
                    links[j][i] = links[j].get(i, 0.0) + x
            degree = np.array([sum(d.values()) for d in links]) + 2 * loops
            total = degree.sum()
            if total == 0:
                break
            own, volume = np.arange(n), degree.copy()
            moved_any = False
            for _ in range(50):
                moved = False
                for i in rng.permutation(n):
                    volume[own[i]] -= degree[i]
                    gain: dict[int, float] = {own[i]: 0.0}
                    for j, x in links[i].items():
                        gain[own[j]] = gain.get(own[j], 0.0) + x
                    best = max(sorted(gain), key=lambda c: gain[c] - resolution * degree[i] * volume[c] / total)
                    value = lambda c: gain[c] - resolution * degree[i] * volume[c] / total  # noqa: B023, E731
                    if best != own[i] and value(best) > value(own[i]) + 1e-12:
                        own[i], moved = best, True
                    volume[own[i]] += degree[i]
                moved_any |= moved
                if not moved:
                    break
            if not moved_any:
                break
            _, own = np.unique(own, return_inverse=True)
            member = own[member]
            merged: dict[tuple[int, int], float] = {}
            for i, j, x in zip(own[a], own[b], w, strict=True):
                key = (min(i, j), max(i, j))
                merged[key] = merged.get(key, 0.0) + x
            a, b = (np.array([k[s] for k in merged]) for s in (0, 1))
            w = np.array(list(merged.values()))
        size = np.bincount(member)
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return pd.DataFrame({"grp": frame["grp"].iloc[0], "id": ids, "community": rank[member]})

    return rows.select("grp", "src", "dst", "w").groupBy("grp").applyInPandas(run, "grp string, id bigint, community bigint")


def normals(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, nx, ny, nz): smallest principal direction of each point's neighbours (edges src -> dst), pointing up; neighbour
    moments are aggregated in Spark and only 3 x 3 matrices go to Python."""
    near = edges.join(points.select(F.col("id").alias("dst"), "x", "y", "z"), "dst")
    pairs = [(p, q) for i, p in enumerate("xyz") for q in "xyz"[i:]]
    m = near.groupBy(F.col("src").alias("id")).agg(*[F.covar_pop(p, q).alias(p + q) for p, q in pairs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.zeros((batch.num_rows, 3, 3))
            for p, q in pairs:
                i, j = "xyz".index(p), "xyz".index(q)
                c[:, i, j] = c[:, j, i] = batch.column(p + q).to_numpy(zero_copy_only=False)
            v = np.linalg.eigh(c)[1][:, :, 0] if batch.num_rows else np.zeros((0, 3))
            v = v * np.where(v[:, 2:] < 0, -1.0, 1.0)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "nx": pa.array(v[:, 0]), "ny": pa.array(v[:, 1]), "nz": pa.array(v[:, 2])})

    return m.mapInArrow(run, "id bigint, nx double, ny double, nz double")


def balanced_neighbours(points: DataFrame, k: int) -> DataFrame:
    """(src, dst, dist, target): ``k`` neighbours of each point in every batch ``grp``, its own included."""
    from .neighbors import knn

    own = knn(points, k=k, scope="within").join(points.select(F.col("id").alias("src"), F.col("grp").alias("target")), "src")
    return knn(points, k=k, scope="each").select("src", "dst", "dist", "target").unionAll(own.select("src", "dst", "dist", "target"))


def linkage(distances: np.ndarray, method: str = "average") -> np.ndarray:
    """Merges (left, right, height, size) of a small distance matrix by Lance-Williams updates: average, complete or single."""
    d = np.array(distances, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), {i: 1 for i in range(n)}, []
    for step in range(n - 1):
        i, j = divmod(int(d.argmin()), len(d))
        i, j = min(i, j), max(i, j)
        a, b = ids[i], ids[j]
        out.append((a, b, d[i, j], size[a] + size[b]))
        if method == "average":
            row = (size[a] * d[i] + size[b] * d[j]) / (size[a] + size[b])
        else:
            row = np.maximum(d[i], d[j]) if method == "complete" else np.minimum(d[i], d[j])
        row[i] = np.inf
        d[i], d[:, i] = row, row
        keep = np.arange(len(d)) != j
        d = d[keep][:, keep]
        ids[i] = n + step
        size[n + step] = size[a] + size[b]
        ids.pop(j)
    return np.array(out)


def cut(merges: np.ndarray, n: int, clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """Cluster numbers of a linkage cut by count or height, numbered by first member."""
    parent = list(range(n + len(merges)))
    for step, (a, b, h, _) in enumerate(merges):
        if (clusters is not None and step >= n - clusters) or (height is not None and h > height):
            break
        parent[int(a)] = parent[int(b)] = n + step
    root = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        root.append(i)
    _, first, out = np.unique(root, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[out]


def relative_visits(stability: DataFrame) -> DataFrame:
    """(prefix, change): total absolute change of pseudotime (id, prefix, t) from one prefix to the next."""
    step = F.col("t") - F.lag("t").over(W.partitionBy("id").orderBy("prefix"))
    return stability.select("prefix", F.abs(step).alias("c")).where("c IS NOT NULL").groupBy("prefix").agg(F.sum("c").alias("change"))


def laplacian(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w) of I - D^-1/2 A D^-1/2, where D has the row sums of the directed edges (src, dst, w). An edge into a node without
    edges of its own has no scale and is left out; every node has its diagonal."""
    degree = edges.groupBy("src").agg(F.sum("w").alias("d")).where("d > 0")
    off = edges.where("src <> dst").join(degree.withColumnRenamed("d", "ds"), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    off = off.select("src", "dst", (-F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))
    own = edges.where("src = dst").join(degree, "src").groupBy("src").agg((F.sum("w") / F.max("d")).alias("own"))
    diagonal = nodes.select(F.col("id").alias("src")).join(own, "src", "left").select("src", F.col("src").alias("dst"), (1 - F.coalesce("own", F.lit(0.0))).alias("w"))
    return off.unionAll(diagonal)


def density_clusters(edges: DataFrame, nodes: DataFrame, min_points: int) -> DataFrame:
    """(id, cluster) of every node: a node with at least ``min_points`` neighbours, itself among them, is a core; linked cores share a
    cluster, named by its smallest core; other nodes join their smallest neighbouring cluster or have none (null). Edges (src, dst) are
    given both ways; loops and repeated edges do not count."""
    both = settled(edges.where("src <> dst").select("src", "dst").distinct())
    core = both.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_points).select(F.col("src").alias("id"))
    if min_points <= 1:
        core = nodes.select("id")
    among = both.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = settled(core.join(smallest_reachable(among), "id", "left").select("id", F.coalesce("component", "id").alias("cluster")))
    near = both.join(found.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("cluster").alias("near"))
    return nodes.select("id").join(found, "id", "left").join(near, "id", "left").select("id", F.coalesce("cluster", "near").alias("cluster"))


def split_labels(points: DataFrame, edges: DataFrame, min_points: int) -> DataFrame:
    """(id, label, part) of points (id, label): density clusters within each label over spatial ``edges``, so that a label whose members
    lie apart falls into parts. A null part is a point too sparse for any."""
    own, other = points.select(F.col("id").alias("src"), F.col("label").alias("l")), points.select(F.col("id").alias("dst"), F.col("label").alias("m"))
    same = edges.join(own, "src").join(other, "dst").where("l = m").select("src", "dst")
    return points.select("id", "label").join(density_clusters(same, points, min_points).withColumnRenamed("cluster", "part"), "id")


#: Cells of a block along an axis, and how far two points within a radius can lie apart in cells.
_BLOCK, _FAR = 8, 2
#: The neighbours of a cell, each pair of cells once, the nearest first.
_AHEAD = sorted(((i, j) for i in range(_FAR + 1) for j in range(-_FAR, _FAR + 1) if (i, j) > (0, 0)), key=lambda m: m[0] ** 2 + m[1] ** 2)


class _Cells:
    """A block's points by cell."""

    def __init__(self, table: pa.Table):
        self.xy = _plane(table)
        at = np.column_stack([table.column(c).to_numpy() for c in ("cx", "cy")])
        cells, self.cell, count = np.unique(at, axis=0, return_inverse=True, return_counts=True)
        self.members = np.split(np.argsort(self.cell.ravel(), kind="stable"), np.cumsum(count)[:-1])
        self.keys = list(map(tuple, cells.tolist()))
        self.of = {k: i for i, k in enumerate(self.keys)}
        self.home = np.asarray(table.column("home").combine_chunks().to_numpy(zero_copy_only=False), bool)

    def around(self, key: tuple[int, int]) -> list[int]:
        reach = range(-_FAR, _FAR + 1)
        return [k for i in reach for j in reach if (k := self.of.get((key[0] + i, key[1] + j))) is not None]


def _touch(a: np.ndarray, b: np.ndarray, r: float, top: float) -> bool:
    """Whether any two points lie within ``r``."""
    slack = r * (1 + 1e-9)
    a = a[((a >= b.min(axis=0) - slack) & (a <= b.max(axis=0) + slack)).all(axis=1)]
    if len(a):
        b = b[((b >= a.min(axis=0) - slack) & (b <= a.max(axis=0) + slack)).all(axis=1)]
    return any((_square(a[i : i + 256], b[j : j + 1024]) <= top).any() for i in range(0, len(a), 256) for j in range(0, len(b), 1024))


def split_points(points: DataFrame, r: float, min_points: int) -> DataFrame:
    """(id, label, part) of points (id, label, x, y) in the plane: ``split_labels`` over all pairs within ``r``, which are never rows. Ids are
    distinct numbers; a point without a label or finite coordinates has no part.

    Cells are so small that two points of one are within ``r``: a cell of ``min_points`` is all core and one cluster. Blocks of cells, with
    the cells around them, are tasks of their own, which find cores, link cells and give border points their neighbouring cells; components
    are those of cells.
    """
    top, side = _squares_within(float(r)), float(r) / 2**0.5 * (1 - 1e-6)
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("id", "label")}
    finite = [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")) for a in "xy"]
    placed = points.select("id", "label", *[F.col(a).cast("double").alias(a) for a in "xy"]).where(F.col("label").isNotNull() & finite[0] & finite[1])
    placed = placed.withColumns({f"c{a}": F.floor(F.col(a) / side) for a in "xy"})

    def blocks(frame: DataFrame):
        block = lambda a, by: F.floor((F.col(f"c{a}") + by) / _BLOCK)
        for a in "xy":
            frame = frame.withColumn(f"b{a}", F.explode(F.array_distinct(F.array(block(a, -_FAR), block(a, _FAR)))))
        return frame.withColumn("home", (F.col("bx") == block("x", 0)) & (F.col("by") == block("y", 0))).groupBy("label", "bx", "by")

    def cores(table: pa.Table) -> pa.Table:
        cells = _Cells(table)
        core = np.zeros(table.num_rows, bool)
        for key, own in zip(cells.keys, cells.members, strict=True):
            if not cells.home[own[0]] or len(own) >= min_points:
                core[own] = len(own) >= min_points
                continue
            met = np.concatenate([cells.members[k] for k in cells.around(key)])
            found = sum((_square(cells.xy[own], cells.xy[met[i : i + 4096]]) <= top).sum(axis=1) for i in range(0, len(met), 4096))
            core[own] = found >= min_points
        kept = pa.array(cells.home)
        return table.select(["id", "label", "x", "y", "cx", "cy"]).append_column("core", pa.array(core)).filter(kept)

    def links(table: pa.Table) -> pa.Table:
        cells = _Cells(table)
        ids = table.column("id").to_numpy()
        core = np.asarray(table.column("core").combine_chunks().to_numpy(zero_copy_only=False), bool)
        held = [m[core[m]] for m in cells.members]
        name = [ids[m].min() if len(m) else None for m in held]
        home = [bool(cells.home[m[0]]) for m in cells.members]
        root = list(range(len(held)))

        def top_of(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        src, rep, link = [], [], []
        for i, j in _AHEAD:
            for key, k in cells.of.items():
                other = cells.of.get((key[0] + i, key[1] + j))
                if other is None or not (home[k] or home[other]) or not len(held[k]) or not len(held[other]):
                    continue
                a, b = top_of(k), top_of(other)
                # Cells that are linked already, by way of others, need no link of their own.
                if a != b and _touch(cells.xy[held[k]], cells.xy[held[other]], r, top):
                    root[a] = b
                    src.append(name[k])
                    rep.append(name[other])
                    link.append(True)
        for k, own in enumerate(cells.members):
            if not home[k]:
                continue
            src += ids[held[k]].tolist()
            rep += [name[k]] * len(held[k])
            link += [False] * len(held[k])
            border = own[~core[own]]
            if len(border):
                for near in cells.around(cells.keys[k]):
                    met = held[near]
                    if len(met):
                        close = np.any([(_square(cells.xy[border], cells.xy[met[i : i + 4096]]) <= top).any(axis=1) for i in range(0, len(met), 4096)], axis=0)
                        src += ids[border[close]].tolist()
                        rep += [name[near]] * int(close.sum())
                        link += [False] * int(close.sum())
        kind = table.schema.field("id").type
        return pa.table({"id": pa.array(src, kind), "rep": pa.array(rep, kind), "link": pa.array(link, pa.bool_())})

    marked = blocks(placed).applyInArrow(cores, f"id {kinds['id']}, label {kinds['label']}, x double, y double, cx bigint, cy bigint, core boolean")
    found = settled(blocks(marked).applyInArrow(links, f"id {kinds['id']}, rep {kinds['id']}, link boolean"))
    joined = smallest_reachable(found.where("link").select(F.col("id").alias("src"), F.col("rep").alias("dst"))).withColumnRenamed("id", "rep")
    parts = found.where("NOT link").join(joined, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("part"))
    out = points.select("id", "label").join(parts, "id", "left")
    return out if min_points > 1 else out.withColumn("part", F.coalesce("part", "id"))


def linear_weights(points: DataFrame, edges: DataFrame, ridge: float | None = None) -> DataFrame:
    """(src, dst, w): weights, of sum one, that best rebuild each point (id, vec) from its neighbours (src, dst). ``ridge`` times the trace
    steadies the local Gram matrix: by default 1e-6 where a point has more neighbours than dimensions, else nothing."""
    own, other = points.select(F.col("id").alias("src"), F.col("vec").alias("own")), points.select(F.col("id").alias("dst"), F.col("vec").alias("vec"))
    near = edges.select("src", "dst").distinct().join(other, "dst").groupBy("src").agg(F.collect_list(F.struct("dst", "vec")).alias("near")).join(own, "src")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst, w = [], [], []
            for s, near, own in zip(*(batch.column(c).to_pylist() for c in ("src", "near", "own")), strict=True):
                near = sorted(near, key=lambda n: n["dst"])
                z = np.array([n["vec"] for n in near], float) - np.array(own, float)
                g = z @ z.T
                by = (1e-6 if z.shape[0] > z.shape[1] else 0.0) if ridge is None else ridge
                g = g / (np.trace(g) or 1.0) + np.eye(len(z)) * by
                # The least of w'Gw at sum one, with a multiplier; a singular matrix gives the smallest such weights.
                one = np.ones((len(z), 1))
                v = np.linalg.lstsq(np.block([[g, one], [one.T, np.zeros((1, 1))]]), np.eye(len(z) + 1)[-1], rcond=None)[0][:-1]
                src += [s] * len(z)
                dst += [n["dst"] for n in near]
                w += v.tolist()
            yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "w": pa.array(w, pa.float64())})

    return near.select(F.col("src").cast("long").alias("src"), "near", "own").mapInArrow(run, "src bigint, dst bigint, w double")
