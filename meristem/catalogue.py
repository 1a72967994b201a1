"""Registered queries of the library's own operators, each with a DuckDB twin where SQL can express it.

The driver's tables stand in for the operators' inputs: ``embeddings`` for latent vectors, coordinates and labels, ``lineitem`` for
sparse counts (cell: supplier, gene: part or brand), ``events`` for ordered walks, ``orders`` and dimensions for annotation tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans, sources
from .functions import vectors
from .operators import decompose, descriptors, geometry, graphs, integrate, interp, labels, learning, neighbors, network, preprocess, register, residual, scores, stats, tables, trajectory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K = 5


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec, label, grp (slice 0..3), x, y, z."""
    v = F.col("embedding").cast("array<double>")
    axes = [v[i].alias(a) for i, a in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("vec"), F.col("label").cast("long").alias("label"), (F.col("vec_id") % 4).alias("grp"), *axes)


def edges(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return neighbors.knn(points(spark, sf_dir), k=k)


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, gene (part), value."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, gene (brand), value."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gene"))
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    return line.join(part, line.l_partkey == part.p_partkey).groupBy(F.col("l_suppkey").alias("cell"), "gene").agg(F.sum("l_quantity").alias("value"))


def n_cells(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().count()


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, grp (the supplier's nation)."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").cast("long").alias("grp"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded columns, with negative zero made plain."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# SQL of the common inputs.
_EMB = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label::BIGINT AS label, vec_id % 4 AS grp, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def _nn(k: int = K, where: str = "a.id <> b.id", part: str = "a.id", name: str = "nn", extra: str = "") -> str:
    return f"{name} AS (SELECT src, dst, dist, rank{', target' if extra else ''} FROM (SELECT a.id AS src, b.id AS dst, list_distance(a.vec, b.vec) AS dist{extra}, row_number() OVER (PARTITION BY {part} ORDER BY list_distance(a.vec, b.vec), b.id) AS rank FROM emb a, emb b WHERE {where}) WHERE rank <= {k})"


_EXPR = "expr AS (SELECT l_suppkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
_BRANDS = "expr AS (SELECT l_suppkey AS cell, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_N = "n AS (SELECT count(DISTINCT l_suppkey)::DOUBLE AS n FROM lineitem)"
_NORM = "norm AS (SELECT cell, gene, value, ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY cell)) AS norm FROM expr)"
_CELLS = "cells AS (SELECT s_suppkey AS cell, s_nationkey::BIGINT AS grp FROM supplier)"
_BEST = "row_number() OVER (PARTITION BY {key} ORDER BY {by} DESC, {tie}) = 1"


# Neighbours -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_EMB}, {_nn()} SELECT src, dst, round(dist, 6) AS dist, rank FROM nn")
def knn_embed(spark, d):
    return rounded(edges(spark, d), "dist").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_EMB}, {_nn()}, v AS (SELECT src, label::VARCHAR AS label, count(*) / {K}.0::DOUBLE AS score FROM nn JOIN emb ON dst = id GROUP BY ALL) SELECT src, label AS predict, score FROM v QUALIFY {_BEST.format(key='src', by='score', tie='label')}")
def knn_label_vote(spark, d):
    return labels.vote(edges(spark, d), points(spark, d), K)


@query(f"WITH {_EMB}, {_nn()} SELECT a.src, a.dst, round(a.dist, 6) AS dist FROM nn a WHERE EXISTS (SELECT 1 FROM nn b WHERE b.src = a.dst AND b.dst = a.src)")
def mutual_knn(spark, d):
    return rounded(neighbors.mutual(edges(spark, d)), "dist").select("src", "dst", "dist")


@query(f"WITH {_EMB}, {_nn(3, 'a.id <> b.id AND a.grp <> b.grp', 'a.id, b.grp', extra=', b.grp AS target')} SELECT src, dst, round(dist, 6) AS dist, rank, target FROM nn")
def knn_by_group_ovo(spark, d):
    return rounded(neighbors.knn(points(spark, d), k=3, scope="each"), "dist").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_EMB}, {_nn(3, 'a.id <> b.id AND a.grp <> b.grp')} SELECT src, dst, round(dist, 6) AS dist FROM nn")
def knn_one_vs_rest(spark, d):
    return rounded(neighbors.knn(points(spark, d), k=3, scope="rest"), "dist").select("src", "dst", "dist")


@query(f"WITH {_EMB}, {_nn(3, 'a.grp < b.grp AND b.grp <= a.grp + 1', 'a.id, b.grp')} SELECT src, dst, round(dist, 6) AS dist FROM nn")
def knn_next_slice(spark, d):
    return rounded(neighbors.knn(points(spark, d), k=3, scope="next", exclude_self=False), "dist").select("src", "dst", "dist")


@query(f"WITH {_EMB}, {_nn(K, 'a.id <> b.id AND a.label = b.label')} SELECT src, dst, round(dist, 6) AS dist FROM nn")
def knn_within_label(spark, d):
    p = points(spark, d).withColumn("grp", F.col("label"))
    return rounded(neighbors.knn(p, k=K, scope="within"), "dist").select("src", "dst", "dist")


_RADIUS = 0.05


@query(f"WITH {_EMB} SELECT a.id AS src, b.id AS dst, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS dist FROM emb a, emb b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {_RADIUS}")
def radius_edges(spark, d):
    return rounded(neighbors.radius(points(spark, d), _RADIUS), "dist")


@query(f"WITH {_EMB}, {_nn()}, b AS (SELECT avg(dist) + 1.0 * stddev_pop(dist) AS top FROM nn) SELECT src, dst, round(dist, 6) AS dist FROM nn, b WHERE dist <= top AND src <> dst")
def edge_state_filter(spark, d):
    e = edges(spark, d)
    top = e.agg((F.avg("dist") + 1.0 * F.stddev_pop("dist")).alias("top"))
    return rounded(e.crossJoin(F.broadcast(top)).where("dist <= top AND src <> dst"), "dist").select("src", "dst", "dist")


@query(f"WITH {_EMB}, {_nn()}, own AS (SELECT src, dst FROM nn UNION SELECT src, src FROM nn) SELECT a.src AS a, b.src AS b, count(*) AS shared FROM own a JOIN own b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL")
def snn_counts(spark, d):
    return neighbors.shared_neighbours(edges(spark, d).select("src", "dst"))


_SWNN_SQL = f"""
WITH {_EMB},
qr AS (SELECT q.id AS src, r.id AS dst, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, r.vec), r.id) AS rank FROM emb q JOIN emb r ON q.grp = r.grp + 1 QUALIFY rank <= 20),
rq AS (SELECT r.id AS src, q.id AS dst, row_number() OVER (PARTITION BY r.id ORDER BY list_distance(q.vec, r.vec), q.id) AS rank FROM emb q JOIN emb r ON q.grp = r.grp + 1 QUALIFY rank <= 20),
near AS (SELECT a.id AS src, b.id AS dst FROM emb a JOIN emb b ON a.grp = b.grp QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance([a.x, a.y], [b.x, b.y]), b.id) <= 12),
pairs AS (SELECT qr.src AS q, qr.dst AS r FROM qr JOIN rq ON rq.src = qr.dst AND rq.dst = qr.src WHERE qr.rank <= 6 AND rq.rank <= 6),
a AS (SELECT qr.src AS q, near.dst AS r, count(*) AS a FROM qr JOIN near ON near.src = qr.dst GROUP BY ALL),
b AS (SELECT rq.src AS r, near.dst AS q, count(*) AS b FROM rq JOIN near ON near.src = rq.dst GROUP BY ALL)
SELECT emb.grp AS pair, p.r, p.q, round(sqrt(sqrt(a.a * b.b) / 12.0), 6) AS score FROM pairs p JOIN a USING (q, r) JOIN b USING (q, r) JOIN emb ON emb.id = p.r
"""


@query(_SWNN_SQL)
def swnn_score(spark, d):
    """Every consecutive slice pair; ``pair`` is the reference's slice."""
    p = points(spark, d)
    back = p.withColumn("grp", -F.col("grp"))
    rq, qr = neighbors.knn(p, k=20, scope="next", exclude_self=False), neighbors.knn(back, k=20, scope="next", exclude_self=False)
    near = neighbors.knn(p.select("id", "grp", F.array("x", "y").alias("vec")), k=12, scope="within", exclude_self=False)
    qr, rq, near = map(plans.settled, (qr, rq, near))
    out = rounded(neighbors.matched_score(qr, rq, near, near, 6, 20, 12), "score")
    return out.join(p.select(F.col("id").alias("r"), F.col("grp").alias("pair")), "r").select("pair", "r", "q", "score")


@query(f"WITH {_EMB}, {_nn()} SELECT src, dst, round(list_cosine_similarity(a.vec, b.vec), 6) + 0.0 AS cosine FROM nn JOIN emb a ON src = a.id JOIN emb b ON dst = b.id")
def cosine_pairs(spark, d):
    return _pairs(spark, d, "cosine", vectors.cosine)


def _pairs(spark, d, name, f):
    p = points(spark, d)
    e = edges(spark, d).select("src", "dst")
    both = e.join(p.select(F.col("id").alias("src"), F.col("vec").alias("u")), "src").join(p.select(F.col("id").alias("dst"), F.col("vec").alias("v")), "dst")
    return rounded(both.select("src", "dst", f(F.col("u"), F.col("v")).alias(name)), name)


_UNNEST = "nn JOIN emb a ON src = a.id JOIN emb b ON dst = b.id, LATERAL (SELECT unnest(a.vec) AS u, unnest(b.vec) AS v) e"


@query(f"WITH {_EMB}, {_nn()} SELECT src, dst, round(corr(u, v), 6) + 0.0 AS pearson FROM {_UNNEST} GROUP BY src, dst")
def pearson_pairs(spark, d):
    return _pairs(spark, d, "pearson", vectors.pearson)


@query(f"WITH {_EMB}, {_nn()} SELECT src, dst, round(sum(exp(u) / su * ln((exp(u) / su + 1e-10) / (exp(v) / sv + 1e-10))), 6) + 0.0 AS kl FROM (SELECT *, sum(exp(u)) OVER (PARTITION BY src, dst) AS su, sum(exp(v)) OVER (PARTITION BY src, dst) AS sv FROM {_UNNEST}) GROUP BY src, dst")
def kl_pairs(spark, d):
    return _pairs(spark, d, "kl", lambda u, v: vectors.kl(F.transform(u, F.exp), F.transform(v, F.exp)))


@query(f"WITH {_EMB}, {_nn()}, s AS (SELECT avg(dist) AS m FROM nn) SELECT src, dst, round(1 - dist / m, 6) + 0.0 AS s_linear, round(2 * exp(-dist / m) / (1 + exp(-dist / m)), 6) AS s_sigmoid, round(exp(-dist / m), 6) AS s_exp, round(exp(1 - dist / m), 6) AS s_exp1, round(1 / (1 + ln(1 + dist / m)), 6) AS s_log FROM nn, s")
def dist_to_similarity(spark, d):
    e = edges(spark, d)
    e = e.crossJoin(F.broadcast(e.agg(F.avg("dist").alias("m"))))
    kinds = ("linear", "sigmoid", "exp", "exp1", "log")
    return rounded(e.select("src", "dst", *[neighbors.similarity(F.col("dist"), k, F.col("m")).alias(f"s_{k}") for k in kinds]), *[f"s_{k}" for k in kinds])


_SYM = f"w AS (SELECT src AS a, dst AS b, exp(-dist) AS w FROM nn), sym AS (SELECT a, b, sum(w) AS w FROM (SELECT * FROM w UNION ALL SELECT b, a, w FROM w) GROUP BY a, b)"


def _symmetric(spark, d):
    w = edges(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.exp(-F.col("dist")).alias("w"))
    return w.unionAll(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


@query(f"WITH {_EMB}, {_nn()}, {_SYM}, deg AS (SELECT a, sum(w) AS d FROM sym GROUP BY a) SELECT s.a, s.b, round(s.w / sqrt(x.d * y.d), 6) AS norm FROM sym s JOIN deg x ON x.a = s.a JOIN deg y ON y.a = s.b")
def degree_normalised_adj(spark, d):
    return rounded(network.normalised(_symmetric(spark, d)), "norm").select("a", "b", "norm")


@query(f"WITH {_EMB}, {_nn()}, {_SYM} SELECT s.a, s.b, round(s.w / sum(s.w) OVER (PARTITION BY s.a), 6) AS share FROM sym s")
def row_stochastic(spark, d):
    return rounded(network.stochastic(_symmetric(spark, d)), "share").select("a", "b", "share")


@query(f"WITH {_EMB}, {_nn()}, {_SYM} SELECT round(sum(s.w * list_distance(p.vec, q.vec) ** 2) / 2, 4) AS energy, count(*) AS n_edges FROM sym s JOIN emb p ON p.id = s.a JOIN emb q ON q.id = s.b")
def laplacian_energy(spark, d):
    p = points(spark, d)
    s = _symmetric(spark, d).join(p.select(F.col("id").alias("a"), F.col("vec").alias("u")), "a").join(p.select(F.col("id").alias("b"), F.col("vec").alias("v")), "b")
    return s.agg(F.round(F.sum(F.col("w") * F.pow(vectors.l2(F.col("u"), F.col("v")), F.lit(2.0))) / 2, 4).alias("energy"), F.count("*").alias("n_edges"))


@query(f"WITH {_EMB}, near AS (SELECT a.id, a.grp, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d2 FROM emb a JOIN emb b ON b.grp = a.grp + 1 GROUP BY ALL) SELECT grp, round(avg(d2), 8) AS chamfer FROM near GROUP BY grp")
def chamfer(spark, d):
    p = points(spark, d).select("id", "grp", F.array("x", "y").alias("vec"))
    near = neighbors.knn(p, k=1, scope="next", exclude_self=False).join(p.select(F.col("id").alias("src"), "grp"), "src")
    return near.groupBy("grp").agg(F.round(F.avg(F.col("dist") * F.col("dist")), 8).alias("chamfer"))


@query(f"WITH {_EMB}, {_nn()}, k AS (SELECT src, dst, dist, row_number() OVER (ORDER BY dist, src, dst) AS r, count(*) OVER () AS n FROM nn) SELECT src, dst, round(dist, 6) AS dist FROM k WHERE r <= floor(n * 0.9)")
def shortest_edges(spark, d):
    return rounded(neighbors.shortest(edges(spark, d), 0.9), "dist").select("src", "dst", "dist")


# Labels ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_EMB}, {_nn()}, e AS (SELECT src, label, sum(exp(-dist)) AS w FROM nn JOIN emb ON dst = id WHERE id % 3 <> 0 GROUP BY ALL), t AS (SELECT src, sum(exp(-dist)) AS t FROM nn GROUP BY src) SELECT src, label, round(w / t, 6) AS score FROM e JOIN t USING (src) QUALIFY {_BEST.format(key='src', by='w', tie='label')}")
def label_diffusion_step(spark, d):
    e = edges(spark, d).withColumn("weight", F.exp(-F.col("dist")))
    return rounded(labels.diffuse(e, points(spark, d).where("id % 3 <> 0")), "score")


_STEP = "f{n} AS (SELECT id, label, sum(f) AS f FROM (SELECT s.src AS id, f.label, 0.7 * sum(s.s * f.f) AS f FROM s JOIN f{m} f ON f.id = s.dst GROUP BY ALL UNION ALL SELECT id, label, f FROM f0) GROUP BY ALL)"


@query(
    f"WITH {_EMB}, {_nn()}, s AS (SELECT src, dst, exp(-dist) / sum(exp(-dist)) OVER (PARTITION BY src) AS s FROM nn), f0 AS (SELECT id, label, 1.0::DOUBLE AS f FROM emb WHERE id % 3 <> 0), "
    + ", ".join(_STEP.format(n=i, m=i - 1) for i in (1, 2, 3))
    + f" SELECT id, label, round(f, 6) AS score FROM f3 QUALIFY {_BEST.format(key='id', by='f', tie='label')}"
)
def label_propagation(spark, d):
    e = edges(spark, d).withColumn("weight", F.exp(-F.col("dist")))
    return rounded(labels.propagate(e, points(spark, d).where("id % 3 <> 0"), 0.7, 3), "score")


@query(f"WITH {_EMB}, {_nn()} SELECT src AS id, bool_or(a.label <> b.label) AS boundary FROM nn JOIN emb a ON src = a.id JOIN emb b ON dst = b.id GROUP BY src")
def boundary_nodes(spark, d):
    return labels.boundaries(edges(spark, d), points(spark, d))


@query(f"WITH {_EMB}, {_nn()}, c AS (SELECT src, label, count(*) AS n FROM (SELECT src, dst FROM nn UNION ALL SELECT id, id FROM emb) JOIN emb ON dst = id GROUP BY ALL) SELECT src AS id, label FROM c QUALIFY {_BEST.format(key='src', by='n', tie='label')}")
def label_smooth_mode(spark, d):
    return labels.smooth_mode(edges(spark, d), points(spark, d).select("id", "label"))


@query(f"WITH {_EMB} SELECT id, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS index, 1 AS value FROM emb")
def one_hot_labels(spark, d):
    return labels.one_hot(points(spark, d).select("id", "label")).select("id", F.col("index").cast("int").alias("index"), "value")


@query(f"WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM c QUALIFY {_BEST.format(key='user_id', by='n', tie='event_type')}")
def argmax_label(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return labels.arg_max(c, ["user_id"], "n", "event_type").select("user_id", "event_type", "n")


# Interpolation and grids ----------------------------------------------------------------------------------------------

_Q = "a.id % 5 = 0 AND b.id % 5 <> 0"


def _to_queries(spark, d, k=K):
    p = points(spark, d)
    return neighbors.knn(p.where("id % 5 = 0"), p.where("id % 5 <> 0"), k, exclude_self=False), p


@query(f"WITH {_EMB}, {_nn(K, _Q)} SELECT src AS id, round(avg(z), 6) + 0.0 AS value FROM nn JOIN emb ON dst = id GROUP BY src")
def kd_interp_mean(spark, d):
    e, p = _to_queries(spark, d)
    return rounded(interp.neighbour_aggregate(e, p.select("id", F.col("z").alias("value")), p.where("id % 5 = 0")), "value")


@query(f"WITH {_EMB}, {_nn(K, _Q)}, c AS (SELECT src, label, count(*) AS n FROM nn JOIN emb ON dst = id GROUP BY ALL) SELECT src AS id, label AS value FROM c QUALIFY {_BEST.format(key='src', by='n', tie='label')}")
def kd_interp_mode(spark, d):
    e, p = _to_queries(spark, d)
    return interp.neighbour_aggregate(e, p.select("id", F.col("label").alias("value")), p.where("id % 5 = 0"), "mode")


@query(f"WITH {_EMB}, {_nn(K, _Q)} SELECT src AS id, round(median(z), 6) + 0.0 AS value FROM nn JOIN emb ON dst = id GROUP BY src")
def kd_interp_median(spark, d):
    e, p = _to_queries(spark, d)
    return rounded(interp.neighbour_aggregate(e, p.select("id", F.col("z").alias("value")), p.where("id % 5 = 0"), "median"), "value")


@query(f"WITH {_EMB}, {_nn(K, _Q)} SELECT src, round(sum(z / dist ** 2) / sum(1 / dist ** 2), 6) + 0.0 AS value FROM nn JOIN emb ON dst = id GROUP BY src")
def shepard_interp(spark, d):
    e, p = _to_queries(spark, d)
    return rounded(interp.kernel_mean(e, p.select("id", F.col("z").alias("value")), "shepard"), "value")


@query(f"WITH {_EMB}, {_nn(K, _Q)} SELECT src, round(sum(z * exp(-((dist * 2.0) ** 2))) / sum(exp(-((dist * 2.0) ** 2))), 6) + 0.0 AS value FROM nn JOIN emb ON dst = id GROUP BY src")
def gauss_interp(spark, d):
    e, p = _to_queries(spark, d)
    return rounded(interp.kernel_mean(e, p.select("id", F.col("z").alias("value")), "gaussian"), "value")


@query(f"WITH {_EMB}, {_nn(K, _Q)}, c AS (SELECT src, label::VARCHAR AS label, sum(exp(-dist * dist / 2.0)) AS w FROM nn JOIN emb ON dst = id GROUP BY ALL), s AS (SELECT *, w / sum(w) OVER (PARTITION BY src) AS score FROM c) SELECT src, CASE WHEN score < 0.3 THEN '_NONE' ELSE label END AS label, round(score, 6) AS score FROM s QUALIFY {_BEST.format(key='src', by='w', tie='label')}")
def prob_interp_label(spark, d):
    e, p = _to_queries(spark, d)
    return rounded(interp.kernel_label(e, p, 1.0, 0.3), "score")


_GRID = "g AS (SELECT id, label, least(floor((x - lx) / ((hx - lx) / 8)), 7)::BIGINT AS bin_x, least(floor((y - ly) / ((hy - ly) / 8)), 7)::BIGINT AS bin_y, lx, hx, ly, hy FROM emb, (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM emb))"


@query(f"WITH {_EMB}, {_GRID} SELECT id, bin_x, bin_y, round(lx + (bin_x + 0.5) * (hx - lx) / 8, 6) + 0.0 AS centre_x, round(ly + (bin_y + 0.5) * (hy - ly) / 8, 6) + 0.0 AS centre_y FROM g")
def grid_bins(spark, d):
    return rounded(interp.grid_bins(points(spark, d), 8), "centre_x", "centre_y").select("id", "bin_x", "bin_y", "centre_x", "centre_y")


@query(f"WITH {_EMB}, {_GRID} SELECT bin_x, bin_y, " + ", ".join(f'count(*) FILTER (WHERE label = {i}) AS "{i}"' for i in range(10)) + " FROM g GROUP BY bin_x, bin_y")
def grid_label_counts(spark, d):
    return interp.grid_counts(interp.grid_bins(points(spark, d), 8), "label", list(range(10)))


@query(f"WITH {_EMB} SELECT floor(x / 0.1)::BIGINT AS v_x, floor(y / 0.1)::BIGINT AS v_y, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, count(*) AS n FROM emb GROUP BY ALL")
def voxel_down_sample(spark, d):
    return rounded(interp.voxel_down_sample(points(spark, d), 0.1), "x", "y")


@query(f"WITH {_EMB}, r AS (SELECT a.id, sum(CASE WHEN (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.09 THEN exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 0.02) ELSE 0 END) AS d FROM emb a, emb b GROUP BY a.id) SELECT id, round((d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 6) AS density FROM r")
def kernel_density(spark, d):
    return rounded(interp.density(points(spark, d), points(spark, d), 0.3, 0.1), "density")


# Geometry and registration --------------------------------------------------------------------------------------------

_C, _S = float(np.cos(0.5)), float(np.sin(0.5))
_TURN = np.array([[_C, -_S, 0.3], [_S, _C, -0.2], [0.0, 0.0, 1.0]])


@query(f"WITH {_EMB} SELECT id, round({_C!r} * x - {_S!r} * y + 0.3, 6) + 0.0 AS x, round({_S!r} * x + {_C!r} * y - 0.2, 6) + 0.0 AS y FROM emb")
def homotransform(spark, d):
    return rounded(geometry.transform_points(points(spark, d).select("id", "x", "y"), _TURN), "x", "y")


@query(f"WITH {_EMB}, m AS (SELECT avg(x) AS mx, avg(y) AS my, sqrt(var_pop(x) + var_pop(y)) AS s FROM emb) SELECT id, round((x - mx) / s, 6) + 0.0 AS x, round((y - my) / s, 6) + 0.0 AS y FROM emb, m")
def centre_scale(spark, d):
    return rounded(geometry.centre_scale(points(spark, d).select("id", "x", "y")), "x", "y")


@query(f"WITH {_EMB}, m AS (SELECT max(x) AS hx FROM emb) SELECT id, round(hx - x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM emb, m")
def mirror_axis(spark, d):
    return rounded(geometry.mirror(points(spark, d).select("id", "x", "y"), ("x",)), "x", "y")


@query(f"WITH {_EMB} SELECT a.grp AS pair, round(avg((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 8) AS sigma2 FROM emb a JOIN emb b ON b.grp = a.grp + 1 GROUP BY a.grp")
def sigma_square(spark, d):
    """Every consecutive slice pair; ``pair`` is the first slice."""
    return geometry.next_square_distances(points(spark, d)).select(F.col("grp").alias("pair"), F.round("sigma2", 8).alias("sigma2"))


@query(f"WITH {_EMB} SELECT id, round(sqrt(list_inner_product(vec, vec)), 6) AS length FROM emb")
def vector_norms(spark, d):
    return rounded(points(spark, d).select("id", vectors.norm(F.col("vec")).alias("length")), "length")


def _matrix_rows(spark, m: np.ndarray, **more: float) -> DataFrame:
    rows = [(i, j, float(round(m[i, j], 4)) + 0.0) for i in range(m.shape[0]) for j in range(m.shape[1])]
    out = spark.createDataFrame(rows, "i int, j int, value double")
    return out.withColumns({k: F.lit(v) for k, v in more.items()})


@query(f"SELECT i, j, value FROM (VALUES (0, 0, {round(_C, 4)}::DOUBLE), (0, 1, {round(-_S, 4)}::DOUBLE), (0, 2, 0.3::DOUBLE), (1, 0, {round(_S, 4)}::DOUBLE), (1, 1, {round(_C, 4)}::DOUBLE), (1, 2, -0.2::DOUBLE), (2, 0, 0.0::DOUBLE), (2, 1, 0.0::DOUBLE), (2, 2, 1.0::DOUBLE)) t(i, j, value)")
def rigid_fit(spark, d):
    """Recovers the known rotation and shift from matched points."""
    p = points(spark, d).select("id", "x", "y")
    pairs = p.join(geometry.transform_points(p, _TURN).select("id", F.col("x").alias("u"), F.col("y").alias("v")), "id")
    return _matrix_rows(spark, geometry.procrustes(geometry.moments(pairs, ("x", "y"), ("u", "v"))))


@query(f"SELECT i, j, value FROM (VALUES (0, 0, {round(_C, 4)}::DOUBLE), (0, 1, {round(-_S, 4)}::DOUBLE), (0, 2, 0.3::DOUBLE), (1, 0, {round(_S, 4)}::DOUBLE), (1, 1, {round(_C, 4)}::DOUBLE), (1, 2, -0.2::DOUBLE), (2, 0, 0.0::DOUBLE), (2, 1, 0.0::DOUBLE), (2, 2, 1.0::DOUBLE)) t(i, j, value)")
def affine_fit(spark, d):
    p = points(spark, d).select("id", "x", "y")
    pairs = p.join(geometry.transform_points(p, _TURN).select("id", F.col("x").alias("u"), F.col("y").alias("v")), "id")
    return _matrix_rows(spark, geometry.affine_fit(geometry.moments(pairs, ("x", "y"), ("u", "v"))))


_SMALL = np.array([[np.cos(0.1), -np.sin(0.1), 0.05], [np.sin(0.1), np.cos(0.1), -0.04], [0, 0, 1]])


@query()
def em_rigid(spark, d):
    """Registers a rotated copy of the points onto the originals without known matches."""
    p = points(spark, d).select("id", "x", "y")
    m, s2 = register.em_register(geometry.transform_points(p, _SMALL), p, "rigid")
    return _matrix_rows(spark, m, sigma2=round(s2, 6))


@query()
def ransac_fit(spark, d):
    """A rigid fit of matches of which a fifth are wrong."""
    p = points(spark, d).select("id", "x", "y")
    moved = geometry.transform_points(p, _TURN).select("id", F.col("x").alias("u"), F.when(F.col("id") % 5 == 0, -F.col("y")).otherwise(F.col("y")).alias("v"))
    m, n = register.ransac(p.join(moved, "id"), ("x", "y"), ("u", "v"), 0.01)
    return _matrix_rows(spark, m, inliers=float(n))


@query()
def sinkhorn_plan(spark, d):
    return rounded(register.sinkhorn_slices(points(spark, d)), "plan")


# Counts ---------------------------------------------------------------------------------------------------------------

_FLAGS = {"small": r"^(SMALL|ECONOMY)", "large": r"(?i)large", "promo": r"(?i)^promo"}


@query(f"WITH {_EXPR}, g AS (SELECT p_partkey AS gene, " + ", ".join(f"regexp_matches(p_type, '{p}') AS {f}" for f, p in _FLAGS.items()) + ") , m AS (SELECT * FROM expr LEFT JOIN g USING (gene)) SELECT cell, sum(value) AS total, count(*) FILTER (WHERE value > 0) AS n_genes, ".replace(") , m", " FROM part), m") + ", ".join(f"round(100 * sum(CASE WHEN {f} THEN value ELSE 0 END) / sum(value), 6) AS pct_{f}" for f in _FLAGS) + " FROM m GROUP BY cell")
def qc_metrics(spark, d):
    genes = preprocess.flag_genes(table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("name")), "name", _FLAGS)
    return preprocess.qc_metrics(expr(spark, d), genes, list(_FLAGS))


@query(f"WITH {_EXPR}, {_N} SELECT gene, sum(value) AS total, count(*) AS n_cells, round(sum(value) / max(n), 6) AS mean, round(100 * (1 - count(*) / max(n)), 6) AS pct_dropout FROM expr, n GROUP BY gene")
def gene_metrics(spark, d):
    return rounded(preprocess.gene_metrics(expr(spark, d), n_cells(spark, d)), "mean", "pct_dropout")


@query("SELECT p_partkey, p_type FROM part WHERE NOT regexp_matches(p_type, '(?i)^promo')")
def drop_by_regex(spark, d):
    return preprocess.drop_genes(table(spark, d, "part"), ["promo"], "p_type", _FLAGS).select("p_partkey", "p_type")


@query(f"WITH {_EXPR}, {_NORM} SELECT cell, gene, round(norm, 6) AS norm FROM norm")
def normalize_log1p(spark, d):
    return rounded(preprocess.normalise(expr(spark, d)), "norm").select("cell", "gene", "norm")


@query(f"WITH {_BRANDS}, {_N}, m AS (SELECT gene, sum(value) / max(n) AS mean, sqrt(greatest(sum(value * value) / max(n) - (sum(value) / max(n)) ** 2, 0)) AS sd FROM expr, n GROUP BY gene) SELECT cell, gene, round(least((value - mean) / (CASE WHEN sd = 0 THEN 1 ELSE sd END), 3.0), 6) + 0.0 AS z, round(-mean / (CASE WHEN sd = 0 THEN 1 ELSE sd END), 6) AS absent FROM expr JOIN m USING (gene)")
def scale_zscore(spark, d):
    return rounded(preprocess.zscore(brands(spark, d), n_cells(spark, d), 3.0), "z", "absent")


@query(f"WITH {_EXPR}, {_N}, m AS (SELECT gene, CASE WHEN count(*) < max(n) THEN least(min(value), 0) ELSE min(value) END AS lo, CASE WHEN count(*) < max(n) THEN greatest(max(value), 0) ELSE max(value) END AS hi FROM expr, n GROUP BY gene) SELECT cell, gene, round(coalesce((value - lo) / nullif(hi - lo, 0), 0), 6) AS scaled FROM expr JOIN m USING (gene)")
def minmax(spark, d):
    return rounded(preprocess.minmax(expr(spark, d), n_cells(spark, d)), "scaled")


@query(f"WITH {_EXPR}, {_N} SELECT gene, round(sum(value) / max(n), 6) AS mean, round(sum(value * value) / max(n) - (sum(value) / max(n)) ** 2, 6) AS variance FROM expr, n GROUP BY gene")
def gene_variance_with_zeros(spark, d):
    return rounded(preprocess.variance_with_zeros(expr(spark, d), n_cells(spark, d)), "mean", "variance")


@query(f"WITH {_EXPR}, {_N} SELECT gene, round(exp(sum(ln(value + 1)) / max(n)) - 1, 6) AS gmean FROM expr, n GROUP BY gene")
def gene_gmean(spark, d):
    return rounded(preprocess.geometric_mean(expr(spark, d), n_cells(spark, d)), "gmean")


_HVG = f"""
WITH {_EXPR}, {_N}, m AS (SELECT gene, sum(value) / max(n) AS mean, (sum(value * value) / max(n) - (sum(value) / max(n)) ** 2) * max(n) / (max(n) - 1) AS var FROM expr, n GROUP BY gene),
s AS (SELECT gene, mean, var / mean AS dispersion, least(floor((mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) * 20), 19)::BIGINT AS bin FROM m),
z AS (SELECT *, coalesce((dispersion - avg(dispersion) OVER (PARTITION BY bin)) / nullif(stddev_samp(dispersion) OVER (PARTITION BY bin), 0), 1.0) AS dn FROM s)
SELECT gene, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, bin, round(dn, 6) + 0.0 AS dispersion_norm, row_number() OVER (ORDER BY round(dn, 9) DESC, gene) <= 50 AS highly_variable FROM z
"""


@query(_HVG)
def hvg_dispersion(spark, d):
    return rounded(preprocess.variable_genes(expr(spark, d), n_cells(spark, d), 50), "mean", "dispersion", "dispersion_norm")


_RES = "r AS (SELECT cell, gene, value AS x, sum(value) OVER (PARTITION BY cell) * sum(value) OVER (PARTITION BY gene) / sum(value) OVER () AS mu, sum(value) OVER (PARTITION BY cell) AS n, sum(value) OVER (PARTITION BY gene) / sum(value) OVER () AS p FROM expr)"


@query(f"WITH {_EXPR}, {_RES} SELECT cell, gene, round(sign(x - mu) * sqrt(greatest(2 * (x * ln(x / mu) - (x - mu)), 0)), 5) + 0.0 AS residual FROM r")
def null_residuals_poisson(spark, d):
    return rounded(preprocess.null_residuals(expr(spark, d)), "residual", digits=5).select("cell", "gene", "residual")


@query(f"WITH {_EXPR}, {_RES} SELECT cell, gene, round((x - mu) / sqrt(mu * (1 - p)), 5) + 0.0 AS residual FROM r")
def null_residuals_binomial(spark, d):
    return rounded(preprocess.null_residuals(expr(spark, d), "pearson", "binomial"), "residual", digits=5).select("cell", "gene", "residual")


@query(f"WITH {_BRANDS}, {_N}, c AS (SELECT cell, sum(value) AS size FROM expr GROUP BY cell), g AS (SELECT gene, sum(value) AS total FROM expr GROUP BY gene), w AS (SELECT sum(value) AS w FROM expr), f AS (SELECT gene, coalesce(value, 0) AS v, size * total / w AS mu, sqrt(n) AS top FROM c CROSS JOIN g LEFT JOIN expr USING (cell, gene), w, n) SELECT gene, round(var_pop(greatest(-top, least(top, (v - mu) / sqrt(mu + mu * mu / 100.0)))), 6) AS residual_variance FROM f GROUP BY gene")
def residual_variance(spark, d):
    return rounded(preprocess.residual_variance(brands(spark, d), n_cells(spark, d)), "residual_variance")


_SPOTS = "spot AS (SELECT id, x, y FROM emb WHERE id IN (SELECT cell FROM expr))"


@query(f"WITH {_EMB}, {_BRANDS}, {_SPOTS}, e AS (SELECT a.id AS src, b.id AS dst FROM spot a, spot b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.2), deg AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT e.src AS id, gene, round(sum(value) / max(n), 6) AS mean FROM e JOIN expr ON cell = dst JOIN deg USING (src) GROUP BY e.src, gene")
def neighbor_mean(spark, d):
    b = brands(spark, d)
    spots = points(spark, d).join(b.select(F.col("cell").alias("id")).distinct(), "id", "left_semi").select("id", "x", "y")
    return rounded(stats.radius_mean(plans.settled(spots), b, 0.2), "mean")


_SVG = f"""
WITH {_EMB}, e0 AS (SELECT l_suppkey AS cell, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
spot AS (SELECT id, x, y FROM emb WHERE id IN (SELECT cell FROM e0)), expr AS (SELECT * FROM e0 WHERE cell IN (SELECT id FROM spot)), n AS (SELECT count(*)::DOUBLE AS n FROM spot),
mm AS (SELECT gene, CASE WHEN count(*) < max(n) THEN least(min(value), 0) ELSE min(value) END AS lo, max(value) AS hi FROM expr, n GROUP BY gene),
sc AS (SELECT cell, gene, coalesce((value - lo) / nullif(hi - lo, 0), 0) AS v FROM expr JOIN mm USING (gene)),
d AS (SELECT unnest([0.15, 0.45]) AS r), ed AS (SELECT r, a.id AS src, b.id AS dst FROM d, spot a, spot b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= r),
deg AS (SELECT r, src, count(*) AS k FROM ed GROUP BY ALL), me AS (SELECT r, src, gene, sum(v) / max(k) AS m FROM ed JOIN sc ON cell = dst JOIN deg USING (r, src) GROUP BY ALL),
va AS (SELECT r, gene, sum(m * m) / max(n) - (sum(m) / max(n)) ** 2 AS va FROM me, n GROUP BY ALL), raw AS (SELECT gene, sum(value * value) / max(n) - (sum(value) / max(n)) ** 2 AS raw FROM expr, n GROUP BY gene)
SELECT gene, round(max(va) FILTER (WHERE r > 0.3) / max(va) FILTER (WHERE r < 0.3) * max(raw.raw) / (SELECT max(raw) FROM raw), 6) AS t FROM va JOIN raw USING (gene) GROUP BY gene
"""


@query(_SVG)
def svg_score(spark, d):
    p = points(spark, d).select("id", "x", "y")
    b = brands(spark, d).join(p.select(F.col("id").alias("cell")), "cell", "left_semi")
    return rounded(stats.spatial_genes(b, p, 0, 0, radii=(0.15, 0.45)), "t")


@query()
def svg_table(spark, d):
    p = points(spark, d).select("id", "x", "y")
    b = brands(spark, d).join(p.select(F.col("id").alias("cell")), "cell", "left_semi")
    return rounded(stats.spatial_gene_table(stats.spatial_genes(b, p)), "t", "p", "q")


# Statistics -----------------------------------------------------------------------------------------------------------


@query("WITH g AS (SELECT p_partkey AS id, p_brand, (p_partkey * 7919 % 1000 + 1) / 1001.0::DOUBLE AS p FROM part), r AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY p, id) AS s FROM g) SELECT id, p_brand, round(p, 6) AS p, round(least(1.0, min(s) OVER (PARTITION BY p_brand ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r")
def bh_adjust(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", ((F.col("p_partkey") * 7919 % 1000 + 1) / 1001.0).alias("p"))
    return rounded(stats.bh_adjust(t, "p", ["p_brand"]), "p", "q")


@query(f"WITH {_BRANDS}, {_NORM}, {_CELLS}, s AS (SELECT grp, count(*) AS n FROM cells GROUP BY grp), e AS (SELECT gene, grp, sum(exp(norm) - 1) AS t, count(*) FILTER (WHERE norm > 0) AS pos FROM norm JOIN cells USING (cell) GROUP BY ALL), f AS (SELECT gene, grp, n, coalesce(t, 0) AS t, coalesce(pos, 0) AS pos FROM (SELECT DISTINCT gene FROM expr) CROSS JOIN s LEFT JOIN e USING (gene, grp)) SELECT gene, grp, round(log2(t / n + 1), 6) AS log_mean, round(pos / n, 6) AS fraction FROM f")
def group_logmean_fraction(spark, d):
    s = stats.group_summary(preprocess.normalise(brands(spark, d)), cells(spark, d))
    return rounded(s.select("gene", "grp", F.log2(F.col("expm1_sum") / F.col("n") + 1).alias("log_mean"), (F.col("positive") / F.col("n")).alias("fraction")), "log_mean", "fraction")


_MARK = f"""
WITH {_BRANDS}, {_NORM}, {_CELLS}, s AS (SELECT grp, count(*) AS n FROM cells GROUP BY grp), e AS (SELECT gene, grp, sum(exp(norm) - 1) AS t, count(*) FILTER (WHERE norm > 0) AS pos FROM norm JOIN cells USING (cell) GROUP BY ALL),
f AS (SELECT gene, grp, n, coalesce(t, 0) AS t, coalesce(pos, 0) AS pos FROM (SELECT DISTINCT gene FROM expr) CROSS JOIN s LEFT JOIN e USING (gene, grp)),
m AS (SELECT gene, grp, log2(t / n + 1) - log2(greatest((sum(t) OVER w - t) / (sum(n) OVER w - n), 0) + 1) AS lfc, pos / n AS pct_in, (sum(pos) OVER w - pos) / (sum(n) OVER w - n) AS pct_out FROM f WINDOW w AS (PARTITION BY gene))
SELECT gene, grp, round(lfc, 6) AS lfc, round(pct_in, 6) AS pct_in, round(pct_out, 6) AS pct_out FROM m WHERE pct_in >= 0.005 AND pct_out <= 1 AND abs(lfc) >= 0.1
"""


@query(_MARK)
def markers_vs_rest(spark, d):
    return rounded(stats.markers(preprocess.normalise(brands(spark, d)), cells(spark, d)), "lfc", "pct_in", "pct_out")


@query()
def marker_table(spark, d):
    return rounded(stats.marker_table(preprocess.normalise(brands(spark, d)), cells(spark, d), max_q=1.0), "lfc", "p", "q")


_MWU = f"""
WITH expr AS (SELECT l_suppkey AS cell, p_type AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), c AS (SELECT s_suppkey AS cell, s_nationkey % 3 AS grp FROM supplier),
v AS (SELECT gene, grp::BIGINT AS grp, value FROM expr JOIN c USING (cell)), r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS k FROM v),
t AS (SELECT gene, sum(x * x * x - x) AS ties, sum(x) AS n FROM (SELECT gene, value, count(*)::DOUBLE AS x FROM v GROUP BY ALL) GROUP BY gene),
g AS (SELECT gene, grp, count(*)::DOUBLE AS n1, sum(k) - count(*) * (count(*) + 1) / 2.0 AS u FROM r GROUP BY ALL)
SELECT gene, grp, n1::BIGINT AS n1, (n - n1)::BIGINT AS n2, u::DOUBLE AS u, round((abs(u - n1 * (n - n1) / 2) - 0.5) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))) * sign(u - n1 * (n - n1) / 2), 6) + 0.0 AS z FROM g JOIN t USING (gene) WHERE n > n1
"""


@query(_MWU)
def mannwhitney_u(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("gene"))
    e = table(spark, d, "lineitem").join(part, "l_partkey").groupBy(F.col("l_suppkey").alias("cell"), "gene").agg(F.sum("l_quantity").alias("value"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_nationkey") % 3).cast("long").alias("grp"))
    out = stats.mann_whitney(e.join(c, "cell").select("gene", "grp", "value"))
    return rounded(out.withColumn("u", F.col("u").cast("double")), "z")


@query("WITH q AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_partkey, qty, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey) AS rank FROM q QUALIFY rank <= 3")
def topn_per_group(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return stats.top_per_group(q, "l_suppkey", "qty", 3, "l_partkey").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT round(exp(avg(ln(p_retailprice))), 6) AS gmean, count(*) AS n FROM part")
def geo_mean(spark, d):
    return table(spark, d, "part").agg(F.round(F.exp(F.avg(F.ln("p_retailprice"))), 6).alias("gmean"), F.count("*").alias("n"))


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS lo, round(quantile_cont(value, 0.95), 6) AS hi, round(median(value), 6) AS med FROM events GROUP BY event_type")
def percentile_box(spark, d):
    p = lambda x: F.percentile("value", F.lit(x))
    return rounded(table(spark, d, "events").groupBy("event_type").agg(p(0.05).alias("lo"), p(0.95).alias("hi"), p(0.5).alias("med")), "lo", "hi", "med")


@query("WITH q AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM events) SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS clipped FROM events, q")
def clip_percentiles(spark, d):
    e = table(spark, d, "events")
    q = e.agg(F.percentile("value", F.lit(0.02)).alias("lo"), F.percentile("value", F.lit(0.98)).alias("hi"))
    return rounded(e.crossJoin(F.broadcast(q)).select("event_id", vectors.clip(F.col("value"), F.col("lo"), F.col("hi")).alias("clipped")), "clipped")


@query()
def otsu_threshold(spark, d):
    e = table(spark, d, "events")
    kinds = ("otsu", "isodata", "mean", "triangle", "yen", "minimum")
    return spark.createDataFrame([(k, round(stats.histogram_threshold(e, "value", k), 6)) for k in kinds], "method string, threshold double")


@query()
def welch_tests(spark, d):
    return rounded(stats.consecutive_t_tests(table(spark, d, "events"), "event_type", "value"), "t", "df", "p")


# Tables ---------------------------------------------------------------------------------------------------------------


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL HAVING count(*) > 20")
def cooccurrence_pairs(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return tables.pair_counts(both, "c_mktsegment", "o_orderpriority", 20)


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, c_mktsegment, n, round(n / sum(n) OVER (PARTITION BY c_nationkey), 6) AS ratio FROM c")
def ratio_by_group(spark, d):
    return rounded(tables.shares(table(spark, d, "customer"), "c_nationkey", "c_mktsegment"), "ratio")


_TYPES = ["click", "login", "logout", "purchase", "view"]


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id")
def pivot_counts(spark, d):
    return tables.pivot_counts(table(spark, d, "events"), "user_id", "event_type", ["click", "purchase", "view"])


@query("SELECT s_suppkey, u.variable, u.value FROM supplier, LATERAL (VALUES ('s_acctbal', s_acctbal), ('nation', s_nationkey::DOUBLE)) u(variable, value)")
def unpivot_long(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("nation"))
    return tables.unpivot(s, ["s_suppkey"], ["s_acctbal", "nation"])


@query("SELECT id, balance, segment, source FROM (SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier)")
def concat_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return tables.concat({"customer": c, "supplier": s}).select("id", "balance", "segment", "source")


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def id_intersect(spark, d):
    return tables.intersect_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def id_except(spark, d):
    return tables.except_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedupe_first(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return tables.dedupe_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_join_sampleinfo(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return tables.attach(tables.attach(c, n, "nation"), r, "region").select("c_custkey", "n_name", "r_name")


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT page_id, nullif(regexp_extract(html, 'lang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(html, 'charset="([^"]*)"', 1), '') AS charset, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host FROM pages""")
def attr_parse(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", sources.attributes("html", "lang").alias("lang"), sources.attributes("html", "charset").alias("charset"), F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("")).alias("host"))


@query("WITH s AS (SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 0 THEN string_split(text, chr(10)) ELSE [doc_id::VARCHAR] END AS parts FROM documents) SELECT doc_id, len(parts)::INTEGER AS n, (u.position - 1)::INTEGER AS position, length(u.segment)::INTEGER AS length FROM s, LATERAL (SELECT unnest(parts) AS segment, unnest(range(1, len(parts) + 1)) AS position) u")
def explode_segments(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("parts"))
    return tables.explode_segments(docs, "doc_id", "parts").select("doc_id", "n", "position", F.length("segment").alias("length"))


@query("SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS ordinal FROM events")
def label_to_order(spark, d):
    return labels.ordinal(table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", F.col("ordinal").cast("int").alias("ordinal"))


@query("WITH RECURSIVE e AS (SELECT 'world' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey), walk AS (SELECT parent, child, 1 AS depth FROM e WHERE parent = 'world' UNION ALL SELECT e.parent, e.child, depth + 1 FROM walk JOIN e ON e.parent = walk.child) SELECT parent, child, depth FROM walk")
def tree_edges(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    e = r.select(F.lit("world").alias("parent"), F.col("r_name").alias("child")).unionAll(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name"))
    return tables.tree_edges(spark, e, "world")


@query("WITH q AS (SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') AS n, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, CASE WHEN a >= n AND a >= r THEN 'a' WHEN n >= r THEN 'n' ELSE 'r' END AS name, greatest(a, n, r) AS value FROM q WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL")
def widest_column(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).dropna()
    return tables.widest_column(q.toDF("l_suppkey", "a", "n", "r"), "l_suppkey", ["a", "n", "r"])


_RATIO = "WITH q AS (SELECT l_suppkey, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS x, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS y FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round((x + 1) / (y + 1), 6) AS raw, round(log2((x + 1) / (y + 1)), 6) + 0.0 AS log2fc FROM q"


@query(_RATIO)
def counts_ratio(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.coalesce(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))), F.lit(0.0)).alias(n) for f, n in (("A", "x"), ("R", "y"))])
    ratio = (F.col("x") + 1) / (F.col("y") + 1)
    return rounded(q.select("l_suppkey", ratio.alias("raw"), F.log2(ratio).alias("log2fc")), "raw", "log2fc")


# Networks -------------------------------------------------------------------------------------------------------------

_COR = f"{_BRANDS}, {_N}, g AS (SELECT gene, sum(value) AS s, sum(value * value) AS q FROM expr GROUP BY gene), dd AS (SELECT x.gene AS a, y.gene AS b, sum(x.value * y.value) AS d FROM expr x JOIN expr y ON x.cell = y.cell AND x.gene < y.gene GROUP BY ALL), cor AS (SELECT a, b, (d - ga.s * gb.s / n) / sqrt((ga.q - ga.s * ga.s / n) * (gb.q - gb.s * gb.s / n)) AS r FROM dd JOIN g ga ON ga.gene = a JOIN g gb ON gb.gene = b, n)"
_ADJ = "adj AS (SELECT a, b, abs(r) ** 2 AS w FROM cor UNION ALL SELECT b, a, abs(r) ** 2 FROM cor)"


def _cor(spark, d):
    return network.gene_correlation(brands(spark, d), n_cells(spark, d))


@query(f"WITH {_COR} SELECT a, b, round(r, 6) + 0.0 AS r FROM cor")
def gene_corr(spark, d):
    return rounded(_cor(spark, d), "r")


@query(f"WITH {_COR}, {_ADJ}, k AS (SELECT a, sum(w) AS k FROM adj GROUP BY a), l AS (SELECT x.a, y.b, sum(x.w * y.w) AS l FROM adj x JOIN adj y ON x.b = y.a WHERE x.a <> y.b GROUP BY ALL) SELECT l.a, l.b, round((l.l + coalesce(adj.w, 0)) / (least(ka.k, kb.k) + 1 - coalesce(adj.w, 0)), 6) AS tom FROM l LEFT JOIN adj ON adj.a = l.a AND adj.b = l.b JOIN k ka ON ka.a = l.a JOIN k kb ON kb.a = l.b")
def tom(spark, d):
    return rounded(network.overlap(network.adjacency(_cor(spark, d), 2)), "tom")


@query(f"WITH {_COR}, ends AS (SELECT a, r FROM cor UNION ALL SELECT b, r FROM cor), k AS (SELECT p AS power, a, sum(abs(r) ** p) AS k FROM ends, (SELECT unnest([1, 2, 3, 4, 6]) AS p) GROUP BY ALL) SELECT power::INTEGER AS power, round(avg(k), 6) AS mean_k, round(max(k), 6) AS max_k FROM k GROUP BY power")
def soft_power(spark, d):
    return rounded(network.soft_power(_cor(spark, d), [1, 2, 3, 4, 6]), "mean_k", "max_k")


_FIT = f"""WITH {_COR}, {_ADJ}, k AS (SELECT sum(w) AS k FROM adj GROUP BY a), s AS (SELECT min(k) AS lo, max(k) AS hi, avg(k) AS m, median(k) AS med, count(*)::DOUBLE AS n, var_pop(k) AS v FROM k),
b AS (SELECT least(floor((k - lo) / ((hi - lo) / 10)), 9) AS bin, avg(k) AS dk, count(*) / max(n) AS pk FROM k, s GROUP BY 1), f AS (SELECT regr_r2(log10(pk + 1e-9), log10(dk)) AS r2, regr_slope(log10(pk + 1e-9), log10(dk)) AS slope FROM b WHERE dk > 0)
SELECT round(r2, 5) AS r2, round(slope, 5) + 0.0 AS slope, round(m, 5) AS mean_k, round(med, 5) AS median_k, round(hi, 5) AS max_k, round(m / (n - 1), 5) AS density, round(n / (n - 2) * (hi / (n - 1) - m / (n - 1)), 5) AS centralisation, round(sqrt(v) / m, 5) AS heterogeneity FROM f, s"""


@query(_FIT)
def scale_free_fit(spark, d):
    k = network.adjacency(_cor(spark, d), 2).groupBy("a").agg(F.sum("w").alias("k")).select("k")
    out = network.scale_free_fit(k)
    return rounded(out, *out.columns, digits=5)


@query(f"WITH {_COR}, {_ADJ} SELECT x.a AS gene, round(sum(w), 6) AS total, round(sum(CASE WHEN left(a, 7) = left(b, 7) THEN w ELSE 0 END), 6) AS within, round(sum(w) - sum(CASE WHEN left(a, 7) = left(b, 7) THEN w ELSE 0 END), 6) AS outside FROM adj x GROUP BY x.a")
def module_connectivity(spark, d):
    modules = brands(spark, d).select("gene").distinct().withColumn("module", F.expr("left(gene, 7)"))
    return rounded(network.module_connectivity(network.adjacency(_cor(spark, d), 2), modules), "total", "within", "outside")


@query(f"WITH {_BRANDS}, r AS (SELECT cell, gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS k FROM expr) SELECT x.gene AS a, y.gene AS b, round(corr(x.k, y.k), 6) + 0.0 AS r FROM r x JOIN r y ON x.cell = y.cell AND x.gene < y.gene GROUP BY ALL")
def spearman_genes(spark, d):
    return rounded(network.spearman(brands(spark, d)), "r")


@query()
def module_eigengenes(spark, d):
    b = brands(spark, d)
    modules = b.select("gene").distinct().withColumn("module", F.expr("left(gene, 7)"))
    return rounded(decompose.eigengenes(b, modules), "score", digits=4)


# Trajectory -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(value - lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) + 0.0 AS lag_diff FROM events")
def lag_pseudotime(spark, d):
    return rounded(trajectory.lag_difference(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 2), "lag_diff").select("event_id", "lag_diff")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 10) AS prefix_mean FROM events")
def prefix_mean(spark, d):
    return rounded(trajectory.prefix_mean(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value"), "prefix_mean", digits=10).select("event_id", "prefix_mean")


@query("SELECT event_id, round(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / count(*) OVER (PARTITION BY user_id), 6) AS hop FROM events")
def hop_position(spark, d):
    return rounded(trajectory.hop_position(table(spark, d, "events"), "user_id", ["ts", "event_id"]), "hop").select("event_id", "hop")


@query(f"WITH {_EMB}, {_nn()} SELECT src, dst, round(exp(-dist) / (1 + exp(-2.0 * (b.x - a.x - 0.1))), 6) AS w FROM nn JOIN emb a ON src = a.id JOIN emb b ON dst = b.id")
def transition_weights(spark, d):
    t = edges(spark, d).select("src", "dst", F.exp(-F.col("dist")).alias("w"))
    return rounded(trajectory.weight_transitions(t, points(spark, d).select("id", F.col("x").alias("t")), 0.1, 2.0), "w")


@query(f"WITH {_EMB}, {_nn()} SELECT dst AS id, round(1 - exp(sum(ln(1 - least(exp(-dist), 0.999)))), 6) AS p FROM nn WHERE src % 10 = 0 AND dst % 10 <> 0 GROUP BY dst")
def combined_visit(spark, d):
    t = edges(spark, d).select("src", "dst", F.least(F.exp(-F.col("dist")), F.lit(0.999)).alias("p"))
    return rounded(trajectory.combined_visit(t, points(spark, d).where("id % 10 = 0").select("id")), "p")


@query()
def flood_pseudotime(spark, d):
    t = trajectory.row_scaled(edges(spark, d, 10).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.exp(-F.col("dist")).alias("w")))
    return rounded(trajectory.flood_pseudotime(trajectory.flood(t, [0, 1, 2], 30)), "pseudotime")


@query()
def random_walks(spark, d):
    t = edges(spark, d, 10).select("src", "dst", F.exp(-F.col("dist")).alias("w"))
    return rounded(trajectory.walk_summary(trajectory.random_walks(t, [0, 1, 2], list(range(10, 30)), 100)), "position")


# Decomposition and scores ---------------------------------------------------------------------------------------------


@query()
def pca_scores(spark, d):
    p = points(spark, d)
    v, _, mean = decompose.pca(p, 3)
    s = decompose.project(p, v, mean)
    return rounded(s.select("id", *[F.col("scores")[i].alias(f"pc{i + 1}") for i in range(3)]), "pc1", "pc2", "pc3", digits=4)


@query(f"WITH {_EMB}, e AS (SELECT id, unnest(vec) AS v, unnest(range(1, 65)) AS i FROM emb), v AS (SELECT i, var_samp(v) AS v FROM e GROUP BY i) SELECT round(sum(v), 5) AS total FROM v")
def pca_total_variance(spark, d):
    """The sum of all explained variances equals the sum of the dimensions' variances."""
    p = points(spark, d)
    _, values, _ = decompose.pca(p, 64)
    return spark.createDataFrame([(round(float(values.sum()), 5),)], "total double")


@query()
def kmeans_labels(spark, d):
    found, _ = decompose.kmeans(points(spark, d).select("id", "vec"), 10)
    return found.select("id", "cluster")


@query(f"WITH {_EMB}, near AS (SELECT a.grp, a.id, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d2 FROM emb a JOIN emb b ON b.grp = a.grp + 1 GROUP BY ALL), s AS (SELECT grp, exp(-avg(d2) / median(d2)) AS v FROM near GROUP BY grp) SELECT round(exp(avg(ln(v))), 6) AS total, count(*) AS n FROM s WHERE v > 0")
def zstack_total(spark, d):
    """Geometric mean of the consecutive slices' chamfer scores."""
    p = points(spark, d).select("id", "grp", F.array("x", "y").alias("vec"))
    near = neighbors.knn(p, k=1, scope="next", exclude_self=False).join(p.select(F.col("id").alias("src"), "grp"), "src").withColumn("d2", F.col("dist") * F.col("dist"))
    s = near.groupBy("grp").agg(F.exp(-F.avg("d2") / F.median("d2")).alias("v")).where("v > 0")
    return s.agg(F.round(F.exp(F.avg(F.ln("v"))), 6).alias("total"), F.count("*").alias("n"))


# Graph building blocks ------------------------------------------------------------------------------------------------


def _weighted(spark, d):
    return edges(spark, d).select("src", "dst", F.exp(-F.col("dist")).alias("w"))


@query(f"WITH {_EMB}, {_nn()}, w AS (SELECT src, dst, exp(-dist) AS w FROM nn) SELECT round(max(abs(coalesce(a.w, 0) - coalesce(b.w, 0))), 6) AS gap FROM w a FULL JOIN w b ON a.src = b.dst AND a.dst = b.src")
def graph_asymmetry(spark, d):
    return rounded(graphs.asymmetry(_weighted(spark, d)), "gap")


@query(f"WITH {_EMB}, {_nn()}, w AS (SELECT src, dst, exp(-dist) AS w FROM nn) SELECT src, dst, round(sum(w) / 2, 6) AS w FROM (SELECT * FROM w UNION ALL SELECT dst, src, w FROM w) GROUP BY ALL")
def graph_symmetrised(spark, d):
    return rounded(graphs.symmetrised(_weighted(spark, d)), "w")


@query("SELECT i.i, j.j FROM (SELECT unnest(range(0, 12)) AS i) i, (SELECT unnest(range(0, 12)) AS j) j WHERE i.i <> j.j AND abs(i.i - j.j) <= 2")
def slice_window_pairs(spark, d):
    return graphs.slice_pairs(spark, 12, 2)


@query("SELECT l_partkey AS member, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY l_partkey HAVING count(*) >= 0.3 * (SELECT count(DISTINCT l_suppkey) FROM lineitem)")
def common_genes(spark, d):
    return graphs.common_members(expr(spark, d).select(F.col("gene").alias("member")), n_cells(spark, d), 0.3)


@query(f"WITH {_EMB}, {_nn()}, m AS (SELECT src, min(dist) AS d FROM nn GROUP BY src), q AS (SELECT quantile_cont(d, 0.05) AS lo, quantile_cont(d, 0.95) AS hi FROM m) SELECT round(avg(d), 6) AS mean, count(*) AS n FROM m, q WHERE d >= lo AND d <= hi")
def nearest_distance(spark, d):
    return rounded(graphs.nearest_distance(edges(spark, d)), "mean")


@query(f"WITH {_EMB}, {_nn()} SELECT round(sum(exp(-dist) * sqrt(dist * dist + 0.000001)), 4) AS loss FROM nn")
def charbonnier_loss(spark, d):
    return edges(spark, d).agg(F.round(graphs.charbonnier(F.col("dist") * F.col("dist"), F.exp(-F.col("dist"))), 4).alias("loss"))


@query(f"WITH {_EXPR}, {_RES} SELECT round(sum(mu - x * ln(mu + 1e-8)), 2) AS nll FROM r")
def poisson_nll(spark, d):
    r = preprocess.null_residuals(expr(spark, d)).join(expr(spark, d), ["cell", "gene"])
    return r.agg(F.round(graphs.poisson_nll(F.col("value"), F.col("mu")), 2).alias("nll"))


_FUZZY = f"""
WITH RECURSIVE {_EMB}, {_nn(15)},
ds AS (SELECT src, list(dist ORDER BY dist) AS ds, coalesce(min(dist) FILTER (dist > 0), 0) AS rho FROM nn GROUP BY src),
it AS (
  SELECT src, 0 AS k, 0.0::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 1.0::DOUBLE AS s FROM ds
  UNION ALL
  SELECT src, k + 1, lo, hi, CASE WHEN isfinite(hi) THEN (lo + hi) / 2 ELSE s * 2 END FROM (
    SELECT src, k, CASE WHEN total > log2(15) THEN lo ELSE s END AS lo, CASE WHEN total > log2(15) THEN s ELSE hi END AS hi, s
    FROM (SELECT it.*, list_sum(list_transform(ds, lambda d: exp(-greatest(d - rho, 0) / s))) AS total FROM it JOIN ds USING (src)) WHERE k < 64 AND abs(total - log2(15)) >= 1e-5)),
fit AS (SELECT src, rho, greatest(max_by(s, k), 1e-3 * list_avg(ds)) AS sigma FROM it JOIN ds USING (src) GROUP BY src, rho, ds),
a AS (SELECT src, dst, exp(-greatest(dist - rho, 0) / sigma) AS w FROM nn JOIN fit USING (src)),
b AS (SELECT src, dst, max(v) AS v, max(w) AS w FROM (SELECT src, dst, w, 0 AS v FROM a UNION ALL SELECT dst, src, 0, w FROM a) GROUP BY ALL)
SELECT src, dst, round(w + v - w * v, 6) AS w FROM b
"""


@query(_FUZZY)
def fuzzy_connectivities(spark, d):
    return rounded(graphs.fuzzy_connectivities(edges(spark, d, 15), 15), "w")


@query()
def graph_communities(spark, d):
    e = _weighted(spark, d).where("src < dst")
    return graphs.communities(e).select("id", "community")


@query(
    f"WITH RECURSIVE {_EMB}, {_nn(10)}, own AS (SELECT src, dst FROM nn UNION SELECT src, src FROM nn), strong AS (SELECT a.src AS a, b.src AS b FROM own a JOIN own b ON a.dst = b.dst AND a.src < b.src GROUP BY ALL HAVING count(*) >= 4), "
    "e AS (SELECT a AS src, b AS dst FROM strong UNION ALL SELECT b, a FROM strong), core AS (SELECT src AS id FROM e GROUP BY src HAVING count(*) >= 2), "
    "reach AS (SELECT id, id AS c FROM core UNION SELECT e.dst, r.c FROM reach r JOIN e ON e.src = r.id JOIN core ON core.id = e.dst), found AS (SELECT id, min(c) AS cluster FROM reach GROUP BY id) "
    "SELECT * FROM found UNION ALL SELECT e.src, min(cluster) FROM e JOIN found ON found.id = e.dst WHERE e.src NOT IN (SELECT id FROM core) GROUP BY e.src"
)
def snn_clusters(spark, d):
    return graphs.shared_neighbour_clusters(neighbors.shared_neighbours(edges(spark, d, 10).select("src", "dst")), 4, 2)


@query()
def point_normals(spark, d):
    p = points(spark, d)
    near = neighbors.knn(p.select("id", F.array("x", "y", "z").alias("vec")), k=12)
    return rounded(graphs.normals(p, near), "nx", "ny", "nz", digits=4)


@query(f"WITH {_EMB}, {_nn(3, 'a.id <> b.id', 'a.id, b.grp', extra=', b.grp AS target')} SELECT src, dst, round(dist, 6) AS dist, target FROM nn")
def batch_balanced_knn(spark, d):
    return rounded(graphs.balanced_neighbours(points(spark, d), 3), "dist")


@query(f"WITH {_BRANDS}, b AS (SELECT s_suppkey AS cell, s_nationkey % 3 AS batch FROM supplier), e AS (SELECT expr.*, batch FROM expr JOIN b USING (cell)), w AS (SELECT *, avg(value) OVER g AS m, stddev_pop(value) OVER g AS s, avg(value) OVER p AS mb, stddev_pop(value) OVER p AS sb, count(*) OVER p AS n FROM e WINDOW g AS (PARTITION BY gene), p AS (PARTITION BY gene, batch)) SELECT cell, gene, round(m + (value - m - n / (n + 1.0) * (mb - m)) * coalesce(pow(s / nullif(sb, 0), n / (n + 1.0)), 1.0), 4) AS value FROM w")
def batch_centred(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_nationkey") % 3).alias("batch"))
    return rounded(residual.centre_batches(brands(spark, d), b), "value", digits=4)


@query()
def hvg_trend(spark, d):
    return rounded(residual.trend_variable_genes(expr(spark, d), n_cells(spark, d), 50), "mean", "variance", "variance_norm")


@query()
def regression_residuals(spark, d):
    return rounded(residual.regression_residuals(brands(spark, d), n_cells(spark, d)), "residual", digits=4)


@query()
def gene_linkage(spark, d):
    """Average linkage of genes on 1 - |r|, cut into five clusters."""
    r = _cor(spark, d).orderBy("a", "b").toPandas()
    genes = sorted(set(r["a"]) | set(r["b"]))
    at = {g: k for k, g in enumerate(genes)}
    dist = np.ones((len(genes), len(genes)))
    for a, b, x in r.itertuples(index=False):
        dist[at[a], at[b]] = dist[at[b], at[a]] = 1 - abs(x)
    found = graphs.cut(graphs.linkage(dist), len(genes), 5)
    return spark.createDataFrame([(g, int(c)) for g, c in zip(genes, found, strict=True)], "gene string, cluster bigint")


# Stack scores ---------------------------------------------------------------------------------------------------------

_FLAT = "list_distance([a.x, a.y], [b.x, b.y])"
_CROSS = f"""fwd AS (SELECT a.id AS src, b.id AS dst, {_FLAT} AS dist FROM emb a, emb b WHERE b.grp = a.grp + 1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_FLAT}, b.id) <= 4),
back AS (SELECT a.id AS src, b.id AS dst, {_FLAT} AS dist FROM emb a, emb b WHERE b.grp = a.grp - 1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_FLAT}, b.id) <= 4)"""
_WE = f"""{_CROSS}, e AS (SELECT src, dst, a.grp, dist * dist AS dx2, list_distance(a.vec, b.vec) ** 2 AS df2 FROM fwd JOIN emb a ON src = a.id JOIN emb b ON dst = b.id),
w AS (SELECT *, exp(-dx2 / median(dx2) OVER (PARTITION BY grp) - df2 / median(df2) OVER (PARTITION BY grp)) AS w FROM e)"""


def _stack(spark, d):
    return points(spark, d).select("id", "grp", "x", "y", "vec", "label")


@query(f"WITH {_EMB}, {_CROSS}, u AS (SELECT * FROM fwd UNION ALL SELECT * FROM back), k AS (SELECT *, row_number() OVER (ORDER BY dist, src, dst) AS r, count(*) OVER () AS n FROM u) SELECT src, dst, round(dist, 6) AS dist FROM k WHERE r <= floor(n * 0.99)")
def cross_slice_edges(spark, d):
    return rounded(scores.slice_edges(_stack(spark, d), 4), "dist").select("src", "dst", "dist")


@query(f"WITH {_EMB}, {_WE} SELECT src, dst, round(w, 6) AS w FROM w")
def cross_slice_weights(spark, d):
    return rounded(scores.weighted_edges(_stack(spark, d), 4), "w").select("src", "dst", "w")


@query(f"WITH {_EMB}, {_WE} SELECT round(avg(exp(-dx2)), 6) AS spatial, round(avg(exp(-df2)), 6) AS feature, round(avg(exp(-dx2 / 2) * exp(-df2 / 2)), 6) AS mixed, count(*) AS n FROM w")
def match_scores(spark, d):
    return rounded(scores.match_scores(scores.weighted_edges(_stack(spark, d), 4)), "spatial", "feature", "mixed")


@query(f"WITH {_EMB}, {_WE}, n AS (SELECT count(*) AS n FROM emb) SELECT round(sum(w * dx2) / max(n), 6) AS spatial, round(sum(w * df2) / max(n), 6) AS feature FROM w, n")
def stack_smoothness(spark, d):
    p = _stack(spark, d)
    return rounded(scores.smoothness(scores.weighted_edges(p, 4), p.count()), "spatial", "feature")


@query(f"WITH {_EMB}, {_WE}, af AS (SELECT src AS id, dst AS after, w AS wa FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) = 1), be AS (SELECT dst AS id, src AS before, w AS wb FROM w QUALIFY row_number() OVER (PARTITION BY dst ORDER BY w DESC, src) = 1) SELECT round(sum(wa * wb * ((a.x - 2 * p.x + b.x) ** 2 + (a.y - 2 * p.y + b.y) ** 2)) / sum(wa * wb), 6) AS bending, count(*) AS n FROM af JOIN be USING (id) JOIN emb p USING (id) JOIN emb a ON a.id = after JOIN emb b ON b.id = before")
def stack_bending(spark, d):
    p = _stack(spark, d)
    return rounded(scores.bending(p, scores.weighted_edges(p, 4)), "bending")


@query(f"WITH {_EMB}, {_CROSS} SELECT round(avg((a.label = b.label)::INTEGER), 6) AS same, count(*) AS n FROM fwd JOIN emb a ON src = a.id JOIN emb b ON dst = b.id")
def label_agreement(spark, d):
    p = _stack(spark, d)
    return rounded(scores.label_agreement(scores.weighted_edges(p, 4), p), "same")


# Integration, merging and further scores --------------------------------------------------------------------------------


@query(f"WITH {_EMB} SELECT label, round((sum(w * x * y) / sum(w) - sum(w * x) * sum(w * y) / (sum(w) * sum(w))) / sqrt((sum(w * x * x) / sum(w) - sum(w * x) * sum(w * x) / (sum(w) * sum(w))) * (sum(w * y * y) / sum(w) - sum(w * y) * sum(w * y) / (sum(w) * sum(w)))), 6) AS r FROM (SELECT label, x, y, exp(-abs(z)) AS w FROM emb) GROUP BY label")
def weighted_correlation(spark, d):
    r = vectors.weighted_pearson(F.col("x"), F.col("y"), F.exp(-F.abs("z")))
    return points(spark, d).groupBy("label").agg(F.round(r, 6).alias("r"))


@query(f"WITH {_EMB}, {_nn()}, both_ways AS (SELECT src, dst, 1 / (1 + dist) AS w FROM nn UNION ALL SELECT dst, src, 1 / (1 + dist) FROM nn), e AS (SELECT src, dst, max(w) AS w FROM both_ways GROUP BY ALL) SELECT src AS id, count(*) AS degree, round(sum(w), 6) AS strength FROM e GROUP BY src")
def degree_centrality(spark, d):
    return rounded(graphs.centrality(edges(spark, d).select("src", "dst", (1 / (1 + F.col("dist"))).alias("w"))), "strength")


@query(
    f"WITH {_EMB}, {_nn()}, l AS (SELECT id, CASE WHEN id % 7 = 0 THEN 1000 + id % 3 ELSE label END AS label FROM emb), small AS (SELECT label FROM l GROUP BY label HAVING count(*) < 30), "
    "led AS (SELECT nn.src, b.label AS target, sum(round(1 / (1 + nn.dist), 9)) AS w FROM nn JOIN l a ON a.id = nn.src AND a.label IN (SELECT label FROM small) JOIN l b ON b.id = nn.dst AND b.label NOT IN (SELECT label FROM small) GROUP BY ALL), "
    "best AS (SELECT src, target FROM led QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, target) = 1) SELECT l.id, coalesce(best.target, l.label) AS label FROM l LEFT JOIN best ON best.src = l.id"
)
def small_labels_merged(spark, d):
    own = points(spark, d).select("id", F.when(F.col("id") % 7 == 0, 1000 + F.col("id") % 3).otherwise(F.col("label")).alias("label"))
    return labels.merge_small(edges(spark, d).select("src", "dst", F.round(1 / (1 + F.col("dist")), 9).alias("w")), own, 30)


@query(
    f"WITH {_EMB}, box AS (SELECT grp, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM emb GROUP BY grp), m AS (SELECT max(hx - lx) AS wx, max(hy - ly) AS wy FROM box) "
    "SELECT id, grp, round(x - lx + (wx - hx + lx) / 2, 6) + 0.0 AS x, round(y - ly + (wy - hy + ly) / 2, 6) + 0.0 AS y FROM emb JOIN box USING (grp), m"
)
def padded_slices(spark, d):
    return rounded(geometry.padded(points(spark, d).select("id", "grp", "x", "y")), "x", "y")


@query()
def normal_continuity(spark, d):
    p = points(spark, d)
    cross = neighbors.knn(p, k=K, scope="next").select("src", "dst", F.exp(-F.col("dist")).alias("w"))
    return rounded(scores.normal_continuity(p, cross), "score")


@query(f"WITH {_EMB}, {_nn(where="a.grp <> b.grp", part="a.id, b.grp", extra=", b.grp AS target")} SELECT a.src, a.dst, round(a.dist, 6) AS dist, a.target FROM nn a JOIN nn b ON a.src = b.dst AND a.dst = b.src")
def mnn_anchors(spark, d):
    return rounded(integrate.anchors(points(spark, d), K), "dist")


@query()
def mnn_corrected(spark, d):
    out = integrate.mnn_correct(points(spark, d), 0, K)
    return out.select("id", "grp", F.transform("vec", lambda v: F.round(v, 6)).alias("vec"))


@query()
def harmony_corrected(spark, d):
    out = integrate.harmony(points(spark, d))
    return out.select("id", "grp", F.transform("vec", lambda v: F.round(v, 4)).alias("vec"))


# Descriptors, soft matches, moments and learning ------------------------------------------------------------------------

_UNIT = "n.vec[{i}] / sqrt(n.vec[4] ** 2 + n.vec[5] ** 2 + n.vec[6] ** 2)"
_FPFH = f"""
WITH {_EMB}, f AS (SELECT id, x, y, z, {', '.join(_UNIT.format(i=i) + f' AS n{a}' for i, a in ((4, 'x'), (5, 'y'), (6, 'z')))} FROM emb n),
e AS (SELECT a.id AS src, b.id AS dst, list_distance([a.x, a.y, a.z], [b.x, b.y, b.z]) AS dist FROM emb a, emb b WHERE a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) <= 8),
p AS (SELECT src, dst, dist, a.nx AS ax, a.ny AS ay, a.nz AS az, b.nx AS bx, b.ny AS by_, b.nz AS bz, (b.x - a.x) / dist AS sx, (b.y - a.y) / dist AS sy, (b.z - a.z) / dist AS sz FROM e JOIN f a ON a.id = src JOIN f b ON b.id = dst WHERE dist >= 1e-10),
c AS (SELECT *, ay * sz - az * sy AS cx, az * sx - ax * sz AS cy, ax * sy - ay * sx AS cz FROM p),
t AS (SELECT src, dst, dist, [(sx * bx + sy * by_ + sz * bz + 1) / 2, (sx * ax + sy * ay + sz * az + 1) / 2, (CASE WHEN sqrt(cx * cx + cy * cy + cz * cz) > 1e-10 THEN atan2((bx * cx + by_ * cy + bz * cz) / sqrt(cx * cx + cy * cy + cz * cz), bx * ax + by_ * ay + bz * az) ELSE 0 END + pi()) / (2 * pi())] AS shares FROM c),
b AS (SELECT src, dst, dist, least(floor(greatest(0, least(1, round(unnest(shares), 9))) * 11), 10)::BIGINT + unnest([0, 11, 22]) AS bin FROM t),
h AS (SELECT src AS id, bin, count(*) / max(n) AS share FROM b JOIN (SELECT src, count(*)::DOUBLE AS n FROM t GROUP BY src) USING (src) GROUP BY ALL),
w AS (SELECT src AS id, sum(1 / dist) AS w FROM t GROUP BY src), l AS (SELECT t.src AS id, h.bin, sum(h.share / t.dist) / max(w.w) AS v FROM t JOIN h ON h.id = t.dst JOIN w ON w.id = t.src GROUP BY ALL),
u AS (SELECT id, bin, sum(v) AS v FROM (SELECT id, bin, share AS v FROM h UNION ALL SELECT * FROM l) GROUP BY ALL)
SELECT id, bin::BIGINT AS bin, round(v / sum(v) OVER (PARTITION BY id), 6) AS value FROM u
"""


@query(_FPFH)
def point_feature_histograms(spark, d):
    """Histograms of the points' first three dimensions, the next three as their normals."""
    size = vectors.norm(F.slice("vec", 4, 3))
    p = points(spark, d).select("id", "x", "y", "z", *[(F.col("vec")[i] / size).alias(f"n{a}") for i, a in ((3, "x"), (4, "y"), (5, "z"))])
    near = neighbors.knn(p.select("id", F.array("x", "y", "z").alias("vec")), k=8)
    return rounded(descriptors.feature_histograms(p, near), "value")


_SOFT = f"""
WITH {_EMB}, unit AS (SELECT id, grp, x, y, list_transform(vec, lambda v: v / sqrt(list_inner_product(vec, vec))) AS vec FROM emb),
qr AS (SELECT q.id AS src, r.id AS dst, list_distance(q.vec, r.vec) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, r.vec), r.id) AS rank FROM unit q JOIN unit r ON q.grp = r.grp + 1 QUALIFY rank <= 20),
rq AS (SELECT r.id AS src, q.id AS dst, list_distance(q.vec, r.vec) AS dist, row_number() OVER (PARTITION BY r.id ORDER BY list_distance(q.vec, r.vec), q.id) AS rank FROM unit q JOIN unit r ON q.grp = r.grp + 1 QUALIFY rank <= 20),
near AS (SELECT a.id AS src, b.id AS dst, exp(-(list_distance([a.x, a.y], [b.x, b.y]) ** 2) / 2) AS g FROM emb a JOIN emb b ON a.grp = b.grp QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance([a.x, a.y], [b.x, b.y]), b.id) <= 12),
wq AS (SELECT *, sqrt(greatest(1 - dist * dist / 2, 0)) AS w FROM qr), wr AS (SELECT *, sqrt(greatest(1 - dist * dist / 2, 0)) AS w FROM rq),
pairs AS (SELECT wq.src AS q, wq.dst AS r, wq.w * wr.w AS w FROM wq JOIN wr ON wr.src = wq.dst AND wr.dst = wq.src WHERE wq.rank <= 6 AND wr.rank <= 6),
a AS (SELECT wq.src AS q, near.dst AS r, sum(w * g) AS a FROM wq JOIN near ON near.src = wq.dst GROUP BY ALL),
b AS (SELECT wr.src AS r, near.dst AS q, sum(w * g) AS b FROM wr JOIN near ON near.src = wr.dst GROUP BY ALL)
SELECT emb.grp AS pair, p.r, p.q, round(sqrt(p.w * sqrt(a.a * b.b) / 12.0), 6) AS score FROM pairs p JOIN a USING (q, r) JOIN b USING (q, r) JOIN emb ON emb.id = p.r
"""


@query(_SOFT)
def soft_swnn_score(spark, d):
    """Every consecutive slice pair; ``pair`` is the reference's slice."""
    p = points(spark, d).withColumn("vec", vectors.unit(F.col("vec")))
    rq, qr = neighbors.knn(p, k=20, scope="next", exclude_self=False), neighbors.knn(p.withColumn("grp", -F.col("grp")), k=20, scope="next", exclude_self=False)
    near = neighbors.knn(p.select("id", "grp", F.array("x", "y").alias("vec")), k=12, scope="within", exclude_self=False)
    qr, rq, near = map(plans.settled, (qr, rq, near))
    out = rounded(neighbors.soft_matched_score(qr, rq, near, near, 6, 20, 12), "score")
    return out.join(p.select(F.col("id").alias("r"), F.col("grp").alias("pair")), "r").select("pair", "r", "q", "score")


@query(
    f"WITH {_EMB}, {_BRANDS}, c AS (SELECT var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM emb), s AS (SELECT gene, sum(value) AS w, sum(value * x) / sum(value) AS mx, sum(value * y) / sum(value) AS my, sum(value * x * x) / sum(value) AS qxx, sum(value * y * y) / sum(value) AS qyy, sum(value * x * y) / sum(value) AS qxy FROM expr JOIN emb ON id = cell GROUP BY gene) "
    "SELECT gene, round((yy * (qxx - mx * mx) + xx * (qyy - my * my) - 2 * xy * (qxy - mx * my)) / (xx * yy - xy * xy), 6) AS moment, w AS weight FROM s, c"
)
def gene_spread(spark, d):
    return rounded(stats.weighted_moments(brands(spark, d), points(spark, d)), "moment")


@query("SELECT vec_id AS id, r.r AS repeat, ((('0x' || left(md5(vec_id || ':' || r.r), 8))::BIGINT) % 5)::INTEGER AS fold FROM embeddings, (SELECT unnest([0, 1])::INTEGER AS r) r")
def hash_folds(spark, d):
    return learning.folds(points(spark, d).select("id"), 5, 2)


@query()
def held_out_labels(spark, d):
    """A row per class-balanced score of a logistic model on rows that it has not seen."""
    found, _ = learning.held_out(points(spark, d).select("id", "vec", "label"), "logistic", n=3)
    return rounded(learning.class_scores(found, ["fold"]), "accuracy", "balanced", "precision", "recall", "f1", digits=4)


@query()
def residual_pca(spark, d):
    """The residual form of generalised PCA on brand counts."""
    rows = decompose.residual_vectors(brands(spark, d))
    v, _, mean = decompose.pca(rows, 3)
    return rounded(decompose.project(rows, v, mean).select("cell", *[F.col("scores")[i].alias(f"pc{i + 1}") for i in range(3)]), "pc1", "pc2", "pc3", digits=4)


@query()
def em_mixed(spark, d):
    """As ``em_rigid`` with a mixing proportion for every moving point."""
    p = points(spark, d).select("id", "x", "y")
    m, s2 = register.em_register(geometry.transform_points(p, _SMALL), p, "rigid", mixed=True)
    return _matrix_rows(spark, m, sigma2=round(s2, 6))


@query(f"WITH {_EMB}, nn AS (SELECT a.id AS src, b.id AS dst, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS rank FROM emb a JOIN emb b ON b.grp = a.grp + 1 QUALIFY rank <= 2) SELECT x.src, x.dst, round(x.dist, 6) AS dist, round(y.dist, 6) AS second FROM nn x JOIN nn y ON x.src = y.src AND x.rank = 1 AND y.rank = 2 WHERE x.dist < 0.97 * y.dist")
def ratio_matches(spark, d):
    return rounded(neighbors.ratio_matches(neighbors.knn(points(spark, d), k=2, scope="next", exclude_self=False), 0.97), "dist", "second")


@query(f"WITH {_EMB}, {_nn()}, w AS (SELECT src, dst, exp(-dist) AS w FROM nn), deg AS (SELECT src, sum(w) AS d FROM w GROUP BY src) SELECT w.src, w.dst, round(-w / sqrt(a.d * b.d), 6) AS w FROM w JOIN deg a ON a.src = w.src JOIN deg b ON b.src = w.dst UNION ALL SELECT id, id, 1.0 FROM emb")
def graph_laplacian(spark, d):
    return rounded(graphs.laplacian(_weighted(spark, d), points(spark, d)), "w")


@query(
    f"WITH RECURSIVE {_EMB}, e AS (SELECT a.id AS src, b.id AS dst FROM emb a JOIN emb b ON a.label = b.label AND a.id <> b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {_RADIUS}), core AS (SELECT src AS id FROM e GROUP BY src HAVING count(*) + 1 >= 3), "
    "reach AS (SELECT id, id AS c FROM core UNION SELECT e.dst, r.c FROM reach r JOIN e ON e.src = r.id JOIN core ON core.id = e.dst), found AS (SELECT id, min(c) AS cluster FROM reach GROUP BY id), "
    "near AS (SELECT e.src AS id, min(cluster) AS near FROM e JOIN found ON found.id = e.dst GROUP BY ALL) SELECT emb.id, label, coalesce(cluster, near, -1) AS part FROM emb LEFT JOIN found USING (id) LEFT JOIN near USING (id)"
)
def labels_split(spark, d):
    """Labels whose members lie apart, in parts; -1 is none."""
    p = points(spark, d)
    return graphs.split_points(p, _RADIUS, 3).withColumn("part", F.coalesce("part", F.lit(-1)))


@query(f"WITH {_EMB} SELECT id AS source, t.target, greatest(t.value, 0) AS value FROM emb, (SELECT unnest([{{'target': 'x', 'value': x}}, {{'target': 'y', 'value': y}}, {{'target': 'z', 'value': z}}]) AS t)")
def unpivot_edges(spark, d):
    return tables.unpivot_edges(points(spark, d).select("id", "x", "y", "z"), "id", drop_negative=True)


@query(
    f"WITH {_EMB}, {_nn(8)}, m AS (SELECT src AS cell, dst AS spot, exp(-dist) AS score FROM nn), best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY cell ORDER BY score DESC, spot) = 1), "
    "lack AS (SELECT id AS spot, 1 + id % 3 - (SELECT count(*) FROM best WHERE best.spot = emb.id) AS lack FROM emb), more AS (SELECT m.* FROM m JOIN lack USING (spot) WHERE lack > 0 AND NOT EXISTS (SELECT 1 FROM best WHERE best.cell = m.cell AND best.spot = m.spot) QUALIFY row_number() OVER (PARTITION BY spot ORDER BY score DESC, cell) <= lack) "
    "SELECT spot, cell, round(score, 6) AS score, 'max' AS kind FROM best UNION ALL SELECT spot, cell, round(score, 6), 'add' FROM more"
)
def placed_cells(spark, d):
    """Cells placed on spots of one to three cells."""
    mapping = edges(spark, d, 8).select(F.col("src").alias("cell"), F.col("dst").alias("spot"), F.exp(-F.col("dist")).alias("score"))
    return rounded(tables.place_cells(mapping, points(spark, d).select(F.col("id").alias("spot"), (1 + F.col("id") % 3).alias("n"))), "score")


@query("SELECT column_name AS name, CASE WHEN column_type IN ('FLOAT', 'DOUBLE') OR column_type LIKE 'DECIMAL%' THEN 'continuous' ELSE 'discrete' END AS kind FROM (DESCRIBE lineitem)")
def column_kinds(spark, d):
    return tables.column_kinds(table(spark, d, "lineitem"))


@query(f"WITH {_BRANDS}, {_CELLS}, s AS (SELECT * FROM expr JOIN cells USING (cell) WHERE value > 0), c AS (SELECT grp, count(*) AS size FROM s GROUP BY grp, cell), g AS (SELECT grp, count(*) AS size FROM s GROUP BY grp, gene) SELECT grp, 'cell' AS side, size, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT grp, 'gene', size, count(*) FROM g GROUP BY ALL")
def detection_counts(spark, d):
    return preprocess.detection(brands(spark, d), cells(spark, d))


@query(
    f"WITH {_BRANDS}, cov AS (SELECT cell, ln(sum(value)) AS c FROM expr GROUP BY cell), a AS (SELECT count(*)::DOUBLE AS n, avg(c) AS mc, var_pop(c) AS vc FROM cov), "
    "f AS (SELECT gene, sum(value) AS s, sum(value * value) AS q, sum(value * (c - mc)) AS k, any_value(n) AS n, any_value(mc) AS mc, any_value(vc) AS vc FROM expr JOIN cov USING (cell), a GROUP BY gene), "
    "p AS (SELECT *, k / (n * vc) AS slope, sqrt(greatest(q - s * s / n - k * k / (n * vc), 0) / (n - 1)) AS sd FROM f) SELECT cell, gene, round(least((value - s / n - slope * (c - mc)) / sd, 3.0), 6) + 0.0 AS z FROM expr JOIN cov USING (cell) JOIN p USING (gene)"
)
def scale_regressed(spark, d):
    """Counts scaled after a regression on the logarithm of a cell's total."""
    b = brands(spark, d)
    return rounded(preprocess.regressed(b, b.groupBy("cell").agg(F.ln(F.sum("value")).alias("c")), 3.0), "z")


@query(
    f"WITH {_EMB}, q AS (SELECT id, f.f, list_transform(vec[3 * f.f + 1 : 3 * f.f + 3], lambda v: v * v) AS s FROM emb, (SELECT unnest([0, 1, 2]) AS f) f), p AS (SELECT id, f, list_transform(s, lambda v: v / list_sum(s)) AS p FROM q), "
    "v AS (SELECT id, list_position(p, list_max(p)) - 1 AS predicted, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT id, predicted AS mode FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, predicted) = 1), "
    "a AS (SELECT id, [avg(p[1]), avg(p[2]), avg(p[3])] AS mean FROM p GROUP BY id) SELECT id, mode::INTEGER AS mode, (list_position(mean, list_max(mean)) - 1)::INTEGER AS best, round(list_max(mean), 6) AS score FROM m JOIN a USING (id)"
)
def folds_joined(spark, d):
    """Three folds' class probabilities, each from three dimensions' squares."""
    v = F.col("vec")
    each = points(spark, d).select("id", v, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("f")).withColumn("s", F.transform(F.slice(v, F.col("f") * 3 + 1, F.lit(3)), lambda x: x * x))
    each = each.withColumn("p", F.transform("s", lambda x: x / (F.col("s")[0] + F.col("s")[1] + F.col("s")[2])))
    found = each.select("id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("predicted"), "p")
    return rounded(learning.over_folds(found).select("id", "mode", "best", "score"), "score")


_TAU2 = f"WITH {_EMB}, {_nn(K, 'b.grp = a.grp + 1')}, w AS (SELECT src, dst, exp(-dist) AS w FROM nn), p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w)"


@query(_TAU2 + " SELECT round(sum(p * list_distance(a.vec, b.vec) ** 2) / (sum(p) * max(len(a.vec))), 6) AS tau2, round(sum(p * (2 - 2 * list_cosine_similarity(a.vec, b.vec))) / (sum(p) * max(len(a.vec))), 6) AS tau2_cosine, round(sum(p), 6) AS mass FROM p JOIN emb a ON a.id = src JOIN emb b ON b.id = dst")
def feature_variance(spark, d):
    p = points(spark, d)
    w = neighbors.knn(p, k=K, scope="next", exclude_self=False).select("src", "dst", F.exp(-F.col("dist")).alias("w"))
    posterior = w.join(w.groupBy("src").agg(F.sum("w").alias("all")), "src").select("src", "dst", (F.col("w") / F.col("all")).alias("p"))
    plain, cosine = (scores.feature_variance(posterior, p, p, c) for c in (False, True))
    return rounded(plain.crossJoin(cosine.select(F.col("tau2").alias("tau2_cosine"))), "tau2", "tau2_cosine", "mass").select("tau2", "tau2_cosine", "mass")


@query(
    f"WITH {_BRANDS}, p AS (SELECT x.gene AS a, y.gene AS b, x.cell, x.value AS u, y.value AS v FROM expr x JOIN expr y ON x.cell = y.cell AND x.gene < y.gene), n AS (SELECT a, b FROM p GROUP BY ALL), "
    "s AS (SELECT p.a, p.b, sum(sign(p.u - q.u) * sign(p.v - q.v)) AS s, sum(abs(sign(p.u - q.u))) AS x, sum(abs(sign(p.v - q.v))) AS y FROM p JOIN p q ON p.a = q.a AND p.b = q.b AND p.cell < q.cell GROUP BY ALL) "
    "SELECT a, b, CASE WHEN x * y > 0 THEN round(s / sqrt(x::DOUBLE * y), 6) + 0.0 END AS r FROM n LEFT JOIN s USING (a, b)"
)
def kendall_genes(spark, d):
    return rounded(network.kendall(brands(spark, d)), "r")


@query()
def adaptive_ransac_fit(spark, d):
    """As ``ransac_fit`` with thresholds from the residuals."""
    p = points(spark, d).select("id", "x", "y")
    moved = geometry.transform_points(p, _TURN).select("id", F.col("x").alias("u"), F.when(F.col("id") % 5 == 0, -F.col("y")).otherwise(F.col("y")).alias("v"))
    m, n, _ = register.adaptive_ransac(p.join(moved, "id"), ("x", "y"), ("u", "v"), "rigid", least=10, sample=3)
    return _matrix_rows(spark, m, inliers=float(n))


@query("WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) / count(value) AS e FROM events GROUP BY event_type), p AS (SELECT event_type AS grp, lead(event_type) OVER w AS next, m - lead(m) OVER w AS gap, e, n, lead(e) OVER w AS e2, lead(n) OVER w AS n2 FROM g WINDOW w AS (ORDER BY event_type)) SELECT grp, next, round(gap / sqrt(e + e2), 6) AS t, round((e + e2) ** 2 / (e * e / (n - 1) + e2 * e2 / (n2 - 1)), 6) AS df FROM p WHERE next IS NOT NULL")
def welch_statistics(spark, d):
    return rounded(stats.consecutive_t_tests(table(spark, d, "events"), "event_type", "value").drop("p"), "t", "df")


_U = "(('0x' || left(md5(id || ':' || {k} || ':0'), 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"WITH {_EMB}, d AS (SELECT id, least(1.0, abs(x)) AS p, list_sum(list_transform(range(20), lambda j: CASE WHEN {_U.format(k='j')} < least(1.0, abs(x)) THEN 1 ELSE 0 END))::INTEGER AS n FROM emb) SELECT id, n FROM d WHERE n > 0 AND {_U.format(k="'stay'")} < n / 20.0::DOUBLE")
def thinned_visits(spark, d):
    return trajectory.thinned(points(spark, d).select("id", F.least(F.lit(1.0), F.abs("x")).alias("p")))


@query(
    f"WITH {_EMB}, o AS (SELECT id, vec, t.t, row_number() OVER (PARTITION BY t.t ORDER BY md5(id || ':' || t.t || ':0'), id) - 1 AS at, count(*) OVER (PARTITION BY t.t) AS n FROM emb, (SELECT unnest([0, 1]) AS t) t), "
    "s AS (SELECT -(a.at + 1 + a.t * a.n) AS id, list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] + z[2]) / 2) AS vec FROM o a JOIN o b ON a.t = b.t AND b.at = (a.at + 1) % a.n), u AS (SELECT id, vec FROM emb UNION ALL SELECT * FROM s), "
    "nn AS (SELECT a.id AS id, b.id AS dst FROM emb a JOIN u b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) <= 30), c AS (SELECT id, count(*) FILTER (dst < 0) AS simulated FROM nn GROUP BY id) "
    "SELECT id, simulated, round((simulated + 1) / 32.0 * 0.05 / (0.9 - (simulated + 1) / 32.0 * 0.85), 6)::DOUBLE AS score FROM c"
)
def doublet_scores(spark, d):
    """Two simulated doublets a cell, each the mean of its pair's vectors."""
    p = points(spark, d).select("id", "vec")
    pairs = preprocess.doublet_pairs(p, 2)
    both = pairs.join(p.select(F.col("id").alias("a"), F.col("vec").alias("u")), "a").join(p.select(F.col("id").alias("b"), F.col("vec").alias("v")), "b")
    mixed = both.select("id", F.zip_with("u", "v", lambda x, y: (x + y) / 2).alias("vec"))
    return rounded(preprocess.doublet_scores(neighbors.knn(p.unionAll(mixed), k=30), 30, 2.0), "score")


@query(f"WITH {_EMB}, m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM emb), c AS (SELECT id, x - mx AS x, y - my AS y, z - mz AS z FROM emb, m) SELECT id, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS x, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 AS y, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 AS z FROM c")
def unit_rows(spark, d):
    rows = preprocess.unit_rows(points(spark, d).select("id", F.array("x", "y", "z").alias("vec")))
    return rounded(rows.select("id", *[F.col("vec")[i].alias(a) for i, a in enumerate("xyz")]), "x", "y", "z")


@query(f"WITH {_EMB} SELECT id, grp, round(x * (1 + grp / 2.0), 6)::DOUBLE AS x, round(y * (1 + grp / 2.0), 6)::DOUBLE AS y FROM emb")
def rescaled_slices(spark, d):
    p = points(spark, d).select("id", "grp", "x", "y")
    return rounded(geometry.rescaled(p, p.select("grp").distinct().withColumn("scale", 1 + F.col("grp") / 2)).select("id", "grp", "x", "y"), "x", "y")


@query(
    f"WITH {_BRANDS}, {_CELLS}, z AS (SELECT grp, count(*) AS n FROM cells GROUP BY grp), m AS (SELECT grp, gene, sum(value) / any_value(n) AS v FROM expr JOIN cells USING (cell) JOIN z USING (grp) GROUP BY ALL), g AS (SELECT count(DISTINCT p_brand)::DOUBLE AS g FROM part), "
    "s AS (SELECT grp, sum(v) AS s, sum(v * v) AS q FROM m GROUP BY grp), d AS (SELECT x.grp AS a, y.grp AS b, sum(x.v * y.v) AS d FROM m x JOIN m y ON x.gene = y.gene AND x.grp < y.grp GROUP BY ALL) "
    "SELECT d.a, d.b, round((d.d - u.s * w.s / g) / sqrt((u.q - u.s * u.s / g) * (w.q - w.s * w.s / g)), 6) AS r FROM d JOIN s u ON u.grp = d.a JOIN s w ON w.grp = d.b, g"
)
def group_correlation(spark, d):
    genes = table(spark, d, "part").select("p_brand").distinct().count()
    return rounded(stats.group_correlation(brands(spark, d), cells(spark, d), genes), "r")


@query("SELECT i, (CASE WHEN i = 11 THEN 170 ELSE floor(i * 170 / 11.0) END)::BIGINT AS first, (CASE WHEN i = 11 THEN 170 ELSE floor(i * 170 / 11.0) END)::BIGINT + 30 AS last FROM range(12) t(i)")
def slice_windows(spark, d):
    return tables.spread_windows(spark, 200, 12, 30)


@query()
def proportions_smoothed(spark, d):
    p = points(spark, d)
    q = p.select("id", F.transform(F.slice("vec", 1, 3), lambda v: v * v).alias("p"))
    out = labels.smoothed(q, edges(spark, d).select("src", "dst", F.lit(1.0).alias("w")))
    return out.select("id", F.transform("p", lambda v: F.round(v, 6)).alias("p"))


@query()
def linear_weights(spark, d):
    return rounded(graphs.linear_weights(points(spark, d), edges(spark, d)), "w")


@query(f"WITH i AS (SELECT p_brand AS gene, min(p_type) AS kind, count(*) AS n_parts FROM part GROUP BY p_brand) SELECT m.*, i.kind, i.n_parts FROM ({_MARK}) m LEFT JOIN i USING (gene)")
def marker_info(spark, d):
    """Markers with what is known of their genes."""
    info = table(spark, d, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.min("p_type").alias("kind"), F.count("*").alias("n_parts"))
    return markers_vs_rest(spark, d).join(info, "gene", "left")
