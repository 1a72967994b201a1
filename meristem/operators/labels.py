"""Label transfer, voting, diffusion and propagation over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import settled


def arg_max(table: DataFrame, key: list[str], by: str, tie: str) -> DataFrame:
    """The row of each key with the largest ``by``, the smaller ``tie`` first; one partially aggregated pass."""
    best = F.min(F.struct((-F.col(by)).alias("__o"), F.col(tie).alias("__t"), F.struct(*[c for c in table.columns if c not in key]).alias("__r")))
    rest = [F.col(f"__b.__r.{c}").alias(c) for c in table.columns if c not in key]
    return table.groupBy(*key).agg(best.alias("__b")).select(*key, *rest)


def vote(edges: DataFrame, labels: DataFrame, k: int, cutoff: float | None = None, unmapped: str = "unmapping") -> DataFrame:
    """(src, predict, score): the most frequent label among ``k`` neighbours and its share; neighbours beyond ``cutoff`` are ``unmapped``."""
    each = edges.join(labels.select(F.col("id").alias("dst"), F.col("label").cast("string").alias("label")), "dst")
    if cutoff is not None:
        each = each.withColumn("label", F.when(F.col("dist") > cutoff, F.lit(unmapped)).otherwise(F.col("label")))
    share = each.groupBy("src", "label").agg((F.count("*") / F.lit(k)).alias("score"))
    return arg_max(share, ["src"], "score", "label").select("src", F.col("label").alias("predict"), "score")


def diffuse(edges: DataFrame, labels: DataFrame, weight: str = "weight") -> DataFrame:
    """One step: each point takes its labelled neighbours' weight shares; (src, label, score) of the best label."""
    each = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum(weight).alias("w"))
    total = edges.groupBy("src").agg(F.sum(weight).alias("total"))
    scored = each.join(total, "src").select("src", "label", F.try_divide(F.col("w"), F.col("total")).alias("score"))
    return arg_max(scored, ["src"], "score", "label")


def propagate(edges: DataFrame, seeds: DataFrame, gamma: float = 0.7, steps: int = 3, tolerance: float | None = None, weight: str = "weight") -> DataFrame:
    """(id, label, score): fixed point of F <- gamma S F + Y over row-normalised weights, ``steps`` rounds, or fewer when
    the largest change falls to ``tolerance``. Every few rounds the state goes to the checkpoint folder."""
    total = edges.groupBy("src").agg(F.sum(weight).alias("total"))
    s = edges.join(total, "src").select("src", "dst", F.try_divide(F.col(weight), F.col("total")).alias("s"))
    y = seeds.select("id", "label", F.lit(1.0).alias("f"))
    state = y
    reliable = edges.sparkSession.sparkContext.getCheckpointDir() is not None
    for turn in range(steps):
        moved = s.join(state.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg((F.sum(F.col("s") * F.col("f")) * gamma).alias("f"))
        new = moved.select(F.col("src").alias("id"), "label", "f").unionAll(y).groupBy("id", "label").agg(F.sum("f").alias("f"))
        if reliable and turn % 4 == 3:
            new = new.checkpoint()
        if tolerance is not None:
            change = new.join(state.withColumnRenamed("f", "old"), ["id", "label"], "left").agg(F.max(F.abs(F.col("f") - F.coalesce("old", F.lit(0.0))))).first()[0]
            state = new
            if change is None or change <= tolerance:
                break
        state = new
    return arg_max(state.withColumnRenamed("f", "score"), ["id"], "score", "label")


def boundaries(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, boundary): whether some neighbour has another label."""
    own = labels.select(F.col("id").alias("src"), F.col("label").alias("own"))
    other = labels.select(F.col("id").alias("dst"), F.col("label").alias("other"))
    return edges.join(own, "src").join(other, "dst").groupBy(F.col("src").alias("id")).agg(F.bool_or(F.col("own") != F.col("other")).alias("boundary"))


def smooth_mode(edges: DataFrame, labels: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(id, label): the most frequent label among a point and its neighbours; ``fixed`` ids keep theirs."""
    each = edges.select("src", "dst").unionAll(labels.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    counted = each.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
    best = arg_max(counted, ["src"], "n", "label").select(F.col("src").alias("id"), "label")
    if fixed is None:
        return best
    held = labels.join(fixed.select("id"), "id", "left_semi").select("id", F.col("label").alias("held"))
    return best.join(held, "id", "left").select("id", F.coalesce("held", "label").alias("label"))


def merge_small(edges: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """(id, label): members of labels with fewer than ``least`` points take the larger label that most of their edge weight (src, dst, w)
    leads to, ties to the smaller label; without such an edge they keep their own."""
    small = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") < least).select("label")
    moving = labels.join(small, "label", "left_semi").select(F.col("id").alias("src"))
    large = labels.join(small, "label", "left_anti").select(F.col("id").alias("dst"), F.col("label").alias("new"))
    led = edges.join(moving, "src", "left_semi").join(large, "dst").groupBy("src", "new").agg(F.sum("w").alias("w"))
    best = led.groupBy(F.col("src").alias("id")).agg(F.min(F.struct(-F.col("w"), "new"))["new"].alias("new"))
    return labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"))


def one_hot(labels: DataFrame) -> DataFrame:
    """(id, index, value): labels as rows of a one-hot matrix over the sorted vocabulary."""
    vocabulary = labels.select("label").where("label IS NOT NULL").distinct().withColumn("index", F.row_number().over(W.orderBy("label")) - 1)
    return labels.join(vocabulary, "label").select("id", "index", F.lit(1).alias("value"))


def ordinal(table: DataFrame, column: str, name: str = "ordinal") -> DataFrame:
    """A dense ordinal of a label column, from a dimension of its distinct values."""
    values = table.select(column).distinct().withColumn(name, F.dense_rank().over(W.orderBy(column)) - 1)
    return table.join(values, column, "left")


def top_k_mode(scores: DataFrame, labels: DataFrame, k: int, least: float = 0.0, null_label: str = "None") -> DataFrame:
    """(src, label, n): modal label of the ``k`` best-scored partners; scores under ``least`` count as ``null_label``."""
    order = W.partitionBy("src").orderBy(F.desc("score"), "dst")
    best = scores.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k)
    named = best.join(labels.select(F.col("id").alias("dst"), F.col("label").cast("string").alias("label")), "dst").withColumn("label", F.when(F.col("score") < least, null_label).otherwise(F.col("label")))
    return arg_max(named.groupBy("src", "label").agg(F.count("*").alias("n")), ["src"], "n", "label")


def smoothed(values: DataFrame, edges: DataFrame, alpha: float = 1.0, tolerance: float = 1e-10, rounds: int = 1000) -> DataFrame:
    """(id, p) that solves (I + alpha L) p = q for every component of arrays (id, p), with L the Laplacian of the edges (src, dst, w) made
    symmetric: proportions pulled towards their neighbours'. Conjugate gradients with the diagonal as preconditioner, until each
    component's residual falls to ``tolerance`` of its start. An id without edges keeps its values; edges of other ids do not count."""
    width = (values.agg(F.max(F.size("p"))).first()[0]) or 0
    at = range(width)
    ids = values.select("id")
    both = edges.select("src", "dst", "w").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("src <> dst")
    both = both.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    both = settled(both.groupBy("src", "dst").agg((F.sum("w") / 2).alias("w")))
    degree = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    state = values.join(degree, "id", "left").select("id", (1 + alpha * F.coalesce("d", F.lit(0.0))).alias("m"), *[F.lit(0.0).alias(f"x{j}") for j in at], *[F.col("p")[j].cast("double").alias(f"r{j}") for j in at])
    state = settled(state.select("*", *[(F.col(f"r{j}") / F.col("m")).alias(f"s{j}") for j in at]))
    total = lambda f, a, b: [F.coalesce(F.sum(F.col(f"{a}{j}") * F.col(f"{b}{j}") / (F.col("m") if f else F.lit(1.0))), F.lit(0.0)) for j in at]
    rz = list(state.agg(*total(True, "r", "r")).first()) if width else []
    start = list(rz)
    for _ in range(rounds if width else 0):
        if all(now <= tolerance**2 * first for now, first in zip(rz, start, strict=True)):
            break
        near = both.join(state.select(F.col("id").alias("dst"), *[f"s{j}" for j in at]), "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("w") * F.col(f"s{j}")).alias(f"n{j}") for j in at])
        state = settled(state.join(near, "id", "left").select(*state.columns, *[(F.col("m") * F.col(f"s{j}") - alpha * F.coalesce(f"n{j}", F.lit(0.0))).alias(f"q{j}") for j in at]))
        step = [a / b if b else 0.0 for a, b in zip(rz, state.agg(*total(False, "s", "q")).first(), strict=True)]
        state = state.select("id", "m", *[(F.col(f"x{j}") + step[j] * F.col(f"s{j}")).alias(f"x{j}") for j in at], *[(F.col(f"r{j}") - step[j] * F.col(f"q{j}")).alias(f"r{j}") for j in at], *[f"s{j}" for j in at])
        new = list(state.agg(*total(True, "r", "r")).first())
        state = state.select("id", "m", *[f"{c}{j}" for c in "xr" for j in at], *[(F.col(f"r{j}") / F.col("m") + (new[j] / rz[j] if rz[j] else 0.0) * F.col(f"s{j}")).alias(f"s{j}") for j in at])
        rz = new
    return state.select("id", F.array(*[F.col(f"x{j}") for j in at]).alias("p"))
