"""Relational operators over annotation tables: set operations, reshaping, harmonisation, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def concat(tables: dict[str, DataFrame], label: str = "source", join: str = "outer") -> DataFrame:
    """Rows of all tables with their source's name; ``outer`` keeps all columns, ``inner`` the common ones in order."""
    parts = [t.withColumn(label, F.lit(name)) for name, t in tables.items()]
    if join == "inner":
        common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        parts = [p.select(*common) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedupe_first(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; partially aggregated, so a common key is no task of its own."""
    rest = [c for c in table.columns if c not in keys]
    first = F.min(F.struct(*[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], F.struct(*rest).alias("__r"))).alias("__f")
    return table.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__f.__r.{c}").alias(c) for c in rest])


def intersect_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def except_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def attach(cells: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """Left join of sample information; its clashing columns give way to the cells' own."""
    new = [c for c in info.columns if c == key or c not in cells.columns]
    return cells.join(info.select(*new), key, "left")


def split_barcode(cells: DataFrame, column: str = "barcode", separator: str = "-") -> DataFrame:
    """The sample suffix of a barcode as its own column."""
    return cells.withColumn("sample", F.element_at(F.split(column, separator), -1)).withColumn("core", F.element_at(F.split(column, separator), 1))


def shares(table: DataFrame, group: str, feature: str) -> DataFrame:
    """(group, feature, n, ratio): value counts and their share within the group."""
    counts = table.groupBy(group, feature).agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def pair_counts(table: DataFrame, a: str, b: str, least: int) -> DataFrame:
    """(a, b, n) of pairs seen more than ``least`` times."""
    return table.groupBy(a, b).agg(F.count("*").alias("n")).where(F.col("n") > least)


def pivot_counts(table: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return table.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def unpivot(table: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return table.unpivot(ids, values, name, value)


def explode_segments(table: DataFrame, key: str, segments: str) -> DataFrame:
    """(key, position, segment, n): an array column as rows with each key's count; an empty or null list gives the key itself."""
    some = F.when(F.size(F.coalesce(F.col(segments), F.array().cast("array<string>"))) > 0, F.col(segments)).otherwise(F.array(F.col(key).cast("string")))
    return table.select(key, F.size(some).alias("n"), F.posexplode(some).alias("position", "segment"))


def repeat_labels(counts: DataFrame, key: str, label: str, n: str, most: DataFrame | None = None) -> DataFrame:
    """Each label ``n`` times per key, in label order; with ``most`` (key, cap) only the first ``cap`` of a key."""
    rows = counts.where(F.col(n) > 0).select(key, label, F.posexplode(F.array_repeat(F.lit(1), F.col(n).cast("int"))).alias("copy", "__one")).drop("__one")
    if most is None:
        return rows
    ranked = rows.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(label, "copy"))).join(most, key)
    return ranked.where(F.col("__k") <= F.col("cap")).drop("__k", "cap")


def split_by_share(matches: DataFrame, spots: DataFrame, reference: DataFrame, counts: DataFrame) -> DataFrame:
    """(cell, gene, value): a spot's expression split over its first n matched cells by the cells' share per gene, evenly
    where no cell has the gene. ``matches`` (spot, cell, score), ``counts`` (spot, n), ``spots`` (spot, gene, value), ``reference`` (cell, gene, value)."""
    order = W.partitionBy("spot").orderBy(F.desc("score"), "cell")
    taken = matches.withColumn("k", F.row_number().over(order)).join(counts, "spot").where(F.col("k") <= F.col("n")).select("spot", "cell")
    sizes = taken.groupBy("spot").agg(F.count("*").alias("m"))
    full = taken.join(sizes, "spot").join(spots, "spot").join(reference.withColumnRenamed("value", "own"), ["cell", "gene"], "left")
    share = F.coalesce(F.try_divide(F.coalesce("own", F.lit(0.0)), F.sum(F.coalesce("own", F.lit(0.0))).over(W.partitionBy("spot", "gene"))), 1 / F.col("m"))
    return full.select("cell", "gene", (F.col("value") * share).alias("value"))


def widest_column(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, name, value): the column with the largest value of each row, the earlier column at ties."""
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("v"), F.lit(-i).alias("o")) for i, c in enumerate(columns)]))
    return table.select(key, F.element_at(F.array(*map(F.lit, columns)), 1 - best["o"]).alias("name"), best["v"].alias("value"))


def means_and_p(means: DataFrame, ps: DataFrame, max_p: float, min_mean: float = 0.0) -> DataFrame:
    """Cells (id, pair) present in both tables, means masked where p is too high, ids whose means are all zero dropped."""
    both = means.join(ps, ["id", "pair"]).select("id", "pair", F.when((F.col("p") <= max_p) & (F.col("mean") > min_mean), F.col("mean")).otherwise(0.0).alias("mean"), "p")
    alive = both.groupBy("id").agg(F.max("mean").alias("top")).where("top > 0").select("id")
    return both.join(alive, "id", "left_semi")


def tree_edges(spark: SparkSession, edges: DataFrame, root: object, drop_leaves: bool = False) -> DataFrame:
    """(parent, child, depth) reachable from ``root``, level by level with a recursive query."""
    edges.createOrReplaceTempView("__tree_edges")
    kind = edges.schema["parent"].dataType.simpleString()
    out = spark.sql(
        f"""WITH RECURSIVE walk(parent, child, depth) AS (
            SELECT parent, child, 1 FROM __tree_edges WHERE parent = CAST('{root}' AS {kind})
            UNION ALL
            SELECT e.parent, e.child, w.depth + 1 FROM walk w JOIN __tree_edges e ON e.parent = w.child
        ) SELECT * FROM walk"""
    )
    if drop_leaves:
        out = out.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child", "depth")
    return out


def chain_edges(n: int, step: int = 1, root: int = 0, self_pair: bool = False) -> list[tuple[int, int]]:
    """Alignment pairs along a chain in both directions from ``root``, fanning out to ``step`` followers."""
    out = [(root, root)] if self_pair else []
    for direction in (1, -1):
        at = root
        while 0 <= at + direction < n:
            for k in range(1, step + 1):
                if 0 <= at + direction * k < n:
                    out.append((at, at + direction * k))
            at += direction * step
    return out


def ancestors(spark: SparkSession, nodes: DataFrame, missing: int = -10) -> DataFrame:
    """(id, level, ancestor): for each node of (id, parent, level) its ancestor at every level up to its own."""
    nodes.createOrReplaceTempView("__nodes")
    return spark.sql(
        f"""WITH RECURSIVE up(id, ancestor, level, parent) AS (
            SELECT id, id, level, parent FROM __nodes
            UNION ALL
            SELECT u.id, n.id, n.level, n.parent FROM up u JOIN __nodes n ON n.id = u.parent
        ) SELECT id, level, coalesce(ancestor, {missing}) AS ancestor FROM up"""
    )


def harmonise(genes: DataFrame, homology: DataFrame, column: str = "mouse", to: str = "human") -> DataFrame:
    """Genes renamed over a homology table; those without a partner go."""
    return genes.join(homology.select(F.col(column).alias("gene"), F.col(to).alias("partner")), "gene").withColumn("gene", F.col("partner")).drop("partner")


def good_rows_and_columns(expr: DataFrame, min_share: float = 0.5, rounds: int = 10) -> DataFrame:
    """``expr`` without genes or cells that store too small a share of the other side, repeated until stable."""
    for _ in range(rounds):
        cells, genes = expr.select("cell").distinct().count(), expr.select("gene").distinct().count()
        good = expr.groupBy("gene").agg(F.count("*").alias("n"), F.variance("value").alias("v")).where((F.col("n") >= min_share * cells) & (F.col("v") > 0)).select("gene")
        expr2 = expr.join(good, "gene", "left_semi")
        kept = expr2.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= min_share * genes * 0 + 1).select("cell")
        expr2 = expr2.join(kept, "cell", "left_semi")
        same = expr2.select("gene").distinct().count() == genes and expr2.select("cell").distinct().count() == cells
        expr = expr2
        if same:
            break
    return expr


def unpivot_edges(matrix: DataFrame, key: str, drop_negative: bool = False, drop_zero: bool = False) -> DataFrame:
    """(source, target, value): a wide matrix, one row per ``key``, as edges to its other columns. Negative weights may count as zero,
    zeros and nulls may be left out."""
    columns = [c for c in matrix.columns if c != key]
    wide = matrix.select(F.col(key).alias("source"), *[F.col(c).cast("double").alias(c) for c in columns])
    out = wide.unpivot("source", columns, "target", "value")
    if drop_negative:
        out = out.withColumn("value", F.when(F.col("value") < 0, 0.0).otherwise(F.col("value")))
    return out.where("value <> 0") if drop_zero else out


def place_cells(mapping: DataFrame, spots: DataFrame) -> DataFrame:
    """(spot, cell, score, kind) of a mapping (cell, spot, score): every cell at its best spot (``max``); a spot that then holds fewer than
    its number (spot, n) takes the best of the other cells mapped to it (``add``). Ties go to the smaller spot or cell."""
    from .labels import arg_max

    best = arg_max(mapping, ["cell"], "score", "spot").select("spot", "cell", "score", F.lit("max").alias("kind"))
    held = best.groupBy("spot").agg(F.count("*").alias("held"))
    short = spots.join(held, "spot", "left").select("spot", (F.col("n") - F.coalesce("held", F.lit(0))).alias("lack")).where("lack > 0")
    others = mapping.join(best.select("spot", "cell"), ["spot", "cell"], "left_anti").join(short, "spot")
    place = F.row_number().over(W.partitionBy("spot").orderBy(F.desc("score"), "cell"))
    more = others.withColumn("place", place).where("place <= lack").select("spot", "cell", "score", F.lit("add").alias("kind"))
    return best.unionAll(more)


def column_kinds(table: DataFrame) -> DataFrame:
    """(name, kind) of a table's columns: ``continuous`` for fractional numbers, ``discrete`` for all else."""
    fractional = ("float", "double", "decimal")
    kinds = [(n, "continuous" if t.startswith(fractional) else "discrete") for n, t in table.dtypes]
    return table.sparkSession.createDataFrame(kinds, "name string, kind string")


def spread_windows(spark: SparkSession, length: int, count: int, width: int = 30) -> DataFrame:
    """(i, first, last): ``count`` windows of ``width`` places, spread evenly over ``length``; ``last`` is exclusive."""
    step = (length - width) / max(1, count - 1)
    first = F.when(F.col("id") == count - 1, F.lit(length - width if count > 1 else 0)).otherwise((F.col("id") * step).cast("long"))
    return spark.range(count).select(F.col("id").alias("i"), first.cast("long").alias("first")).withColumn("last", F.col("first") + width)
