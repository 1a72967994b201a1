"""Readers and writers of annotation, gene, point and metadata files, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_gtf(spark: SparkSession, path: str, keep: tuple[str, ...] = ("gene_name", "gene_id", "gene_type"), feature: str = "gene") -> DataFrame:
    """chr, start, end and chosen attributes of a GTF file's ``feature`` rows (gz by file name)."""
    names = "chr string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes string"
    rows = spark.read.csv(path, sep="\t", comment="#", schema=names, quote="").where(F.col("feature") == feature)
    value = lambda k: F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{k}\s+"?([^";]*)"?', 1), F.lit(""))
    return rows.select("chr", "start", "end", *[value(k).alias(k) for k in keep])


def attributes(column: str, key: str):
    """One key of an attribute string of the form key="value"."""
    return F.nullif(F.regexp_extract(column, rf'{key}="([^"]*)"', 1), F.lit(""))


def read_homology(spark: SparkSession, path: str) -> DataFrame:
    """(key, mouse, human) from a report with one row per species; the last symbol of a species counts."""
    rows = spark.read.csv(path, sep="\t", header=True).withColumn("__n", F.monotonically_increasing_id())
    return homology(rows.select(F.col("`DB Class Key`").alias("key"), F.col("`Common Organism Name`").alias("species"), F.col("Symbol").alias("symbol"), "__n"), "__n")


def homology(rows: DataFrame, order: str) -> DataFrame:
    """(key, mouse, human) of rows (key, species, symbol), the last by ``order``."""
    species = F.when(F.col("species").startswith("mouse"), "mouse").otherwise(F.col("species"))
    return rows.withColumn("species", species).groupBy("key").pivot("species", ["mouse", "human"]).agg(F.max_by("symbol", order))


def read_structure_tree(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent, level, name) of a nested JSON ontology, flattened on the driver from one small document."""
    import json

    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    rows, stack = [], [(node, None) for node in (lambda d: d if isinstance(d, list) else d.get("msg", [d]))(json.loads(text))]
    while stack:
        node, parent = stack.pop()
        rows.append((node.get("id"), node.get("parent_structure_id", parent), node.get("st_level"), node.get("name")))
        stack += [(child, node.get("id")) for child in node.get("children") or []]
    return spark.createDataFrame(rows, "id bigint, parent bigint, level bigint, name string")


def read_spatial(spark: SparkSession, cells: str, coordinates: str, scales: str | None = None) -> DataFrame:
    """Cells (parquet) joined with coordinates (csv: id, x, y) and optional JSON scale factors; fails if ids don't agree."""
    a = spark.read.parquet(cells)
    b = spark.read.csv(coordinates, header=True, schema="id string, x double, y double")
    lost = a.select(F.col("id").cast("string")).exceptAll(b.select("id")).unionAll(b.select("id").exceptAll(a.select(F.col("id").cast("string"))))
    if not lost.isEmpty():
        raise ValueError("cells and coordinates name different ids")
    out = a.join(b.withColumnRenamed("id", "__id"), F.col("id").cast("string") == F.col("__id")).drop("__id")
    return out.crossJoin(F.broadcast(spark.read.json(scales, multiLine=True).limit(1))) if scales else out


def image_pixels(points: DataFrame, scale: float, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Coordinates as integer pixels of an image at ``scale``."""
    return points.withColumns({f"pixel_{c}": F.round(F.col(c) * scale).cast("long") for c in columns})


def with_metadata(table: DataFrame, library: str, values: dict[str, str], column: str = "metadata") -> DataFrame:
    """A library's entries put into a map column, replacing those of the same key."""
    new = F.create_map(*[F.lit(x) for k, v in values.items() for x in (f"{library}.{k}", str(v))])
    if column not in table.columns:
        return table.withColumn(column, new)
    old = F.map_filter(column, lambda k, _: ~k.isin(*[f"{library}.{x}" for x in values]))
    return table.withColumn(column, F.map_concat(old, new))


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y, z) of an ASCII point cloud."""
    lines = spark.read.text(path)
    number = r"^\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)"
    part = lines.where(F.col("value").rlike(number)).withColumn("id", F.monotonically_increasing_id())
    return part.select("id", *[F.regexp_extract("value", number, i + 1).cast("double").alias(a) for i, a in enumerate("xyz")])


def write_table(table: DataFrame, path: str, export: str | None = None) -> None:
    """Parquet, and a tab-separated copy where asked."""
    table.write.mode("overwrite").parquet(path)
    if export:
        table.write.mode("overwrite").option("sep", "\t").option("header", True).csv(export)
