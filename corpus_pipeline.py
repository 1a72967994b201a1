"""The training-corpus pipeline: language, repeated lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages but the last return the columns of ``documents``.
``run`` writes every stage's result as Parquet in the shared folder and reads it again for the next.

* ``language`` drops documents without a letter and those whose language is less certain than ``LEAST_CERTAIN``.
* ``lines`` drops lines that an earlier document holds; n_chars follows the text.
* ``near_duplicates`` keeps the smallest doc_id of each component; documents without a doc_id or a set stay.
* ``benchmark`` drops documents in which a benchmark window occurs.
* ``packing`` returns the pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meristem.llm._shared import scratch_path
from meristem.llm.decontaminate import marked
from meristem.llm.language_id import fold, predict, train
from meristem.llm.line_dedup import dedup_lines
from meristem.llm.near_dedup import near_duplicates
from meristem.llm.packing import pack

#: A document whose best language has less than this calibrated probability is rejected.
LEAST_CERTAIN = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs.where(fold("doc_id", 3) != 1))
    scored = predict(docs, model)
    return scored.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_CERTAIN)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs)
    dropped = found.where("NOT kept AND component_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return marked(docs, items).where("__n_hit = 0").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_copies), ("benchmark", benchmark), ("packing", packing)]

#: A trained classifier decides the first stage, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
