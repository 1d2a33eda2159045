"""From raw documents to a training mix, one written table per stage.

Quality rules reject documents, frequent lines leave the texts, one document of each near-duplicate group
stays, contaminated documents go, and the rest is mixed to target weights. Each stage reads what the last
one kept and returns the columns of documents; the mix adds the copies and words it takes of each document.

Every stage is written as Parquet to the shared checkpoint folder and read again, so a lost executor
repeats one stage at most. Null texts, languages, sources and ids, empty texts, repeated rows, extra
columns and empty tables are handled as each operator states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from labtide.llm import decontaminate, jaccard, lines, mixing, rules
from labtide.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
]

#: The robust estimates of the first stage are iterated to a fixed number of steps over fitted covariances.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
