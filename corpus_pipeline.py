"""A corpus pipeline: documents in, packed sequences out.

Each stage is (name, function) and each function takes (spark, docs, sf_dir); a stage's result is
written as Parquet and read again as the next one's documents. No stage has a form in SQL: the tests
hold each against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonequarry.llm.common import give_back, table, written
from tonequarry.llm.decontamination import drop_contaminated
from tonequarry.llm.language_id import keep_identified, learn
from tonequarry.llm.packing import pack
from tonequarry.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents in which no learned language is found go."""
    return keep_identified(docs, learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 by the rule of a stage (five words, a similarity of 0.8): one document of each group stays, its smallest doc_id."""
    give_back(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark item go."""
    give_back(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a row for each piece of a document in a sequence."""
    give_back(spark)
    return pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
