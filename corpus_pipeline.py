"""A corpus in five stages: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and is the next one's ``docs``.
All but the last keep the columns of ``documents``.

Defined cases, for every stage: rows are told apart by themselves, so null and repeated ids change nothing; a null text
is as good as an empty one, which is no one's copy, holds neither benchmark passages nor personal data, stays null in
all stages but the last, and is packed as its end token; a repeated row is judged like the first, and near duplicates
keep one row of equal texts; texts are taken whole, however long; extra columns are kept, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import costpack, occurrence, pii, tiling, toxicity
from millrace.llm.queries import table
from millrace.llm.scratch import discard, save
from millrace.llm.wordids import word_tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.label_categories())
    return toxicity.drop_toxic(docs, chain)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return occurrence.keep_one(docs, words=5, num=8, den=10)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return costpack.pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", decontaminate),
    ("personal data", mask_pii),
    ("packing", pack),
]

#: The stages' models, joins and packings have no SQL form; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return made
        before, docs = docs, save(made, "stage")
        discard(before, made)  # all that reads them has run
