"""The subpackage's queries: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bestfit, costpack, hmm, multiindex, occurrence, pii, piececount, sharding, tiling, toxicity
from millrace.llm.wordids import word_tokenizer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"))


def op2_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.label_categories()))


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bestfit.pack(table(spark, sf_dir, "documents"), word_tokenizer())
    tokens = F.element_at("cu_seqlens", -1).alias("n_tokens")
    return packed.select("sequence_id", tokens, F.crc32("input_ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"), "cu_seqlens", "doc_ids", "starts")


def op7_cost_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return costpack.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op8_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrence.jaccard_components(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op9_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piececount.count_pieces(table(spark, sf_dir, "documents"), piececount.piece_model())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_hidden_markov, op2_karmarkar_karp, op3_multi_index, op4_classifier_chain, op5_string_tiling, op6_best_fit, op7_cost_balanced, op8_divide_skip, op9_deobfuscated_pii, op10_piece_counts)
}

#: Where SQL can express a query. None of the ten can be: each is held against a brute-force version in tests/llm.
ORACLES: dict[str, str] = {}
