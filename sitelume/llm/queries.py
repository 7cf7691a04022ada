"""Registered queries of this subpackage: thin wrappers that derive the returned columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_by_collisions
from .bpe import encode_documents
from .language import identify_languages, learn_languages
from .lexical import rank_documents
from .line_dedup import dedup_lines
from .lloyd import delta_lloyd
from .mixing import mix_documents
from .near_dup import near_duplicates
from .oracles import ORACLE_SQL  # noqa: F401  the driver reads it here
from .packing import pack_documents
from .quality import learn_quality, score_quality
from .sharding import place
from .topk import exact_top_k
from .toxicity import learn_lexicon, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def _held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(_remainder(modulus) == rest, F.lit(False)).alias("held_out")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = learn_quality(docs, labels.where(_remainder(5) != 0))
    return score_quality(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed", "emptied")


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = learn_languages(docs.where(_remainder(4) != 2))
    return identify_languages(docs, model).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op7_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{k:03d}" for k in range(128)]
    return place(_table(spark, sf_dir, "documents").select("doc_id"), shards).select("doc_id", "slot", "shard")


def op8_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    lexicon = learn_lexicon(docs, labels.where(_remainder(5) != 0))
    found = score_toxicity(docs, lexicon)
    return found.select("doc_id", _held_out(5, 0), "score", "predicted", "hits")


def op9_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_collisions(_table(spark, sf_dir, "embeddings"))


def op10_minmax_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op11_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(_table(spark, sf_dir, "documents"), decode=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_bradley_terry_quality": op2_bradley_terry_quality,
    "op3_source_mixing": op3_source_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_cost_balanced_packing": op5_cost_balanced_packing,
    "op6_language_id": op6_language_id,
    "op7_lookup_sharding": op7_lookup_sharding,
    "op8_toxicity_lexicon": op8_toxicity_lexicon,
    "op9_collision_ann": op9_collision_ann,
    "op10_minmax_near_dup": op10_minmax_near_dup,
    "op11_inverted_treaps": op11_inverted_treaps,
    "op12_word_table_bpe": op12_word_table_bpe,
    "op13_delta_lloyd": op13_delta_lloyd,
}
