"""The registered queries of the corpus operators, and their SQL where SQL can say it."""
from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import angular, bpe, caps, decontam, lloyd, near_dup, pii, piece_count, quality, repeats, sharding, url_filter, vp_search
from .common import table

#: Path of the vocabulary file, a parameter of operators 1 and 6.
VOCABULARY = os.environ.get("EVENTLENS_BPE", public_tokenizers.path("byte_bpe_50k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document after passages that repeat across documents are removed."""
    return repeats.digests(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, equal texts together, shards of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and which."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document."""
    return piece_count.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base matches by kind and all spans."""
    return pii.digests(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document and whether it is kept."""
    return quality.classify(table(spark, sf_dir, "documents"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dup.components(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every vector whose id is divisible by 20, exactly."""
    return vp_search.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of eight parts of sixteen entries of every vector, after six rounds, with their errors."""
    return lloyd.codes(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; every seventh label is taken as the next one."""
    x = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, ((F.col("label").cast("long") + 1) % 10).cast("int")).otherwise(F.col("label"))
    return angular.mine(x.withColumn("label", moved), F.col("id") % 100 == 0)


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate component of every vector."""
    return caps.components(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_substring_dedup, op3_url_filter, op4_sharding, op5_decontamination, op6_token_counts,
                                  op7_pii, op8_quality, op9_near_dup, op10_nearest, op11_codes, op12_hard_negatives, op13_near_vectors)}
SQL: dict[str, str] = {"op11_codes": lloyd.sql(), "op12_hard_negatives": angular.sql(), "op13_near_vectors": caps.sql()}
