"""The corpus queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from seqspark.session import read_table

from .bpe import bpe_round_trip
from .decontaminate import find_leaks
from .digest import document_digests
from .language import language_predictions
from .lattice_lm import document_scores
from .merkle import merkle_manifest
from .oracles import MERKLE, SPELLING
from .pseudonyms import pseudonymize
from .quality import quality_scores
from .simhash import near_duplicate_groups
from .spelling import spelling_variants
from .token_count import token_counts
from .toxicity import toxicity_scores
from .unit_dedup import repeated_text


#: The key of the registered query; a user passes their own.
PSEUDONYM_KEY = "registered-query"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(read_table(spark, sf_dir, "documents"))


def op5_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_digests(read_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_scores(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, PSEUDONYM_KEY)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_text(read_table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_leaks": op3_leaks,
    "op4_language": op4_language,
    "op5_digests": op5_digests,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_lm_scores": op7_lm_scores,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_toxicity": op9_toxicity,
    "op10_repeated_text": op10_repeated_text,
    "op11_quality": op11_quality,
    "op12_spelling": op12_spelling,
    "op13_merkle": op13_merkle,
}
ORACLE: dict[str, str] = {"op12_spelling": SPELLING, "op13_merkle": MERKLE}
