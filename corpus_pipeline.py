"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each
result as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqspark.llm.bpe import bpe_encode
from seqspark.llm.decontaminate import without_leaks
from seqspark.llm.language import crc_of, identify, learn_dictionaries
from seqspark.llm.names import beside, restored
from seqspark.llm.near_copies import one_of_near_copies
from seqspark.llm.pseudonyms import pseudonymize
from seqspark.session import delete_table, materialize, read_table, scratch

#: The pseudonym key of the registered pipeline; a user passes their own.
KEY = "registered-pipeline"
#: Chunks that a worker remembers in the last stage; the same workers have served the others.
REMEMBERED = 120_000
#: Documents whose id's crc32 leaves this remainder are not learned from (see op4).
FOLDS, HELD_OUT = 3, 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter or with too narrow a margin go.

    Null and empty texts go, rows with a null id stay, repeated rows are judged alike; of tied languages
    none is clear. Without a labelled row, or of an empty table, nothing stays. Texts of any length are judged
    whole. Further columns keep their values, also those with names of the operator's own columns.
    """
    labelled = docs.where(F.pmod(crc_of("doc_id"), F.lit(FOLDS)) != HELD_OUT).select("doc_id", "text", "lang")
    added = ("lang_pred", "score", "rejected")
    found = beside(docs, added, lambda d: identify(d, learn_dictionaries(labelled)))
    return restored(found.where(~F.col("rejected")), docs, added)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more, met by Golay-code keys first.

    The least (doc_id, text) stays, null ids last; of equal rows one. Null and empty texts are one group. Texts
    of any length are compared whole; an empty table stays empty, further columns keep their values.
    """
    return one_of_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts stay, repeated rows stay or go together; an empty benchmark keeps all. Texts of any
    length are searched whole; an empty table stays empty, further columns keep their values.
    """
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for private values; null texts stay null.

    Equal values get equal pseudonyms, in repeated rows too, and in texts of any length; an empty table stays
    empty, further columns keep their values, also those with names of the operator's own columns.
    """
    added = ("n_private",)
    return restored(beside(docs, added, lambda d: pseudonymize(d, KEY)), docs, added)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, token_ids)`` of all documents; other columns are left out.

    Null and empty texts have no token.
    """
    encoded = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED)
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").alias("n_tokens"), "token_ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("tokens", tokens),
]
#: Compression, fingerprints and tokens cannot be told in SQL; a plain version in the tests is the oracle.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; what a stage wrote besides its result is deleted after it."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
            made.remove(docs.written_to)
        if before is not None:
            delete_table(spark, before)
        before = docs.written_to
    return docs
