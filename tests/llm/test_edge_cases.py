"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns for every operator."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from seqspark.llm import bpe, decontaminate, digest, language, lattice_lm, pseudonyms, simhash, token_count, toxicity, unit_dedup

WORDS = "thin oring retion the of and ander inble eaing"
LONG = (WORDS + " ") * 4000
ROWS = [
    (0, "The oring of the retion and thander was inble, +1 (743) 555-3824.", "en", "s", 1),
    (1, None, None, None, None),
    (2, "", "en", None, 0),
    (3, LONG, "en", "s", None),
    (4, "Les aimentre des étion et la queleau.", "fr", "s", 3),
    (4, "Les aimentre des étion et la queleau.", "fr", "s", 3),
    (None, "The oring of the retion and thander was inble, +1 (743) 555-3824.", None, "s", 1),
    (6, "123 456 !!", "de", "s", 1),
    (7, "Der stupid einung und die keitlich.", "de", "s", 1),
]
CLASHES = ("score", "rejected", "token_ids", "n_private", "_private", "_removed", "key", "word", "fp", "part", "spans", "held_out", "component_id", "n", "row")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1, 1), (7, 1, 1), (0, 1, 0), (4, None, 0), (None, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(0, "einung und die keitlich"), (1, None), (2, ""), (3, "zqx"), (3, "zqx"), (4, " ?! ")], "item_id long, text string")


@pytest.fixture(scope="module")
def operators(docs, labels, benchmark):
    word, byte, piece = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
    return {
        "token_counts": lambda d: token_count.token_counts(d, word),
        "round_trip": lambda d: bpe.bpe_round_trip(d, byte, with_text=True),
        "encode": lambda d: bpe.bpe_encode(d, byte),
        "leaks": lambda d: decontaminate.find_leaks(d, benchmark),
        "without_leaks": lambda d: decontaminate.without_leaks(d, benchmark),
        "language": language.language_predictions,
        "digests": digest.document_digests,
        "groups": simhash.near_duplicate_groups,
        "one_of_each": simhash.one_of_each_group,
        "scores": lambda d: lattice_lm.document_scores(d, piece),
        "pseudonyms": lambda d: pseudonyms.pseudonymize(d, "k"),
        "toxicity": lambda d: toxicity.toxicity_scores(d, labels),
        "removed": unit_dedup.repeated_text,
        "without_repeats": unit_dedup.without_repeats,
    }


NAMES = ["token_counts", "round_trip", "encode", "leaks", "without_leaks", "language", "digests", "groups", "one_of_each", "scores", "pseudonyms", "toxicity", "removed", "without_repeats"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, docs, name):
    assert operators[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(operators, docs, name):
    rows = operators[name](docs).collect()
    one_for_each = {"token_counts", "round_trip", "encode", "language", "digests", "groups", "scores", "pseudonyms", "toxicity", "without_repeats"}
    if name in one_for_each:
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    if name == "token_counts":
        assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[1]["n_bytes"] == 0 and by[3]["over_limit"] and not by[0]["over_limit"]
    elif name == "round_trip":
        assert by[1]["decoded"] == by[2]["decoded"] == "" and by[3]["decoded"] == LONG
    elif name == "encode":
        assert by[1]["token_ids"] == [] and by[0]["score"] == "x0"
    elif name == "leaks":
        assert [(r["doc_id"], r["item_id"], r["distance"]) for r in rows] == [(7, 0, 0)] and ROWS[8][1][rows[0]["start"] : rows[0]["end"]] == "einung und die keitlich"
    elif name == "without_leaks":
        assert 7 not in by and len(rows) == len(ROWS) - 1
    elif name == "language":
        assert {by[i]["lang_pred"] for i in (1, 2, 6)} == {"und"} and by[1]["score"] == 0 and by[6]["rejected"]
        assert all(0 <= r["score"] <= 1 for r in rows)
    elif name == "digests":
        assert by[1]["fingerprint"] == by[2]["fingerprint"] == "" and by[1]["near_next"] == 1.0
        same = {r["fingerprint"] for r in rows if r["doc_id"] in (0, None)}
        assert len(same) == 1
    elif name == "groups":
        assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[1]["fingerprint"] == "0" * 16
        assert {r["component_id"] for r in rows if r["doc_id"] is None} == {0}
    elif name == "one_of_each":
        assert Counter(r["doc_id"] for r in rows) == Counter([0, 1, 3, 4, 6, 7, None]) and by[0]["row"] == f"x{CLASHES.index('row')}"
    elif name == "scores":
        assert by[1]["n_tokens"] == 1 and by[1]["score"] == by[2]["score"] < 0 and by[3]["n_tokens"] == len(LONG.split()) + 1
        assert all(math.isfinite(r["score"]) for r in rows)
    elif name == "pseudonyms":
        assert by[1]["text"] is None and by[2]["text"] == "" and by[0]["n_private"] == 1 and by[3]["text"] == LONG
        assert by[0]["text"] == next(r["text"] for r in rows if r["doc_id"] is None) != ROWS[0][1] and by[0]["_private"] == f"x{CLASHES.index('_private')}"
    elif name == "toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows) and by[1]["spans"] == []
    elif name == "without_repeats":
        assert by[1]["text"] is None and by[2]["text"] == "" and by[0]["_removed"] == f"x{CLASHES.index('_removed')}"


def test_repeated_rows_of_one_id_keep_one(spark):
    rows = [(1, "b c d e f g"), (1, "a b c d e f"), (2, "z y x w v u")]
    kept = simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a b c d e f"), (2, "z y x w v u")]
