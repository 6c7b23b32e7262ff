"""FASTA files, one row for each record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqspark.functions.exprs import clean_sequence


def parse_fasta(records: DataFrame) -> DataFrame:
    """``(file, name, description, seq)`` from a column ``value`` of records cut at line starts with ``>``.

    The first record of a file keeps its ``>``; empty records are dropped. Letters other than a, c, g, t
    are dropped from sequences.
    """
    lines = F.split(F.regexp_replace("value", "^>", ""), "\r?\n", 2)
    header, body = F.trim(F.get(lines, 0)), F.coalesce(F.get(lines, 1), F.lit(""))
    rows = records.where(F.trim("value") != "").select("file", header.alias("header"), clean_sequence(body).alias("seq"))
    return rows.select("file", F.substring_index("header", " ", 1).alias("name"), F.regexp_extract("header", r"^\S+\s+(.*)$", 1).alias("description"), "seq")


FILES = "*.{fa,fasta,fna,ffn}"


def read_fasta(spark: SparkSession, path: str, files: str = FILES) -> DataFrame:
    """All records of a file or directory. Files are split between tasks at record starts."""
    raw = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", True).option("pathGlobFilter", files).text(path)
    return parse_fasta(raw.select("value", F.col("_metadata.file_name").alias("file")))


def write_fasta(seqs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``seqs(name, seq)`` with an optional ``description``, in lines of 70 bases."""
    description = F.concat(F.lit(" "), F.col("description")) if "description" in seqs.columns else F.lit("")
    body = F.regexp_replace("seq", "(.{70})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), F.col("name"), F.coalesce(description, F.lit("")), F.lit("\n"), body)).write.mode(mode).option("compression", "none").text(path)
