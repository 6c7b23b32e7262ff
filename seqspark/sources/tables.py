"""Mixed directories, and tables of molecules kept together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fasta, genbank


def read_sequences(spark: SparkSession, path: str, fasta_files: str = fasta.FILES, genbank_files: str = genbank.FILES) -> DataFrame:
    """``(seq_id, name, seq, length, topology, file)`` of all FASTA and GenBank files below a directory.

    Records without a name take their file's. Ids are digests of file, name and sequence.
    """
    lines = fasta.read_fasta(spark, path, fasta_files).select("name", "seq", F.lit("linear").alias("topology"), "file")
    records = genbank.read_genbank(spark, path, genbank_files)["sequences"].select("name", "seq", "topology", "file")
    rows = lines.unionByName(records, allowMissingColumns=True)
    named = rows.withColumn("name", F.when(F.trim("name") == "", F.regexp_replace("file", r"\.[^.]+$", "")).otherwise(F.col("name")))
    return named.select(F.xxhash64("file", "name", "seq").alias("seq_id"), "name", "seq", F.length("seq").alias("length"), "topology", "file")


def save_tables(tables: dict[str, DataFrame], path: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Each table as Parquet below ``path``, clustered by sequence so that rows of one molecule are near."""
    for name, df in tables.items():
        if "seq_id" in df.columns:
            df = df.repartition(partitions, "seq_id") if partitions else df.repartition("seq_id")
            df = df.sortWithinPartitions("seq_id")
        df.write.mode(mode).parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
