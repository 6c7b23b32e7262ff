"""Streaming ingestion: FASTA files that arrive are parsed and annotated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from seqspark.operators.matching import annotate
from seqspark.sources.fasta import FILES, parse_fasta


def annotate_stream(spark: SparkSession, source: str, library: DataFrame, target: str, checkpoint: str, trigger: dict | None = None, files: str = FILES, min_run: int = 6) -> StreamingQuery:
    """Annotates every FASTA file that appears in ``source`` and writes features below ``target``.

    Each batch goes to a folder of its own number and overwrites it, so a batch that is replayed after a
    failure leaves its rows once. No state is kept between batches.
    """
    raw = spark.readStream.option("lineSep", "\n>").option("pathGlobFilter", files).format("text").load(source)

    def write(batch: DataFrame, number: int) -> None:
        records = parse_fasta(batch).select(F.xxhash64("file", "name", "seq").alias("seq_id"), "seq", F.lit("linear").alias("topology")).dropDuplicates(["seq_id"])
        annotate(records, library, min_run).write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = raw.select("value", F.col("_metadata.file_name").alias("file"))
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
