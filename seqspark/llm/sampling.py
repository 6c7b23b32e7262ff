"""Labelled documents, and a bounded draw of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqspark.session import materialize


def with_labels(docs: DataFrame, marks: DataFrame, broadcast_labels: int) -> DataFrame:
    """Documents with their labels, from ``marks`` of one row for each doc_id. A counted, bounded number of
    labels is broadcast, so that texts stay where they are read; beyond it both sides are shuffled, once, and
    the result is written."""
    marks = materialize(marks, "marks")
    if marks.count() <= broadcast_labels:
        return docs.join(F.broadcast(marks), "doc_id")
    return materialize(docs.join(marks, "doc_id"), "labelled")


def label_counts(known: DataFrame, label: str) -> dict[int, int]:
    return {r[label]: r["count"] for r in known.groupBy(label).count().collect()}


def sample_by_label(known: DataFrame, label: str, totals: dict[int, int], documents: int, sample_bytes: int) -> list[tuple[str, int]]:
    """Whole texts and labels, 0 or 1, of at most so many documents of each label with so much text.

    They are those with the smallest hash of id and text, so the draw depends only on the rows; equal rows
    count once. Sorted by the hash."""
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    share = F.when(F.col(label) == 1, 2.0 * documents / max(1, totals.get(1, 0))).otherwise(2.0 * documents / max(1, totals.get(0, 0)))
    drawn = known.withColumn("draw", draw).where(F.col("draw") < share * float(1 << 40)).groupBy(label, "draw").agg(F.min("text").alias("text"))
    by_draw = Window.partitionBy(label).orderBy("draw")
    size = F.sum(F.octet_length("text")).over(by_draw.rowsBetween(Window.unboundedPreceding, -1))
    ranked = drawn.withColumn("place", F.row_number().over(by_draw)).withColumn("size", F.coalesce(size, F.lit(0)))
    rows = ranked.where((F.col("place") <= documents) & (F.col("size") <= sample_bytes)).select(F.col(label).alias("label"), "draw", "text").collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["draw"], r["label"]))]
