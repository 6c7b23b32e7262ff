"""Feature libraries, inventories, reagents and sequencing reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqspark.session import dealt

from .edits import merge_features
from .matching import annotate
from .spans import span_bases


def build_feature_library(features: DataFrame, seqs: DataFrame, parts: int | None = None) -> DataFrame:
    """``(seq, label, feature_type, sequences, occurrences)``: features with one sequence as one entry.

    The commonest label and type name it, the smallest among ties.
    """
    cut = span_bases(seqs, features.select("seq_id", "label", "feature_type", "start", "end"), "seq", parts=parts)
    return dealt(cut, parts, "seq").groupBy("seq").agg(F.mode("label", True).alias("label"), F.mode("feature_type", True).alias("feature_type"), F.count_distinct("seq_id").alias("sequences"), F.count("*").alias("occurrences"))


def sequence_stats(seqs: DataFrame, features: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """``(topology, sequences, bases, longest, gc, <type> ...)``: an inventory with features by type."""
    n = F.length("seq")
    base = seqs.groupBy("topology").agg(
        F.count("*").alias("sequences"), F.sum(n).alias("bases"), F.max(n).alias("longest"),
        F.round(F.sum(F.length(F.regexp_replace("seq", "[at]", ""))) / F.sum(n), 6).alias("gc"),
    )
    kinds = features.join(seqs.select("seq_id", "topology"), "seq_id").groupBy("topology").pivot("feature_type", list(types)).count()
    return base.join(kinds, "topology", "left").select(*base.columns, *[F.coalesce(F.col(t), F.lit(0)).alias(t) for t in types])


def reagent_demand(orders: DataFrame, recipe_lines: DataFrame, reagents: DataFrame) -> DataFrame:
    """``(reagent_id, name, mass_g, volume_l, uses)`` over a batch of preparations.

    ``orders(order_id, solution_id, volume_l)``; ``recipe_lines(solution_id, reagent_id, molarity, prep,
    stock_molarity, sub_solution_id, sub_fraction)``. A line is a reagent (``mass``: weight times
    molarity times volume, ``volume``: molarity times volume over the stock's), or a sub-solution that
    takes a fraction of the volume; sub-solutions go one level deep.
    """
    direct = orders.join(recipe_lines, "solution_id")
    below = direct.where("sub_solution_id is not null").select("order_id", F.col("sub_solution_id").alias("solution_id"), (F.col("volume_l") * F.col("sub_fraction")).alias("volume_l"))
    nested = below.join(recipe_lines, "solution_id").where("sub_solution_id is null")
    columns = ["order_id", "reagent_id", "molarity", "prep", "stock_molarity", "volume_l"]
    lines = direct.where("sub_solution_id is null").select(columns).unionByName(nested.select(columns))
    exact = lambda x: F.sum(F.round(x, 9).cast("decimal(28,9)")).cast("double")  # noqa: E731  sums in any order are equal
    amount = lines.groupBy("reagent_id").agg(
        exact(F.when(F.col("prep") == "mass", F.col("molarity") * F.col("volume_l")).otherwise(0.0)).alias("moles"),
        exact(F.when(F.col("prep") == "volume", F.col("molarity") * F.col("volume_l") / F.col("stock_molarity")).otherwise(0.0)).alias("volume"),
        F.count("*").alias("uses"),
    )
    return amount.join(reagents, "reagent_id").select("reagent_id", "name", F.round(F.col("moles") * F.col("mw") + 1e-9, 4).alias("mass_g"), F.round(F.col("volume") + 1e-11, 6).alias("volume_l"), "uses")


def reads_to_sequences(reads: DataFrame) -> DataFrame:
    """Sequencing reads, whole, as linear sequences named by their read."""
    return reads.select(F.col("read_id").alias("seq_id"), F.concat(F.lit("read "), F.col("read_id").cast("string")).alias("name"), "seq", F.length("seq").alias("length"), F.lit("linear").alias("topology"))


def annotate_reads(reads: DataFrame, library: DataFrame, known: DataFrame | None = None, min_run: int = 6) -> tuple[DataFrame, DataFrame]:
    """Reads as sequences, and their features: those ``known``, and library entries and His tags that are
    found on them at ranges that no known feature has.

    ``known(seq_id, start, end, feature_type, direction, label)`` may come with the reads.
    """
    seqs = reads_to_sequences(reads)
    found = annotate(seqs, library, min_run)
    return seqs, found if known is None else merge_features(known.select(*found.columns), found)


def trace_scale(reads: DataFrame, n: int = 40) -> DataFrame:
    """``(read_id, peak)``: the highest of four channels among the first samples of each read."""
    rows = reads.select("read_id", F.posexplode(F.arrays_zip("ch1", "ch2", "ch3", "ch4")).alias("pos", "s")).where(F.col("pos") <= n)
    return rows.groupBy("read_id").agg(F.max(F.greatest("s.ch1", "s.ch2", "s.ch3", "s.ch4")).alias("peak"))


def remove_duplicates(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return rows.dropDuplicates(columns) if columns else rows.distinct()
