"""Distances between sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def similarity_join(a: DataFrame, b: DataFrame, max_dist: int) -> DataFrame:
    """``(a_id, b_id, distance)`` of pairs within ``max_dist``: Hamming distance for equal lengths, else
    edit distance. ``a(id, seq)`` is the query set.

    A pattern of n bases cut into max_dist + 1 pieces keeps one piece whole, at an offset that moves by
    max_dist at most. So each text of ``b`` is cut into pieces, each text of ``a`` gives its substrings
    of those sizes around the same offsets, and pieces of equal hash are joined and verified; no pair is lost.
    Texts too short to be cut meet by length alone.
    """
    d = max_dist
    cut = b.where(F.length("seq") > d).select(F.col("id").alias("b_id"), F.length("seq").alias("b_n"), F.explode(F.sequence(F.lit(0), F.lit(d))).alias("piece"), "seq")
    size = F.floor(F.col("b_n") / (d + 1)).cast("int")
    offset = F.col("piece") * size
    width = F.when(F.col("piece") == d, F.col("b_n") - offset).otherwise(size)
    pieces = cut.select("b_id", "b_n", "piece", F.xxhash64(F.substring(F.col("seq"), offset + 1, width)).alias("part"))
    shapes = F.explode(F.sequence(F.greatest(F.lit(d + 1), F.length("seq") - d), F.length("seq") + d))
    own = a.select(F.col("id").alias("a_id"), "seq", shapes.alias("b_n")).where(F.length("seq") >= 1)
    own = own.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(d)))).withColumn("move", F.explode(F.sequence(F.lit(-d), F.lit(d))))
    at = offset + F.col("move") + 1
    own = own.where((at >= 1) & (at + width - 1 <= F.length("seq"))).select("a_id", "b_n", "piece", F.xxhash64(F.substring(F.col("seq"), at, width)).alias("part"))
    pairs = own.join(pieces, ["b_n", "piece", "part"]).select("a_id", "b_id")
    if d:  # texts of b of d bases or fewer cannot be cut: they meet by length, of which there are d + 1
        lengths = F.explode(F.sequence(F.greatest(F.lit(0), F.length("seq") - d), F.least(F.lit(d), F.length("seq") + d)))
        near = a.where(F.length("seq") <= 2 * d).select(F.col("id").alias("a_id"), lengths.alias("b_n"))
        short = b.where(F.length("seq") <= d).select(F.col("id").alias("b_id"), F.length("seq").alias("b_n"))
        pairs = pairs.union(near.join(short, "b_n").select("a_id", "b_id"))
    pairs = pairs.distinct()
    full = pairs.join(a.select(F.col("id").alias("a_id"), F.col("seq").alias("x")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("seq").alias("y")), "b_id")
    hamming = F.aggregate(F.zip_with(F.split("x", ""), F.split("y", ""), lambda p, q: (p != q).cast("int")), F.lit(0), lambda acc, v: acc + v)
    distance = F.when(F.length("x") == F.length("y"), hamming).otherwise(F.levenshtein("x", "y", d))
    return full.select("a_id", "b_id", distance.alias("distance")).where(F.col("distance").between(0, d))
