"""Interval joins: every one has an equality key, from the sequence and from bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqspark.functions.exprs import span_length
from seqspark.session import dealt

#: Bin widths as powers of two, the narrowest first: an interval's home is the narrowest bin that holds it.
LEVELS = (14, 17, 20, 23, 26)


def home_bin(beg: Column, end: Column) -> Column:
    """``level << 40 | number`` of the narrowest bin that holds the half-open interval."""
    out = F.lit(len(LEVELS) << 40).cast("long")
    for i, bits in reversed(list(enumerate(LEVELS))):
        place = F.call_function("shiftright", beg.cast("long"), F.lit(bits))
        out = F.when(place == F.call_function("shiftright", (end - 1).cast("long"), F.lit(bits)), place + (i << 40)).otherwise(out)
    return out


def bins_met(beg: Column, end: Column) -> Column:
    """All bins of all levels that the half-open interval meets."""
    parts = [F.array(F.lit(len(LEVELS) << 40).cast("long"))]
    for i, bits in enumerate(LEVELS):
        a, b = (F.call_function("shiftright", x.cast("long"), F.lit(bits)) for x in (beg, end - 1))
        parts.append(F.sequence(a + (i << 40), b + (i << 40)))
    return F.concat(*parts)


def overlap_join(a: DataFrame, b: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Pairs of rows of ``a(key, beg, end, ...)`` and ``b(key, b_beg, b_end, ...)`` that overlap.

    Intervals are half-open. A row of ``a`` stands in its home bin, a row of ``b`` in all bins it meets;
    every pair meets in one bin, so none is lost or repeated. Empty intervals overlap nothing.
    """
    left = a.where("beg < end").withColumn("_bin", home_bin(F.col("beg"), F.col("end")))
    right = b.where("b_beg < b_end").withColumn("_bin", F.explode(bins_met(F.col("b_beg"), F.col("b_end"))))
    return dealt(left, parts, key, "_bin").join(dealt(right, parts, key, "_bin"), [key, "_bin"]).where("beg < b_end and b_beg < end").drop("_bin")


def features_at(points: DataFrame, features: DataFrame, width: int = 256, parts: int | None = None) -> DataFrame:
    """``(seq_id, pos, feature_id, label, length)``: the smallest feature strictly around each point.

    ``points(seq_id, pos, n)``. ``Source`` features do not count; ties go to the first feature id.
    Features that wrap are in two parts. Both sides meet in bins of a sequence.
    """
    rows = dealt(features.where("feature_type != 'Source'"), parts, "seq_id").join(dealt(points.select("seq_id", "n"), parts, "seq_id").distinct(), "seq_id")
    rows = rows.withColumn("length", span_length(F.col("start"), F.col("end"), F.col("n")))
    part = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    inside = F.when(F.col("start") <= F.col("end"), F.array(part(F.col("start") + 1, F.col("end") - 1))).otherwise(F.array(part(F.col("start") + 1, F.col("n")), part(F.lit(1), F.col("end") - 1)))
    inner = rows.select("seq_id", "feature_id", "label", "length", F.explode(inside).alias("p")).select("seq_id", "feature_id", "label", "length", "p.a", "p.b").where("a <= b")
    binned = inner.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    placed = points.select("seq_id", "pos", F.floor(F.col("pos") / width).alias("bin"))
    met = dealt(placed, parts, "seq_id", "bin").join(dealt(binned, parts, "seq_id", "bin"), ["seq_id", "bin"]).where("a <= pos and pos <= b")
    best = Window.partitionBy("seq_id", "pos").orderBy("length", "feature_id")
    return dealt(met, parts, "seq_id", "pos").withColumn("best", F.row_number().over(best)).where("best = 1").select("seq_id", "pos", "feature_id", "label", F.col("length").cast("int").alias("length"))


def tile_features(features: DataFrame, seqs: DataFrame, width: int) -> DataFrame:
    """``(seq_id, feature_id, tile, start, end)``: features cut at tiles of ``width`` bases; tile 0 first."""
    rows = features.join(seqs.select("seq_id", F.length("seq").alias("n")), "seq_id")
    part = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    parts = F.when(F.col("start") <= F.col("end"), F.array(part(F.col("start"), F.col("end")))).otherwise(F.array(part(F.col("start"), F.col("n")), part(F.lit(1), F.col("end"))))
    rows = rows.select("seq_id", "feature_id", F.explode(parts).alias("p")).select("seq_id", "feature_id", "p.a", "p.b")
    tiled = rows.withColumn("tile", F.explode(F.sequence(F.floor((F.col("a") - 1) / width), F.floor((F.col("b") - 1) / width))))
    return tiled.select(
        "seq_id", "feature_id", F.col("tile").cast("int").alias("tile"),
        F.greatest(F.col("a"), F.col("tile") * width + 1).cast("int").alias("start"), F.least(F.col("b"), (F.col("tile") + 1) * width).cast("int").alias("end"),
    )


def tile_coverage(tiles: DataFrame) -> DataFrame:
    """``(seq_id, tile, features, bases)``: how many features and feature bases a tile has."""
    return tiles.groupBy("seq_id", "tile").agg(F.count_distinct("feature_id").alias("features"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"))


def region(features: DataFrame, centers: DataFrame, width: int) -> DataFrame:
    """``(seq_id, center, feature_id)``: features that meet the slice of ``width`` bases around a centre.

    ``centers(seq_id, center, n)``; the slice of a circular map goes on at the origin.
    """
    half = width // 2
    lo, hi = F.col("center") - half, F.col("center") + half
    slices = F.when(F.col("n") <= width, F.array(F.struct(F.lit(1).alias("lo"), F.col("n").alias("hi")))).otherwise(
        F.filter(
            F.array(
                F.struct(F.greatest(lo, F.lit(1)).alias("lo"), F.least(hi, F.col("n")).alias("hi")),
                F.struct((lo + F.col("n")).alias("lo"), F.col("n").alias("hi")),
                F.struct(F.lit(1).alias("lo"), (hi - F.col("n")).alias("hi")),
            ),
            lambda s: (s["lo"] <= s["hi"]) & (s["lo"] >= 1) & (s["hi"] >= 1),
        )
    )
    cut = centers.select("seq_id", "center", "n", F.explode(slices).alias("s")).select("seq_id", "center", F.col("s.lo").alias("b_beg"), (F.col("s.hi") + 1).alias("b_end"))
    rows = features.join(centers.select("seq_id", "n").distinct(), "seq_id")
    part = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    parts = F.when(F.col("start") <= F.col("end"), F.array(part(F.col("start"), F.col("end")))).otherwise(F.array(part(F.col("start"), F.col("n")), part(F.lit(1), F.col("end"))))
    spans = rows.select("seq_id", "feature_id", F.explode(parts).alias("p")).select("seq_id", "feature_id", F.col("p.a").alias("beg"), (F.col("p.b") + 1).alias("end"))
    return overlap_join(spans, cut, "seq_id").select("seq_id", "center", "feature_id").distinct()
