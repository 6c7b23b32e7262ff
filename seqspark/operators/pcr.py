"""In-silico PCR."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .intervals import overlap_join
from .spans import lengths, span_bases

#: Extension speed of polymerases in seconds for each 1000 bases.
SPEEDS = {"taq": 60, "high_fidelity": 15}


def amplicons(seqs: DataFrame, sites: DataFrame, primers: DataFrame, max_sites: int = 1, polymerase: str = "taq", max_length: int = 40_000, parts: int | None = None) -> DataFrame:
    """``(seq_id, fwd_id, rev_id, start, end, length, product, anneal, extend_s)``.

    A primer takes part if it has at most ``max_sites`` sites in the sequence. The product runs from the
    forward site's start to the reverse site's end, ``max_length`` bases at most, which no polymerase goes
    beyond; across the origin only of circular sequences. Sites meet in bins of that many bases, a forward
    one in its own and the next, a reverse one where it ends and, on circular sequences, one turn further on;
    so a site meets what it can reach and no more. The programme anneals at 5 degrees under the lower melting
    temperature and extends by the polymerase's speed, in whole seconds. ``primers(primer_id, tm)``.
    """
    count = F.count("*").over(Window.partitionBy("seq_id", "primer_id"))
    few = sites.withColumn("k", count).where(F.col("k") <= max_sites)
    placed = few.join(primers.select("primer_id", "tm"), "primer_id").join(lengths(seqs, parts), "seq_id")
    home = F.floor((F.col("start") - 1) / max_length)
    fwd = placed.where("strand = 'fwd'").select("seq_id", F.col("primer_id").alias("fwd_id"), "start", F.col("tm").alias("fwd_tm"), "n", F.explode(F.array(home, home + 1)).alias("bin"))
    turns = F.explode(F.when(F.col("circular"), F.array(F.col("end"), F.col("end") + F.col("n"))).otherwise(F.array(F.col("end"))))
    rev = placed.where("strand = 'rev'").select("seq_id", F.col("primer_id").alias("rev_id"), "end", F.col("tm").alias("rev_tm"), turns.alias("stop"))
    rev = rev.withColumn("bin", F.floor((F.col("stop") - 1) / max_length))
    near = F.col("stop").between(F.col("start"), F.col("start") + F.least(F.lit(max_length), F.col("n")) - 1)
    rows = fwd.join(rev, ["seq_id", "bin"]).where(near & (F.col("fwd_id") != F.col("rev_id")))
    length = (F.col("stop") - F.col("start") + 1).cast("int")
    rows = rows.select(
        "seq_id", "fwd_id", "rev_id", "start", "end", length.alias("length"),
        F.round(F.least("fwd_tm", "rev_tm") - 5, 4).alias("anneal"), F.floor(F.lit(SPEEDS[polymerase]) * length / 1000).cast("int").alias("extend_s"),
    )
    return span_bases(seqs, rows, "product", parts=parts).select("seq_id", "fwd_id", "rev_id", "start", "end", "length", "product", "anneal", "extend_s")


def amplicon_features(products: DataFrame, features: DataFrame, parts: int | None = None) -> DataFrame:
    """``(seq_id, fwd_id, rev_id, feature_id, label, start, end)``: features strictly inside a product, in
    its coordinates. Products and features that wrap carry nothing."""
    a = features.where("start <= end").select("seq_id", "feature_id", "label", F.col("start").alias("beg"), (F.col("end") + 1).alias("end"))
    b = products.where("start <= end").select("seq_id", "fwd_id", "rev_id", F.col("start").alias("b_beg"), (F.col("end") + 1).alias("b_end"))
    inside = overlap_join(a, b, "seq_id", parts).where("b_beg < beg and end < b_end")
    return inside.select("seq_id", "fwd_id", "rev_id", "feature_id", "label", (F.col("beg") - F.col("b_beg") + 1).alias("start"), (F.col("end") - F.col("b_beg")).alias("end"))
