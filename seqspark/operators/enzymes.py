"""Restriction sites, enzyme choice and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from seqspark.functions.constants import table
from seqspark.functions.exprs import span_length, wrap

from .matching import motif_hits


def re_sites(seqs: DataFrame) -> DataFrame:
    """``(seq_id, enzyme_id, enzyme, site_start, cut_pos, match_count)`` of the enzyme library.

    Ambiguous sites are spelled out, so each is an exact pattern; palindromes are reported once, sites
    across the origin of circular sequences count. ``cut_pos`` is the base after which the top strand is
    cut; ``match_count`` the number of sites of the enzyme in the sequence. Sites whose cut would lie
    outside a linear sequence are left out.
    """
    spark = seqs.sparkSession
    spelled = table(spark, "enzyme_sites").select(F.struct("enzyme_id", "spelled").alias("pattern_id"), F.col("spelled").alias("pattern"), "strand")
    hits = motif_hits(seqs, spelled, seeds=(4, 6), strands=False)
    enzymes = F.broadcast(table(spark, "enzymes").select("enzyme_id", "enzyme", F.length("site").alias("size"), "cut_after"))
    lengths = seqs.select("seq_id", F.length("seq").alias("n"), (F.col("topology") == "circular").alias("circular"))
    rows = hits.select("seq_id", F.col("pattern_id.enzyme_id").alias("enzyme_id"), "strand", F.col("start").alias("site_start")).join(enzymes, "enzyme_id").join(lengths, "seq_id")
    after = F.when(F.col("strand") == "fwd", F.col("cut_after")).otherwise(F.col("size") - 2 - F.col("cut_after"))
    cut = F.col("site_start") + after
    rows = rows.withColumn("cut_pos", F.when(F.col("circular"), wrap(cut, F.col("n"))).otherwise(cut).cast("int")).where(F.col("circular") | F.col("cut_pos").between(0, F.col("n")))
    count = F.count("*").over(Window.partitionBy("seq_id", "enzyme_id"))
    return rows.select("seq_id", "enzyme_id", "enzyme", "site_start", "cut_pos", count.alias("match_count"))


def digest(sites: DataFrame, seqs: DataFrame) -> DataFrame:
    """``(seq_id, frag_no, start, end, length, left_enzyme, right_enzyme)``.

    k distinct cuts give k fragments of a circular sequence and k + 1 of a linear one; where several
    enzymes cut at one place the first by name is told. Ends of linear sequences have no enzyme. A
    sequence without a cut gives no row.
    """
    lengths = seqs.select("seq_id", F.length("seq").alias("n"), (F.col("topology") == "circular").alias("circular"))
    cuts = sites.groupBy("seq_id", "cut_pos").agg(F.min("enzyme").alias("enzyme")).join(lengths, "seq_id")
    order = Window.partitionBy("seq_id").orderBy("cut_pos")
    whole = Window.partitionBy("seq_id")
    rows = cuts.select(
        "seq_id", "n", "circular", F.col("cut_pos").alias("cut"), F.col("enzyme").alias("left_enzyme"),
        F.lead("cut_pos").over(order).alias("next"), F.lead("enzyme").over(order).alias("right"),
        F.min(F.struct("cut_pos", "enzyme")).over(whole).alias("first"),
    )
    ends = rows.withColumn("last", F.col("next").isNull())
    after = ends.where("circular or cut < n").select(
        "seq_id", "n", F.when(F.col("cut") == F.col("n"), 1).otherwise(F.col("cut") + 1).alias("start"), "left_enzyme",
        F.when(~F.col("last"), F.col("next")).when(F.col("circular"), F.col("first.cut_pos")).otherwise(F.col("n")).alias("end"),
        F.when(~F.col("last"), F.col("right")).when(F.col("circular"), F.col("first.enzyme")).alias("right_enzyme"),
    )
    head = ends.where("not circular and cut = first.cut_pos and cut > 0").select("seq_id", "n", F.lit(1).alias("start"), F.lit(None).cast("string").alias("left_enzyme"), F.col("cut").alias("end"), F.col("left_enzyme").alias("right_enzyme"))
    every = head.unionByName(after)
    # one cut of a circular sequence opens it: the fragment runs around
    length = F.when(F.col("end") == F.when(F.col("start") == 1, F.col("n")).otherwise(F.col("start") - 1), F.col("n")).otherwise(span_length(F.col("start"), F.col("end"), F.col("n")))
    number = F.row_number().over(Window.partitionBy("seq_id").orderBy("start"))
    return every.select("seq_id", number.alias("frag_no"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), length.cast("int").alias("length"), "left_enzyme", "right_enzyme")


def crowded_sites(sites: DataFrame, gap: int = 10) -> DataFrame:
    """Sites with another distinct site position less than ``gap`` bases to the right, in order."""
    ahead = Window.partitionBy("seq_id").orderBy("site_start").rangeBetween(1, gap - 1)
    rows = sites.select("seq_id", "enzyme", "site_start", F.min("site_start").over(ahead).alias("next_start"))
    return rows.where(F.col("next_start").isNotNull())


def enzyme_filter(sites: DataFrame, seq_ids: DataFrame | None = None, unique: bool = True, sticky: bool = False, multi: bool = False) -> DataFrame:
    """``(enzyme_id, enzyme, sequences, most_sites)`` of the enzymes that pass.

    unique: one site at most in every sequence; sticky: no blunt ends; multi: in two sequences or more.
    """
    rows = sites if seq_ids is None else sites.join(seq_ids.select("seq_id").distinct(), "seq_id", "left_semi")
    found = rows.groupBy("enzyme_id", "enzyme").agg(F.count_distinct("seq_id").alias("sequences"), F.max("match_count").alias("most_sites"))
    if unique:
        found = found.where("most_sites = 1")
    if multi:
        found = found.where("sequences >= 2")
    if sticky:
        sharp = table(sites.sparkSession, "enzymes").where("not is_blunt").select("enzyme_id")
        found = found.join(F.broadcast(sharp), "enzyme_id", "left_semi")
    return found.select("enzyme_id", "enzyme", "sequences", "most_sites")


def re_candidates(insert_sites: DataFrame, vector_sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(insert_id, vector_id, enzyme_id, insert_pos, vector_pos)``: enzymes that cut an insert and a
    vector once each, and leave sticky ends, for the stated ``pairs(insert_id, vector_id)``.

    The pairs go to the sites of their insert, and these to those of their vector by vector and enzyme, so
    no key is as common as an enzyme.
    """
    sharp = F.broadcast(table(insert_sites.sparkSession, "enzymes").where("not is_blunt").select("enzyme_id"))
    once = lambda s: s.where("match_count = 1").join(sharp, "enzyme_id", "left_semi")
    a = once(insert_sites).select(F.col("seq_id").alias("insert_id"), "enzyme_id", F.col("site_start").alias("insert_pos"))
    b = once(vector_sites).select(F.col("seq_id").alias("vector_id"), "enzyme_id", F.col("site_start").alias("vector_pos"))
    rows = pairs.select("insert_id", "vector_id").distinct().join(a, "insert_id").join(b, ["vector_id", "enzyme_id"])
    return rows.select("insert_id", "vector_id", "enzyme_id", "insert_pos", "vector_pos")


def query_candidates(insert_sites: DataFrame, vector_sites: DataFrame, parts: int = 64) -> DataFrame:
    """``(insert_id, vector_id, enzyme_id, insert_pos, vector_pos)`` of every insert with every vector, as
    re_candidates gives them.

    Only single cuts meet, by enzyme, so a pair without a common enzyme is never formed. The cuts of inserts are
    dealt into ``parts`` by sequence, those of vectors go to each, so no key is as common as an enzyme.
    """
    sharp = F.broadcast(table(insert_sites.sparkSession, "enzymes").where("not is_blunt").select("enzyme_id"))
    once = lambda s: s.where("match_count = 1").join(sharp, "enzyme_id", "left_semi")
    a = once(insert_sites).select(F.col("seq_id").alias("insert_id"), "enzyme_id", F.col("site_start").alias("insert_pos"), F.pmod(F.xxhash64("seq_id"), F.lit(parts)).cast("int").alias("part"))
    b = once(vector_sites).select(F.col("seq_id").alias("vector_id"), "enzyme_id", F.col("site_start").alias("vector_pos"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return a.join(b, ["enzyme_id", "part"]).select("insert_id", "vector_id", "enzyme_id", "insert_pos", "vector_pos")


def candidate_links(insert_sites: DataFrame, vector_sites: DataFrame) -> DataFrame:
    """``(enzyme_id, enzyme, inserts, vectors, pairs)``: of every insert with every vector, how many an enzyme
    cuts once each with sticky ends. The members of either side are its single cuts; no pair is formed."""
    sharp = F.broadcast(table(insert_sites.sparkSession, "enzymes").where("not is_blunt").select("enzyme_id"))
    count = lambda s, name: s.where("match_count = 1").join(sharp, "enzyme_id", "left_semi").groupBy("enzyme_id", "enzyme").agg(F.count("*").alias(name))
    both = count(insert_sites, "inserts").join(count(vector_sites, "vectors"), ["enzyme_id", "enzyme"])
    return both.withColumn("pairs", F.col("inserts") * F.col("vectors"))


def candidate_members(insert_sites: DataFrame, vector_sites: DataFrame, sides: tuple[str, str] = ("insert", "vector")) -> DataFrame:
    """``(side, seq_id, enzyme_id, pos, partners)``: each single sticky cut of an insert or a vector, and how many
    of the other side the enzyme cuts once; zero too. An enzyme is a class, and its rows are the members."""
    sharp = F.broadcast(table(insert_sites.sparkSession, "enzymes").where("not is_blunt").select("enzyme_id"))
    single = [s.where("match_count = 1").join(sharp, "enzyme_id", "left_semi").select(F.lit(name).alias("side"), "seq_id", "enzyme_id", F.col("site_start").alias("pos")) for s, name in zip((insert_sites, vector_sites), sides)]
    rows = single[0].unionByName(single[1])
    counts = rows.groupBy("enzyme_id").agg(*[F.count_if(F.col("side") == name).alias(f"_{i}") for i, name in enumerate(sides)])  # a row for each enzyme
    partners = F.when(F.col("side") == sides[0], F.col("_1")).otherwise(F.col("_0"))
    return rows.join(F.broadcast(counts), "enzyme_id").select("side", "seq_id", "enzyme_id", "pos", partners.alias("partners"))


def common_enzymes(sites: DataFrame, sets: DataFrame) -> DataFrame:
    """``(set_id, enzyme)``: the enzymes that cut every sequence of a set, by a relational division.

    ``sets(set_id, seq_id)``; a sequence may be in several.
    """
    wanted = sets.select("set_id", "seq_id").distinct()
    found = wanted.join(sites.select("seq_id", "enzyme").distinct(), "seq_id").groupBy("set_id", "enzyme").agg(F.count("*").alias("k"))
    return found.join(wanted.groupBy("set_id").agg(F.count("*").alias("k")), ["set_id", "k"], "left_semi").select("set_id", "enzyme")
