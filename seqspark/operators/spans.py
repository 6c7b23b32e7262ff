"""The bases of many ranges of long sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqspark.functions.exprs import span_length, windows
from seqspark.session import dealt

#: Bases of a piece of a sequence.
CHUNK = 4096


def lengths(seqs: DataFrame, parts: int | None = None) -> DataFrame:
    """``(seq_id, n, circular)`` if ``seqs`` has a topology, else ``(seq_id, n)``.

    Aggregated, so that the length is counted once a sequence: a join would put off the count of a plain
    column and repeat it for every row that a sequence meets.
    """
    circular = ["circular"] if "topology" in seqs.columns else []
    rows = seqs.select("seq_id", F.length("seq").alias("n"), *[(F.col("topology") == "circular").alias(c) for c in circular])
    return dealt(rows, parts, "seq_id").groupBy("seq_id").agg(F.max("n").alias("n"), *[F.max(c).alias(c) for c in circular])


def span_bases(seqs: DataFrame, spans: DataFrame, name: str = "bases", chunk: int = CHUNK, parts: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``spans(seq_id, start, end, ...)`` with the bases of each range; one that ends before it starts wraps.

    Sequences are cut into pieces of ``chunk`` bases in one pass. A range meets the pieces it touches by
    (sequence, piece), takes its share of each and puts them together, so the work grows with the bases of
    sequences and ranges and not with their product, and no row holds more than a piece and a range. Repeated
    ranges stay repeated; ranges of sequences that are not there go; what lies outside a sequence is empty.
    With ``parts`` every step is dealt into so many partitions, and the result by the columns ``by``.
    """
    keys = spans.columns
    n = F.col("_n")
    sized = dealt(spans, parts, "seq_id").join(lengths(seqs, parts).select("seq_id", F.col("n").alias("_n")), "seq_id")
    last = F.least(F.col("start") + span_length(F.col("start"), F.col("end"), n) - 1, 2 * n)
    turn = lambda k, a, b: F.struct(F.lit(k).alias("turn"), a.alias("a"), b.alias("b"))
    shares = F.array(turn(0, F.col("start"), F.least(F.col("_last"), n)), turn(1, F.greatest(F.col("start") - n, F.lit(1)), F.col("_last") - n))
    shares = F.explode_outer(F.filter(shares, lambda p: p["a"] <= p["b"]))
    own = sized.withColumn("_last", last).withColumn("_part", shares)
    pieces = F.sequence(F.floor((F.col("_part.a") - 1) / chunk), F.floor((F.col("_part.b") - 1) / chunk))
    own = own.withColumn("_piece", F.explode_outer(F.when(F.col("_part").isNotNull(), pieces)))
    first = F.col("_piece") * chunk + 1
    own = own.select(*keys, "_part.turn", "_piece", F.greatest(F.col("_part.a") - first, F.lit(0)).cast("int").alias("_from"), F.least(F.col("_part.b") - first, F.lit(chunk - 1)).cast("int").alias("_to"))
    cut = seqs.select(F.col("seq_id").alias("_seq"), F.posexplode(windows(F.col("seq"), chunk, 0)).alias("_place", "_cut"))
    cut = cut.withColumn("_place", F.col("_place").cast("long"))
    met = dealt(own, parts, "seq_id", "_piece").join(dealt(cut, parts, "_seq", "_place"), (F.col("seq_id") == F.col("_seq")) & (F.col("_piece") == F.col("_place")), "left")
    share = F.coalesce(F.substring(F.col("_cut"), F.col("_from") + 1, F.col("_to") - F.col("_from") + 1), F.lit(""))
    found = met.select(*keys, F.struct("turn", "_piece", share.alias("share")).alias("_share"))
    # repeated ranges have equal shares: each once, and how often
    whole = dealt(found, parts, *(by or keys)).groupBy(*keys).agg(F.sort_array(F.collect_set("_share")).alias("_shares"), F.count("*").alias("_rows"))
    bases = F.array_join(F.transform("_shares", lambda s: s["share"]), "")
    times = F.explode(F.array_repeat(F.lit(0), (F.col("_rows") / F.size("_shares")).cast("int")))
    return whole.select(*keys, bases.alias(name), times.alias("_time")).drop("_time")
