"""Exact and nearly exact occurrences of patterns in sequences, by k-mer seeds.

A pattern's first k bases are its seed. Sequences are cut into overlapping chunks in one pass, so that no
row and no string operation grows with a chromosome. Of a counted, bounded number of patterns the seeds are
looked up where the chunks are read, so that only places of seeds become rows, and these are verified against
the broadcast patterns; nothing is shuffled. More patterns are joined by shuffles through which the sequence
itself never goes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqspark.functions.constants import DIRECTED
from seqspark.functions.exprs import overlapping, reverse_complement, windows, wrap

from .scan import word_places
from .spans import lengths

#: Bases that belong to a chunk, unless patterns are longer; it also holds the overlap that follows.
CHUNK = 2048
#: Patterns, and bases of them, that are broadcast at most.
BROADCAST_PATTERNS, BROADCAST_BASES = 500_000, 32 << 20


def chunk_size(overlap: int) -> int:
    """Bases of a chunk: what follows a chunk must lie in the next one."""
    return max(CHUNK, overlap)


def chunk_sequences(seqs: DataFrame, overlap: int) -> DataFrame:
    """``(seq_id, n, circular, chunk, first, own, bases)``: chunks and the ``overlap`` after them, across
    the origin of circular sequences. A position belongs to the chunk it starts in; ``own`` of them do."""
    n, size = F.length("seq"), chunk_size(overlap)
    padded = F.when(F.col("topology") == "circular", F.concat("seq", F.substring(F.col("seq"), F.lit(1), F.lit(overlap)))).otherwise(F.col("seq"))
    cut = seqs.where(n > 0).select("seq_id", n.alias("n"), (F.col("topology") == "circular").alias("circular"), F.posexplode(windows(padded, size, overlap)).alias("chunk", "bases"))
    first = F.col("chunk") * size + 1
    rows = cut.select("seq_id", "n", "circular", "chunk", first.alias("first"), F.least(F.lit(size), F.col("n") - first + 1).alias("own"), "bases")
    return rows.where("own > 0")


def _scanned_hits(seqs: DataFrame, patterns: DataFrame, longest: int) -> DataFrame:
    """``(seq_id, n, circular, pos, pattern_id, strand, pattern)`` of every occurrence, in one scan for seeds of
    all lengths; ``patterns`` have a ``seed``, and are so few that they are broadcast."""
    words: dict[int, list[str]] = {}
    for r in patterns.select("seed").distinct().collect():
        words.setdefault(len(r["seed"]), []).append(r["seed"])
    pieces = chunk_sequences(seqs, longest - 1).select("seq_id", "n", "circular", "first", "own", "bases")
    met = word_places(pieces, words, longest).join(F.broadcast(patterns), F.col("word") == F.col("seed"))
    found = met.where((F.length("pattern") <= F.col("n")) & F.startswith(F.col("tail"), F.col("pattern")))
    return found.select("seq_id", "n", "circular", (F.col("first") + F.col("offset")).alias("pos"), "pattern_id", "strand", "pattern")


def _joined_hits(seqs: DataFrame, patterns: DataFrame, k: int, longest: int) -> DataFrame:
    """The same for seeds of ``k`` bases, by shuffles through which no sequence goes."""
    chunks = chunk_sequences(seqs, longest - 1)
    kmers = F.posexplode(F.slice(overlapping(F.col("bases"), k), F.lit(1), F.col("own"))).alias("offset", "seed")
    met = chunks.where(F.length("bases") >= k).select("seq_id", "chunk", kmers).join(patterns, "seed").drop("seed")
    found = met.join(chunks, ["seq_id", "chunk"])
    found = found.where((F.length("pattern") <= F.col("n")) & (F.substring(F.col("bases"), F.col("offset") + 1, F.length("pattern")) == F.col("pattern")))
    return found.select("seq_id", "n", "circular", (F.col("first") + F.col("offset")).alias("pos"), "pattern_id", "strand", "pattern")


def both_strands(patterns: DataFrame) -> DataFrame:
    """``(pattern_id, pattern, strand)``: patterns as given, and reverse-complemented as ``rev``."""
    forward = patterns.select("pattern_id", "pattern", F.lit("fwd").alias("strand"))
    return forward.unionByName(patterns.select("pattern_id", reverse_complement(F.col("pattern")).alias("pattern"), F.lit("rev").alias("strand")))


def motif_hits(seqs: DataFrame, patterns: DataFrame, min_len: int = 3, seeds: tuple[int, ...] = tuple(range(3, 11)), strands: bool = True) -> DataFrame:
    """``(seq_id, pattern_id, strand, start, end)`` of every occurrence, overlapping ones included.

    ``seqs(seq_id, seq, topology)``; ``patterns(pattern_id, pattern)``, or with a ``strand`` if
    ``strands`` is false. Occurrences wrap only in circular sequences; a pattern longer than the
    sequence never matches; palindromes are reported on both strands. A pattern is looked up by the
    longest of ``seeds`` that it holds; a bounded number of patterns takes one scan, more take one for each
    seed length that occurs.
    """
    usable = (both_strands(patterns) if strands else patterns).where(F.length("pattern") >= max(min_len, min(seeds)))
    size = F.length("pattern")
    k = F.greatest(*[F.when(size >= n, n).otherwise(0) for n in (0, *seeds)])
    seeded = usable.select("pattern_id", "strand", "pattern", F.substring(F.col("pattern"), F.lit(1), k).alias("seed"))
    groups = seeded.groupBy(F.length("seed").alias("k")).agg(F.count("*").alias("n"), F.max(size).alias("longest"), F.sum(size).alias("bases")).collect()
    if not groups:
        return seqs.sparkSession.createDataFrame([], f"seq_id {seqs.schema['seq_id'].dataType.simpleString()}, pattern_id {patterns.schema['pattern_id'].dataType.simpleString()}, strand string, start int, end int")
    if sum(g["n"] for g in groups) <= BROADCAST_PATTERNS and sum(g["bases"] for g in groups) <= BROADCAST_BASES:
        hits = _scanned_hits(seqs, seeded, max(g["longest"] for g in groups))
    else:
        parts = [_joined_hits(seqs, seeded.where(F.length("seed") == g["k"]), g["k"], g["longest"]) for g in sorted(groups, key=lambda g: g["k"])]
        hits = reduce(DataFrame.unionByName, parts)
    end = F.when(F.col("circular"), wrap(F.col("pos") + F.length("pattern") - 1, F.col("n"))).otherwise(F.col("pos") + F.length("pattern") - 1)
    return hits.select("seq_id", "pattern_id", "strand", F.col("pos").alias("start"), end.cast("int").alias("end"))


def primer_sites(seqs: DataFrame, primers: DataFrame) -> DataFrame:
    """``(seq_id, primer_id, strand, start, end)``; primers under 10 bases bind nowhere."""
    hits = motif_hits(seqs, primers.select(F.col("primer_id").alias("pattern_id"), F.col("seq").alias("pattern")), min_len=10)
    return hits.withColumnRenamed("pattern_id", "primer_id")


def search(seqs: DataFrame, queries: DataFrame) -> DataFrame:
    """``(seq_id, query_id, strand, start, end)`` of query sequences of 3 bases or more."""
    hits = motif_hits(seqs, queries.select(F.col("query_id").alias("pattern_id"), F.col("seq").alias("pattern")), min_len=3)
    return hits.withColumnRenamed("pattern_id", "query_id")


def library_features(hits: DataFrame, library: DataFrame) -> DataFrame:
    """Hits as ``(seq_id, start, end, feature_type, direction, label)``."""
    named = hits.join(library.select(F.col("lib_id").alias("pattern_id"), "name", "feature_type"), "pattern_id")
    direction = F.when(~F.col("feature_type").isin(*DIRECTED), "None").when(F.col("strand") == "fwd", "Forward").otherwise("Reverse")
    return named.select("seq_id", "start", "end", "feature_type", direction.alias("direction"), F.col("name").alias("label"))


def annotate(seqs: DataFrame, library: DataFrame, min_run: int = 6) -> DataFrame:
    """Library entries and His tags of every sequence, as features."""
    from .frames import his_tags

    hits = motif_hits(seqs, library.select(F.col("lib_id").alias("pattern_id"), F.col("seq").alias("pattern")), min_len=10)
    return library_features(hits, library).unionByName(his_tags(seqs, min_run))


def annotate_fuzzy(seqs: DataFrame, library: DataFrame, min_identity: float = 0.95) -> DataFrame:
    """``(seq_id, lib_id, strand, start, end, mismatches)`` of ungapped occurrences.

    With d mismatches allowed, a pattern is cut into d + 1 pieces; one of them occurs exactly. Pieces are
    looked up by seeds, and the whole pattern is verified at the place that a piece implies.
    """
    allowed = F.floor(F.length("pattern") * F.lit(1 - min_identity) + 1e-9).cast("int")
    whole = both_strands(library.select(F.col("lib_id").alias("pattern_id"), F.col("seq").alias("pattern"))).withColumn("d", allowed)
    size = F.floor(F.length("pattern") / (F.col("d") + 1)).cast("int")
    cut = whole.withColumn("size", size).where("size >= 3").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("d"))))
    pieces = cut.select(
        F.struct("pattern_id", "strand", "piece").alias("pattern_id"), F.lit("fwd").alias("strand"), F.substring(F.col("pattern"), F.col("piece") * F.col("size") + 1, F.col("size")).alias("pattern")
    )
    hits = motif_hits(seqs, pieces, strands=False).select("seq_id", F.col("pattern_id.*"), F.col("start").alias("piece_start"))
    placed = hits.join(cut.select("pattern_id", "strand", "piece", "size", F.length("pattern").alias("m")), ["pattern_id", "strand", "piece"])
    start = F.col("piece_start") - F.col("piece") * F.col("size")
    places = placed.join(lengths(seqs), "seq_id").withColumn("start", F.when(F.col("circular"), wrap(start, F.col("n"))).otherwise(start))
    places = places.where((F.col("m") <= F.col("n")) & (F.col("circular") | ((F.col("start") >= 1) & (F.col("start") + F.col("m") - 1 <= F.col("n")))))
    # each place once, before any bases come in
    places = places.select("seq_id", "pattern_id", "strand", F.col("start").cast("int").alias("start")).distinct()
    longest = whole.agg(F.max(F.length("pattern"))).first()[0] or 1
    chunk = F.floor((F.col("start") - 1) / chunk_size(longest - 1)).cast("int")
    full = places.withColumn("chunk", chunk).join(whole.select("pattern_id", "strand", "pattern", "d"), ["pattern_id", "strand"]).join(chunk_sequences(seqs, longest - 1), ["seq_id", "chunk"])
    window = F.substring(F.col("bases"), F.col("start") - F.col("first") + 1, F.length("pattern"))
    missed = F.size(F.filter(F.zip_with(F.split(window, ""), F.split("pattern", ""), lambda a, b: a != b), lambda x: x))
    last = F.col("start") + F.length("pattern") - 1
    return full.withColumn("mismatches", missed).where("mismatches <= d").select(
        "seq_id", F.col("pattern_id").alias("lib_id"), "strand", "start", F.when(F.col("circular"), wrap(last, F.col("n"))).otherwise(last).cast("int").alias("end"), F.col("mismatches").cast("int").alias("mismatches")
    )
