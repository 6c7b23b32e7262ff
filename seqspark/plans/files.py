"""Queries that write tables as files in the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqspark.session import dealt, shared_dir
from seqspark.sources.fasta import read_fasta, write_fasta
from seqspark.sources.genbank import read_genbank, write_genbank
from seqspark.sources.tables import load_tables, read_sequences, save_tables
from seqspark.streaming.ingest import annotate_stream

from . import derive as d
from .chemistry import SITES
from .registry import query
from .sites import RUNS, primer_sites

PARTS = "part-*"


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _named(spark, sf):
    return d.sequences(spark, sf).withColumn("name", F.concat(F.lit("seq"), F.col("seq_id").cast("string")))


@query("a1_fasta_round_trip", f"WITH {d.SEQUENCES} SELECT 'seq' || seq_id AS name, seq FROM sequences")
def fasta_round_trip(spark, sf):
    path = _place(spark, "fasta")
    write_fasta(_named(spark, sf).select("name", "seq"), path)
    return read_fasta(spark, path, PARTS).select("name", "seq")


def _genbank(spark, sf):
    path = _place(spark, "genbank")
    write_genbank(_named(spark, sf), d.features(spark, sf), path, parts=d.parts(spark, sf))
    return read_genbank(spark, path, PARTS)


@query("a3_genbank_sequences", f"WITH {d.SEQUENCES} SELECT 'seq' || seq_id AS name, seq, topology FROM sequences")
def genbank_sequences(spark, sf):
    return _genbank(spark, sf)["sequences"].select("name", "seq", "topology")


@query(
    "a4_genbank_features",
    f"WITH {d.FEATURES} SELECT 'seq' || seq_id AS name, start, \"end\", CASE WHEN feature_type = 'AntibioticResistance' THEN 'Generic' ELSE feature_type END AS feature_type, "
    "CASE WHEN direction = 'Reverse' THEN 'Reverse' WHEN feature_type = 'CodingRegion' THEN 'Forward' ELSE 'None' END AS direction, label FROM features",
)
def genbank_features(spark, sf):
    tables = _genbank(spark, sf)
    names = tables["sequences"].select("seq_id", "name")
    return _with_name(spark, sf, tables["features"], names).select("name", "start", "end", "feature_type", "direction", "label")


def _metadata(spark, sf):
    """A head for every sequence, and two references for every third."""
    rows = _named(spark, sf).select("seq_id", "name", "topology", F.length("seq").cast("string").alias("n"))
    accession = F.concat(F.lit("AC"), F.col("seq_id").cast("string"))
    head = rows.select(
        "seq_id", F.concat(F.lit("Molecule of "), "n", F.lit(" bases.")).alias("definition"), accession.alias("accession"), F.concat(accession, F.lit(".1")).alias("version"),
        F.when(F.col("seq_id") % 2 == 0, F.col("topology")).alias("keywords"), F.lit("synthetic construct").alias("source"),
    )
    number = F.explode(F.array(F.lit(1), F.lit(2)))
    refs = rows.where("seq_id % 3 = 0").select("seq_id", "n", number.alias("k")).select(
        "seq_id", F.concat(F.col("k").cast("string"), F.lit("  (bases 1 to "), "n", F.lit(")")).alias("description"), F.lit("Doe,J. and Roe,R.").alias("authors"),
        F.concat(F.lit("On molecule "), F.col("seq_id").cast("string")).alias("title"), F.lit("Unpublished").alias("journal"), F.when(F.col("k") == 2, F.col("seq_id").cast("string")).alias("pubmed"),
    )
    return head, refs


def _with_name(spark, sf, table, names):
    parts = d.parts(spark, sf)
    return dealt(table, parts, "seq_id").join(dealt(names, parts, "seq_id"), "seq_id")


def _genbank_heads(spark, sf):
    path = _place(spark, "genbank")
    head, refs = _metadata(spark, sf)
    sites = primer_sites(spark, sf).select("seq_id", F.concat(F.lit("p"), F.col("primer_id").cast("string")).alias("name"), "strand", "start", "end")
    write_genbank(_named(spark, sf), d.features(spark, sf), path, sites=sites, metadata=head, refs=refs, parts=d.parts(spark, sf))
    tables = read_genbank(spark, path, PARTS)
    return tables, tables["sequences"].select("seq_id", F.col("name").alias("molecule"))


@query("a3_genbank_metadata", f"WITH {d.SEQUENCES} SELECT 'seq' || seq_id AS molecule, 'Molecule of ' || length(seq) || ' bases.' AS definition, 'AC' || seq_id AS accession, 'AC' || seq_id || '.1' AS version, CASE WHEN seq_id % 2 = 0 THEN topology END AS keywords, 'synthetic construct' AS source FROM sequences")
def genbank_metadata(spark, sf):
    tables, names = _genbank_heads(spark, sf)
    return _with_name(spark, sf, tables["metadata"], names).select("molecule", "definition", "accession", "version", "keywords", "source")


@query("a3_genbank_refs", f"WITH {d.SEQUENCES} SELECT 'seq' || seq_id AS molecule, k || '  (bases 1 to ' || length(seq) || ')' AS description, 'Doe,J. and Roe,R.' AS authors, 'On molecule ' || seq_id AS title, 'Unpublished' AS journal, CASE WHEN k = 2 THEN CAST(seq_id AS VARCHAR) END AS pubmed FROM sequences, (VALUES (1), (2)) t(k) WHERE seq_id % 3 = 0")
def genbank_refs(spark, sf):
    tables, names = _genbank_heads(spark, sf)
    return _with_name(spark, sf, tables["refs"], names).select("molecule", "description", "authors", "title", "journal", "pubmed")


@query("a3_genbank_primers", f"WITH {d.SEQUENCES}, {d.LIBRARY}, {d.PRIMERS}, {SITES} SELECT 'seq' || s.seq_id AS molecule, 'p' || s.primer_id AS name, p.seq FROM sites s JOIN primers p USING (primer_id)")
def genbank_primers(spark, sf):
    tables, names = _genbank_heads(spark, sf)
    return _with_name(spark, sf, tables["primers"], names).select("molecule", "name", "seq")


@query("a5_read_sequences", f"WITH {d.SEQUENCES} SELECT 'seq' || seq_id AS name, seq, CAST(length(seq) AS INT) AS length, CASE WHEN seq_id % 3 = 0 THEN 'linear' ELSE topology END AS topology FROM sequences")
def mixed_directory(spark, sf):
    """Every third sequence as FASTA, the others as compressed GenBank records, in one directory."""
    path, rows = _place(spark, "mixed"), _named(spark, sf)
    write_fasta(rows.where("seq_id % 3 = 0").select("name", "seq"), f"{path}/fasta")
    write_genbank(rows.where("seq_id % 3 != 0"), d.features(spark, sf), f"{path}/genbank", compression="gzip", parts=d.parts(spark, sf))
    return read_sequences(spark, path, "part-*.txt", "part-*.txt.gz").select("name", "seq", "length", "topology")


@query("a7_saved_tables", f"WITH {d.FEATURES} SELECT seq_id, feature_id, start, \"end\", label FROM features")
def saved_tables(spark, sf):
    path = _place(spark, "tables")
    save_tables({"features": d.features(spark, sf)}, path)
    return load_tables(spark, path, ["features"])["features"].select("seq_id", "feature_id", "start", "end", "label")


@query(
    "a6_annotate_stream",
    f"WITH {d.SEQUENCES.replace('sequences AS (', 'all_sequences AS (')}, sequences AS (SELECT min(seq_id) AS seq_id, seq, 'linear' AS topology FROM all_sequences GROUP BY seq), {d.LIBRARY}, {d.LIBRARY_HITS}, {d.LIBRARY_FEATURES}, {d.STRANDS}, {d.TRIPLETS}, {RUNS} SELECT start, \"end\", feature_type, direction, label FROM lib_features "
    "UNION ALL SELECT start, \"end\", 'CodingRegion', CASE WHEN strand = 'Fwd' THEN 'Forward' ELSE 'Reverse' END, codons || '×His' FROM tags",
)
def annotated_stream(spark, sf):
    """Distinct sequences arrive as FASTA files and are annotated as linear molecules."""
    source, target, state = (_place(spark, n) for n in ("arrived", "annotated", "progress"))
    distinct = d.sequences(spark, sf).groupBy("seq").agg(F.min("seq_id").alias("seq_id"))
    write_fasta(distinct.select(F.concat(F.lit("seq"), F.col("seq_id").cast("string")).alias("name"), "seq"), source)
    annotate_stream(spark, source, d.feature_library(spark, sf), target, state, files=PARTS, min_run=3).awaitTermination()
    return spark.read.parquet(target).select("start", "end", "feature_type", "direction", "label")
