"""Sequence tables derived from the given tables, in Spark and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seqspark.functions.exprs import clean_sequence, reverse_complement
from seqspark.operators import frames, matching
from seqspark.operators.spans import span_bases
from seqspark.session import dealt, is_written, materialize, read_table, table_bytes

#: Insert ids are sequence ids times this, and the first base.
INSERT_PLACES = 10_000_000
#: Bytes of the documents' files for each partition of what follows from them.
PART_BYTES = 8 << 20
TYPES = ("CodingRegion", "Promoter", "Ori", "AntibioticResistance", "Generic")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Each text is cleaned once: as what a generator makes, a sequence is not worked out anew, and a filter on it not
    moved before it, wherever a plan names it or its length."""
    docs = read_table(spark, sf, "documents")
    topology = F.when(F.col("doc_id") % 2 == 0, "circular").otherwise("linear")
    return docs.select(F.col("doc_id").alias("seq_id"), F.col("source").alias("name"), F.explode(F.array(clean_sequence(F.col("text")))).alias("seq"), topology.alias("topology"))


def parts(spark: SparkSession, sf: str) -> int:
    """Partitions for what follows from the sequences; they grow with these, so a task does not."""
    least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-table_bytes(spark, sf, "documents") // PART_BYTES))


def feature_library(spark: SparkSession, sf: str) -> DataFrame:
    seq = clean_sequence(F.col("text"))
    rows = read_table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 1, reverse_complement(seq)).otherwise(seq).alias("seq"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("item_id") % 5 + 1).cast("int"))
    return rows.where(F.length("seq") >= 10).select(F.col("item_id").alias("lib_id"), F.concat(F.lit("lib"), F.col("item_id").cast("string")).alias("name"), kind.alias("feature_type"), "seq")


def primers(spark: SparkSession, sf: str) -> DataFrame:
    lib = feature_library(spark, sf).where(F.length("seq") >= 20)
    both = F.array(
        F.struct((F.col("lib_id") * 2).alias("primer_id"), F.substring("seq", 1, 20).alias("seq")),
        F.struct((F.col("lib_id") * 2 + 1).alias("primer_id"), reverse_complement(F.substring("seq", -20, 20)).alias("seq")),
    )
    rows = lib.select(F.explode(both).alias("p")).select("p.*")
    mode = F.when(F.col("primer_id") % 3 == 0, "both").when(F.col("primer_id") % 3 == 1, "only3").otherwise("only5")
    return rows.select("primer_id", "seq", mode.alias("tune_mode"))


def long_primers(spark: SparkSession, sf: str) -> DataFrame:
    """For tuning: up to 32 bases of each library entry of 15 or more."""
    lib = feature_library(spark, sf).where(F.length("seq") >= 15)
    mode = F.when(F.col("lib_id") % 3 == 0, "both").when(F.col("lib_id") % 3 == 1, "only3").otherwise("only5")
    return lib.select(F.col("lib_id").alias("primer_id"), F.substring("seq", 1, 32).alias("seq"), mode.alias("tune_mode"), F.lit(16).alias("anchor"))


#: Derived tables that are written once for an application and its tables.
_written: dict[tuple[str, str], DataFrame] = {}


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Library hits, and open reading frames of 30 bases or more as coding regions; written once."""
    key = spark.sparkContext.applicationId, sf
    if key not in _written or not is_written(spark, _written[key].written_to):
        _written[key] = materialize(_features(spark, sf), "features")
    return _written[key]


def _features(spark: SparkSession, sf: str) -> DataFrame:
    seqs = sequences(spark, sf)
    hits = matching.library_features(library_hits(spark, sf), feature_library(spark, sf))
    orfs = frames.orfs(seqs).where(F.col("end") - F.col("start") >= 29)
    direction = F.when(F.col("frame").startswith("Fwd"), "Forward").otherwise("Reverse")
    found = orfs.select("seq_id", "start", "end", F.lit("CodingRegion").alias("feature_type"), direction.alias("direction"), F.concat(F.lit("orf"), "frame").alias("label"))
    order = Window.partitionBy("seq_id").orderBy("start", "end", "feature_type", "direction", "label")
    return dealt(hits.unionByName(found), parts(spark, sf), "seq_id").withColumn("feature_id", F.row_number().over(order).cast("long"))


def library_hits(spark: SparkSession, sf: str) -> DataFrame:
    lib = feature_library(spark, sf).select(F.col("lib_id").alias("pattern_id"), F.col("seq").alias("pattern"))
    return matching.motif_hits(sequences(spark, sf), lib, min_len=10)


def backbones(spark: SparkSession, sf: str) -> DataFrame:
    """Circular sequences of 600 bases or more, with ranges at fixed shares of the length."""
    n = F.length("seq")
    at = lambda share, size: (F.floor(n * share).cast("int"), (F.floor(n * share) + size).cast("int"))
    ranges = {"promoter": at(0.1, 20), "terminator": at(0.8, 30), "rbs": at(0.2, 6), "his": at(0.5, 17)}
    cols = []
    for name, (a, b) in ranges.items():
        known = F.col("seq_id") % {"rbs": 3, "his": 4}.get(name, 1000000) != 2 if name in ("rbs", "his") else F.lit(True)
        cols += [F.when(known, a).alias(f"{name}_start"), F.when(known, b).alias(f"{name}_end")]
    trait = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.col("seq_id") % k + 1).cast("int"))
    rows = sequences(spark, sf).where((F.col("topology") == "circular") & (n >= 600))
    return rows.select(
        F.col("seq_id").alias("backbone_id"), "seq", "topology", *cols, trait(("Ampicillin", "Kanamycin"), 2).alias("resistance"),
        trait(("T7", "Pgk1", "None"), 3).alias("expression_system"), trait(("High", "Low"), 2).alias("copy_number"),
    )


def inserts(spark: SparkSession, sf: str, step: int = 1) -> DataFrame:
    """All forward reading frames of 30 bases or more of linear sequences; the id holds sequence and start.

    With a ``step`` those whose id it divides.
    """
    seqs = sequences(spark, sf).where("topology = 'linear'")
    insert_id = F.col("seq_id") * INSERT_PLACES + F.col("start")
    orfs = frames.orfs(seqs).where((F.col("end") - F.col("start") >= 29) & F.col("frame").startswith("Fwd") & (insert_id % step == 0))
    own = span_bases(seqs, orfs.select("seq_id", "start", "end"), "insert", parts=parts(spark, sf))
    return own.select(insert_id.alias("insert_id"), "seq_id", "insert")


#: Every insert whose id is divided by this is compared with every vector.
QUERY_STEP = 100


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """The query set of inserts, for all vectors."""
    return inserts(spark, sf, QUERY_STEP)


def alignments(spark: SparkSession, sf: str) -> DataFrame:
    beg = (F.col("l_partkey") * 37 % 100000).cast("long")
    return read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ref_id"), beg.alias("beg"), (beg + F.col("l_quantity").cast("long")).alias("end"), "l_orderkey", "l_linenumber")


# --- the same tables for the SQL twins --------------------------------------------------------------
CLEAN = "regexp_replace(lower({}), '[^acgt]', '', 'g')"
RC = "reverse(translate({}, 'acgt', 'tgca'))"

SEQUENCES = f"sequences AS (SELECT doc_id AS seq_id, source AS name, {CLEAN.format('text')} AS seq, CASE WHEN doc_id % 2 = 0 THEN 'circular' ELSE 'linear' END AS topology FROM documents)"
LIBRARY = (
    f"library AS (SELECT item_id AS lib_id, 'lib' || item_id AS name, list_extract(['{"','".join(TYPES)}'], CAST(item_id % 5 + 1 AS INT)) AS feature_type, s AS seq FROM "
    f"(SELECT item_id, CASE WHEN item_id % 2 = 1 THEN {RC.format(CLEAN.format('text'))} ELSE {CLEAN.format('text')} END AS s FROM benchmark) WHERE length(s) >= 10)"
)


def hits_sql(name: str, patterns: str, sequences: str = "sequences", strands: bool = True) -> str:
    """Occurrences of ``patterns(pattern_id, pattern)`` as ``name(seq_id, pattern_id, strand, start, end)``."""
    both = f"SELECT pattern_id, pattern, 'fwd' AS strand FROM {patterns} UNION ALL SELECT pattern_id, {RC.format('pattern')}, 'rev' FROM {patterns}" if strands else f"SELECT pattern_id, pattern, strand FROM {patterns}"
    return (
        f"{name}_p AS ({both}), "
        f"{name}_c AS (SELECT s.seq_id, p.pattern_id, p.strand, p.pattern, length(s.seq) AS n, s.topology, CASE WHEN s.topology = 'circular' THEN s.seq || substring(s.seq, 1, length(p.pattern) - 1) ELSE s.seq END AS padded "
        f"FROM {sequences} s JOIN {name}_p p ON length(p.pattern) <= length(s.seq) AND contains(CASE WHEN s.topology = 'circular' THEN s.seq || s.seq ELSE s.seq END, p.pattern)), "
        f"{name}_q AS (SELECT *, unnest(range(1, n + 1)) AS pos FROM {name}_c), "
        f"{name} AS (SELECT seq_id, pattern_id, strand, CAST(pos AS INT) AS start, CAST((pos + length(pattern) - 2) % n + 1 AS INT) AS \"end\" FROM {name}_q WHERE substring(padded, pos, length(pattern)) = pattern)"
    )


LIBRARY_HITS = "lib_patterns AS (SELECT lib_id AS pattern_id, seq AS pattern FROM library), " + hits_sql("hits", "lib_patterns")
LIBRARY_FEATURES = (
    "lib_features AS (SELECT h.seq_id, h.start, h.\"end\", l.feature_type, CASE WHEN l.feature_type NOT IN ('CodingRegion', 'Ori', 'Promoter', 'AntibioticResistance') THEN 'None' "
    "WHEN h.strand = 'fwd' THEN 'Forward' ELSE 'Reverse' END AS direction, l.name AS label FROM hits h JOIN library l ON l.lib_id = h.pattern_id)"
)
STRANDS = f"strands AS (SELECT seq_id, length(seq) AS n, 'Fwd' AS strand, seq AS s FROM sequences UNION ALL SELECT seq_id, length(seq), 'Rev', {RC.format('seq')} FROM sequences)"
TRIPLETS = "triplets AS (SELECT seq_id, n, strand, pos, substring(s, pos, 3) AS codon FROM (SELECT *, unnest(range(1, n - 1)) AS pos FROM strands WHERE n >= 3))"
ORFS = (
    "marks AS (SELECT *, strand || ((pos - 1) % 3) AS frame FROM triplets WHERE codon IN ('atg', 'taa', 'tag', 'tga')), "
    "segments AS (SELECT *, coalesce(sum(CASE WHEN codon <> 'atg' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id, frame ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM marks), "
    "spans AS (SELECT seq_id, strand, frame, n, seg, min(CASE WHEN codon = 'atg' THEN pos END) AS a, min(CASE WHEN codon <> 'atg' THEN pos END) AS z FROM segments GROUP BY ALL), "
    "orfs AS (SELECT seq_id, frame, CAST(CASE WHEN strand = 'Fwd' THEN a ELSE n - (z + 2) + 1 END AS INT) AS start, CAST(CASE WHEN strand = 'Fwd' THEN z + 2 ELSE n - a + 1 END AS INT) AS \"end\" FROM spans WHERE z > a)"
)
FEATURES = (
    f"{SEQUENCES}, {LIBRARY}, {LIBRARY_HITS}, {LIBRARY_FEATURES}, {STRANDS}, {TRIPLETS}, {ORFS}, "
    "all_features AS (SELECT * FROM lib_features UNION ALL SELECT seq_id, start, \"end\", 'CodingRegion', CASE WHEN frame LIKE 'Fwd%' THEN 'Forward' ELSE 'Reverse' END, 'orf' || frame FROM orfs WHERE \"end\" - start >= 29), "
    'features AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY start, "end", feature_type, direction, label) AS feature_id FROM all_features)'
)
PRIMERS = (
    f"all_primers AS (SELECT lib_id * 2 AS primer_id, substring(seq, 1, 20) AS seq FROM library WHERE length(seq) >= 20 UNION ALL SELECT lib_id * 2 + 1, {RC.format('right(seq, 20)')} FROM library WHERE length(seq) >= 20), "
    "primers AS (SELECT primer_id, seq, CASE primer_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'only3' ELSE 'only5' END AS tune_mode FROM all_primers)"
)
BACKBONES = (
    "backbones AS (SELECT seq_id AS backbone_id, seq, topology, CAST(floor(n * 0.1) AS INT) AS promoter_start, CAST(floor(n * 0.1) AS INT) + 20 AS promoter_end, CAST(floor(n * 0.8) AS INT) AS terminator_start, CAST(floor(n * 0.8) AS INT) + 30 AS terminator_end, "
    "CASE WHEN seq_id % 3 <> 2 THEN CAST(floor(n * 0.2) AS INT) END AS rbs_start, CASE WHEN seq_id % 3 <> 2 THEN CAST(floor(n * 0.2) AS INT) + 6 END AS rbs_end, "
    "CASE WHEN seq_id % 4 <> 2 THEN CAST(floor(n * 0.5) AS INT) END AS his_start, CASE WHEN seq_id % 4 <> 2 THEN CAST(floor(n * 0.5) AS INT) + 17 END AS his_end, "
    "list_extract(['Ampicillin', 'Kanamycin'], CAST(seq_id % 2 + 1 AS INT)) AS resistance, list_extract(['T7', 'Pgk1', 'None'], CAST(seq_id % 3 + 1 AS INT)) AS expression_system, list_extract(['High', 'Low'], CAST(seq_id % 2 + 1 AS INT)) AS copy_number "
    "FROM (SELECT *, CAST(length(seq) AS DOUBLE) AS n FROM sequences) WHERE topology = 'circular' AND n >= 600)"
)
INSERTS = (
    "inserts AS (SELECT o.seq_id * 10000000 + o.start AS insert_id, o.seq_id, substring(q.seq, o.start, o.\"end\" - o.start + 1) AS insert FROM orfs o JOIN sequences q ON q.seq_id = o.seq_id WHERE q.topology = 'linear' AND o.\"end\" - o.start >= 29 AND frame LIKE 'Fwd%')"
)
PAIRS = "pairs AS (SELECT i.insert_id, b.backbone_id FROM inserts i, backbones b WHERE i.insert_id % 100 = 0)"
