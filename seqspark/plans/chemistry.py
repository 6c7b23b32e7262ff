"""Queries on primers, reagents, reads and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions.constants import values_sql
from seqspark.operators import frames, library, pcr, primers
from seqspark.session import read_table

from . import derive as d
from .registry import query
from .sites import RUNS, primer_sites as found_sites

WITH = f"WITH {d.SEQUENCES}, {d.LIBRARY}, {d.PRIMERS}"
#: ln(0.05), R ln(1.25e-8): the default ions.
LOG_NA, R_LOG_C = "ln(50.0 * 1e-3)", "1.987 * ln(25.0 * 1e-9 / 2)"


def tm_sql(name: str, source: str, key: str = "primer_id") -> str:
    """``name(key, seq, dh, ds, tm)`` from ``source(key, seq)``."""
    return (
        f"{values_sql('neighbours')}, {name}_s AS (SELECT {key}, any_value(seq) AS seq, sum(dh) AS dh, sum(ds) AS ds FROM (SELECT {key}, seq, unnest(range(1, length(seq))) AS p FROM {source} WHERE length(seq) >= 10) x "
        f"JOIN neighbours ON pair = substring(seq, p, 2) GROUP BY {key}), "
        f"{name}_e AS (SELECT *, CAST(left(seq, 1) IN ('a', 't') AS INT) + CAST(right(seq, 1) IN ('a', 't') AS INT) + CAST(length(regexp_replace(seq, '[at]', '', 'g')) = 0 AS INT) AS extra FROM {name}_s), "
        f"{name} AS (SELECT {key}, seq, 1000.0 * (CAST(dh + 2 + 22 * extra AS DOUBLE) / 10.0) / (CAST(ds - 57 + 69 * extra AS DOUBLE) / 10.0 + CAST(0.368 AS DOUBLE) * (length(seq) - 1) * {LOG_NA} + {R_LOG_C}) - 273.15 AS tm FROM {name}_e)"
    )


def repeats_sql(name: str, source: str, key: str = "primer_id") -> str:
    """``name(key, mono, di, triplet, repeats)`` from ``source(key, seq)``."""

    def runs(tag: str, width: int, count: str) -> str:
        return (
            f"{name}_{tag}u AS (SELECT {key}, i, substring(seq, i * {width} + 1, {width}) AS u FROM (SELECT {key}, seq, unnest(range(0, {count})) AS i FROM {source} WHERE length(seq) >= 4)), "
            f"{name}_{tag}g AS (SELECT *, i - row_number() OVER (PARTITION BY {key}, u ORDER BY i) AS g FROM {name}_{tag}u), "
            f"{name}_{tag}r AS (SELECT {key}, min(i) AS f, count(*) AS r FROM {name}_{tag}g GROUP BY {key}, u, g), "
            f"{name}_{tag} AS (SELECT {key}, sum(CASE WHEN f = 0 THEN r // 3 ELSE (r - 1) // 3 END) AS v FROM {name}_{tag}r GROUP BY {key})"
        )

    return (
        f"{runs('m', 1, 'length(seq)')}, {runs('d', 2, 'length(seq) // 2 - 1')}, "
        f"{name}_t0 AS (SELECT {key}, i, substring(seq, i + 1, 3) AS t, substring(seq, i, 1) AS b FROM (SELECT {key}, seq, unnest(range(0, length(seq) - 2)) AS i FROM {source} WHERE length(seq) >= 4)), "
        f"{name}_t AS (SELECT x.{key}, count(DISTINCT x.t) AS v FROM {name}_t0 x JOIN {name}_t0 y ON x.{key} = y.{key} AND x.t = y.t AND x.i <> y.i AND NOT (x.i >= 3 AND y.i >= 3 AND x.b = y.b) GROUP BY x.{key}), "
        f"{name} AS (SELECT p.{key}, CAST(coalesce(m.v, 0) AS INT) AS mono, CAST(coalesce(dd.v, 0) AS INT) AS di, CAST(coalesce(t.v, 0) AS INT) AS triplet, CAST(coalesce(m.v, 0) + coalesce(dd.v, 0) + coalesce(t.v, 0) AS INT) AS repeats "
        f"FROM {source} p LEFT JOIN {name}_m m USING ({key}) LEFT JOIN {name}_d dd USING ({key}) LEFT JOIN {name}_t t USING ({key}) WHERE length(p.seq) >= 4)"
    )


def qc_sql(name: str, source: str, key: str = "primer_id") -> str:
    """``name`` with all measures, from ``source(key, seq, tune_mode)``."""

    def length_score(ideal: int, lo: int, hi: int, off: int) -> str:
        return f"CASE WHEN n BETWEEN {lo} AND {hi} THEN 1.0 ELSE 1.0 - CAST(abs(n - {ideal}) AS DOUBLE) / CASE WHEN n > {ideal} THEN {ideal + off} ELSE {ideal - off} END END"

    return (
        f"{tm_sql(name + '_tm', source, key)}, {repeats_sql(name + '_rp', source, key)}, "
        f"{name}_b AS (SELECT s.*, t.tm, r.repeats, length(s.seq) AS n, CAST(length(regexp_replace(s.seq, '[at]', '', 'g')) AS DOUBLE) / length(s.seq) AS gc, length(regexp_replace(right(s.seq, 5), '[at]', '', 'g')) AS gc_3p, CASE WHEN s.tune_mode = 'both' THEN r.repeats // 2 ELSE r.repeats END AS rr FROM {source} s JOIN {name}_tm t USING ({key}) JOIN {name}_rp r USING ({key})), "
        f"{name}_c AS (SELECT *, greatest(0.0, least(1.0, 1.0 - abs(tm - 59.0) / 18.0)) AS tm_score, 1.0 - abs(gc - 0.5) * 2.0 AS gc_score, CASE WHEN gc_3p IN (2, 3) THEN 1.0 WHEN gc_3p = 4 THEN 0.5 ELSE 0.0 END AS gc_3p_score, "
        f"CASE WHEN tune_mode = 'both' THEN {length_score(42, 36, 48, 16)} ELSE {length_score(21, 18, 24, 8)} END AS len_score, CASE rr WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.3 WHEN 4 THEN 0.2 ELSE 0.0 END AS repeats_score FROM {name}_b), "
        f"{name} AS (SELECT *, round((CAST(tm_score AS DOUBLE) + CAST(gc_score AS DOUBLE) + CAST(gc_3p_score AS DOUBLE) + 1.5 * CAST(len_score AS DOUBLE) + 0.5 * CAST(repeats_score AS DOUBLE)) / 6.0, 6) AS quality FROM {name}_c)"
    )


@query("d1_primer_tm", f"{WITH}, {tm_sql('t', 'primers')} SELECT primer_id, round(tm, 4) AS tm FROM t")
def primer_tm(spark, sf):
    return primers.primer_tm(d.primers(spark, sf))


@query("d4_primer_repeats", f"{WITH}, {repeats_sql('r', 'primers')} SELECT primer_id, mono, di, triplet, repeats FROM r")
def primer_repeats(spark, sf):
    return primers.primer_repeats(d.primers(spark, sf))


MASS = f"{values_sql('base_mass')}, mass AS (SELECT primer_id, round(CAST(sum(b.mass) - 6196 AS DOUBLE) / 100.0, 2) AS mass FROM (SELECT primer_id, seq, unnest(range(1, length(seq) + 1)) AS p FROM primers) x JOIN base_mass b ON b.base = substring(seq, p, 1) GROUP BY primer_id)"


@query("d5_oligo_mass", f"{WITH}, {MASS} SELECT * FROM mass")
def oligo_mass(spark, sf):
    return primers.oligo_mass(d.primers(spark, sf))


QC = ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in primers.QC)


@query("d2_primer_qc", f"{WITH}, {MASS}, {qc_sql('q', 'primers')} SELECT primer_id, tune_mode, CAST(n AS INT) AS length, gc_3p, repeats, mass, {QC} FROM q JOIN mass USING (primer_id)")
def primer_qc(spark, sf):
    return primers.primer_qc(d.primers(spark, sf))


@query(
    "d9_qc_summary",
    f"{WITH}, {qc_sql('q', 'primers')}, g AS (SELECT CASE WHEN round(quality, 4) > 0.8 THEN 'good' WHEN round(quality, 4) > 0.5 THEN 'marginal' ELSE 'bad' END AS grade, tune_mode, round(quality, 4) AS quality FROM q) "
    "SELECT grade, tune_mode, count(*) AS primers, round(avg(quality), 4) AS mean_quality FROM g GROUP BY CUBE (grade, tune_mode)",
)
def qc_summary(spark, sf):
    return primers.qc_summary(primer_qc(spark, sf))


def tuning_sql(source: str, keys: tuple[str, ...]) -> str:
    """``tuned`` with the best trim of each row of ``source(keys, seq, tune_mode, anchor)``."""
    own = ", ".join(f"'{k}': {k}" for k in keys)
    shown = ", ".join(f"owner.{k} AS {k}" for k in keys)
    return (
        "room AS (SELECT *, CASE WHEN tune_mode = 'only5' THEN length(seq) - 10 WHEN tune_mode = 'both' AND length(seq) > 20 THEN greatest(anchor - 10, 0) ELSE 0 END AS r5, CASE WHEN tune_mode = 'only3' THEN length(seq) - 10 WHEN tune_mode = 'both' AND length(seq) > 20 THEN greatest(length(seq) - anchor - 10, 0) ELSE 0 END AS r3 "
        f"FROM {source} WHERE length(seq) >= 10), "
        "t5 AS (SELECT *, unnest(range(0, CASE WHEN tune_mode = 'both' AND r3 < 1 THEN 1 ELSE greatest(r5, 1) END)) AS trim5, CASE WHEN tune_mode = 'both' AND r5 < 1 THEN 1 ELSE greatest(r3, 1) END AS n3 FROM room), "
        "t3 AS (SELECT *, unnest(range(0, n3)) AS trim3 FROM t5), "
        f"cand AS (SELECT {{{own}}} AS owner, row_number() OVER () AS primer_id, substring(seq, trim5 + 1, length(seq) - trim5 - trim3) AS seq, tune_mode, CAST(trim5 AS INT) AS trim5, CAST(trim3 AS INT) AS trim3 FROM t3), "
        f"{qc_sql('q', 'cand')}, best AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY quality DESC, trim5, trim3) AS b FROM q), "
        f"tuned AS (SELECT {shown}, tune_mode, trim5, trim3, seq, quality FROM best WHERE b = 1)"
    )


@query(
    "f1_tune_primers",
    f"WITH {d.LIBRARY}, lp AS (SELECT lib_id AS primer_id, substring(seq, 1, 32) AS seq, CASE lib_id % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'only3' ELSE 'only5' END AS tune_mode, 16 AS anchor FROM library WHERE length(seq) >= 15), "
    f"{tuning_sql('lp', ('primer_id',))} SELECT primer_id, trim5, trim3, seq, quality FROM tuned",
)
def tune_primers(spark, sf):
    return primers.tune_primers(d.long_primers(spark, sf))


SITES = f"pp AS (SELECT primer_id AS pattern_id, seq AS pattern FROM primers), {d.hits_sql('hits', 'pp')}, sites AS (SELECT seq_id, pattern_id AS primer_id, strand, start, \"end\" FROM hits)"


@query(
    "d8_primer_specificity",
    f"{WITH}, {SITES} SELECT p.primer_id, count(s.seq_id) AS sites, count(DISTINCT s.seq_id) AS sequences, count(s.seq_id) = 1 AS specific FROM primers p LEFT JOIN sites s USING (primer_id) GROUP BY p.primer_id",
)
def primer_specificity(spark, sf):
    return primers.primer_specificity(d.primers(spark, sf), found_sites(spark, sf))


@query(
    "d8_site_totals",
    f"{WITH}, {SITES}, lib_patterns AS (SELECT lib_id AS pattern_id, seq AS pattern FROM library), {d.hits_sql('lib_hits', 'lib_patterns')}, "
    "targets AS (SELECT DISTINCT p.primer_id, h.seq_id FROM primers p JOIN lib_hits h ON h.pattern_id = p.primer_id // 2), "
    "n AS (SELECT s.primer_id, s.seq_id, count(*) AS sites, count(t.primer_id) AS on_target FROM sites s LEFT JOIN targets t ON t.primer_id = s.primer_id AND t.seq_id = s.seq_id GROUP BY ALL) "
    "SELECT primer_id, seq_id, CAST(sum(sites) AS BIGINT) AS sites, CAST(sum(on_target) AS BIGINT) AS on_target, CAST(sum(sites) - sum(on_target) AS BIGINT) AS off_target FROM n GROUP BY ROLLUP (primer_id, seq_id)",
)
def site_totals(spark, sf):
    """A primer is meant for the sequences that hold the whole library entry it was made of."""
    own = d.library_hits(spark, sf).select(F.explode(F.array(F.col("pattern_id") * 2, F.col("pattern_id") * 2 + 1)).alias("primer_id"), "seq_id")
    return primers.site_totals(found_sites(spark, sf), own.join(d.primers(spark, sf), "primer_id", "left_semi"))


AMPLICONS = (
    f"{tm_sql('ptm', 'primers')}, few AS (SELECT *, count(*) OVER (PARTITION BY seq_id, primer_id) AS k FROM sites), "
    "amp AS (SELECT f.seq_id, f.primer_id AS fwd_id, r.primer_id AS rev_id, f.start, r.\"end\", CASE WHEN r.\"end\" >= f.start THEN r.\"end\" - f.start + 1 ELSE length(q.seq) - f.start + 1 + r.\"end\" END AS length, q.seq, round(least(round(a.tm, 4), round(b.tm, 4)) - 5, 4) AS anneal "
    "FROM few f JOIN few r ON r.seq_id = f.seq_id AND f.strand = 'fwd' AND r.strand = 'rev' AND f.primer_id <> r.primer_id AND f.k <= 1 AND r.k <= 1 JOIN sequences q ON q.seq_id = f.seq_id JOIN ptm a ON a.primer_id = f.primer_id JOIN ptm b ON b.primer_id = r.primer_id WHERE f.start <= r.\"end\" OR q.topology = 'circular'), "
    "amplicons AS (SELECT seq_id, fwd_id, rev_id, start, \"end\", CAST(length AS INT) AS length, substring(seq || seq, start, length) AS product, anneal, CAST(60 * length // 1000 AS INT) AS extend_s FROM amp WHERE length <= 40000)"
)


@query("b10_amplicons", f"{WITH}, {SITES}, {AMPLICONS} SELECT * FROM amplicons")
def amplicons(spark, sf):
    own = d.primers(spark, sf)
    return pcr.amplicons(d.sequences(spark, sf), found_sites(spark, sf), primers.primer_tm(own), parts=d.parts(spark, sf))


@query(
    "b11_amplicon_features",
    f"WITH {d.FEATURES}, {d.PRIMERS}, pp AS (SELECT primer_id AS pattern_id, seq AS pattern FROM primers), {d.hits_sql('phits', 'pp')}, sites AS (SELECT seq_id, pattern_id AS primer_id, strand, start, \"end\" FROM phits), {AMPLICONS} "
    "SELECT a.seq_id, a.fwd_id, a.rev_id, f.feature_id, f.label, CAST(f.start - a.start + 1 AS INT) AS start, CAST(f.\"end\" - a.start + 1 AS INT) AS \"end\" FROM amplicons a JOIN features f ON f.seq_id = a.seq_id AND a.start < f.start AND f.\"end\" < a.\"end\" AND f.start <= f.\"end\" AND a.start <= a.\"end\"",
)
def amplicon_features(spark, sf):
    return pcr.amplicon_features(amplicons(spark, sf), d.features(spark, sf), d.parts(spark, sf))


def _recipes(spark, sf):
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderkey").alias("solution_id"), ((F.col("o_custkey") % 7 + 1) / 10.0).alias("volume_l"))
    line = read_table(spark, sf, "lineitem")
    sub = F.when(F.col("l_linenumber") == 4, F.col("l_orderkey") % 97 + 1)
    lines = line.select(
        F.col("l_orderkey").alias("solution_id"), F.col("l_partkey").alias("reagent_id"), F.col("l_discount").cast("double").alias("molarity"),
        F.when(F.col("l_linenumber") % 2 == 0, "volume").otherwise("mass").alias("prep"), (F.col("l_quantity").cast("double") / 10).alias("stock_molarity"),
        sub.alias("sub_solution_id"), F.lit(0.25).alias("sub_fraction"),
    )
    parts = read_table(spark, sf, "part").select(F.col("p_partkey").alias("reagent_id"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("double").alias("mw"))
    return orders, lines, parts


@query(
    "d10_reagent_demand",
    "WITH o AS (SELECT o_orderkey AS order_id, o_orderkey AS solution_id, CAST(o_custkey % 7 + 1 AS DOUBLE) / 10.0 AS volume_l FROM orders), l AS (SELECT l_orderkey AS solution_id, l_partkey AS reagent_id, CAST(l_discount AS DOUBLE) AS molarity, CASE WHEN l_linenumber % 2 = 0 THEN 'volume' ELSE 'mass' END AS prep, CAST(l_quantity AS DOUBLE) / 10 AS stock, CASE WHEN l_linenumber = 4 THEN l_orderkey % 97 + 1 END AS sub FROM lineitem), "
    "dir AS (SELECT * FROM o JOIN l USING (solution_id)), nest AS (SELECT l.*, x.v AS volume_l FROM (SELECT sub AS solution_id, volume_l * 0.25 AS v FROM dir WHERE sub IS NOT NULL) x JOIN l USING (solution_id) WHERE l.sub IS NULL), "
    "every AS (SELECT reagent_id, molarity, prep, stock, volume_l FROM dir WHERE sub IS NULL UNION ALL SELECT reagent_id, molarity, prep, stock, volume_l FROM nest), "
    "s AS (SELECT reagent_id, CAST(sum(CAST(round(CASE WHEN prep = 'mass' THEN molarity * volume_l ELSE 0 END, 9) AS DECIMAL(28, 9))) AS DOUBLE) AS moles, CAST(sum(CAST(round(CASE WHEN prep = 'volume' THEN molarity * volume_l / stock ELSE 0 END, 9) AS DECIMAL(28, 9))) AS DOUBLE) AS vol, count(*) AS uses FROM every GROUP BY reagent_id) "
    "SELECT reagent_id, p_name AS name, round(moles * CAST(p_retailprice AS DOUBLE) + 1e-9, 4) AS mass_g, round(vol + 1e-11, 6) AS volume_l, uses FROM s JOIN part ON p_partkey = reagent_id",
)
def reagent_demand(spark, sf):
    return library.reagent_demand(*_recipes(spark, sf))


@query(
    "d7_build_feature_library",
    f"WITH {d.FEATURES}, c AS (SELECT f.seq_id, f.label, f.feature_type, substring(q.seq || q.seq, f.start, CASE WHEN f.\"end\" >= f.start THEN f.\"end\" - f.start + 1 ELSE length(q.seq) - f.start + 1 + f.\"end\" END) AS seq FROM features f JOIN sequences q USING (seq_id)), "
    "lab AS (SELECT seq, label, row_number() OVER (PARTITION BY seq ORDER BY count(*) DESC, label) AS r FROM c GROUP BY seq, label), typ AS (SELECT seq, feature_type, row_number() OVER (PARTITION BY seq ORDER BY count(*) DESC, feature_type) AS r FROM c GROUP BY seq, feature_type) "
    "SELECT c.seq, any_value(lab.label) AS label, any_value(typ.feature_type) AS feature_type, count(DISTINCT c.seq_id) AS sequences, count(*) AS occurrences FROM c JOIN lab ON lab.seq = c.seq AND lab.r = 1 JOIN typ ON typ.seq = c.seq AND typ.r = 1 GROUP BY c.seq",
)
def build_feature_library(spark, sf):
    return library.build_feature_library(d.features(spark, sf), d.sequences(spark, sf), d.parts(spark, sf))


@query(
    "d11_sequence_stats",
    f"WITH {d.FEATURES}, b AS (SELECT topology, count(*) AS sequences, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(max(length(seq)) AS INT) AS longest, round(CAST(sum(length(regexp_replace(seq, '[at]', '', 'g'))) AS DOUBLE) / sum(length(seq)), 6) AS gc FROM sequences GROUP BY topology) "
    "SELECT b.*, " + ", ".join(f"coalesce(k.{t}, 0) AS {t}" for t in d.TYPES) + " FROM b LEFT JOIN (SELECT topology, " + ", ".join(f"count(*) FILTER (feature_type = '{t}') AS {t}" for t in d.TYPES) + " FROM features f JOIN sequences q USING (seq_id) GROUP BY topology) k USING (topology)",
)
def sequence_stats(spark, sf):
    return library.sequence_stats(d.sequences(spark, sf), d.features(spark, sf), d.TYPES)


def _reads(spark, sf):
    """Whole sequences as reads, with four channels computed from base and position."""
    bases = F.split("seq", "")
    rows = d.sequences(spark, sf).where("seq != ''").select(F.col("seq_id").alias("read_id"), "seq")
    channel = lambda base, k: F.transform(bases, lambda b, i: F.when(b == base, 100 + (i * k) % 37).otherwise(i % 11).cast("int"))
    return rows.select("read_id", "seq", *[channel(b, k).alias(f"ch{j}") for j, (b, k) in enumerate((("a", 3), ("c", 5), ("g", 7), ("t", 11)), 1)])


@query(
    "e6_trace_scale",
    f"WITH {d.SEQUENCES}, r AS (SELECT seq_id AS read_id, substring(seq, 1, 41) AS s FROM sequences WHERE seq <> ''), p AS (SELECT read_id, substring(s, CAST(i + 1 AS INT), 1) AS b, i FROM (SELECT *, unnest(range(0, length(s))) AS i FROM r)) "
    "SELECT read_id, CAST(max(100 + (i * CASE b WHEN 'a' THEN 3 WHEN 'c' THEN 5 WHEN 'g' THEN 7 ELSE 11 END) % 37) AS INT) AS peak FROM p GROUP BY read_id",
)
def trace_scale(spark, sf):
    """The scale is that of the first 41 samples; the reads are whole."""
    return library.trace_scale(_reads(spark, sf))


@query("a8_reads_to_sequences", f"WITH {d.SEQUENCES} SELECT seq_id, 'read ' || seq_id AS name, seq, CAST(length(seq) AS INT) AS length, 'linear' AS topology FROM sequences WHERE seq <> ''")
def reads_to_sequences(spark, sf):
    return library.reads_to_sequences(_reads(spark, sf))


LINEAR = d.SEQUENCES.replace("CASE WHEN doc_id % 2 = 0 THEN 'circular' ELSE 'linear' END", "'linear'")


@query(
    "a8_read_features",
    f"WITH {LINEAR}, {d.LIBRARY}, {d.LIBRARY_HITS}, {d.LIBRARY_FEATURES}, {d.STRANDS}, {d.TRIPLETS}, {d.ORFS}, {RUNS}, known AS (SELECT seq_id, start, \"end\", 'CodingRegion' AS feature_type, 'Forward' AS direction, 'orf' || frame AS label FROM orfs WHERE \"end\" - start >= 29 AND frame LIKE 'Fwd%'), "
    "found AS (SELECT * FROM lib_features UNION ALL SELECT seq_id, start, \"end\", 'CodingRegion', CASE WHEN strand = 'Fwd' THEN 'Forward' ELSE 'Reverse' END, codons || '×His' FROM tags) "
    "SELECT * FROM known UNION ALL SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.seq_id = f.seq_id AND k.start = f.start AND k.\"end\" = f.\"end\")",
)
def read_features(spark, sf):
    """Reads come with their forward reading frames; the library is merged in."""
    reads = d.sequences(spark, sf).where("seq != ''").select(F.col("seq_id").alias("read_id"), "seq")
    orfs = frames.orfs(library.reads_to_sequences(reads)).where((F.col("end") - F.col("start") >= 29) & F.col("frame").startswith("Fwd"))
    known = orfs.select("seq_id", "start", "end", F.lit("CodingRegion").alias("feature_type"), F.lit("Forward").alias("direction"), F.concat(F.lit("orf"), "frame").alias("label"))
    return library.annotate_reads(reads, d.feature_library(spark, sf), known, min_run=3)[1]
