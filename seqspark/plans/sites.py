"""Queries on occurrences, frames, proteins, enzymes and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions.constants import HIS_CODONS, values_sql
from seqspark.functions.exprs import clean_sequence, reverse_complement
from seqspark.operators import enzymes, frames, intervals, library, matching
from seqspark.session import read_table

from . import derive as d
from .registry import query

WITH = f"WITH {d.SEQUENCES}, {d.LIBRARY}, "
E_ = '"end"'


@query("b1_motif_hits", f"{WITH}{d.LIBRARY_HITS} SELECT * FROM hits")
def motif_hits(spark, sf):
    return d.library_hits(spark, sf)


@query("b2_primer_sites", f"{WITH}{d.PRIMERS}, pp AS (SELECT primer_id AS pattern_id, seq AS pattern FROM primers), {d.hits_sql('hits', 'pp')} SELECT seq_id, pattern_id AS primer_id, strand, start, {E_} FROM hits")
def primer_sites(spark, sf):
    return matching.primer_sites(d.sequences(spark, sf), d.primers(spark, sf))


RUNS = (
    "his AS (SELECT *, strand || ((pos - 1) % 3) AS frame FROM triplets WHERE codon IN ('cat', 'cac')), "
    "isl AS (SELECT *, pos - 3 * row_number() OVER (PARTITION BY seq_id, frame ORDER BY pos) AS g FROM his), "
    "runs AS (SELECT seq_id, strand, frame, n, min(pos) AS a, max(pos) + 2 AS b, CAST(count(*) AS INT) AS codons FROM isl GROUP BY seq_id, strand, frame, n, g HAVING count(*) >= 3), "
    "tags AS (SELECT seq_id, strand, frame, CAST(CASE WHEN strand = 'Fwd' THEN a ELSE n - b + 1 END AS INT) AS start, CAST(CASE WHEN strand = 'Fwd' THEN b ELSE n - a + 1 END AS INT) AS \"end\", codons FROM runs)"
)


@query(
    "b3_annotate",
    f"{WITH}{d.LIBRARY_HITS}, {d.LIBRARY_FEATURES}, {d.STRANDS}, {d.TRIPLETS}, {RUNS} SELECT * FROM lib_features UNION ALL SELECT seq_id, start, {E_}, 'CodingRegion', CASE WHEN strand = 'Fwd' THEN 'Forward' ELSE 'Reverse' END, codons || '×His' FROM tags",
)
def annotate(spark, sf):
    return matching.annotate(d.sequences(spark, sf), d.feature_library(spark, sf), min_run=3)


#: Short motifs that are searched for besides: TATA box, CAAT box, Kozak start, polyadenylation signal, E-box.
MOTIFS = ((1, "tataaa"), (2, "ccaat"), (3, "accatgg"), (4, "aataaa"), (5, "cacgtg"))
MOTIFS_SQL = ", ".join(f"({k}, '{m}')" for k, m in MOTIFS)


@query(
    "b4_search",
    f"{WITH}qq AS (SELECT item_id AS pattern_id, seq AS pattern FROM (SELECT item_id, {d.CLEAN.format("text")} AS seq FROM benchmark UNION ALL SELECT -k, {d.RC.format("m")} FROM (VALUES {MOTIFS_SQL}) AS t(k, m)) WHERE length(seq) >= 3), {d.hits_sql('hits', 'qq')} SELECT seq_id, pattern_id AS query_id, strand, start, {E_} FROM hits",
)
def search(spark, sf):
    """Whole benchmark items, and a short list of motifs under negative ids, from their other strand."""
    items = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), clean_sequence(F.col("text")).alias("seq"))
    motifs = spark.createDataFrame([(-k, m) for k, m in MOTIFS], "query_id long, seq string").withColumn("seq", reverse_complement(F.col("seq")))
    return matching.search(d.sequences(spark, sf), items.unionByName(motifs).where(F.length("seq") >= 3))


SITES = (
    f"{values_sql('enzymes')}, {values_sql('enzyme_sites')}, ep AS (SELECT {{'e': enzyme_id, 's': spelled}} AS pattern_id, spelled AS pattern, strand FROM enzyme_sites), {d.hits_sql('site_hits', 'ep', strands=False)}, "
    "cut0 AS (SELECT h.seq_id, e.enzyme_id, e.enzyme, h.start AS site_start, length(q.seq) AS n, q.topology, h.start + CASE WHEN h.strand = 'fwd' THEN e.cut_after ELSE length(e.site) - 2 - e.cut_after END AS c FROM site_hits h JOIN enzymes e ON e.enzyme_id = h.pattern_id.e JOIN sequences q ON q.seq_id = h.seq_id), "
    "re_sites AS (SELECT seq_id, enzyme_id, enzyme, site_start, CAST(CASE WHEN topology = 'circular' THEN (c - 1 + n) % n + 1 ELSE c END AS INT) AS cut_pos, count(*) OVER (PARTITION BY seq_id, enzyme_id) AS match_count FROM cut0 WHERE topology = 'circular' OR c BETWEEN 0 AND n)"
)
SITES_WITH = f"WITH {d.SEQUENCES}, {SITES} "


@query("b5_re_sites", SITES_WITH + "SELECT * FROM re_sites")
def re_sites(spark, sf):
    return enzymes.re_sites(d.sequences(spark, sf))


def _points(spark, sf):
    n = F.length("seq")
    rows = d.sequences(spark, sf).where(n >= 4)
    return rows.select("seq_id", n.alias("n"), F.explode(F.array(*[F.floor(n * k / 4).cast("int") for k in (1, 2, 3)])).alias("pos")).distinct()


POINTS = "points AS (SELECT DISTINCT seq_id, length(seq) AS n, CAST(length(seq) * k // 4 AS INT) AS pos FROM sequences, (VALUES (1), (2), (3)) t(k) WHERE length(seq) >= 4)"


@query(
    "b6_features_at",
    f"WITH {d.FEATURES}, {POINTS}, m AS (SELECT p.seq_id, p.pos, f.feature_id, f.label, CASE WHEN f.{E_} >= f.start THEN f.{E_} - f.start + 1 ELSE p.n - f.start + 1 + f.{E_} END AS length FROM points p JOIN features f ON f.seq_id = p.seq_id "
    f"WHERE CASE WHEN f.start <= f.{E_} THEN f.start < p.pos AND p.pos < f.{E_} ELSE p.pos > f.start OR p.pos < f.{E_} END) "
    "SELECT seq_id, pos, feature_id, label, CAST(length AS INT) AS length FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, pos ORDER BY length, feature_id) AS b FROM m) WHERE b = 1",
)
def features_at(spark, sf):
    return intervals.features_at(_points(spark, sf), d.features(spark, sf), parts=d.parts(spark, sf))


TILES = (
    f"parts AS (SELECT f.seq_id, feature_id, start AS a, {E_} AS b FROM features f WHERE start <= {E_} UNION ALL SELECT f.seq_id, feature_id, start, length(q.seq) FROM features f JOIN sequences q ON q.seq_id = f.seq_id WHERE start > {E_} UNION ALL SELECT seq_id, feature_id, 1, {E_} FROM features WHERE start > {E_}), "
    f"tiles AS (SELECT seq_id, feature_id, CAST(t AS INT) AS tile, CAST(greatest(a, t * 100 + 1) AS INT) AS start, CAST(least(b, (t + 1) * 100) AS INT) AS {E_} FROM (SELECT *, unnest(range((a - 1) // 100, (b - 1) // 100 + 1)) AS t FROM parts))"
)


@query("b7_tile_features", f"WITH {d.FEATURES}, {TILES} SELECT * FROM tiles")
def tile_features(spark, sf):
    return intervals.tile_features(d.features(spark, sf), d.sequences(spark, sf), 100)


@query("b7_tile_coverage", f"WITH {d.FEATURES}, {TILES} SELECT seq_id, tile, count(DISTINCT feature_id) AS features, CAST(sum({E_} - start + 1) AS BIGINT) AS bases FROM tiles GROUP BY seq_id, tile")
def tile_coverage(spark, sf):
    return intervals.tile_coverage(tile_features(spark, sf))


CDS = (
    f"cds AS (SELECT f.seq_id, f.feature_id, f.start AS cds_start, f.{E_} AS cds_end, o.frame, o.start, o.{E_}, row_number() OVER (PARTITION BY f.seq_id, f.feature_id ORDER BY o.{E_} - o.start, CASE WHEN o.frame LIKE 'Fwd%' THEN 0 ELSE 3 END + CAST(right(o.frame, 1) AS INT), o.start) AS best "
    f"FROM features f JOIN orfs o ON o.seq_id = f.seq_id AND o.start <= f.start AND f.{E_} <= o.{E_} AND f.start <= f.{E_} WHERE f.feature_type = 'CodingRegion'), cds_orfs AS (SELECT * EXCLUDE (best) FROM cds WHERE best = 1)"
)


@query("b8_cds_orfs", f"WITH {d.FEATURES}, {CDS} SELECT * FROM cds_orfs")
def cds_orfs(spark, sf):
    return frames.cds_orfs(d.features(spark, sf), frames.orfs(d.sequences(spark, sf)), parts=d.parts(spark, sf))


ALIGNMENTS = "al AS (SELECT l_suppkey AS ref_id, l_partkey * 37 % 100000 AS beg, l_partkey * 37 % 100000 + CAST(l_quantity AS BIGINT) AS fin, l_orderkey, l_linenumber FROM lineitem)"


@query(
    "b9_overlap_join",
    f"WITH {ALIGNMENTS} SELECT a.ref_id, a.l_orderkey, a.l_linenumber, count(*) AS overlaps, min(b.beg) AS first_beg FROM al a JOIN al b ON a.ref_id = b.ref_id AND a.beg < b.fin AND b.beg < a.fin AND b.l_linenumber = 1 GROUP BY ALL",
)
def overlap_join(spark, sf):
    al = d.alignments(spark, sf)
    targets = al.where("l_linenumber = 1").select("ref_id", F.col("beg").alias("b_beg"), F.col("end").alias("b_end"))
    return intervals.overlap_join(al, targets, "ref_id").groupBy("ref_id", "l_orderkey", "l_linenumber").agg(F.count("*").alias("overlaps"), F.min("b_beg").alias("first_beg"))


@query(
    "b16_region",
    f"WITH {d.FEATURES}, c AS (SELECT seq_id, length(seq) AS n, CAST(length(seq) * 9 // 10 AS INT) AS center FROM sequences WHERE topology = 'circular' AND length(seq) >= 10), "
    f"slice AS (SELECT seq_id, center, 1 AS lo, n AS hi FROM c WHERE n <= 200 UNION ALL SELECT seq_id, center, greatest(center - 100, 1), least(center + 100, n) FROM c WHERE n > 200 UNION ALL SELECT seq_id, center, center - 100 + n, n FROM c WHERE n > 200 AND center - 100 < 1 UNION ALL SELECT seq_id, center, 1, center + 100 - n FROM c WHERE n > 200 AND center + 100 > n), "
    f"{TILES.split('tiles AS')[0].rstrip(', ')} SELECT DISTINCT s.seq_id, s.center, p.feature_id FROM slice s JOIN parts p ON p.seq_id = s.seq_id AND p.a <= s.hi AND s.lo <= p.b",
)
def region(spark, sf):
    n = F.length("seq")
    centers = d.sequences(spark, sf).where((F.col("topology") == "circular") & (n >= 10)).select("seq_id", n.alias("n"), F.floor(n * 9 / 10).cast("int").alias("center"))
    return intervals.region(d.features(spark, sf), centers, 200)


@query(
    "b17_annotate_fuzzy",
    f"{WITH}pat AS (SELECT lib_id, 'fwd' AS strand, seq AS pattern FROM library UNION ALL SELECT lib_id, 'rev', {d.RC.format('seq')} FROM library), pd AS (SELECT *, CAST(floor(length(pattern) * (1 - 0.95) + 1e-9) AS INT) AS dd FROM pat), "
    "pieces AS (SELECT *, length(pattern) // (dd + 1) AS size, unnest(range(0, dd + 1)) AS piece FROM pd), "
    "cand AS (SELECT q.seq_id, q.seq, q.topology, length(q.seq) AS n, p.lib_id, p.strand, p.pattern, p.dd, p.piece, p.size FROM sequences q JOIN pieces p ON length(p.pattern) <= length(q.seq) AND contains(CASE WHEN q.topology = 'circular' THEN q.seq || q.seq ELSE q.seq END, substring(p.pattern, p.piece * p.size + 1, p.size))), "
    "places AS (SELECT DISTINCT seq_id, seq, topology, n, lib_id, strand, pattern, dd, CASE WHEN topology = 'circular' THEN (pos - piece * size - 1 + 2 * n) % n + 1 ELSE pos - piece * size END AS start FROM (SELECT *, unnest(range(1, n + 1)) AS pos FROM cand) WHERE substring(seq || CASE WHEN topology = 'circular' THEN seq ELSE '' END, pos, size) = substring(pattern, piece * size + 1, size)), "
    "ok AS (SELECT *, list_sum(list_transform(range(1, length(pattern) + 1), lambda i: CASE WHEN substring(seq || seq, start + i - 1, 1) <> substring(pattern, i, 1) THEN 1 ELSE 0 END)) AS mm FROM places WHERE topology = 'circular' OR (start >= 1 AND start + length(pattern) - 1 <= n)) "
    f"SELECT seq_id, lib_id, strand, CAST(start AS INT) AS start, CAST((start + length(pattern) - 2) % n + 1 AS INT) AS {E_}, CAST(mm AS INT) AS mismatches FROM ok WHERE mm <= dd",
)
def annotate_fuzzy(spark, sf):
    return matching.annotate_fuzzy(d.sequences(spark, sf), d.feature_library(spark, sf), 0.95)


DIGEST = (
    "cuts AS (SELECT r.seq_id, r.cut_pos AS cut, min(r.enzyme) AS enzyme, any_value(length(q.seq)) AS n, any_value(q.topology = 'circular') AS circ FROM re_sites r JOIN sequences q ON q.seq_id = r.seq_id GROUP BY r.seq_id, r.cut_pos), "
    "ord AS (SELECT *, lead(cut) OVER w AS nxt, lead(enzyme) OVER w AS nxt_e, first_value(cut) OVER w AS c0, first_value(enzyme) OVER w AS e0, row_number() OVER w AS rn FROM cuts WINDOW w AS (PARTITION BY seq_id ORDER BY cut)), "
    "frag AS (SELECT seq_id, n, CASE WHEN cut = n THEN 1 ELSE cut + 1 END AS start, CASE WHEN nxt IS NOT NULL THEN nxt WHEN circ THEN c0 ELSE n END AS fin, enzyme AS left_enzyme, CASE WHEN nxt IS NOT NULL THEN nxt_e WHEN circ THEN e0 END AS right_enzyme FROM ord WHERE circ OR cut < n "
    "UNION ALL SELECT seq_id, n, 1, cut, NULL, enzyme FROM ord WHERE NOT circ AND rn = 1 AND cut > 0) "
    "SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY start) AS frag_no, CAST(start AS INT) AS start, CAST(fin AS INT) AS \"end\", CAST(CASE WHEN fin >= start THEN fin - start + 1 ELSE n - start + 1 + fin END AS INT) AS length, left_enzyme, right_enzyme FROM frag"
)


@query("e1_digest", SITES_WITH + ", " + DIGEST)
def digest(spark, sf):
    seqs = d.sequences(spark, sf)
    return enzymes.digest(enzymes.re_sites(seqs), seqs).withColumn("frag_no", F.col("frag_no").cast("long"))


@query("e2_orfs", f"WITH {d.SEQUENCES}, {d.STRANDS}, {d.TRIPLETS}, {d.ORFS} SELECT * FROM orfs")
def orfs(spark, sf):
    return frames.orfs(d.sequences(spark, sf))


@query("e3_codon_runs", f"WITH {d.SEQUENCES}, {d.STRANDS}, {d.TRIPLETS}, {RUNS} SELECT * FROM tags")
def codon_runs(spark, sf):
    return frames.codon_runs(d.sequences(spark, sf), HIS_CODONS, 3)


RESIDUES = (
    f"{values_sql('codons')}, body AS (SELECT c.*, CASE WHEN c.frame LIKE 'Fwd%' THEN substring(q.seq, c.start, c.{E_} - c.start + 1) ELSE {d.RC.format(f'substring(q.seq, c.start, c.{E_} - c.start + 1)')} END AS bases FROM cds_orfs c JOIN sequences q ON q.seq_id = c.seq_id), "
    "cod AS (SELECT *, substring(bases, 3 * pos + 1, 3) AS codon, CASE WHEN frame LIKE 'Fwd%' THEN start + 3 * pos ELSE \"end\" - 3 * pos - 2 END AS spot FROM (SELECT *, unnest(range(0, length(bases) // 3)) AS pos FROM body)), "
    "residues AS (SELECT seq_id, feature_id, frame, pos, aa, CASE WHEN (frame LIKE 'Fwd%' AND spot < cds_start) OR (frame LIKE 'Rev%' AND spot + 2 > cds_end) THEN 'pre' WHEN (frame LIKE 'Fwd%' AND spot + 2 > cds_end) OR (frame LIKE 'Rev%' AND spot < cds_start) THEN 'post' ELSE 'cds' END AS zone FROM cod JOIN codons USING (codon) WHERE aa <> '*')"
)
PROTEIN_WITH = f"WITH {d.FEATURES}, {CDS}, {RESIDUES}"


def _residues(spark, sf):
    return frames.residues(d.sequences(spark, sf), cds_orfs(spark, sf), d.parts(spark, sf))


@query(
    "h1_proteins",
    PROTEIN_WITH + " SELECT seq_id, feature_id, frame, coalesce(string_agg(aa, '' ORDER BY pos) FILTER (zone = 'cds'), '') AS aa, coalesce(string_agg(aa, '' ORDER BY pos) FILTER (zone = 'pre'), '') AS aa_pre, coalesce(string_agg(aa, '' ORDER BY pos) FILTER (zone = 'post'), '') AS aa_post FROM residues GROUP BY ALL",
)
def proteins(spark, sf):
    return frames.proteins(_residues(spark, sf))


@query(
    "d6_protein_mass",
    PROTEIN_WITH + f", {values_sql('residue_mass')}, sm AS (SELECT seq_id, feature_id, sum(CASE WHEN zone = 'cds' THEN mass ELSE 0 END) AS m, count(*) FILTER (zone = 'cds') AS k, sum(mass) AS m2, count(*) AS k2 FROM residues JOIN residue_mass USING (aa) GROUP BY seq_id, feature_id) "
    "SELECT seq_id, feature_id, CASE WHEN k > 0 THEN CAST((m - 180150 * (k - 1) + 500) // 1000 AS DOUBLE) / 10000.0 END AS kda, CAST((m2 - 180150 * (k2 - 1) + 500) // 1000 AS DOUBLE) / 10000.0 AS kda_total FROM sm",
)
def protein_mass(spark, sf):
    return frames.protein_mass(_residues(spark, sf))


@query(
    "e4_hydropathy",
    PROTEIN_WITH + f", {values_sql('hydropathy')}, w AS (SELECT seq_id, feature_id, pos, sum(value) OVER x AS t, count(*) OVER x AS k FROM residues JOIN hydropathy USING (aa) WHERE zone = 'cds' WINDOW x AS (PARTITION BY seq_id, feature_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)) "
    "SELECT seq_id, feature_id, CAST(pos AS INT) AS pos, round(CAST(t AS DOUBLE) / 90.0, 4) AS value FROM w WHERE k = 9",
)
def hydropathy(spark, sf):
    return frames.hydropathy(_residues(spark, sf))


@query(
    "e5_residue_tracts",
    f"WITH {d.SEQUENCES}, {d.STRANDS}, {d.TRIPLETS}, {values_sql('codons')}, w AS (SELECT seq_id, strand || ((pos - 1) % 3) AS frame, sum(CASE WHEN aa = 'L' THEN 1 ELSE 0 END) OVER x AS h, count(*) OVER x AS k FROM triplets JOIN codons USING (codon) WINDOW x AS (PARTITION BY seq_id, strand, (pos - 1) % 3 ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) "
    "SELECT seq_id, frame, count(*) AS windows, CAST(max(h) AS BIGINT) AS most FROM w WHERE k = 12 AND h > 0.5 * 12 GROUP BY seq_id, frame",
)
def residue_tracts(spark, sf):
    return frames.residue_tracts(d.sequences(spark, sf), "L", 12, 0.5)


@query(
    "e7_crowded_sites",
    SITES_WITH + "SELECT * FROM (SELECT seq_id, enzyme, site_start, (SELECT min(o.site_start) FROM re_sites o WHERE o.seq_id = r.seq_id AND o.site_start > r.site_start AND o.site_start < r.site_start + 10) AS next_start FROM re_sites r) WHERE next_start IS NOT NULL",
)
def crowded_sites(spark, sf):
    return enzymes.crowded_sites(re_sites(spark, sf))


FILTER = "f AS (SELECT enzyme_id, enzyme, count(DISTINCT seq_id) AS sequences, max(match_count) AS most_sites FROM re_sites GROUP BY enzyme_id, enzyme)"


@query("d3_enzyme_filter", SITES_WITH + f", {FILTER} SELECT f.* FROM f JOIN enzymes e USING (enzyme_id) WHERE sequences >= 2 AND NOT e.is_blunt")
def enzyme_filter(spark, sf):
    return enzymes.enzyme_filter(re_sites(spark, sf), unique=False, sticky=True, multi=True)


@query("d3_unique_cutters", SITES_WITH + f", {FILTER} SELECT f.* FROM f WHERE most_sites = 1")
def unique_cutters(spark, sf):
    return enzymes.enzyme_filter(re_sites(spark, sf), unique=True)


SINGLE_CUTS = (
    "cuts AS (SELECT a.seq_id, a.enzyme_id, a.enzyme, a.site_start, q.topology FROM re_sites a JOIN enzymes e ON e.enzyme_id = a.enzyme_id JOIN sequences q ON q.seq_id = a.seq_id WHERE a.match_count = 1 AND NOT e.is_blunt AND (q.topology = 'linear' OR length(q.seq) >= 600))"
)


def _insert_and_vector_sites(spark, sf):
    seqs = d.sequences(spark, sf)
    inserts = seqs.where("topology = 'linear'")
    vectors = seqs.where((F.col("topology") == "circular") & (F.length("seq") >= 600))
    return inserts, vectors, enzymes.re_sites(inserts), enzymes.re_sites(vectors)


@query(
    "b13_re_candidates",
    SITES_WITH + "SELECT a.seq_id AS insert_id, b.seq_id AS vector_id, a.enzyme_id, a.site_start AS insert_pos, b.site_start AS vector_pos FROM re_sites a JOIN re_sites b ON a.enzyme_id = b.enzyme_id JOIN enzymes e ON e.enzyme_id = a.enzyme_id "
    "JOIN sequences i ON i.seq_id = a.seq_id JOIN sequences v ON v.seq_id = b.seq_id WHERE a.match_count = 1 AND b.match_count = 1 AND NOT e.is_blunt AND i.topology = 'linear' AND v.topology = 'circular' AND length(v.seq) >= 600",
)
def re_candidates(spark, sf):
    """Every linear sequence with every vector."""
    return enzymes.query_candidates(*_insert_and_vector_sites(spark, sf)[2:])


@query(
    "b13_candidate_pairs",
    SITES_WITH.rstrip() + f", {SINGLE_CUTS} SELECT a.seq_id AS insert_id, b.seq_id AS vector_id, a.enzyme_id, a.site_start AS insert_pos, b.site_start AS vector_pos FROM cuts a JOIN cuts b USING (enzyme_id) WHERE a.topology = 'linear' AND b.topology = 'circular' AND b.seq_id % 100 = 0",
)
def candidate_pairs(spark, sf):
    """Every vector whose id is divided by 100 with every linear sequence."""
    _, vectors, own, _ = _insert_and_vector_sites(spark, sf)
    return enzymes.query_candidates(own, enzymes.re_sites(vectors.where("seq_id % 100 = 0")))


@query(
    "b13_candidate_links",
    SITES_WITH.rstrip() + f", {SINGLE_CUTS}, i AS (SELECT enzyme_id, enzyme, count(*) AS inserts FROM cuts WHERE topology = 'linear' GROUP BY ALL), v AS (SELECT enzyme_id, enzyme, count(*) AS vectors FROM cuts WHERE topology = 'circular' GROUP BY ALL) SELECT enzyme_id, enzyme, inserts, vectors, inserts * vectors AS pairs FROM i JOIN v USING (enzyme_id, enzyme)",
)
def candidate_links(spark, sf):
    """Every linear sequence with every vector."""
    return enzymes.candidate_links(*_insert_and_vector_sites(spark, sf)[2:])


@query("g3_common_enzymes", SITES_WITH + ", sets AS (SELECT seq_id // 2 AS set_id, seq_id FROM sequences) SELECT set_id, enzyme FROM sets JOIN re_sites USING (seq_id) GROUP BY set_id, enzyme HAVING count(DISTINCT seq_id) = (SELECT count(*) FROM sets s WHERE s.set_id = sets.set_id)")
def common_enzymes(spark, sf):
    """Sets of two neighbouring sequences."""
    seqs = d.sequences(spark, sf)
    return enzymes.common_enzymes(enzymes.re_sites(seqs), seqs.select(F.floor(F.col("seq_id") / 2).alias("set_id"), "seq_id"))


@query("f3_ordered_sites", SITES_WITH + "SELECT seq_id, enzyme, site_start, row_number() OVER (PARTITION BY seq_id ORDER BY site_start, enzyme) AS place FROM re_sites")
def ordered_sites(spark, sf):
    from pyspark.sql import Window

    return re_sites(spark, sf).select("seq_id", "enzyme", "site_start", F.row_number().over(Window.partitionBy("seq_id").orderBy("site_start", "enzyme")).cast("long").alias("place"))


@query("g4_distinct_sequences", f"WITH {d.SEQUENCES} SELECT DISTINCT seq FROM sequences")
def distinct_sequences(spark, sf):
    return library.remove_duplicates(d.sequences(spark, sf).select("seq"))
