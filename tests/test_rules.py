"""Hand cases: one small table for each rule of the sequence model."""

import random

import pandas as pd

import pytest

from seqspark.functions.constants import HIS_CODONS, reverse_complement
from seqspark.operators import alignment, cloning, edits, enzymes, frames, intervals, library, matching, pcr, primers, similarity


def seqs_of(spark, *rows):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "seq_id long, seq string, topology string")


def hits(spark, seq, pattern, topology="linear"):
    found = matching.motif_hits(seqs_of(spark, (seq, topology)), spark.createDataFrame([(7, pattern)], "pattern_id long, pattern string"))
    return sorted((r["strand"], r["start"], r["end"]) for r in found.collect())


def test_hit_across_the_origin(spark):
    assert hits(spark, "aacgtt", "ttaac", "circular") == [("fwd", 5, 3), ("rev", 4, 2)]
    assert hits(spark, "aacgtt", "ttaac") == []


def test_hit_at_the_ends(spark):
    assert hits(spark, "ccgatc", "gatc") == [("fwd", 3, 6), ("rev", 3, 6)]
    assert hits(spark, "gatccc", "gatc") == [("fwd", 1, 4), ("rev", 1, 4)]


def test_pattern_longer_than_the_sequence(spark):
    assert hits(spark, "acg", "acgacg", "circular") == []


def test_overlapping_hits_and_long_sequences_equal_plain(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("at") for _ in range(5000))
    patterns = ["att", "tatatat", long[2040:2060], long[4990:] + long[:20]]
    for topology in ("linear", "circular"):
        table = spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
        got = {(r["pattern_id"], r["strand"], r["start"]) for r in matching.motif_hits(seqs_of(spark, (long, topology)), table).collect()}
        text = long + (long if topology == "circular" else "")
        want = {(i, s, p + 1) for i, own in enumerate(patterns) for s, q in (("fwd", own), ("rev", reverse_complement(own))) for p in range(len(long)) if text.startswith(q, p)}
        assert got == want


def test_short_primers_bind_nowhere(spark):
    table = spark.createDataFrame([(1, "acgtacgta"), (2, "acgtacgtac")], "primer_id long, seq string")
    assert {r["primer_id"] for r in matching.primer_sites(seqs_of(spark, ("acgtacgtacgt", "linear")), table).collect()} == {2}


def orf_rows(spark, seq, **more):
    return sorted((r["frame"], r["start"], r["end"]) for r in frames.orfs(seqs_of(spark, (seq, "linear")), **more).collect())


@pytest.mark.parametrize(
    "seq, want",
    [("atgatgtaa", [("Fwd0", 1, 9)]), ("atgaaa", []), ("ttatttcat", [("Rev0", 1, 9)]), ("cc" + "ttatttcat" + "gg", [("Rev2", 3, 11)]), ("", []), ("at", [])],
)
def test_orfs(spark, seq, want):
    assert orf_rows(spark, seq) == want


def test_open_frame_may_close_at_the_end(spark):
    assert orf_rows(spark, "atgaaa", close_at_end=True) == [("Fwd0", 1, 6)]


def test_orfs_of_long_sequences_equal_plain(spark):
    rng = random.Random(2)
    seq = "".join(rng.choice("acgt") for _ in range(5000))
    want = []
    for strand, s in (("Fwd", seq), ("Rev", reverse_complement(seq))):
        for f in range(3):
            start = None
            for p in range(f, len(s) - 2, 3):
                if s[p : p + 3] == "atg" and start is None:
                    start = p
                elif s[p : p + 3] in ("taa", "tag", "tga") and start is not None:
                    a, b = start + 1, p + 3
                    want.append((f"{strand}{f}", a, b) if strand == "Fwd" else (f"{strand}{f}", len(s) - b + 1, len(s) - a + 1))
                    start = None
    assert orf_rows(spark, seq) == sorted(want)


@pytest.mark.parametrize("n, label", [(5, None), (6, "6×His"), (8, "8×His")])
def test_his_tags(spark, n, label):
    got = [r["label"] for r in frames.his_tags(seqs_of(spark, ("cat" * n + "gcg", "linear"))).collect() if r["direction"] == "Forward"]
    assert got == ([label] if label else [])


def test_reverse_his_run(spark):
    got = [(r["start"], r["end"], r["codons"]) for r in frames.codon_runs(seqs_of(spark, ("gcgcg" + "atg" * 6 + "gg", "linear")), HIS_CODONS, 6).collect() if r["strand"] == "Rev"]
    assert got == [(6, 23, 6)]


def test_coding_region_takes_the_shortest_frame(spark):
    feats = spark.createDataFrame([(0, 1, 4, 9, "CodingRegion", "x"), (0, 2, 4, 9, "CodingRegion", "6×His"), (0, 3, 4, 9, "Gene", "g")], "seq_id long, feature_id long, start int, end int, feature_type string, label string")
    found = spark.createDataFrame([(0, "Fwd0", 1, 30), (0, "Rev1", 1, 18), (0, "Fwd1", 2, 19), (0, "Fwd2", 5, 9)], "seq_id long, frame string, start int, end int")
    assert [(r["feature_id"], r["frame"]) for r in frames.cds_orfs(feats, found).collect()] == [(1, "Fwd1")]


def test_residues_before_and_after(spark):
    table = seqs_of(spark, ("atgcataaacattaa", "linear"))
    region = spark.createDataFrame([(0, 1, 4, 9, "Fwd0", 1, 15)], "seq_id long, feature_id long, cds_start int, cds_end int, frame string, start int, end int")
    row = frames.proteins(frames.residues(table, region)).first()
    assert (row["aa_pre"], row["aa"], row["aa_post"]) == ("M", "HK", "H")
    back = seqs_of(spark, (reverse_complement("atgcataaacattaa"), "linear"))
    region = spark.createDataFrame([(0, 1, 7, 12, "Rev0", 1, 15)], "seq_id long, feature_id long, cds_start int, cds_end int, frame string, start int, end int")
    row = frames.proteins(frames.residues(back, region)).first()
    assert (row["aa_pre"], row["aa"], row["aa_post"]) == ("M", "HK", "H")


GOLDEN = [
    ("taatacgactcactataggg", "only3", 44.4939, 3, 2, 0.6324),
    ("gtaaaacgacggccagtgaattc", "only3", 54.8357, 1, 3, 0.5625),
    ("caggaaacagctatgaccatgattacgccaagcttg", "only3", 64.0160, 3, 4, 0.5817),
    ("caggaaacagctatgaccatgattacgccaagcttg", "both", 64.0160, 3, 4, 0.7443),
    ("atatatatatatatatatat", "only3", 23.7861, 0, 5, 0.2500),
    ("aaaaaaaaaa", "only3", 3.3555, 0, 5, 0.0385),
]


def test_golden_primers(spark):
    table = spark.createDataFrame([(i, g[0], g[1]) for i, g in enumerate(GOLDEN)], "primer_id long, seq string, tune_mode string")
    got = {r["primer_id"]: r for r in primers.primer_qc(table).collect()}
    for i, (_, _, tm, gc3, repeats, quality) in enumerate(GOLDEN):
        r = got[i]
        assert (r["gc_3p"], r["repeats"]) == (gc3, repeats) and abs(r["tm"] - tm) < 2e-4 and abs(r["quality"] - quality) < 2e-4


def test_magnesium_and_dntp_change_nothing(spark):
    table = spark.createDataFrame([(1, GOLDEN[0][0])], "primer_id long, seq string")
    assert primers.primer_tm(table, primers.Ions(divalent=0, dntp=0)).first() == primers.primer_tm(table, primers.Ions(divalent=10, dntp=5)).first()


def test_nine_bases_have_no_tm(spark):
    assert primers.primer_tm(spark.createDataFrame([(1, "acgtacgta")], "primer_id long, seq string")).collect() == []


@pytest.mark.parametrize("seq, mono", [("aaac" + "gtgtgtcg", 1), ("caaac" + "gtgtgtcg", 0), ("caaaac" + "gtgtgtcg", 1)])
def test_single_base_runs(spark, seq, mono):
    assert primers.primer_repeats(spark.createDataFrame([(1, seq)], "primer_id long, seq string")).first()["mono"] == mono


def test_tuning_keeps_the_best_and_smallest_trim(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("acgt") for _ in range(32)), mode, 16) for i, mode in enumerate(["only5", "only3", "both", "disabled"])]
    got = {r["primer_id"]: r for r in primers.tune_primers(spark.createDataFrame(rows, "primer_id long, seq string, tune_mode string, anchor int")).collect()}
    for i, seq, mode, _ in rows:
        trims = {"only5": [(k, 0) for k in range(22)], "only3": [(0, k) for k in range(22)], "both": [(a, b) for a in range(6) for b in range(6)], "disabled": [(0, 0)]}[mode]
        table = spark.createDataFrame([(k, seq[a : 32 - b], mode) for k, (a, b) in enumerate(trims)], "primer_id long, seq string, tune_mode string")
        quality = {trims[r["primer_id"]]: r["quality"] for r in primers.primer_qc(table).collect()}
        best = max(quality.values())
        assert abs(got[i]["quality"] - best) < 1e-4 and abs(quality[got[i]["trim5"], got[i]["trim3"]] - best) < 1e-4
        assert got[i]["seq"] == seq[got[i]["trim5"] : 32 - got[i]["trim3"]]


def digest_rows(spark, seq, topology):
    table = seqs_of(spark, (seq, topology))
    return sorted((r["frag_no"], r["start"], r["end"], r["length"], r["left_enzyme"], r["right_enzyme"]) for r in enzymes.digest(enzymes.re_sites(table), table).collect())


def test_digests(spark):
    one = "a" * 10 + "gaattc" + "a" * 10
    assert digest_rows(spark, one, "linear") == [(1, 1, 11, 11, None, "EcoRI"), (2, 12, 26, 15, "EcoRI", None)]
    assert digest_rows(spark, one, "circular") == [(1, 12, 11, 26, "EcoRI", "EcoRI")]
    three = one + one + one
    rows = digest_rows(spark, three, "circular")
    assert len(rows) == 3 and sum(r[3] for r in rows) == len(three)
    assert digest_rows(spark, "acgtacgt", "linear") == []
    edge = digest_rows(spark, "gatc" + "a" * 6, "linear")  # cut before the first base
    assert sum(r[3] for r in edge) == 10


def test_site_across_the_origin(spark):
    assert [r["site_start"] for r in enzymes.re_sites(seqs_of(spark, ("attc" + "a" * 10 + "ga", "circular"))).collect()] == [15]


def test_crowded_sites(spark):
    table = seqs_of(spark, ("gaattc" + "a" * 3 + "gaattc" + "a" * 20 + "gaattc", "linear"))
    assert [(r["site_start"], r["next_start"]) for r in enzymes.crowded_sites(enzymes.re_sites(table)).collect()] == [(1, 10)]


def test_rotate_origin(spark):
    table = seqs_of(spark, ("acgtacgtaa", "circular"), ("acgtacgtaa", "linear"))
    feats = spark.createDataFrame([(0, 1, 3, 3), (0, 2, 9, 5), (1, 1, 3, 3)], "seq_id long, feature_id long, start int, end int")
    origins = spark.createDataFrame([(0, 4), (1, 4)], "seq_id long, origin int")
    new, moved = edits.rotate_origin(table, feats, origins)
    assert {r["seq_id"]: r["seq"] for r in new.collect()} == {0: "tacgtaaacg", 1: "acgtacgtaa"}
    assert sorted((r["seq_id"], r["feature_id"], r["start"], r["end"]) for r in moved.collect()) == [(0, 1, 10, 10), (0, 2, 6, 2), (1, 1, 3, 3)]


def test_inserts_and_deletes(spark):
    table = seqs_of(spark, ("aaaaacccccgggggttttt", "linear"))
    feats = spark.createDataFrame([(0, 1, 1, 4), (0, 2, 6, 10), (0, 3, 11, 15), (0, 4, 9, 12)], "seq_id long, feature_id long, start int, end int")
    new, moved = edits.apply_inserts(table, feats, spark.createDataFrame([(0, 6, "tt"), (0, 21, "g")], "seq_id long, pos int, ins string"))
    assert new.first()["seq"] == "aaaaattcccccgggggtttttg"
    assert sorted(tuple(r)[1:] for r in moved.collect()) == [(1, 1, 4), (2, 8, 12), (3, 13, 17), (4, 11, 14)]
    new, moved = edits.apply_deletes(table, feats, spark.createDataFrame([(0, 6, 10)], "seq_id long, pos int, end int"))
    assert new.first()["seq"] == "aaaaagggggttttt"
    assert sorted(tuple(r)[1:] for r in moved.collect()) == [(1, 1, 4), (3, 6, 10), (4, 6, 7)]


def test_merge_keeps_the_old_label(spark):
    schema = "seq_id long, start int, end int, label string"
    old, new = spark.createDataFrame([(0, 1, 5, "old")], schema), spark.createDataFrame([(0, 1, 5, "new"), (0, 1, 6, "other")], schema)
    assert sorted(r["label"] for r in edits.merge_features(old, new).collect()) == ["old", "other"]


def test_two_sites_give_no_amplicon(spark):
    fwd, rev = "acgttgcaacgg", "ggatccaattgg"
    own = spark.createDataFrame([(1, fwd), (2, rev)], "primer_id long, seq string")
    tm = spark.createDataFrame([(1, 50.0), (2, 52.0)], "primer_id long, tm double")
    once, twice = fwd + "t" * 30 + reverse_complement(rev), fwd + "c" * 5 + fwd + "t" * 30 + reverse_complement(rev)
    table = seqs_of(spark, (once, "linear"), (twice, "linear"))
    sites = matching.primer_sites(table, own)
    rows = pcr.amplicons(table, sites, tm).collect()
    assert [(r["seq_id"], r["product"], r["anneal"]) for r in rows] == [(0, once, 45.0)]
    assert {r["seq_id"] for r in pcr.amplicons(table, sites, tm, max_sites=2).collect()} == {0, 1}


def test_overlap_join_equals_plain(spark):
    rng = random.Random(5)
    a = [(i, 1, x, x + rng.choice((0, 1, 50, 40_000, 1 << 21))) for i, x in ((i, rng.randrange(1 << 24)) for i in range(120))]
    b = [(i, 1, x, x + rng.choice((1, 80, 90_000, 1 << 22))) for i, x in ((i, rng.randrange(1 << 24)) for i in range(120))]
    got = intervals.overlap_join(spark.createDataFrame(a, "a long, ref int, beg long, end long"), spark.createDataFrame(b, "b long, ref int, b_beg long, b_end long"), "ref")
    want = sorted((i, j) for i, _, p, q in a for j, _, r, s in b if p < q and p < s and r < q)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want and len(want) > 100


def plain_distance(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y))
    costs = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row = [i]
        for j, d in enumerate(y, 1):
            row.append(min(costs[j - 1] + (c != d), costs[j] + 1, row[j - 1] + 1))
        costs = row
    return costs[-1]


@pytest.mark.parametrize("d", [0, 1, 3])
def test_similarity_join_equals_plain(spark, d):
    rng = random.Random(d)
    texts = ["".join(rng.choice("ac") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    got = {(r["a_id"], r["b_id"]): r["distance"] for r in similarity.similarity_join(table, table, d).collect()}
    want = {(i, j): plain_distance(x, y) for i, x in enumerate(texts) for j, y in enumerate(texts) if x and y and plain_distance(x, y) <= d}
    assert {k: v for k, v in got.items() if texts[k[0]] and texts[k[1]]} == want


def test_alignment_scores(spark):
    import pandas as pd

    pairs = [("acgt", "ttacgttt", 4), ("acgtacgtacgt", "acgtacgttacgt", 12 - 6), ("aaaa", "tttt", -4), ("acgt", "", -5 - 4), ("ggg", "gg", 2 - 6)]
    got = alignment.align_scores(pd.DataFrame({"x": [p[0] for p in pairs], "y": [p[1] for p in pairs]}))
    assert got.tolist() == [p[2] for p in pairs]


def test_cloning_checks(spark):
    vector = "a" * 40 + "c" * 60
    schema = "backbone_id long, seq string, promoter_start int, promoter_end int, terminator_start int, terminator_end int, rbs_start int, rbs_end int, his_start int, his_end int"
    backs = spark.createDataFrame([(1, vector, 1, 10, 80, 90, 12, 18, 51, 68), (2, vector, 1, 10, 80, 90, None, None, None, None), (3, vector, 1, 10, 80, 90, 12, 18, 20, 37)], schema)
    ins = spark.createDataFrame([(1, "atggcgtaa"), (2, "atgtaagcg"), (3, "at")], "insert_id long, insert string")
    pairs = ins.select("insert_id").crossJoin(backs.select("backbone_id"))
    rows = {(r["insert_id"], r["backbone_id"]): r for r in cloning.cloning_screen(ins, backs, pairs).collect()}
    assert set(rows) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert rows[1, 1]["loc"] == 24 and rows[1, 1]["tag_frame"] == "Pass" and rows[2, 1]["tag_frame"] == "Fail" and rows[1, 2]["rbs_dist"] == "NotApplicable"
    assert rows[1, 1]["product_length"] == 106 and rows[2, 1]["product_length"] == 109


def plain_tag_frame(insert, vector, loc, his):
    """The check on the product as a string."""
    insert = insert[:-3] if insert[-3:] in ("taa", "tag", "tga") else insert
    product, tag = vector[: loc - 1] + insert + vector[loc - 1 :], his + len(insert)
    if loc >= tag or (tag - loc) % 3:
        return "Fail"
    stops = any(product[i - 1 : i + 2] in ("taa", "tag", "tga") or i + 2 >= len(product) for i in range(loc, tag, 3))
    return "Fail" if stops else "Pass"


def test_screen_and_summary_equal_plain_products(spark):
    rng = random.Random(12)
    vectors, inserts = [], []
    for i in range(60):
        seq = "".join(rng.choice("acgt") for _ in range(rng.randint(24, 40)))
        rbs = rng.randint(3, 10)
        his = rng.choice([None, rbs + 6 + rng.randint(0, 12), len(seq) - rng.randint(0, 2)])
        vectors.append((i, seq, 1, 2, 30, 33, *rng.choice([(rbs - 2, rbs), (None, None)]), his, None if his is None else his + 5))
    for i in range(40):
        size = rng.choice([3, 3, 6, 7, 9, 12])
        inserts.append((i, rng.choice(["taa", "".join(rng.choice("acgt") for _ in range(size))])))
    schema = "backbone_id long, seq string, promoter_start int, promoter_end int, terminator_start int, terminator_end int, rbs_start int, rbs_end int, his_start int, his_end int"
    backs, ins = spark.createDataFrame(vectors, schema), spark.createDataFrame(inserts, "insert_id long, insert string")
    rows = cloning.cloning_screen(ins, backs, ins.select("insert_id").crossJoin(backs.select("backbone_id"))).collect()
    tags, totals = {v[0]: (v[1], v[8]) for v in vectors}, {}
    for r in rows:
        seq, his = tags[r["backbone_id"]]
        want = "NotApplicable" if his is None else plain_tag_frame(dict(inserts)[r["insert_id"]], seq, r["loc"], his)
        assert r["tag_frame"] == want
        good = "Fail" not in (r["rbs_dist"], r["promoter"], r["terminator"], want)
        for key in ((r["backbone_id"], want), (r["backbone_id"], None), (None, None)):
            n, k = totals.get(key, (0, 0))
            totals[key] = n + 1, k + good
    got = {(r["backbone_id"], r["tag_frame"]): (r["pairs"], r["good"]) for r in cloning.screen_summary(ins, backs).collect()}
    assert got == totals and {r["tag_frame"] for r in rows} == {"Pass", "Fail", "NotApplicable"}


def test_products_are_annotated_again(spark):
    vector = "aaccggtt" * 5
    schema = "backbone_id long, seq string, topology string, promoter_end int, rbs_end int, his_start int"
    backs = spark.createDataFrame([(1, vector, "circular", 3, None, None)], schema)
    ins = spark.createDataFrame([(5, "atgacatca")], "insert_id long, insert string")
    features = spark.createDataFrame([(1, 0, "Promoter", "None", 1, 3, "p"), (1, 1, "Generic", "None", 20, 29, "old")], "backbone_id long, feature_id int, feature_type string, direction string, start int, end int, label string")
    product = vector[:9] + "atgacatca" + vector[9:]
    lib = spark.createDataFrame([(1, "junction", "Generic", product[5:15]), (2, "same range", "Generic", product[28:38])], "lib_id long, name string, feature_type string, seq string")
    seqs, found = cloning.cloning_products(ins, backs, features, spark.createDataFrame([(5, 1), (5, 1)], "insert_id long, backbone_id long"), library=lib)
    assert [r["seq"] for r in seqs.collect()] == [product]
    got = {(r["label"], r["start"], r["end"]): r["feature_id"] for r in found.collect()}
    assert got[("p", 1, 3)] == 0 and got[("old", 29, 38)] == 1 and got[("Cloning insert", 10, 18)] == -1 and ("junction", 6, 15) in got
    assert ("same range", 29, 38) not in got and all(r["insert_id"] == 5 and r["backbone_id"] == 1 for r in found.collect())


def test_cutting_is_linear_in_the_molecule(spark):
    import time

    from pyspark.sql import functions as F

    rows = spark.range(1).select(F.lit(1).alias("seq_id"), F.repeat(F.lit("acgtacgttg"), 800_000).alias("seq"), F.lit("circular").alias("topology"))
    began = time.time()
    chunks = matching.chunk_sequences(rows, 30).agg(F.sum("own").alias("n"), F.sum(F.length("bases")).alias("m")).first()
    assert (chunks["n"], chunks["m"]) == (8_000_000, 8_000_000 + 30 * -(-8_000_000 // matching.CHUNK)) and time.time() - began < 20


@pytest.mark.parametrize("bounds", [(0, 0), (500_000, 1 << 25)])
def test_hits_are_the_same_broadcast_or_not(spark, monkeypatch, bounds):
    monkeypatch.setattr(matching, "BROADCAST_PATTERNS", bounds[0])
    rng = random.Random(3)
    texts = ["".join(rng.choice("ac") for _ in range(n)) for n in (5, 40, 5000)]
    own = ["".join(rng.choice("ac") for _ in range(n)) for n in (2, 3, 4, 7, 9, 12)]
    patterns = spark.createDataFrame(list(enumerate(own)), "pattern_id long, pattern string")
    got = {(r["seq_id"], r["pattern_id"], r["start"]) for r in matching.motif_hits(seqs_of(spark, *[(t, "circular") for t in texts]), patterns).where("strand = 'fwd'").collect()}
    ids = sorted({g[0] for g in got} | {r["seq_id"] for r in seqs_of(spark, *[(t, "circular") for t in texts]).collect()})
    want = {(ids[k], p, i + 1) for k, t in enumerate(texts) for p, x in enumerate(own) if 3 <= len(x) <= len(t) for i in range(len(t)) if (t + t)[i : i + len(x)] == x}
    assert got == want


def test_align_best_equals_full_alignment(spark, monkeypatch):
    rng = random.Random(21)
    monkeypatch.setattr(alignment, "BLOCK_BASES", 40)
    queries = [(i, "".join(rng.choice("acgt") for _ in range(rng.randint(8, 24)))) for i in range(7)]
    targets = [(i, "".join(rng.choice("acgt") for _ in range(rng.randint(0, 60)))) for i in range(60)]

    def plain(x, y):
        low = -(10**9)
        best, down = [0] * (len(y) + 1), [low] * (len(y) + 1)
        for c in x:
            row, across = [low] * (len(y) + 1), low
            for j in range(len(y) + 1):
                down[j] = max(best[j] - 6, down[j] - 1)
                across = max(row[j - 1] - 6, across - 1) if j else low
                row[j] = max(down[j], across, best[j - 1] + (1 if y[j - 1] == c else -1) if j else low)
            best = row
        return max(best)

    got = {}
    tables = [spark.createDataFrame(t, "id long, seq string") for t in (queries, targets)]
    for r in alignment.align_best(*tables).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["target_id"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted((-plain(x, y), t) for t, y in targets if y)[:3] for q, x in queries}


def test_few_cells_are_filled_for_the_best():
    rng = random.Random(4)
    texts = ["".join(rng.choice("acgt") for _ in range(300)) for _ in range(400)]
    queries = []
    for q in range(6):
        own = rng.choice(texts)[50:90]
        queries.append((q, own[:10] + own[11:20] + rng.choice("acgt") + own[21:]))
    found, cells = alignment.best_targets(queries, list(range(len(texts))), texts, 1)
    scores = {q: alignment.align_scores(pd.DataFrame({"x": [x] * len(texts), "y": texts})) for q, x in queries}
    assert found == [(q, int(s.argmax()), int(s.max())) for q, s in scores.items()]
    assert cells < 0.05 * sum(len(x) for _, x in queries) * sum(map(len, texts))


def test_long_targets_are_cut_into_windows(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(alignment, "WINDOW_BASES", 200)
    text = "".join(rng.choice("acgt") for _ in range(3000))
    queries = [(i, text[at : at + 30] + text[at + 32 : at + 60]) for i, at in enumerate((0, 175, 190, 2940))]
    tables = [spark.createDataFrame(t, "id long, seq string") for t in (queries, [(7, text), (8, text[:250]), (9, "")])]
    got = {(r["query_id"], r["target_id"]): r["score"] for r in alignment.align_best(*tables).collect()}
    want = {(q, t): int(alignment.align_scores(pd.DataFrame({"x": [x], "y": [y]}))[0]) for q, x in queries for t, y in ((7, text), (8, text[:250]))}
    assert got == want


def test_fuzzy_hits_across_chunks_and_origin(spark):
    rng = random.Random(31)
    text = "".join(rng.choice("acgt") for _ in range(5000))
    own = [(text[2030:2070], 2031), ((text + text)[4980:5020], 4981), (text[100:140], 101)]
    changed = [(i, "n", "Generic", x[:20] + ("a" if x[20] != "a" else "c") + x[21:]) for i, (x, _) in enumerate(own)]
    lib = spark.createDataFrame(changed, "lib_id long, name string, feature_type string, seq string")
    got = {(r["lib_id"], r["start"], r["mismatches"]) for r in matching.annotate_fuzzy(seqs_of(spark, (text, "circular")), lib).where("strand = 'fwd'").collect()}
    assert got == {(i, at, 1) for i, (_, at) in enumerate(own)}


def test_reads_are_annotated_without_duplicates(spark):
    reads = spark.createDataFrame([(1, "ttt" + "acgtacgtga" + "ggg")], "read_id long, seq string")
    lib = spark.createDataFrame([(1, "x", "Generic", "acgtacgtga"), (2, "y", "Generic", "tttacgtacg")], "lib_id long, name string, feature_type string, seq string")
    known = spark.createDataFrame([(1, 4, 13, "Gene", "Forward", "mine")], "seq_id long, start int, end int, feature_type string, direction string, label string")
    seqs, found = library.annotate_reads(reads, lib, known)
    assert seqs.first()["name"] == "read 1" and sorted((r["label"], r["start"]) for r in found.collect()) == [("mine", 4), ("y", 1)]


def test_trace_scale_and_reads(spark):
    rows = [(1, "ac", [1] * 41 + [99], [2], [3], [50])]
    reads = spark.createDataFrame(rows, "read_id long, seq string, ch1 array<int>, ch2 array<int>, ch3 array<int>, ch4 array<int>")
    assert library.trace_scale(reads).first()["peak"] == 50
    assert tuple(library.reads_to_sequences(reads).first()) == (1, "read 1", "ac", 2, "linear")


def test_empty_sequences_give_nothing(spark):
    table = seqs_of(spark, ("", "circular"), ("", "linear"))
    one = spark.createDataFrame([(1, "acgtacgtac")], "pattern_id long, pattern string")
    assert matching.motif_hits(table, one).collect() == [] and frames.orfs(table).collect() == [] and enzymes.re_sites(table).collect() == []
    assert frames.residue_tracts(table).collect() == [] and primers.design_amplification(table).collect() == []


def test_stretches_side_by_side_score_as_alone(monkeypatch):
    """No gap runs from one stretch into the next, and a short stretch is not filled up to a long one."""
    monkeypatch.setattr(alignment, "CELLS", 300)
    rng = random.Random(31)
    text = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    for _ in range(30):
        query, ys = text(rng.randrange(1, 60)), [""]
        for _ in range(rng.randrange(1, 20)):
            a = rng.randrange(len(query) + 1)
            ys.append(text(rng.randrange(200)) + query[:a] + text(rng.randrange(9)) + query[a:] + text(rng.randrange(30)))
        want = alignment.align_scores(pd.DataFrame({"x": [query] * len(ys), "y": ys}))
        assert alignment.stretch_scores(query, ys).tolist() == want.tolist()
