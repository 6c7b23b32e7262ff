"""Plans that must not grow faster than their input, and the rules that their faster forms must keep."""

import random

import duckdb

from seqspark.operators import edits, enzymes, frames, primers
from seqspark.plans.registry import ORACLE, QUERIES


def plain_orfs(seq, n_frames=3):
    """Frames of both strands, codon by codon."""
    out = []
    n = len(seq)
    for name, s in (("Fwd", seq), ("Rev", seq[::-1].translate(str.maketrans("acgt", "tgca")))):
        for frame in range(n_frames):
            start = None
            for i in range(frame, n - 2, 3):
                codon = s[i : i + 3]
                if codon == "atg" and start is None:
                    start = i + 1
                elif codon in ("taa", "tag", "tga"):
                    if start is not None:
                        a, z = start, i + 3
                        out.append((f"{name}{frame}", a, z) if name == "Fwd" else (f"{name}{frame}", n - z + 1, n - a + 1))
                    start = None
    return out


def test_frames_go_on_over_pieces_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(frames, "TOGETHER", 2)
    rng = random.Random(5)
    seqs = ["".join(rng.choice("acgt") for _ in range(n)) for n in (0, 2, 3, 700, 1535, 1536, 1537, 1538, 1539, 4000, 9000)]
    seqs += ["atg" + "gcc" * 3000 + "taa", "tta" + "ggc" * 3000 + "cat", "atg" + "gcc" * 1000, "gcc" * 1000 + "taa"]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, seq string").coalesce(1)
    found = frames.orfs(table)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().toString()
    want = sorted((i, *row) for i, s in enumerate(seqs) for row in plain_orfs(s))
    assert sorted(map(tuple, found.collect())) == want


def test_designs_are_tuned_in_the_row(spark):
    """No candidate is joined or written: one shuffle for distinct designs, one for the best trims, one or two to join."""
    rng = random.Random(6)
    seqs = [(i, "".join(rng.choice("acgt") for _ in range(60)), "linear") for i in range(20)]
    designed = primers.design_amplification(spark.createDataFrame(seqs, "seq_id long, seq string, topology string"))
    tuned = primers.tuned_designs(designed, "seq_id")
    plan = tuned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "parquet" not in plan and "Window" not in plan
    rows = {(r["seq_id"], r["name"]): r for r in tuned.collect()}
    for r in designed.collect():
        cuts = [(t, r["seq"][: 32 - t]) for t in range(22)]
        scored = primers.primer_qc(spark.createDataFrame([(t, s, "only3") for t, s in cuts], "primer_id long, seq string, tune_mode string")).collect() if r["seq_id"] == 3 else []
        if scored:
            best = max(scored, key=lambda q: (q["quality"], -q["primer_id"]))
            own = rows[3, r["name"]]
            assert own["seq"] == cuts[own["trim3"]][1] and abs(own["quality"] - best["quality"]) < 1e-4
    assert len(rows) == 40


def test_query_candidates_form_no_pair_without_an_enzyme(spark):
    rows = [(1, 1, 10, 1), (1, 2, 20, 1), (3, 1, 30, 1), (3, 2, 40, 2), (5, 3, 50, 1)]
    sites = lambda rows: spark.createDataFrame([(s, e, f"e{e}", p, p, k) for s, e, p, k in rows], "seq_id long, enzyme_id int, enzyme string, site_start int, cut_pos int, match_count long")
    own, theirs = sites(rows), sites([(100, 1, 7, 1), (200, 1, 8, 1), (200, 2, 9, 1), (300, 3, 9, 2)])
    pairs = spark.createDataFrame([(a, b) for a in (1, 3, 5) for b in (100, 200, 300)], "insert_id long, vector_id long")
    found = enzymes.query_candidates(own, theirs)
    want = enzymes.re_candidates(own, theirs, pairs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_re_candidates_list_every_linear_sequence_with_every_vector(spark, tmp_path):
    """Each pair is a row, and no vector is left out for its id."""
    filler, site = "acc" * 250, "gaattc"
    texts = [(i, (filler[:300] + site + filler[300:]) if i < 8 else filler, "x") for i in range(11)] + [(12, site + filler[:90], "x"), (13, site + filler + site, "x")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["b13_re_candidates"](spark, str(tmp_path))
    eco = enzymes.table(spark, "enzymes").where("enzyme = 'EcoRI'").first()["enzyme_id"]
    rows = sorted(tuple(r) for r in found.collect() if r["enzyme_id"] == eco)
    assert rows == [(i, v, eco, 301, 301) for i in (1, 3, 5, 7) for v in (0, 2, 4, 6)]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(ORACLE["b13_re_candidates"])
        assert [c[0] for c in want.description] == found.columns
        assert sorted(want.fetchall()) == sorted(map(tuple, found.collect()))


def test_edits_are_cut_from_the_row(spark):
    """Parts come to the sequence; it is not cut into pieces that are shuffled and put together again."""
    seqs = spark.createDataFrame([(1, "acgtacgt", "linear"), (2, "ggcc", "linear"), (3, None, "linear")], "seq_id long, seq string, topology string")
    feats = spark.createDataFrame([], "seq_id long, feature_id long, start int, end int")
    ins = spark.createDataFrame([(1, 1, "tt"), (1, 5, "g"), (1, 9, "c")], "seq_id long, pos int, ins string")
    new = edits.apply_inserts(seqs, feats, ins)[0]
    assert "Generate" not in new._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["seq_id"], r["seq"]) for r in new.collect()) == [(1, "ttacgtgacgtc"), (2, "ggcc"), (3, None)]
    gone = spark.createDataFrame([(1, 1, 2), (1, 7, 8), (2, 1, 4)], "seq_id long, pos int, end int")
    assert sorted((r["seq_id"], r["seq"]) for r in edits.apply_deletes(seqs, feats, gone)[0].collect()) == [(1, "gtac"), (2, ""), (3, None)]
