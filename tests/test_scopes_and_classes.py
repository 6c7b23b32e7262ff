"""Scopes of threads, classes of the cloning screen, candidates by members, and words of pieces."""

import random
import threading

from pyspark.sql import functions as F

from seqspark import session
from seqspark.operators import cloning, enzymes, frames, scan


def test_scopes_of_threads_are_their_own(spark):
    """A table that one thread writes is not in the scope that another has open."""
    inside, done = threading.Event(), threading.Event()
    seen = {}

    def other() -> None:
        with session.scratch(spark) as made:
            inside.set()
            done.wait(60)
            seen["other"] = list(made)

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with session.scratch(spark) as made:
        table = session.materialize(spark.range(3), "x")
        assert made == [table.written_to] and session.is_written(spark, table.written_to)
    assert not session.is_written(spark, table.written_to)
    done.set()
    thread.join()
    assert seen["other"] == []


def test_screen_classes_cover_every_pair(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    rows = [(i, text(120), 5, 15, 90, 100, *((20, 26) if i % 3 else (None, None)), *((60 + i % 4, 77) if i % 4 else (None, None))) for i in range(24)]
    schema = "backbone_id long, seq string, promoter_start int, promoter_end int, terminator_start int, terminator_end int, rbs_start int, rbs_end int, his_start int, his_end int"
    backs = spark.createDataFrame(rows, schema)
    ins = spark.createDataFrame([(i, "atg" + text(rng.choice((3, 6, 7))) + rng.choice(("taa", "gcg"))) for i in range(20)] + [(90, "taa"), (91, "at")], "insert_id long, insert string")
    pairs = ins.select("insert_id", F.lit(0).alias("k")).join(backs.select("backbone_id", F.lit(0).alias("k")), "k")
    screen = cloning.cloning_screen(ins, backs, pairs)
    checks = ["rbs_dist", "promoter", "terminator", "direction", "tag_frame"]
    want = {tuple(r)[:5]: r["n"] for r in screen.groupBy(*checks).agg(F.count("*").alias("n")).collect()}
    classes = cloning.screen_classes(ins, backs)
    assert {tuple(r)[:5]: r["n"] for r in classes.groupBy(*checks).agg(F.sum("pairs").alias("n")).collect()} == want and len(want) > 2
    # a representative does as its class
    rows = {(r["insert_id"], r["backbone_id"]): tuple(r[c] for c in checks) for r in screen.collect()}
    assert all(rows[r["insert_id"], r["backbone_id"]] == tuple(r[c] for c in checks) for r in classes.collect())


def test_candidate_members_count_their_partners(spark):
    schema = "seq_id long, enzyme_id int, enzyme string, site_start int, match_count int"
    known = [tuple(r) for r in enzymes.table(spark, "enzymes").select("enzyme_id", "is_blunt").collect()]
    sharp, blunt = (next(i for i, b in known if b is x) for x in (False, True))
    a = spark.createDataFrame([(1, sharp, "x", 5, 1), (2, sharp, "x", 6, 1), (3, sharp, "x", 7, 2), (4, blunt, "y", 8, 1)], schema)
    b = spark.createDataFrame([(9, sharp, "x", 50, 1), (8, blunt, "y", 51, 1)], schema)
    assert sorted(map(tuple, enzymes.candidate_members(a, b).collect())) == [("insert", 1, sharp, 5, 1), ("insert", 2, sharp, 6, 1), ("vector", 9, sharp, 50, 2)]
    assert [tuple(r) for r in enzymes.candidate_links(a, b).collect()] == [(sharp, "x", 2, 1, 2)]


def test_word_places_equal_plain_search(spark):
    rng = random.Random(4)
    pieces = [(i, "".join(rng.choice("acgtn") for _ in range(rng.randint(0, 40)))) for i in range(50)]
    words = {2: ["ac", "gg"], 3: ["cat"], 5: ["ttttt", "acgta", "nnnnn"]}
    table = spark.createDataFrame([(i, s, max(0, len(s) - 4)) for i, s in pieces], "id long, bases string, own int")
    got = sorted(map(tuple, scan.word_places(table, words, 4).collect()))
    want = sorted((i, p, w, s[p : p + 4]) for i, s in pieces for own in words.values() for w in own if "n" not in w for p in range(max(0, len(s) - 4)) if s.startswith(w, p))
    assert got == want and len(want) > 30


def test_tracts_equal_plain_windows(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(("cag", "caa", "gct")) if rng.random() < 0.9 else rng.choice("acgt") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    table = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "seq_id long, seq string")
    want = set()
    for i, s in enumerate(texts):
        for name, strand in (("Fwd", s), ("Rev", s[::-1].translate(str.maketrans("acgt", "tgca")))):
            for f in range(3):
                codons = [strand[k : k + 3] for k in range(f, len(strand) - 2, 3)]
                sums = [sum(c in ("cag", "caa") for c in codons[k : k + 9]) for k in range(len(codons) - 8)]
                if any(x > 4.5 for x in sums):
                    want.add((i, f"{name}{f}", sum(x > 4.5 for x in sums), max(sums)))
    assert {tuple(r) for r in frames.residue_tracts(table, "Q", 9, 0.5).collect()} == want and want


def test_all_inserts_meet_all_vectors(spark):
    """Sent to every task or in blocks, and without a list of pairs, as with the list of all pairs."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    backs = spark.createDataFrame([(i, text(80), "circular", 5, 15, 60, 70) for i in range(9)], "backbone_id long, seq string, topology string, promoter_start int, promoter_end int, terminator_start int, terminator_end int")
    backs = backs.selectExpr("*", *[f"cast(null as int) {c}" for c in ("rbs_start", "rbs_end", "his_start", "his_end")])
    ins = spark.createDataFrame([(100 * i, text(12)) for i in range(7)], "insert_id long, insert string")
    pairs = ins.select("insert_id").crossJoin(backs.select("backbone_id"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(cloning.cloning_screen(ins, backs)) == rows(cloning.cloning_screen(ins, backs, pairs))
    feats = cloning.features_from_backbones(backs).withColumn("direction", F.lit("None")).withColumn("label", F.lit("x"))
    for got, want in zip(cloning.cloning_products(ins, backs, feats), cloning.cloning_products(ins, backs, feats, pairs)):
        assert rows(got) == rows(want)
    for most in (1, 100, 1 << 20):
        assert rows(cloning.meet(ins, backs.select("backbone_id"), most=most).select("insert_id", "backbone_id")) == rows(pairs)
    assert rows(cloning.meet(ins.where("false"), backs.select("backbone_id"))) == []
