"""Ranges put together from pieces, edits and products against plain versions on strings."""

import random

import pytest
from pyspark.sql import functions as F

from seqspark.operators import cloning, edits, pcr, primers, spans


def text(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame([(i, s, "circular" if i % 2 == 0 else "linear") for i, s in enumerate(texts)], "seq_id long, seq string, topology string")


def plain_span(s, start, end):
    return s[start - 1 : end] if end >= start else s[start - 1 :] + s[:end]


@pytest.mark.parametrize("chunk", [7, 64, 4096])
def test_spans_equal_substrings(spark, chunk):
    rng = random.Random(chunk)
    texts = [text(rng, n) for n in (1, 6, 7, 8, 50, 300)] + [""]
    rows = [(i, rng.randint(1, max(1, len(s))), rng.randint(1, max(1, len(s))), rng.choice(["x", None])) for i, s in enumerate(texts[:-1]) for _ in range(30)]
    rows += rows[:20] + rows[:5] + [(99, 1, 2, "no sequence")]
    got = spans.span_bases(table(spark, texts), spark.createDataFrame(rows, "seq_id long, start int, end int, label string"), chunk=chunk).collect()
    want = [(i, a, b, label, plain_span(texts[i], a, b)) for i, a, b, label in rows if i < len(texts)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert spans.span_bases(table(spark, texts), spark.createDataFrame([], "seq_id long, start int, end int")).collect() == []


def test_picked_insert_is_the_longest_first(spark):
    seqs = table(spark, ["acgtacgtacgtacgtacgt"])
    rows = [(0, 5, 3, 8, "CodingRegion", "a"), (0, 2, 3, 8, "Gene", "b"), (0, 1, 18, 2, "Gene", "wraps"), (0, 9, 1, 20, "Promoter", "no insert")]
    found = cloning.pick_inserts(spark.createDataFrame(rows, "seq_id long, feature_id long, start int, end int, feature_type string, label string"), seqs, 4)
    assert [tuple(r) for r in found.collect()] == [(0, 2, "b", "acgtacgtacgt")]


def gone(cuts, upto):
    return sum(max(0, min(b, upto) - a + 1) for a, b in cuts)


def test_deletes_and_inserts_equal_plain_edits(spark):
    rng = random.Random(8)
    texts = [text(rng, 200) for _ in range(6)]
    cuts, ins = {}, {}
    for i in range(5):
        places = sorted(rng.sample(range(1, 201), 2 * i))
        cuts[i] = list(zip(places[::2], places[1::2]))
        ins[i] = {p: text(rng, rng.randint(1, 9)) for p in rng.sample(range(1, 202), 3 * i)}
    cuts[4] = [(1, 3), (4, 4), (9, 200)]
    feats = [(i, k, rng.randint(1, 200), rng.randint(1, 200), "f") for i in range(6) for k in range(25)]
    schema = "seq_id long, feature_id long, start int, end int, label string"
    seqs, features = table(spark, texts), spark.createDataFrame(feats, schema)
    new, moved = edits.apply_deletes(seqs, features, spark.createDataFrame([(i, a, b) for i, own in cuts.items() for a, b in own], "seq_id long, pos int, end int"))
    assert {r.seq_id: r.seq for r in new.collect()} == {i: "".join(c for k, c in enumerate(s, 1) if not any(a <= k <= b for a, b in cuts.get(i, []))) for i, s in enumerate(texts)}
    want = [(i, k, a - gone(cuts.get(i, []), a - 1), b - gone(cuts.get(i, []), b), label, a > b) for i, k, a, b, label in feats]
    assert sorted(map(tuple, moved.collect())) == sorted(x[:5] for x in want if x[5] or x[2] <= x[3])
    new, moved = edits.apply_inserts(seqs, features, spark.createDataFrame([(i, p, x) for i, own in ins.items() for p, x in own.items()], "seq_id long, pos int, ins string"))
    assert {r.seq_id: r.seq for r in new.collect()} == {i: "".join(ins.get(i, {}).get(k, "") + c for k, c in enumerate(s + "-", 1))[:-1] for i, s in enumerate(texts)}
    assert sorted(map(tuple, moved.collect())) == sorted((i, k, *(x + sum(len(v) for p, v in ins.get(i, {}).items() if p <= x) for x in (a, b)), label) for i, k, a, b, label in feats)


@pytest.mark.parametrize("most", [30, 90, 40_000])
def test_products_within_a_length(spark, most):
    rng = random.Random(most)
    texts = [text(rng, 200), text(rng, 200), text(rng, 25)]
    sites = [(i, p, s, a, (a + 5) % len(t) + 1) for i, t in enumerate(texts) for p in range(12) for s, a in [(rng.choice(["fwd", "rev"]), rng.randint(1, len(t) - 5))]]
    tm = spark.createDataFrame([(p, 50.0 + p) for p in range(12)], "primer_id long, tm double")
    got = pcr.amplicons(table(spark, texts), spark.createDataFrame(sites, "seq_id long, primer_id long, strand string, start int, end int"), tm, max_length=most).collect()
    want = set()
    for i, f, s, a, _ in sites:
        for j, r, t, _, b in sites:
            if i == j and f != r and (s, t) == ("fwd", "rev") and (a <= b or i % 2 == 0):
                product = plain_span(texts[i], a, b)
                if len(product) <= most:
                    want.add((i, f, r, a, b, len(product), product))
    assert sorted((r.seq_id, r.fwd_id, r.rev_id, r.start, r.end, r.length, r["product"]) for r in got) == sorted(want)


def test_sites_on_and_off_target_with_totals(spark):
    sites = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 8)], "seq_id long, primer_id long")
    targets = spark.createDataFrame([(7, 1), (7, 1), (9, 1)], "primer_id long, seq_id long")
    got = {(r.primer_id, r.seq_id): (r.sites, r.on_target, r.off_target) for r in primers.site_totals(sites, targets).collect()}
    assert got == {(7, 1): (2, 2, 0), (7, 2): (1, 0, 1), (8, 2): (1, 0, 1), (7, None): (3, 2, 1), (8, None): (1, 0, 1), (None, None): (4, 2, 2)}
