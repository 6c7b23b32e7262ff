"""The pipeline's near-duplicate stage against brute-force Jaccard."""

import itertools
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from seqspark.llm import near_copies

SF = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_survivors(rows):
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * both >= 4 * either:
            root[find(b)] = find(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    rank = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    return sorted((min(g, key=rank) for g in groups.values()), key=rank)


def test_stage_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    for i in range(80):  # a crowd of near copies at 0.3 to 1
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(16)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(i, " ".join(base[:n])) for i, n in enumerate(range(120, 150, 3), 20_000)]
    rows += [(30_000, "A b"), (30_001, "a  B"), (30_002, None), (30_003, ""), (None, "a b"), (None, "lone words here"), (30_000, "other text of the same id")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    rank = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=rank) == plain_survivors(rows)


def test_rows_of_one_id_are_chosen_by_text(spark):
    rows = [(1, "b c d e f g"), (1, "B c d e f g"), (1, "z y x w v u"), (1, "z y x w v u")]
    kept = near_copies.one_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in kept) == ["B c d e f g", "z y x w v u"]


@pytest.mark.parametrize("hot", [4, 512])
def test_keys_dealt_in_groups_change_nothing(spark, hot):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 40])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.one_of_near_copies(docs, near_copies.NearCopyParams(hot=hot)).collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == plain_survivors(rows)


def test_texts_of_one_template(spark):
    """Every shingle outside the slots is crowded, and similarities lie about the threshold."""
    rng = random.Random(2)
    base = [f"t{i}" for i in range(90)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in (10, 40, 70):
            words[at] = f"s{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    began = time.time()
    kept = near_copies.one_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    took = time.time() - began
    want = plain_survivors(rows)
    removed, asked = len(rows) - len(kept), len(rows) - len(want)
    assert removed >= 0.9 * asked and {r["doc_id"] for r in kept} >= {r[0] for r in want}
    assert took < 60


def test_signatures_tell_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8, 0.95):
        same = []
        for _ in range(20):
            a = np.unique(rng.integers(-(1 << 62), 1 << 62, 400))
            k = int(len(a) * 2 * share / (1 + share))
            b = np.concatenate((a[:k], rng.integers(-(1 << 62), 1 << 62, len(a) - k)))
            same.append(np.mean(near_copies.signature(a) == near_copies.signature(np.unique(b))))
        assert abs(np.mean(same) - share) < 0.03


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (5, 900), (130, 128), (700, 650), (3000, 2900)):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate((a[: rng.integers(0, n + 1)], rng.integers(-(1 << 62), 1 << 62, m))))
        most, total = near_copies.most_shared(near_copies.sketch(a), near_copies.sketch(b))
        assert total == len(a) + len(b) and len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
    assert near_copies.sketch(np.arange(0, 64 * 600, 64)) is None or len(near_copies.sketch(np.arange(0, 64 * 600, 64))) > 64
    assert near_copies.sketch(np.arange(0, 1 << 20, 1 << 10)) is None


@pytest.mark.parametrize("hot", [32, 512])
def test_no_link_of_a_crowd_is_left_out(spark, hot):
    """Rounds of one partner a text, and turns of a crowd, leave links between components, which are all settled after."""
    rng = random.Random(2)
    base = [f"t{i}" for i in range(90)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in (10, 40, 70):
            words[at] = f"s{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    params = near_copies.NearCopyParams(hot=hot, rounds=1, turns=1)
    kept = near_copies.one_of_near_copies(docs, params).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == plain_survivors(rows)
