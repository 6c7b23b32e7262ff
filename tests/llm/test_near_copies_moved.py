"""What the near-duplicate stage moves: texts that no pair names stay in their task, tried partners come with the text."""

import numpy as np

from seqspark.llm import near_copies


def test_only_named_texts_leave_their_task(spark):
    rng = np.random.default_rng(5)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 4000).tolist()
    texts = spark.createDataFrame([(h, str(h)) for h in hashes], "h long, normal string")
    named = spark.createDataFrame([(h,) for h in hashes[:200]], "h long")
    left = near_copies.named_texts(texts, named)
    found = {r["h"] for r in left.collect()}
    assert found >= set(hashes[:200]) and len(found) < 200 + 3800 / 10
    assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
    assert near_copies.named_texts(texts, named.where("false")).count() == 0


def test_a_text_meets_the_most_alike_that_it_was_not_tried_with():
    own = np.arange(128, dtype=np.uint8)
    marks = [own.copy() for _ in range(3)]
    for m, changed in zip(marks, (20, 24, 28)):
        m[:changed] += 100
    params, group = near_copies.NearCopyParams(sure=129), near_copies._Standing()
    for h, (m, tried) in enumerate(zip(marks, ([], [7], [])), 1):
        group.meet(h, h, m.tobytes(), tried, params)
    assert group.meet(8, 8, own.tobytes(), [], params) == (1, 108)
    assert group.meet(9, 9, own.tobytes(), [8, 1], params) == (2, 104)
    assert group.meet(7, 7, own.tobytes(), [1, 8, 9], params) == (3, 100)
    assert group.meet(6, 6, own.tobytes(), [1, 2, 3, 7, 8, 9], params) is None


def test_rows_that_stay_are_not_shuffled(spark):
    """With many rows to remove, the texts of few others go through the join that removes them."""
    rows = [(i, f"w{i % 3000} and some more words of text {i % 3000} here") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        gone = spark.createDataFrame([(i,) for i in range(3000, 6000)], "id long")
        marked = near_copies.beside_named(docs, near_copies.F.xxhash64("doc_id"), gone, near_copies.F.xxhash64("id"), "hit")
        assert "SortMergeJoin" not in marked._jdf.queryExecution().executedPlan().toString()
        found = {r["doc_id"] for r in marked.where("hit").collect()}
        assert found >= set(range(3000, 6000)) and len(found) < 3300 and marked.count() == 6000
        kept = near_copies.one_of_near_copies(docs, near_copies.NearCopyParams(rounds=0)).collect()
        assert sorted(r["doc_id"] for r in kept) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
