"""The manifest, spelling variants and quality scores against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seqspark.llm import merkle, oracles, quality, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("leaf", "node", "place", "total", "block", "path", "word", "n", "gram", "form", "score", "quality", "draw")


def with_extra(df):
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(EXTRA)])


# the manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, at, node):
    """The siblings from a leaf up, and the root with the leaf replaced."""
    proof = ""
    for level in levels[:-1]:
        start = at - at % 3
        run = list(level[start : start + 3])
        proof += "".join(x for i, x in enumerate(run) if start + i != at)
        run[at - start] = node
        node, at = h(run), at // 3
    return proof, node


def plain_manifest(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h([field(x) for x in (doc_id, source, lang, n_chars, text)])
        tampered = leaf
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            tampered = h([field(x) for x in (doc_id, source, lang, n_chars, text.replace("\n", ""))])
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, tampered, doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s])]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (*_, leaf, tampered, doc_id) in enumerate(sorted(groups[s])):
            low, node = climb(trees[s], i, tampered)
            high, folded = climb(top, k, node)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h([low + high]), folded, folded == top[-1][0]))
    return out


def by_text(rows):
    return sorted(rows, key=str)


def manifest_rows(n):
    draw = random.Random(n)
    rows = [(draw.choice([None, draw.randrange(n)]), draw.choice([None, "", "a\nb\n", "é\n" * 9, "no break"]), draw.choice([None, "en"]), draw.choice([None, "", "s", "t", "é", "hot", "hot", "hot"]), draw.choice([None, 3])) for _ in range(n)]
    return rows + rows[:5] + [(n + 1, "one\ntext", None, "lone", 1), (n + 2, "x\n" * 200_000, "en", "hot", None)]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_plain_tree(spark, height):
    rows = manifest_rows(120)
    found = merkle.merkle_manifest(with_extra(spark.createDataFrame(rows, SCHEMA)), height).collect()
    assert by_text(map(tuple, found)) == by_text(plain_manifest(rows))
    assert 0 < sum(r.verified for r in found) < len(rows)


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(7, "a\nb", None, None, None)]
    (found,) = merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert tuple(found) == plain_manifest(rows)[0] and found.leaf == found.subroot == found.root and found.proof_sha256 == h([])
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_versions_copy_ancestors_only():
    tree = merkle.Tree([h([str(i)]) for i in range(20)], None)
    before = [list(level) for level in tree.levels]
    copied = tree.version(13, h(["new"]))
    assert tree.levels == before and len(copied) == len(tree.levels)
    leaves = list(before[0])
    leaves[13] = h(["new"])
    assert copied == [level[13 // 3**k] for k, level in enumerate(merkle.Tree(leaves, None).levels)]


# spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def plain_variants(rows, params):
    counts = Counter()
    for doc_id, text in rows:
        for run in spelling.RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            x = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and x % params.typos == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= params.least_chars and n >= params.least_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    forms = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= params.ratio * words[w]:
            forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), words.get(forms.get(w))))
    return sorted(out)


def variant_rows():
    draw = random.Random(5)
    stems = ["".join(draw.choices("abcçé", k=draw.randint(6, 11))) for _ in range(25)] + ["aaaaaaaa", "abababab", "interaaaa", "interaaab"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(20):
            w = stems[min(int(draw.expovariate(0.15)), len(stems) - 1)]
            for _ in range(draw.choice([0, 0, 0, 1, 2])):
                k = draw.randrange(len(w))
                w = w[:k] + draw.choice(["", w[k] + draw.choice("abcé"), draw.choice("abcé")]) + w[k + 1 :]
            words.append(draw.choice([str, str.upper, str.title])(w))
        rows.append((draw.choice([i, i, None]), draw.choice([" ", "-", "4"]).join(words)))
    return rows + [(1, None), (2, ""), (3, "x" * 200_000)] * 5


@pytest.mark.parametrize("params", [spelling.SpellingParams(), spelling.SpellingParams(rare=1), spelling.SpellingParams(rare=2, dictionary=40, typos=7), spelling.SpellingParams(rare=0, longest=3)])
def test_variants_equal_all_pairs(spark, params):
    rows = variant_rows()
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((tuple(r) for r in spelling.spelling_variants(docs, params).collect()), key=lambda r: r[0])
    assert found == plain_variants(rows, params)
    assert sum(r[4] for r in found) > 50 and any(r[1] for r in found)


def test_variants_of_no_text(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []


def test_roots_follow_forms_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("v", "w3")]
    found = dict(map(tuple, spelling._roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert found == {w: "w11" for w, _ in chain}


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=6, max_size=12), st.integers(0, 11), st.sampled_from("abcd"), st.integers(0, 2), st.sets(st.text("^abc$", min_size=2, max_size=7), max_size=60), st.integers(2, 8))
def test_near_words_share_what_the_bounds_say(word, at, letter, kind, grams, longest):
    at %= len(word)
    other = word[:at] + ("", letter, letter + word[at])[kind] + word[at + 1 :]
    if len(other) < 6 or not one_edit(word, other):
        return
    c = min(len(word), len(other))
    # a gram is frequent only if its beginnings are
    frequent = {g[:k]: 100 - k for g in grams for k in range(2, len(g) + 1)}
    a, size_a, need_a = spelling.index_entries(word, c, frequent, longest)
    b, size_b, need_b = spelling.index_entries(other, c, frequent, longest)
    need = max(need_a, need_b)
    met = [(rank, y[1]) for gram, place, rank in a for g, p, y in [(g, p, (p, r)) for g, p, r in b] if g == gram and (place < 0 or p < 0 or abs(place - p) <= 1)]
    assert any(min(size_a - i, size_b - j) >= need for i, j in met)


# quality


def quality_docs(n):
    draw = random.Random(3)
    words = ["".join(draw.choices("aeinorst", k=draw.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        good = i % 4 > 0
        text = draw.choices(words, k=draw.randint(5, 60))
        if not good:
            text = [w + draw.choice(["$$$", "%%%"]) for w in text] if i % 8 else [w for w in text[:9] for _ in range(5)]
        rows.append((i, " ".join(text), int(good)))
    return rows


def test_quality_of_held_out_rows(spark):
    rows = quality_docs(800)
    params = quality.QualityParams(documents=300, bits=14)
    docs = with_extra(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(0, 1), (None, 1), (5, None)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.quality_scores(docs, labels, params=params).collect()}
    truth = {i: q for i, _, q in rows}
    out = [r for i, r in found.items() if r.held_out]
    assert {i for i, r in found.items() if r.held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    # labels of the held-out fold change nothing
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.quality_scores(docs, turned, params=params).collect()} == {i: r.score for i, r in found.items()}


def test_numbers_of_features_equal_averaged_vectors(spark):
    params = quality.QualityParams(bits=12, epochs=2)
    model = quality.learn([(t, q) for _, t, q in quality_docs(60)], params)
    texts = [t for _, t, _ in quality_docs(90)] + ["", " \n", None, "a a a b", "日本語の文。" * 30, "x" * 100_000, "one " * 50_000]
    found = quality.rate(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert [r.text for r in found] == texts
    assert np.allclose([r.score for r in found], [model.probability(t or "") for t in texts], atol=1e-5)
    assert all(r.predicted == (r.score >= 0.3) for r in found)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    params = quality.QualityParams(bits=10)
    assert [r.score for r in quality.quality_scores(docs, none, params=params).collect()] == [0.5] * 3
    assert quality.quality_scores(docs.where("false"), none, params=params).collect() == []
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(docs, one, params=params).collect())


# the SQL twins, on the test tables


@pytest.mark.parametrize("sql, operator", [(oracles.MERKLE, merkle.merkle_manifest), (oracles.SPELLING, spelling.spelling_variants)])
def test_sql_twins(spark, sql, operator):
    path = "/root/testdata/sf0.001/documents.parquet"
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS FROM '{path}'")
        found = con.sql(sql)
        columns, want = found.columns, found.fetchall()
    assert by_text(map(tuple, operator(spark.read.parquet(path)).select(*columns).collect())) == by_text(want)
