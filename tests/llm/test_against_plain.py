"""Operators against plain versions, libraries and held-out labels on the smallest tables."""

import base64
import datetime
import hashlib
import itertools
import math
import random
import time
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

import public_tokenizers
from tests.llm.test_near_copies import plain_survivors
from seqspark.llm import bpe, decontaminate, digest, graph, language, lattice_lm, pseudonyms, queries, simhash, token_count, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


ODD = ["a", "aa", "the", "ing", " ", "  ", "\n", "é", "Σ", "ß", "İ", "'s", "1", "<|endoftext|>", "<|", "日", "😀", "́", ".", "!!", "\x1c", "\xa0", "\r", "\t"]


def odd_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(n)] + ["a" * 3000, "".join(rng.choice("abcdefgh") for _ in range(3000))]


def test_token_counts_equal_the_library(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    count = token_count.counter(path).count
    for text in odd_texts(3000):
        assert count(text) == len(plain.encode(text, add_special_tokens=False).ids), text
    for doc_id, r in rows_of(spark, "op1_token_counts").items():
        n = len(plain.encode(texts[doc_id], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[doc_id].encode()), n, n > 2048)


def test_whole_tokens_are_proven(texts):
    counter = token_count.counter(public_tokenizers.path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(counter.whole) > 30_000
    for word in random.Random(1).sample(sorted(counter.whole), 500):
        assert len(plain.encode(word, add_special_tokens=False).ids) == 1


def test_bpe_equals_the_library(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, machine = Tokenizer.from_file(path), bpe.automaton(path)
    for text in odd_texts(3000):
        ids = plain.encode(text, add_special_tokens=False).ids
        assert list(memoryview(machine.encode(text)).cast("I")) == ids, text
        assert machine.decode(machine.encode(text)) == plain.decode(ids, skip_special_tokens=False)
    for doc_id, r in rows_of(spark, "op2_bpe_round_trip").items():
        ids = plain.encode(texts[doc_id], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[doc_id].encode()).hexdigest()


def semi_global(pattern, text):
    """The plain edit distance of a pattern to its best place in a text."""
    costs = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(costs[j - 1] + (c != d), costs[j] + 1, row[j - 1] + 1))
        costs = row
    return min(costs)


def test_banded_distance_equals_plain():
    rng = random.Random(3)
    for _ in range(600):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        limit = rng.randint(0, 5)
        codes = [decontaminate.code_points(x) for x in (pattern, text)]
        best, plain = decontaminate.banded_distance(*codes, -len(pattern), len(text) + 1, limit), semi_global(pattern, text)
        assert (best is None) == (plain > limit)
        if best:
            assert best[0] == plain and semi_global(pattern, text[best[1] : best[2]]) == plain
            low = best[1] - rng.randint(0, 2)  # a path starts on a diagonal of the band and stays near it
            near = decontaminate.banded_distance(*codes, low - plain, low + plain + 2, limit)
            assert near is not None and near[0] == plain


def test_band_is_narrow():
    """An alignment of a long passage touches 2k + 1 diagonals a row and not the text."""
    rng = np.random.default_rng(1)
    pattern = rng.integers(97, 123, 4000).astype(np.uint32)
    index = decontaminate.PassageIndex([(0, pattern.tobytes().decode("utf-32-le"))], decontaminate.LeakParams())
    changed = pattern.copy()
    changed[rng.choice(4000, 160, replace=False)] = 35
    text = np.concatenate((rng.integers(97, 123, 5000), np.delete(changed, 7), rng.integers(97, 123, 5000))).astype(np.uint32)
    k = index.edits[0]
    regions = decontaminate._regions(index, text, np.arange(len(text)), np.array([len(text) + 1]))
    assert k == 160 and all(high - low + 1 <= 4 * k + 1 for _, _, low, high, _ in regions)


def test_every_passage_length_equals_plain_search():
    """Passages of 1 to 60 characters, planted with as many edits as the budget allows and one more."""
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz"
    params = decontaminate.LeakParams(edit_rate=0.08)
    passages = [(m, "".join(rng.choice(letters) for _ in range(m))) for m in range(1, 61)]
    index = decontaminate.PassageIndex(passages, params)
    assert index.ids == list(range(1, 61)) and index.edits == [int(0.08 * m) for m in range(1, 61)]
    hits = 0
    for (m, passage), k in zip(passages, index.edits):
        for edits in (0, k, k + 1):
            own = list(passage)
            for at in rng.sample(range(m), min(m, edits)):
                own[at] = rng.choice(("", "é", "xy"))
            text = "".join(rng.choice(letters) for _ in range(80)) + "".join(own) + "".join(rng.choice(letters) for _ in range(80))
            one = decontaminate.PassageIndex([(m, passage)], params)
            best = min((r[4] for r in decontaminate._search(one, [0], [text])), default=None)
            plain = semi_global(passage, text)
            assert best == (plain if plain <= k else None), (passage, text)
            hits += best is not None
    assert hits > 80


def test_leaks_equal_plain_search_with_edits(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnop "
    items = ["".join(rng.choice(letters) for _ in range(n)).strip() for n in (9, 30, 60, 120, 200, 250)] + ["日本語の長い文章がここにあり、それは何度も繰り返される。"]
    docs = []
    for i in range(70):
        own = "".join(rng.choice(letters) for _ in range(300))
        passage = list(items[i % 7])
        for _ in range(i // 7):
            at = rng.randrange(len(passage))
            passage[at : at + rng.choice((0, 1))] = rng.choice(["x", "y", "é", ""])
        docs.append((i, own[:150] + ". " + "".join(passage).upper() + "!\n" + own[150:]))
    plain_form = lambda t: "".join(map(chr, decontaminate.normal_form(decontaminate.code_points(t))[0]))
    index = decontaminate.PassageIndex(list(enumerate(items)), decontaminate.LeakParams())
    limits = dict(zip(index.ids, index.edits))
    want = {}
    for doc_id, text in docs:
        for item, own in enumerate(items):
            distance = semi_global(plain_form(own).strip(), plain_form(text))
            if distance <= limits[item]:
                want[doc_id, item] = distance
    table, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for params in (decontaminate.LeakParams(), decontaminate.LeakParams(block_bytes=300)):  # one block and several
        got: dict = {}
        for r in decontaminate.find_leaks(table, benchmark, params).collect():
            key = r["doc_id"], r["item_id"]
            got[key] = min(got.get(key, 99), r["distance"])
            own = plain_form(dict(docs)[r["doc_id"]][r["start"] : r["end"]])
            assert semi_global(plain_form(items[r["item_id"]]).strip(), own) == r["distance"]
        assert got == want and len(want) > 20
        kept = decontaminate.without_leaks(table, benchmark, params)
        assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_long_words_equal_short_ones(monkeypatch):
    rng = random.Random(3)
    pieces = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    lattice = lattice_lm.Lattice(pieces)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(20, 40))) for _ in range(30)]
    counts = np.array([rng.randint(1, 5) for _ in words], float)
    scores, uses = lattice.log_probs(words), lattice.expected(words, counts)
    monkeypatch.setattr(lattice_lm, "TOGETHER", 5)
    assert np.allclose(lattice.log_probs(words), scores) and np.allclose(lattice.expected(words, counts), uses)


def test_a_word_of_a_megabyte():
    began = time.time()
    lattice = lattice_lm.Lattice(["a", "aa", "aaa", "ab", "▁a"])
    for word in ("a" * 1_000_000, "ab日" * 333_333):
        assert np.isfinite(lattice.log_probs([word])).all()
    assert time.time() - began < 30


def test_repetitive_texts_and_passages():
    rng = random.Random(12)
    params = decontaminate.LeakParams(edit_rate=0.05)
    items = ["a" * 60, "ab" * 40, "abc" * 20 + "x" + "abc" * 20, "q" * 5, "on", "a" * 40 + " " + "b" * 40]
    index = decontaminate.PassageIndex(list(enumerate(items)), params)
    assert index.repetitive.sum() == 4
    found = 0
    for _ in range(25):
        texts = []
        for _ in range(4):
            own = list(rng.choice(items))
            for at in rng.sample(range(len(own)), rng.randint(0, min(4, len(own)))):
                own[at] = rng.choice(("", "z", own[at] * 2))
            texts.append("".join(rng.choice("uvw! ") for _ in range(rng.randint(0, 40))) + "".join(own) + rng.choice(("", "aaaa", " yy? ")))
        rows = decontaminate._search(index, list(range(4)), texts)
        got: dict = {}
        for doc, item, start, end, edits, _ in rows:
            got[doc, item] = min(got.get((doc, item), 99), edits)
        form = lambda t: "".join(map(chr, decontaminate.normal_form(decontaminate.code_points(t))[0]))
        want = {(d, i): n for d, t in enumerate(texts) for i, x in enumerate(items) if (n := semi_global(x, form(t))) <= index.edits[i]}
        assert got == want
        found += len(want)
    assert found > 40


def test_a_megabyte_of_one_letter():
    began = time.time()
    index = decontaminate.PassageIndex(list(enumerate(["a" * 100, "a" * 50 + "b" + "a" * 60, "a"])), decontaminate.LeakParams())
    rows = decontaminate._search(index, [0, 1], ["a" * 1_000_000, "b" + "a" * 70_000])
    assert {(r[0], r[1], r[4]) for r in rows} == {(0, 0, 0), (0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 1, 1), (1, 2, 0)}
    assert time.time() - began < 30


def test_language_is_right_on_held_out(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.QUERIES["op4_language"](spark, "/root/testdata/sf0.01").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.98
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.01


def test_languages_equal_plain_compression(spark, texts):
    """Each text against one compressor for each dictionary, without blocks shared between texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = language.learn_dictionaries(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"))
    again = language.learn_dictionaries(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1").repartition(7))
    assert dictionaries == again and set(dictionaries) == {"de", "en", "es", "fr"}
    for doc_id, r in rows_of(spark, "op4_language").items():
        words = [w for w in re.findall(r"[^\W\d_]+", texts[doc_id].lower())]
        if not words:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        letters, sizes = " ".join(words), {}
        for lang, content in dictionaries.items():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            search = zstandard.ZstdCompressionParameters(**language.SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            one = zstandard.ZstdCompressor(compression_params=search, dict_data=data)
            sizes[lang] = sum(len(one.compress(letters[i : i + 512].encode() + language.FILLER)) for i in range(0, len(letters), 512))
        first, second = sorted(sizes, key=lambda x: (sizes[x], x))[:2]
        assert r["lang_pred"] == first and r["rejected"] == (sizes[second] - sizes[first] < 0.02 * sizes[first])


def test_ties_of_two_languages_are_rejected():
    one, two = (b"oring retion thander " * 40 for _ in range(2))
    classify = language.Classifier({"a": one, "b": two, "c": b"xylo quz jav " * 40}, language.LanguageParams())
    for text in ("oring retion", "oring retion thander " * 200):
        lang, score, rejected = classify(text)
        assert lang == "a" and rejected and 0.4 < score <= 0.5
    other = language.Classifier({"a": one, "c": b"xylo quz jav " * 40}, language.LanguageParams())
    assert [other("thander oring retion")[i] for i in (0, 2)] == ["a", False]


def plain_levels(data):
    out = []
    for i in range(len(data) - digest.WINDOW + 1):
        total = sum(int(digest.GAINS[:c].sum()) for c in Counter(data[i : i + digest.WINDOW]).values())
        most = np.log2(digest.WINDOW)
        out.append(min(digest.LEVELS - 1, int((most - total / (digest.WINDOW * float(1 << 20))) * (digest.LEVELS / most))))
    return out


def test_entropy_levels_equal_plain(texts):
    data = texts[3].encode()[:700]
    assert digest.entropy_levels(np.frombuffer(data, np.uint8)).tolist() == plain_levels(data)


def plain_digest(data, ranks):
    """Bit sets of the filters: windows that are the leftmost rarest in a quarter of 16 runs or more."""
    if not data:
        return []
    if len(data) < 16:
        data += bytes(16 - len(data))
    rank = [int(ranks[x]) for x in plain_levels(data)]
    wins = Counter(min(range(a, a + 16), key=lambda i: (rank[i], i)) for a in range(max(0, len(rank) - 15)))
    chosen = sorted(i for i, n in wins.items() if n >= 4)
    if len(rank) < 16:
        chosen = [min(range(len(rank)), key=lambda i: (rank[i], i))]
    elif not chosen:
        chosen = [max(sorted(wins), key=lambda i: wins[i])]
    filters, mask = [], (1 << 64) - 1
    for k, at in enumerate(chosen):
        h = 0x9E3779B97F4A7C15
        for word in (data[at : at + 8], data[at + 8 : at + 16]):
            h = (h ^ int.from_bytes(word, "little")) * 0xBF58476D1CE4E5B9 & mask
            h ^= h >> 31
        h = h * 0x94D049BB133111EB & mask
        h ^= h >> 29
        if k % 160 == 0:
            filters.append(set())
        filters[-1] |= {(h >> 11 * j) % 2048 for j in range(5)}
    return filters


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for x in a:
        best = 0.0
        for y in b:
            few, many = sorted((len(x), len(y)))
            chance = few * many / 2048
            best = max(best, (len(x & y) - chance) / max(few - chance, 1.0) * math.sqrt(few / many))
        total += min(1.0, best)
    return total / len(a)


def bits_of(shown):
    filters = np.frombuffer(base64.b64decode(shown), "<u8").reshape(-1, 32)
    return [{64 * w + b for w, x in enumerate(row.tolist()) for b in range(64) if x >> b & 1} for row in filters]


@pytest.mark.parametrize("params", [digest.DigestParams(), digest.DigestParams(range_bytes=9_000, run_bytes=2_000)])
def test_digests_equal_plain(spark, texts, params):
    """One range and many, streamed in small runs, on rows with repeated and null ids as well."""
    rows = [(i, t) for i, t in texts.items() if len(t) < 3000][:70] + [(5, "short"), (5, "another short text of this id"), (None, "no id"), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = lambda filters: tuple(tuple(sorted(x)) for x in filters)
    marks = {t: m for t, m in docs.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) m").collect()}
    order = sorted(((digest.LAST if i is None else i, marks[t or ""], t or "") for i, t in rows))
    ranks = digest.entropy_ranks(docs)
    counts = Counter(x for _, t in rows for x in plain_levels((t or "").encode()))
    assert np.argsort(ranks).tolist() == sorted(range(digest.LEVELS), key=lambda x: (counts[x], x))
    want = Counter()
    for (i, _, text), (_, _, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = (plain_digest(x.encode(), ranks) for x in (text, edited, after))
        want[None if i == digest.LAST else i, len(text), hashlib.sha256(edited.encode()).hexdigest(), sets(own), sets(other), round(plain_likeness(own, other), 9), round(plain_likeness(own, following), 9)] += 1
    got = Counter()
    for r in digest.document_digests(docs, params).collect():
        got[r["doc_id"], r["n_chars"], r["edited_sha256"], sets(bits_of(r["fingerprint"])), sets(bits_of(r["edited_fingerprint"])), round(r["near_edited"], 9), round(r["near_next"], 9)] += 1
    assert got == want


def test_digests_follow_the_next_document(spark, texts):
    ids = sorted(texts)
    rows = rows_of(spark, "op5_digests")
    near = []
    for i, doc_id in enumerate(ids):
        text, after, r = texts[doc_id], texts[ids[(i + 1) % len(ids)]], rows[doc_id]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        near.append(r["near_edited"] > r["near_next"])
    assert sum(near) / len(near) > 0.95  # texts of a few words have one feature or none in common
    prints = defaultdict(set)
    for doc_id in ids:
        prints[texts[doc_id]].add(rows[doc_id]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    ids, root = sorted(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("crowd", [64, 1])
def test_near_duplicate_groups_equal_plain(spark, texts, crowd):
    words = texts[3].split()
    more = {10_000 + i: " ".join(words[:i] + ["zz"] + words[i:]) for i in range(0, 40)}
    every = dict(list(texts.items())[:120]) | more
    prints = {i: plain_fingerprint(t) for i, t in every.items()}
    want = plain_groups(prints)
    got = simhash.near_duplicate_groups(spark.createDataFrame(list(every.items()), "doc_id long, text string"), crowd=crowd).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in every}
    assert len(set(want.values())) < len(every)


def test_golay_keys_lose_no_pair():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    pairs = [(p, p ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b) if b != a else np.uint64(0))) for p in prints for a, b in [rng.integers(0, 64, 2)]]
    for p, q in pairs:
        row, key, side = simhash.golay_keys(np.array([p, q], np.uint64))
        own = [{(k, s) for r, k, s in zip(row, key, side) if r == i} for i in (0, 1)]
        assert any((k, 1 - s if s < 2 else 2) in own[1] for k, s in own[0])


def test_components_equal_plain(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r["vertex"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in root.items() if v in got} and all(a in got and b in got for a, b in edges if a != b)


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    weights = np.log(np.array([0.1, 0.15, 0.15, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]))
    lattice = lattice_lm.Lattice(pieces, weights)

    def plain(text):
        if not text:
            return 1.0
        total = sum(math.exp(weights[i]) * plain(text[len(p) :]) for i, p in enumerate(pieces) if text.startswith(p))
        return total + (math.exp(weights[-2]) / 256) ** len(text[0].encode()) * plain(text[1:])

    words = ["a", "ab", "abba", "éa", "x", "ab" * 30]
    assert np.allclose(lattice.log_probs(words), [math.log(plain("▁" + w)) if len(w) < 20 else lattice.log_probs([w])[0] for w in words])
    # expected counts are the gradient of the log probability
    counts = lattice.expected(words[:4], np.ones(4))
    for i in range(len(pieces)):
        moved = weights.copy()
        moved[i] += 1e-6
        slope = (lattice_lm.Lattice(pieces, moved).log_probs(words[:4]) - lattice.log_probs(words[:4])).sum() / 1e-6
        assert abs(slope - counts[i]) < 1e-3


@pytest.mark.parametrize("head", [1 << 17, 50])
def test_lm_base_scores_equal_plain(spark, texts, head):
    count = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*t.encode().lower().split(), None])
    n, v = sum(count.values()), len(count)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    params = lattice_lm.LmParams(head=head, held=1000, warm_rounds=1)
    rows = lattice_lm.document_scores(docs, public_tokenizers.path("piece_bpe_32k.model"), params=params).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [*texts[r["doc_id"]].encode().lower().split(), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(count[w] > 0 for w in words))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) and r["score"] < 0


def test_lm_scores_sum_over_segmentations_of_whole_documents(spark):
    """The score of a document against the plain sum over all ways to cut it in pieces, words and end."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, t) for i, t in enumerate(["the cat", "a thnd\u00e9 of", "cat", "", "in THE \u65e5 inn", "zq x"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 1")
    marked = docs.selectExpr("text", "crc32(cast(cast(doc_id as string) as binary)) % 5 = 1 as held_out")
    pieces = lattice_lm.pieces_of(path)
    weights = lattice_lm.learn_weights(lattice_lm._word_counts(marked, lattice_lm.LmParams()), train.count(), pieces)
    assert math.isclose(np.exp(weights).sum(), 1)
    weight = {p: math.exp(w) for p, w in zip(pieces, weights)}

    def cut(text):
        """All segmentations of a whole text in which no piece has a blank but at its start."""
        if not text:
            yield 1.0
            return
        end = text.find("\u2581", 1)
        for n in range(1, min(20, end if end > 0 else len(text)) + 1):
            if text[:n] in weight:
                yield from (weight[text[:n]] * rest for rest in cut(text[n:]))
        yield from ((math.exp(weights[-2]) / 256) ** len(text[0].encode()) * rest for rest in cut(text[1:]))

    scored = {r["doc_id"]: r["score"] for r in lattice_lm.document_scores(docs, path).collect()}
    for i, text in rows[:6]:
        whole = "".join("\u2581" + w for w in text.lower().split())
        assert math.isclose(scored[i], math.log10(sum(cut(whole)) * math.exp(weights[-1])), rel_tol=1e-9), text


def test_training_raises_the_likelihood(spark, texts):
    pieces = lattice_lm.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    counts = Counter(w for t in list(texts.values())[:60] for w in t.lower().split())
    counted = spark.createDataFrame([(w, c, c) for w, c in counts.items()], "word string, c long, f long")
    total = []
    for warm, rounds in ((0, 0), (1, 0), (1, 2)):
        weights = lattice_lm.learn_weights(counted, 60, pieces, lattice_lm.LmParams(warm_rounds=warm, rounds=rounds, pseudo=1e-6))
        total.append(float(np.dot(lattice_lm.Lattice(pieces, weights).log_probs(list(counts)), list(counts.values()))) + 60 * weights[-1])
    assert total == sorted(total)


def test_lm_is_a_distribution_over_words(spark):
    """Probabilities of words and the end must not sum to more than one."""
    rows = [(i, w) for i, w in enumerate(["a", "b", "a b", "ab", "c a"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = {r["doc_id"]: r["score"] for r in lattice_lm.document_scores(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    probs = {t: 10 ** scored[i] for i, t in rows}
    assert sum(probs.values()) < 1


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_validate_and_link(spark):
    rng = random.Random(6)
    cards = []
    while len(cards) < 60:
        digits = "4" + "".join(str(rng.randrange(10)) for _ in range(15))
        if luhn(digits):
            cards.append(digits)
    values = {
        "card": (cards, lambda m: re.fullmatch(r"\d{16}", m) and luhn(m)),
        "phone": ([f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(10000):04d}" for _ in range(60)], lambda m: re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", m)),
        "address": ([".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(60)], lambda m: all(int(o) < 256 for o in m.split("."))),
        "date": ([f"19{rng.randrange(10, 99)}-0{rng.randrange(1, 9)}-1{rng.randrange(10)}" for _ in range(60)], lambda m: re.fullmatch(r"\d{4}-\d\d-\d\d", m)),
        "ssn": ([f"{rng.randrange(1, 600):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}" for _ in range(60)], lambda m: m[:3] not in ("000", "666") and m[4:6] != "00" and m[7:] != "0000"),
        "secret": (["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)], lambda m: re.fullmatch("[0-9a-f]{40}", m)),
        "email": ([f"user{i}.x@mail{i % 3}.example.com" for i in range(60)], lambda m: re.fullmatch(r"[a-z]{4}\d+\.[a-z]@mail\d\.example\.com", m)),
    }
    docs = [(k * 100 + i, f"see {v} now, {v}.") for k, (own, _) in enumerate(values.values()) for i, v in enumerate(own)]
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymize(spark.createDataFrame(docs, "doc_id long, text string"), "k").collect()}
    for k, (own, valid) in enumerate(values.values()):
        seen = {}
        for i, v in enumerate(own):
            r = out[k * 100 + i]
            a, b = re.fullmatch(r"see (.*) now, (.*)\.", r["text"]).groups()
            assert a == b and valid(a) and r["n_private"] == 2, (v, r["text"])
            seen[v] = a
        assert len(set(seen.values())) == len(seen) and sum(v == a for v, a in seen.items()) <= 1
    clean = ["4111111111111112 is no card", "version 2.0. of 1.2.3.4.5 and 256.1.1.1", "99/99/1999 000-12-3456", "page 3, 12:30", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "tables 100 200 3000 and 12 34 56", "31/02/2019 and 13/13/2000, 0099-01-01", "+1 23"]
    kept = pseudonyms.pseudonymize(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string"), "k").collect()
    assert [r["text"] for r in sorted(kept, key=lambda r: r["doc_id"])] == clean


def plain_stream(key, kind, step, half):
    return hashlib.sha512(f"{key}|{kind}|{step}|{half}".encode()).digest()


def plain_feistel_text(value, key, kind, hexadecimal=False):
    alphabets = ["0123456789abcdef"] if hexadecimal else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    cut = len(value) // 2
    a, b = value[:cut], value[cut:]
    for step in range(8):
        stream, new = plain_stream(key, kind, step, b), ""
        for i, c in enumerate(a):
            own = next((x for x in alphabets if c in x), None)
            new += own[(own.index(c) + stream[i % 64]) % len(own)] if own else c
        a, b = b, new
    return a + b


def plain_feistel_pair(x, y, a, b, key, kind):
    for step in range(8):
        number = lambda half: int(plain_stream(key, kind, step, half)[:7].hex(), 16)
        if step % 2 == 0:
            x = (x + number(y)) % a
        else:
            y = (y + number(x)) % b
    return x, y


def plain_pseudonym(kind, value, key):
    digits = re.sub(r"\D", "", value)
    if kind == "email":
        name, domain = value.split("@")
        return plain_feistel_text(name, key, "email") + "@" + domain
    if kind == "secret":
        return plain_feistel_text(value, key, "secret", True)
    if kind == "card":
        body = digits[0] + plain_feistel_text(digits[1:-1], key, "card")
        new = next(body + c for c in "0123456789" if luhn(body + c))
    elif kind == "phone":
        code = 0 if value[0] != "+" else 1 if digits[0] in "17" else 2 if re.match("44|33|49", digits) else 3
        own = digits[code:]
        if len(own) == 10 and own[0] > "1" and own[3] > "1":
            x, y = plain_feistel_pair((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200, int(own[6:]), 640_000, 10_000, key, "phone")
            own = f"{x // 800 + 200}{x % 800 + 200}{y:04d}"
        else:
            ten = len(own) == 10
            own = plain_feistel_text(own, key, "phone")
            while ten and own[0] > "1" and own[3] > "1":
                own = plain_feistel_text(own, key, "phone")
        new = digits[:code] + own
    elif kind == "ssn":
        area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
        number = (area - 1 - (area > 666)) * 989_901 + (group - 1) * 9_999 + serial - 1
        x, y = plain_feistel_pair(number // 9_999, number % 9_999, 898 * 99, 9_999, key, "ssn")
        number = x * 9_999 + y
        area = number // 989_901 + 1
        return f"{area + (area >= 666):03d}-{number // 9_999 % 99 + 1:02d}-{number % 9_999 + 1:04d}"
    elif kind == "address":
        sizes = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
        own = [(int(o), *sizes[len(o)]) for o in value.split(".")]
        place = [n - low for n, low, _ in own]
        size = [n for _, _, n in own]
        x, y = plain_feistel_pair(place[0] * size[1] + place[1], place[2] * size[3] + place[3], size[0] * size[1], size[2] * size[3], key + "".join(f"|{len(o)}" for o in value.split(".")), "address")
        return ".".join(str(p + low) for p, (_, low, _) in zip((x // size[1], x % size[1], y // size[3], y % size[3]), own))
    else:
        shape = "%Y-%m-%d" if value[4] == "-" else "%d/%m/%Y"
        try:
            day = datetime.datetime.strptime(value, shape).date()
        except ValueError:
            shape = "%m/%d/%Y"
            day = datetime.datetime.strptime(value, shape).date()
        century = day.year // 100
        start = datetime.date(century * 100, 1, 1)
        a, b = (75, 487) if century % 4 == 0 else (92, 397)
        number = (day - start).days
        while True:
            x, y = plain_feistel_pair(number // b, number % b, a, b, f"{key}|{century}", "date")
            number = x * b + y
            day = start + datetime.timedelta(number)
            if shape != "%m/%d/%Y" or day.day > 12:
                return day.strftime(shape.replace("%Y", f"{day.year:04d}"))
    digit = iter(new)
    return re.sub(r"\d", lambda _: next(digit), value)


def with_check_digit(digits):
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_pseudonyms_equal_a_plain_network(spark):
    rng = random.Random(16)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cards = [with_check_digit("4" + number(14)) for _ in range(4)] + [with_check_digit("37" + number(12)), with_check_digit("6" + number(17))]
    values = [("card", c) for c in cards]
    values += [("card", f"{c[:4]} {c[4:10]} {c[10:]}") for c in cards[4:5]] + [("card", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}") for c in cards[:2]]
    values += [("phone", v) for v in ("+1 (743) 555-3824", "743-555-3824", "743.555.3824", "743 555 3824", "(743) 555-3824", "+44 20 7946 0958", "+49 30 901820", "+33 1 42 68 53 00", "+1 (143) 555-3824", "043-155-3824", "+353 1 679 6111")]
    values += [("date", v) for v in ("2019-12-31", "1850-02-03", "2150-07-09", "31/12/2019", "12/31/2019", "02/29/2020", "05/06/1999", "1999-02-28", "0733-01-01")]
    values += [("ssn", "123-45-6789"), ("ssn", "899-99-9999"), ("address", "10.2.255.100"), ("address", "192.168.1.20"), ("email", "Jane.Doe-7@mail.example.com"), ("secret", "0123456789abcdef" * 2), ("secret", "f0" * 20)]
    rows = [(i, f"see {v} now, {v}.") for i, (_, v) in enumerate(values)]
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, (kind, v) in enumerate(values):
        new = plain_pseudonym(kind, v, "k")
        assert out[i]["text"] == f"see {new} now, {new}." and out[i]["n_private"] == 2, (kind, v)
    by_value = {v: out[i]["text"][4:].split(" now")[0] for i, (_, v) in enumerate(values)}
    plain = re.sub(r"\D", "", by_value["743-555-3824"])
    assert {re.sub(r"\D", "", by_value[v])[-10:] for v in ("+1 (743) 555-3824", "743.555.3824", "743 555 3824", "(743) 555-3824")} == {plain}
    assert re.sub(" ", "", by_value[values[6][1]]) == by_value[cards[4]]


def test_small_feistel_number_is_a_permutation(spark):
    from pyspark.sql import functions as F

    moved = spark.range(0, 600).select(pseudonyms.feistel_number(F.col("id"), 30, 20, F.lit("k"), "t").alias("m")).collect()
    assert sorted(r["m"] for r in moved) == list(range(600))


def plain_chain(emit, move):
    """Log of the sum over all taggings, and the marginals of state 1, by listing all taggings."""
    total, sums = 0.0, np.zeros(len(emit))
    for tags in itertools.product((0, 1), repeat=len(emit)):
        weight = math.exp(sum(e * t for e, t in zip(emit, tags)) + sum(move[a, b] for a, b in zip(tags, tags[1:])))
        total, sums = total + weight, sums + weight * np.array(tags)
    return math.log(total), sums / total


def test_marginals_equal_plain_sums():
    rng = np.random.default_rng(0)
    move, lengths = rng.normal(size=(2, 2)), np.array([6, 0, 1, 9, 4])
    emit = rng.normal(size=20) * 3
    want = np.concatenate([plain_chain(emit[a : a + n], move)[1] for a, n in ((0, 6), (6, 1), (7, 9), (16, 4))])
    assert np.allclose(toxicity.marginals(emit, lengths, move), want)
    assert toxicity.marginals(np.zeros(0), np.array([0]), move).tolist() == []
    # columns do not matter: a long text equals a plain recursion
    emit = rng.normal(size=1000) * 5
    m, gain = np.exp(move), np.exp(emit)
    ahead, behind = [np.array([1.0, gain[0]])], [np.ones(2)]
    for t in range(1, 1000):
        step = ahead[-1] @ m * [1, gain[t]]
        ahead.append(step / step.sum())
        step = m @ (behind[-1] * [1, gain[1000 - t]])
        behind.append(step / step.sum())
    both = np.array(ahead) * np.array(behind[::-1])
    assert np.allclose(toxicity.marginals(emit, np.array([1000]), move), both[:, 1] / both.sum(axis=1))


def test_training_follows_the_likelihood():
    """The likelihood of the tags, by listing all taggings, rises, and words in context are told apart."""
    texts = [["you", "stupid", "man"], ["stupid", "is", "no", "man"], ["a", "man"], ["you", "clown", "is"]] * 5
    tags = [np.array([w in ("stupid", "clown") and t[0] == "you" for w in t]) for t in texts]

    def likelihood(chain):
        emissions, total = toxicity.Emissions(chain), 0.0
        for t, y in zip(texts, tags):
            emit = emissions(t)
            own = float((emit * y).sum()) + sum(chain.move[int(a), int(b)] for a, b in zip(y, y[1:]))
            total += own - plain_chain(emit, chain.move)[0]
        return total

    values = []
    for steps in (1, 5, 60):
        chain = toxicity.Chain(np.zeros(1 << 12, np.float32), prefixes=(4,))
        toxicity._train_chain(chain, texts, tags, toxicity.ToxicParams(steps=steps))
        values.append(likelihood(chain))
    assert values == sorted(values) and values[-1] > -1
    probs = [toxicity.marginals(toxicity.Emissions(chain)(t), np.array([len(t)]), chain.move) for t in texts[:2]]
    assert probs[0][1] > 0.9 and probs[1][0] < 0.1


def test_offsets_are_of_the_original_text(spark):
    chain = toxicity.Chain(np.zeros(1 << 12, np.float32), prefixes=(4,))
    texts = [["you", "stupid", "thing"], ["good", "thing"]] * 10
    toxicity._train_chain(chain, texts, [np.array([w == "stupid" for w in t]) for t in texts], toxicity.ToxicParams())
    rows = [(0, "\u0130\u0130\u0130 you stupid thing"), (1, "good thing " * 9000 + "you STUPID"), (2, None), (3, "--")]
    got = {r["doc_id"]: r["spans"] for r in toxicity.tag(spark.createDataFrame(rows, "doc_id long, text string"), chain).collect()}
    assert [(s["start"], s["end"]) for s in got[0]] == [(8, 14)] and [(s["start"], s["end"]) for s in got[1]] == [(99_004, 99_010)]
    assert got[2] == got[3] == []


def test_candidates_equal_plain_counts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("toxic is not null")
    params, plain = toxicity.ToxicParams(), rows.collect()
    held = [Counter(), Counter()]
    for r in plain:
        held[r["toxic"]].update({x for w in re.findall(r"\w+", r["text"]) for x in (w.lower() + "$", *(w.lower()[:k] for k in (4, 5, 6, 7) if k < len(w.lower())))})
    n = Counter(r["toxic"] for r in plain)
    ratio = {w: ((a + 0.5) / (n[1] + 1)) / ((held[0][w] + 0.5) / (n[0] + 1)) for w, a in held[1].items() if a >= 3}
    want = sorted((w for w, x in ratio.items() if x >= 8), key=lambda w: (-held[1][w] * math.log(ratio[w]), w))
    assert toxicity.candidates(rows, n[1], n[0], params) == set(want[: params.candidates]) and want


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op9_toxicity"](spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    hits = sum(r["predicted"] == toxic[r["doc_id"]] for r in held) / len(held)
    caught = [r["predicted"] for r in held if toxic[r["doc_id"]]]
    assert hits > 0.9 and sum(caught) / len(caught) > 0.7


def test_pipeline_equals_plain_stages(spark, texts):
    import corpus_pipeline

    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1").select("doc_id", "text", "lang")
    classify = language.Classifier(language.learn_dictionaries(labelled), language.LanguageParams())
    kept = {i: t for i, t in texts.items() if not classify(t)[2]}
    kept = dict(plain_survivors(list(kept.items())))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(b in t for b in items)}
    assert set(rows) == set(kept)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in rows.items():
        back = plain.decode(r["token_ids"], skip_special_tokens=False)
        assert r["n_tokens"] == len(r["token_ids"]) and len(back) == len(kept[i])
        if not re.search("[0-9]", kept[i]):
            assert back == kept[i]
