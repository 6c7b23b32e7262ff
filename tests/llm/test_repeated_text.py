"""Repeated paragraphs and lines of any length, and runs of repeated sentences by characters."""

import random
import time
from collections import Counter

import pytest

from seqspark.llm import unit_dedup
from seqspark.llm.unit_dedup import LINE, PARAGRAPH, SENTENCE

SF = "/root/testdata/sf0.001"


def cut(text, spans):
    for s in reversed(spans):
        text = text[: s[0]] + text[s[1] :]
    return text


def plain_removals(rows, min_chars=unit_dedup.MIN_CHARS):
    """``(row, spans)`` by one pass over all texts, in the order of ids, with a set of what was seen."""
    seen, out = set(), []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        text = rows[k][1] or ""
        units = sorted(unit_dedup.units_of(text), key=lambda u: (u[2], -u[3]))
        gone, marked = [], {}
        for level, number, start, end, digest in units:
            if digest not in seen:
                seen.add(digest)
            elif level != SENTENCE:
                gone.append((start, end))
                if not any(u[1] == number and u[0] == SENTENCE for u in units):
                    marked[number] = (start, end)
            else:
                marked[number] = (start, end)
        numbers = sorted(marked)
        for i, n in enumerate(numbers):
            if n - 1 in marked:
                continue
            run = [n]
            while run[-1] + 1 in marked:
                run.append(run[-1] + 1)
            if sum(marked[x][1] - marked[x][0] for x in run) >= min_chars:
                gone.append((marked[run[0]][0], marked[run[-1]][1]))
        places = sorted({i for a, b in gone for i in range(a, b)})
        spans = []
        for i in places:
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        if spans:
            out.append((rows[k][0], tuple(map(tuple, spans))))
    return out


def joined(spans):
    out = []
    for s in spans:
        if out and out[-1][1] == s["start"]:
            out[-1] = (out[-1][0], s["end"])
        else:
            out.append((s["start"], s["end"]))
    return tuple(out)


def removed(spark, rows, **options):
    return unit_dedup.repeated_text(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()


def left(spark, texts):
    rows = removed(spark, list(texts.items()))
    out = dict(texts) | {r["doc_id"]: cut(texts[r["doc_id"]], [(s["start"], s["end"]) for s in r["removed"]]) for r in rows}
    for r in rows:
        assert r["n_removed"] == len(r["removed"]) and r["removed_chars"] == sum(s["end"] - s["start"] for s in r["removed"])
    return out


def test_removals_equal_plain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    passage = "Onhere the retion of thinor was anding. The estion and heed of inble, thanor. " * 3
    rows += [(20_000, "Start one two. " + passage + "End."), (20_001, "Other. " + passage + "Tail of it."), (20_002, passage)]
    rows += [(None, passage), (None, None), (None, "  \n\n "), (7, "Only here.\nThe end, at last."), (7, "Only here.\nThe end, at last.")]
    got = removed(spark, rows)
    assert Counter((r["doc_id"], joined(r["removed"])) for r in got) == Counter(plain_removals(rows))
    assert {20_001, 20_002, None, 7} <= {r["doc_id"] for r in got}


def test_random_texts_equal_plain(spark):
    rng = random.Random(9)
    parts = ["One two three. ", "Four, five! ", "A b c d e f g h i j k l m n o. ", "甲乙丙。", "x", "\n", "\n\n", " ", "...", "Seven eight nine ten eleven twelve. "]
    rows = [(rng.randrange(40), "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for _ in range(60)]
    ids = list(dict(rows).items())  # which of the rows of one id is first is not determined
    assert Counter((r["doc_id"], joined(r["removed"])) for r in removed(spark, ids)) == Counter(plain_removals(ids))


def test_given_twice_keeps_what_it_keeps_alone(spark):
    shared = "Seven words are in this one here."
    first, second = (0, f"Start. {shared} Other."), (1, f"Begin of it. {shared} Another end.")
    assert removed(spark, [first, second]) == []
    twice = removed(spark, [first, second, second])
    assert [(r["doc_id"], cut(second[1], [(s["start"], s["end"]) for s in r["removed"]])) for r in twice] == [(1, "")]


def test_null_ids_are_rows_of_their_own(spark):
    rows = [(None, "Alpha beta.\nCommon line."), (None, "Gamma delta.\nCommon line."), (0, "Common line.")]
    got = sorted(rows[:2][0][1][s["start"] : s["end"]] for r in removed(spark, rows) for s in r["removed"])
    assert len(got) == 2 and all(r["doc_id"] is None and r["removed"][0]["kept_doc_id"] == 0 for r in removed(spark, rows))


def test_short_hot_line(spark):
    texts = {i: f"Own words of number {i}.\nthe and, anea. eriner.\nEnd {i}" for i in range(50)}
    got = left(spark, texts)
    assert got[0] == texts[0] and all(got[i] == f"Own words of number {i}.\n\nEnd {i}" for i in range(1, 50))


def test_paragraph_with_other_line_breaks(spark):
    texts = {0: "A b c d\ne f g h\n\nOwn one", 1: "Own two\n\nA b\nc d e\nf g h"}
    assert left(spark, texts) == texts | {1: "Own two\n\n"}
    lines = removed(spark, list(texts.items()), levels=(LINE,))
    assert lines == [] and removed(spark, list(texts.items()), levels=(PARAGRAPH,))[0]["doc_id"] == 1


def test_short_sentence_inside_a_line_stays(spark):
    texts = {1: "So it is. First thing here.", 2: "So it is. Second thing there."}
    assert left(spark, texts) == texts


def test_unspaced_passage_inside_a_line(spark):
    passage = "这是一个很长的段落它在许多文档中重复出现并且没有任何空格。因此单词的数量几乎总是一而字符的数量却很多很多很多。"
    texts = {1: "开头甲。" + passage + "结尾甲。", 2: "开头乙。" + passage + "结尾乙。", 3: "短行\n甲", 4: "短行\n乙"}
    assert left(spark, texts) == texts | {2: "开头乙。结尾乙。", 4: "\n乙"}


def test_long_run_of_short_sentences(spark):
    passage = "One two three four. Five six seven eight. Nine ten."
    texts = {1: "Start here. " + passage + " End a.", 2: "Begin there. " + passage + " End b."}
    assert left(spark, texts) == texts | {2: "Begin there.  End b."}


def test_cut_texts_follow_the_spans(spark):
    rows = [(1, "Same line.\nOwn a"), (2, "Same line.\nOwn b"), (2, "Same line.\nOwn c"), (None, "Same line."), (3, None), (4, "")]
    kept = unit_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, "Same line.\nOwn a"), (2, "\nOwn b"), (2, "\nOwn c"), (None, ""), (3, None), (4, "")])


@pytest.mark.parametrize("text", ["." * 1_000_000 + "a", "。." * 500_000, "a" * 1_000_000, "a. " * 300_000, "\n" * 1_000_000, "!?" * 400_000 + "\n" + "x" * 200_000])
def test_units_take_linear_time(text):
    began = time.time()
    unit_dedup.units_of(text)
    assert time.time() - began < 10


def test_units_cover_all_words(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect():
        units = unit_dedup.units_of(r["text"])
        lines = [u for u in units if u[0] == LINE]
        assert " ".join(r["text"][a:b] for _, _, a, b, _ in lines).split() == r["text"].split() and all(u[2] < u[3] for u in units)


def test_kept_occurrences_stay(spark):
    rows = [(1, "aa bb\ncc dd"), (2, "aa\nbb cc dd"), (3, "bb cc dd"), ((1 << 63) - 1, "only here\n\nbb cc dd"), (None, "bb cc dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in unit_dedup.repeated_text(docs).collect()}
    assert got == {2: [(0, 11, 1, 0)], (1 << 63) - 1: [(11, 19, 3, 0)], None: [(0, 8, 3, 0)]}


def test_every_line_stays_once(spark):
    rng = random.Random(9)
    lines = [" ".join(rng.choice("abcdef") * 3 for _ in range(rng.randint(1, 3))) for _ in range(14)]
    rows = [(i, "\n".join(rng.choice([*lines, ""]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {line for r in unit_dedup.without_repeats(docs).collect() for line in r["text"].split("\n")}
    assert {line for _, t in rows for line in t.split("\n")} <= kept | {""}
