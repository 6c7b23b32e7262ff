"""Spelling variants: words one edit apart, found with an index of variable-length grams.

Words are compared by their lengths in classes: class c holds the words of c code points, and those of c + 1
beside them, so that each pair that can be one edit apart lies in exactly one class. A class has a gram
dictionary, pruned by frequency: a gram is extended by the next code point only where many words hold it, up
to half of the (anchored) word. A word is decomposed into one gram at each place, the first that is rare or
full, contained ones too; so an edit affects exactly the grams that span it, and the most grams that one edit
of a word can affect bounds what two near words must share. As a gram is never longer than half a word, that
is at least one gram: no word is without a bound, and no pair is lost.

Lists of the index are merged by a join on their gram. A word enters only the lists of its rarest grams, one
more than an edit can affect; where the first shared gram stands in both orders tells whether enough can
follow. What remains is verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqspark.session import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: The shortest gram. What stands before and behind a word; neither is a letter.
SHORTEST, BEGIN, END = 2, "^", "$"
#: Entries, and characters of them, that a task sums before it passes them on.
HELD, HELD_CHARS = 300_000, 8 << 20


@dataclass(frozen=True)
class SpellingParams:
    """typos: one run of so many loses a code point, by its checksum. least_chars, least_count: of a word.
    ratio: times that a form must be as frequent. rare: words of a class up to which a gram is not extended.
    dictionary: grams that are extended, at most; beyond it ``rare`` is raised, which costs work, not links.
    longest: code points of a gram at most."""

    typos: int = 199
    least_chars: int = 6
    least_count: int = 5
    ratio: int = 5
    rare: int = 16
    dictionary: int = 400_000
    longest: int = 8


def lower_ascii(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(LOWER)


def words_of(doc_id: int | None, text: str, typos: int) -> Counter[str]:
    """The runs of a text, lower-cased, with how often each occurs; a run whose checksum asks for it has lost
    one code point. With a null id none has."""
    runs: Counter[str] = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        runs[lower_ascii(run)] += n
    if doc_id is None:
        return runs
    start = zlib.crc32(f"{doc_id}:".encode())
    found: Counter[str] = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % typos == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        found[run] += n
    return found


def _passed_on(counts: Counter, names: list[str]) -> pa.RecordBatch:
    keys = list(counts)
    columns = [pa.array(keys, pa.string())] if len(names) == 2 else [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=names)


def word_counts(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """``(word, n)`` of all words that are long and frequent enough, over all documents.

    Each task sums its own counts first, so a word that fills the table is one row of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of(doc_id, text.as_py() or "", params.typos).items():
                    if len(word) >= params.least_chars:
                        if word not in counts:
                            chars += len(word)
                        counts[word] += n
                if len(counts) > HELD or chars > HELD_CHARS:
                    yield _passed_on(counts, ["word", "n"])
                    counts, chars = Counter(), 0
        yield _passed_on(counts, ["word", "n"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.least_count)


def longest_gram(c: int, longest: int) -> int:
    """Code points of the longest gram in class c: half an anchored word of c code points."""
    return min((c + 2) // 2, longest)


def classes_of(word: str, least_chars: int) -> tuple[int, ...]:
    n = len(word)
    return (n,) if n == least_chars else (n - 1, n)


def decompose(word: str, c: int, frequent: dict[str, int], longest: int) -> list[tuple[int, str]]:
    """``(place, gram)``: at each place of the anchored word the first gram that is not extended, if it ends
    within the word."""
    s, most, out = BEGIN + word + END, longest_gram(c, longest), []
    for p in range(len(s) - SHORTEST + 1):
        end = p + SHORTEST
        while end - p < most and end <= len(s) and s[p:end] in frequent:
            end += 1
        if end <= len(s):
            out.append((p, s[p:end]))
    return out


def most_affected(grams: list[tuple[int, str]], length: int) -> int:
    """The most grams of a word of ``length`` code points that span one place of it: an insertion, deletion or
    replacement there changes these and no other."""
    change = np.zeros(length + 3, np.int64)
    for p, gram in grams:
        change[p] += 1
        change[p + len(gram)] -= 1
    return int(np.cumsum(change)[1 : length + 1].max())


def index_entries(word: str, c: int, frequent: dict[str, int], longest: int) -> tuple[list[tuple[str, int, int]], int, int]:
    """``(gram, place, rank)`` of the lists that a word enters, how many distinct grams it has, and how many of
    them each near word must share. The place is -1 where a gram occurs more than once."""
    grams = decompose(word, c, frequent, longest)
    places: dict[str, int] = {}
    for p, gram in grams:
        places[gram] = -1 if gram in places else p
    need = max(1, len(places) - most_affected(grams, len(word)))
    order = sorted(places, key=lambda g: (frequent.get(g, 0), g))
    return [(g, places[g], i) for i, g in enumerate(order[: len(order) - need + 1])], len(places), need


def gram_dictionary(words: DataFrame, params: SpellingParams = SpellingParams()) -> dict[int, dict[str, int]]:
    """By class, the grams that more than ``rare`` words hold (by place), and how many; at most
    ``dictionary`` of them, which bounds what the driver gets and sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[int, str]] = Counter()
        for batch in batches:
            for word in batch.column(0):
                word = word.as_py()
                s = BEGIN + word + END
                for c in classes_of(word, params.least_chars):
                    for size in range(SHORTEST, longest_gram(c, params.longest) + 1):
                        counts.update((c, s[p : p + size]) for p in range(len(s) - size + 1))
                    if len(counts) > HELD:
                        yield _passed_on(counts, ["c", "gram", "n"])
                        counts = Counter()
        yield _passed_on(counts, ["c", "gram", "n"])

    counts = words.select("word").mapInArrow(run, "c int, gram string, n long").groupBy("c", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where(F.col("n") > params.rare), "grams")
    step = F.floor(F.log2("n") * 8)
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("grams"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # 8 for each doubling
    least, held = None, 0
    for r in rows:
        held += r["grams"]
        if held > params.dictionary:
            break
        least = r["least"]
    found: dict[int, dict[str, int]] = {}
    if least is not None:
        for r in counts.where(F.col("n") >= least).collect():
            found.setdefault(r["c"], {})[r["gram"]] = r["n"]
    return found


def gram_index(words: DataFrame, dictionary: dict[int, dict[str, int]], params: SpellingParams = SpellingParams()) -> DataFrame:
    """``(c, gram, word, n, short, place, rank, size, need)``: the lists of the index."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary)
    names = ["c", "gram", "word", "n", "short", "place", "rank", "size", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for c in classes_of(word, params.least_chars):
                    entries, size, need = index_entries(word, c, grams.get(c, {}), params.longest)
                    for gram, place, rank in entries:
                        for column, value in zip(columns, (c, gram, word, n, len(word) == c, place, rank, size, need)):
                            column.append(value)
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=names)

    return words.select("word", "n").mapInArrow(run, "c int, gram string, word string, n long, short boolean, place int, rank int, size int, need int")


def near_words(words: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """``(a, a_n, b, b_n)``: each pair of ``words(word, n)`` that one inserted, deleted or replaced code point
    tells apart, once.

    Exact. The condition stands in the join, so what meets in a list and is not near makes no row; adaptive
    execution splits a long list.
    """
    lists = materialize(gram_index(words, gram_dictionary(words, params), params), "lists")
    a, b = lists.where("short").alias("a"), lists.alias("b")

    def of(name: str) -> tuple[Column, Column]:
        return F.col(f"a.{name}"), F.col(f"b.{name}")

    (word, other), (place, place_b), (rank, rank_b), (size, size_b), (need, need_b) = map(of, ("word", "place", "rank", "size", "need"))
    once = ~F.col("b.short") | (word < other)
    moved = (place < 0) | (place_b < 0) | (F.abs(place - place_b) <= 1)
    enough = F.least(size - rank, size_b - rank_b) >= F.greatest(need, need_b)
    near = F.levenshtein(word, other, 1) == 1
    met = a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.gram") == F.col("b.gram")) & once & moved & enough & near)
    return met.select(word.alias("a"), F.col("a.n").alias("a_n"), other.alias("b"), F.col("b.n").alias("b_n")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: forms followed to the last, by doubling steps.

    Along forms n grows at least ``ratio`` times, so there is no circle and few rounds."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(state.join(ahead, "root", "left"), "steps")
        if not moved.where("next is not null").head(1):
            return state
        state = materialize(moved.select("word", F.coalesce("next", "root").alias("root")), "roots", instead_of=state)


def spelling_variants(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs``.

    Words are maximal runs of ``A-Za-z`` and U+00C0 to U+00FF in whole texts, A-Z lower-cased; a run whose
    checksum with the id is divided by ``typos`` loses a code point (none where the id is null). A word has
    ``least_chars`` code points and occurs ``least_count`` times. Its form is the most frequent word one edit
    away, of equals the first in code-point order, if that is ``ratio`` times as frequent; its root is where
    forms end. Null and empty texts have no word, repeated rows count as often as they stand, an empty table
    gives no row, a run of any length is one word; extra columns are not read.
    """
    words = materialize(word_counts(docs, params), "words")
    links = materialize(near_words(words, params), "links")
    both = links.union(links.select("b", "b_n", "a", "a_n"))
    best = F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word"))).alias("best")
    near = both.groupBy(F.col("a").alias("word")).agg(F.max("a_n").alias("n"), F.count("*").alias("n_near"), best)
    near = near.withColumn("taken", -F.col("best.n") >= params.ratio * F.col("n"))
    near = materialize(near.select("word", "n_near", F.when(F.col("taken"), F.col("best.word")).alias("form"), F.when(F.col("taken"), -F.col("best.n")).alias("form_n")), "near")
    roots = _roots(near.where("form is not null"))
    found = words.join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
