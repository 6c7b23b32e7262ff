"""Substring dedup by hashing paragraphs, lines and sentences.

A text is cut in units; each unit is normalised and digested; digests are grouped over the whole table;
the earliest occurrence of each, by document id and place, is kept, and the other occurrences are
removed. Offsets of all that is removed refer to the original text.

Paragraphs (lines up to a blank one, two at least) are resolved first: the earliest of each stays. What lies in
a removed one is no occurrence of lines and sentences any more, since a paragraph with other line breaks may
hold no such line; so nothing is kept in what another unit loses. Paragraphs and lines are
removed whatever their length. A passage that
documents share may start inside a line, so lines are also cut in sentences; as short sentences repeat by
chance, they are removed only in runs of consecutive repeated ones that are long enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from seqspark.session import materialize

from .names import spare_name

SENTENCE, LINE, PARAGRAPH = 0, 1, 2
LEVELS = (PARAGRAPH, LINE, SENTENCE)
#: Where a sentence ends; no run of marks is looked at twice, so the scan is linear.
ENDS = re.compile(r"[。！？｡]++|(?<![.!?])[.!?]++(?=\s|$)")
#: Characters of the shortest run of sentences that is removed from inside a line.
MIN_CHARS = 40
#: Units that a task holds before it passes them on.
HELD = 100_000


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode())


def _sentences(line: str, at: int) -> Iterator[tuple[int, int, str]]:
    """``(start, end, normal form)`` of the sentences of a line that begins at ``at``."""
    begin = 0
    for end in [*(m.end() for m in ENDS.finditer(line)), len(line)]:
        body = line[begin:end]
        words = body.lower().split()
        if words:
            yield at + begin + len(body) - len(body.lstrip()), at + begin + len(body.rstrip()), " ".join(words)
        begin = end


def units_of(text: str) -> list[tuple[int, int, int, int, bytes]]:
    """``(level, number, start, end, digest)`` of the units of a text.

    ``number`` is that of the first sentence within, counted over the text. Outer white space is no part
    of a unit, and units of white space alone are none. The normal form is lower case with single
    spaces. A line of one sentence is a line, and a paragraph of one line is a line, so no two units are
    the same stretch.
    """
    out: list[tuple[int, int, int, int, bytes]] = []
    number, at = 0, 0
    lines: list[tuple[int, int, int, str]] = []

    def close() -> None:
        if len(lines) > 1:
            out.append((PARAGRAPH, lines[0][0], lines[0][1], lines[-1][2], _digest(" ".join(x[3] for x in lines))))
        lines.clear()

    for line in text.split("\n"):
        found = list(_sentences(line, at)) if line and not line.isspace() else []
        at += len(line) + 1
        if not found:
            close()
            continue
        whole = " ".join(line.lower().split()) if len(found) > 1 else found[0][2]
        lines.append((number, found[0][0], found[-1][1], whole))
        out.append((LINE, number, found[0][0], found[-1][1], _digest(whole)))
        if len(found) > 1:
            out += [(SENTENCE, number + i, a, b, _digest(s)) for i, (a, b, s) in enumerate(found)]
        number += len(found)
    close()
    return out


def text_units(docs: DataFrame, row_col: str | None = None) -> DataFrame:
    """``(row, doc_id, level, no, start, end, h1, h2)`` of every unit; h1 and h2 are its 128-bit digest.

    ``row`` tells the rows of ``docs`` apart, also where ids repeat or are null: it is ``row_col``, or
    else counted in the task, so that the result must be written before it is used twice.
    """
    names = ["row", "doc_id", "level", "no", "start", "end", "h1", "h2"]

    def batch_of(rows: list, ids: list, units: list) -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(u[4] for u in units), "<i8").reshape(-1, 2)
        numbers = [pa.array([u[i] for u in units], pa.int32()) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), *numbers, *(pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 36
        rows, ids, units = [], [], []
        for batch in batches:
            given = batch.column(2).to_pylist()
            for doc_id, text, row in zip(batch.column(0).to_pylist(), batch.column(1), given):
                found = units_of(text.as_py() or "")
                rows += [count if row is None else row] * len(found)
                ids += [doc_id] * len(found)
                units += found
                count += 1
                if len(units) >= HELD:
                    yield batch_of(rows, ids, units)
                    rows, ids, units = [], [], []
        yield batch_of(rows, ids, units)

    row = F.lit(None).cast("long") if row_col is None else F.col(row_col)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row")).mapInArrow(run, "row long, doc_id long, level int, no int, start int, end int, h1 long, h2 long")


def removals(units: list[tuple[int, int, int, int, int, int]], min_chars: int) -> list[tuple[int, int, int, int]]:
    """Disjoint ``(start, end, kept_doc_id, kept_start)`` from the repeated units of one text.

    A unit is ``(level, number, start, end, kept_doc_id, kept_start)``. Overlapping stretches become one,
    with the kept occurrence of the first, the longest of those that start there.
    """
    spans = [u[2:] for u in units if u[0] != SENTENCE]
    # a line of one sentence continues a run; a longer line has its sentences beside it
    single = sorted({u[1]: u for u in sorted(units, key=lambda u: -u[0]) if u[0] != PARAGRAPH}.values(), key=lambda u: u[1])
    last, chars, span = -2, 0, None
    for _, number, start, end, *kept in single:
        if span is None or number != last + 1:
            if span is not None and chars >= min_chars:
                spans.append(span)
            span, chars = (start, end, *kept), 0
        chars += end - max(start, span[1] if chars else start)
        span, last = (span[0], max(end, span[1]), *span[2:]), number
    if span is not None and chars >= min_chars:
        spans.append(span)
    out: list[tuple[int, int, int, int]] = []
    for start, end, doc, kept in sorted(spans, key=lambda s: (s[0], -s[1], s[2] is None, s[2] or 0, s[3])):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), *out[-1][2:])
        else:
            out.append((start, end, doc, kept))
    return out


def _removed(units: DataFrame, min_chars: int) -> DataFrame:
    """``(row, doc_id, n_removed, removed_chars, removed)`` from all units, which must be a written table.

    What of a row lies in its removed paragraphs is taken out by a join on the row. Digest groups are reduced to
    their earliest member before they are shuffled, and the join back to the
    units is an equi-join of tables, whose hot digests adaptive execution can split. What is gathered
    after it is one document's own.
    """
    rank = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start")).alias("kept")

    def repeated(of: DataFrame) -> DataFrame:
        first = of.groupBy("h1", "h2").agg(rank, F.count("*").alias("n")).where("n > 1")
        kept = materialize(first.select("h1", "h2", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.row").alias("kept_row"), F.col("kept.start").alias("kept_start")), "kept")
        return of.join(kept, ["h1", "h2"]).where((F.col("row") != F.col("kept_row")) | (F.col("start") != F.col("kept_start")))

    paragraphs = materialize(repeated(units.where(F.col("level") == PARAGRAPH)), "paragraphs")
    gone = paragraphs.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    inside = F.exists("gone", lambda g: (g["start"] <= F.col("start")) & (F.col("end") <= g["end"]))
    smaller = units.where(F.col("level") != PARAGRAPH).join(gone, "row", "left").where(F.col("gone").isNull() | ~inside).drop("gone")
    repeated = repeated(materialize(smaller, "smaller")).unionByName(paragraphs)
    own = repeated.groupBy("row", "doc_id").agg(F.collect_list(F.struct("level", "no", "start", "end", "kept_doc_id", "kept_start")).alias("units"))
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kept_doc_id", pa.int64()), ("kept_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [removals([tuple(u.values()) for u in units.as_py()], min_chars) for units in batch.column(2)]
            spans = pa.array([[{"start": a, "end": b, "kept_doc_id": d, "kept_start": k} for a, b, d, k in x] for x in found], spans_type)
            counts = pa.array([len(x) for x in found], pa.int64()), pa.array([sum(b - a for a, b, *_ in x) for x in found], pa.int64())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, spans], names=["row", "doc_id", "n_removed", "removed_chars", "removed"])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return own.mapInArrow(run, "row long, doc_id long, n_removed long, removed_chars long, removed array<struct<start: int, end: int, kept_doc_id: long, kept_start: int>>")


def repeated_text(docs: DataFrame, min_chars: int = MIN_CHARS, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``(doc_id, n_removed, removed_chars, removed)`` of every row that loses text.

    ``removed`` lists ``(start, end, kept_doc_id, kept_start)`` in order, as code-point offsets in the
    original text; the kept occurrence is that of the first unit of a stretch. Every paragraph and line
    that repeats an earlier unit is removed whatever its length; a run of repeated sentences if they have
    ``min_chars`` characters. Occurrences are ranked by doc id, null last, then by row and place; so of
    repeated rows one keeps what it alone would keep, and the others lose all. Which of them is first is
    not determined where ids repeat. Null, empty and blank texts have no unit. Extra columns are not read.
    """
    units = materialize(text_units(docs).where(F.col("level").isin(*levels)), "units")
    return _removed(units, min_chars).drop("row")


def without_repeats(docs: DataFrame, min_chars: int = MIN_CHARS, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``docs`` with the removed stretches cut from ``text``; the rules are those of ``repeated_text``.

    The rows are written with a number first, which joins them with what they lose.
    """
    row, removed = spare_name(docs, "_row"), spare_name(docs, "_removed")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    units = materialize(text_units(numbered, row).where(F.col("level").isin(*levels)), "units")
    cut = _removed(units, min_chars).select(F.col("row").alias(row), F.col("removed").alias(removed))
    spans = F.col(removed)

    def gap(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        end = F.when(i == F.size(spans), F.length("text")).otherwise(F.get(spans, i)["start"])
        return F.substring(F.col("text"), start + 1, end - start)

    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), gap), "")
    return numbered.join(cut, row, "left").withColumn("text", F.when(spans.isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
