"""Places of short words in pieces of sequences, found before any row is made of a place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

CODES = np.full(256, -1, np.int64)
CODES[[97, 99, 103, 116]] = range(4)
#: Bases that are looked at together.
TOGETHER = 1 << 20


def word_number(word: str) -> int | None:
    """A word of a, c, g and t as a number; None for any other."""
    number = 0
    for base in word:
        if base not in "acgt":
            return None
        number = 4 * number + "acgt".index(base)
    return number


def word_places(pieces: DataFrame, words: dict[int, list[str]], tail: int = 0) -> DataFrame:
    """``pieces`` without ``bases`` and ``own``, with ``(offset, word, tail)`` for each place of one of ``words``
    that starts in the first ``own`` bases; ``tail`` is that many bases from there, as far as the piece goes.

    ``words`` are sorted by length, ten at most. The pieces of a batch are scanned together, each word length
    by one look-up for each base, so only places that count become rows.
    """
    keys = [f for f in pieces.schema.fields if f.name not in ("bases", "own")]
    names = [f.name for f in keys]
    numbers = {k: [x for w in own if (x := word_number(w)) is not None] for k, own in words.items()}

    def scan(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, tables: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        piece = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(codes)) - starts[piece]
        for k, table in tables.items():
            n = len(codes) - k + 1
            if n < 1:
                continue
            word, whole = np.zeros(n, np.int64), (at[:n] < own[piece[:n]]) & (at[:n] + k <= sizes[piece[:n]])
            for i in range(k):
                word = word * 4 + codes[i : i + n]
                whole &= codes[i : i + n] >= 0
            found = np.flatnonzero(whole)
            found = found[table[word[found]]]
            yield k, piece[found], at[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for k, own in numbers.items():
            tables[k] = np.zeros(4**k, bool)
            tables[k][own] = True
        for batch in batches:
            bases, own = batch.column("bases").to_pylist(), batch.column("own").to_numpy(zero_copy_only=False)
            lengths = np.array([len(b) for b in bases], np.int64)
            cuts = np.searchsorted(np.cumsum(lengths), np.arange(TOGETHER, lengths.sum() + TOGETHER, TOGETHER)) if len(bases) else []
            first = 0
            for last in [*dict.fromkeys(min(int(c) + 1, len(bases)) for c in cuts)]:
                part, sizes = bases[first:last], lengths[first:last]
                codes = CODES[np.frombuffer("".join(part).encode("latin-1", "replace"), np.uint8)]
                for k, piece, at in scan(codes, np.cumsum(sizes) - sizes, sizes, own[first:last], tables):
                    held = batch.select(names).take(pa.array(piece + first)) if names else None
                    spots = list(zip(piece.tolist(), at.tolist()))
                    found = [pa.array(at, pa.int32()), pa.array([part[i][p : p + k] for i, p in spots], pa.string()), pa.array([part[i][p : p + tail] for i, p in spots], pa.string())]
                    yield pa.RecordBatch.from_arrays([*held.columns, *found], names=[*names, "offset", "word", "tail"])
                first = last

    return pieces.mapInArrow(run, T.StructType(keys).add("offset", "integer").add("word", "string").add("tail", "string"))
