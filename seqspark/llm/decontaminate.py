"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in a normal form: ASCII letters in lower case, every run of ASCII characters that
are neither letters nor digits as one space. A passage of m characters within k edits of a document
region keeps at least (m - q + 1) - k q of its q-grams, and those lie on at most k + 1 neighbouring
diagonals (position in the document less position in the passage). So shared q-grams are counted in
overlapping diagonal bands; bands that meet the bound are regions, and an alignment that fills only the
2k + 1 diagonals around their q-grams decides them. Passages too short for the bound have shorter q-grams;
those shorter than a q-gram are searched exactly, and of their occurrences that overlap the first counts.

A passage that repeats a q-gram many times would make a hit for each pair of places. Of such a passage only the
document's places count: an occurrence has as many places whose q-gram the passage holds, within its length.
Regions whose diagonals overlap are one region, which is aligned once, so text that repeats itself makes one
region and not one for each diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqspark.session import materialize

#: Documents are searched in runs of about so many bytes, whatever the Arrow batch holds.
RUN_BYTES = 1 << 20
#: Characters of a run that are hashed at a time, so that the arrays stay in cache.
HASH_CHARS = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32

RESULT = "doc_id long, item_id long, start long, end long, distance int, shared int"


@dataclass(frozen=True)
class LeakParams:
    """q: characters of a q-gram, at most. edit_rate: edits allowed for each character of a passage.
    block_bytes: passages are taken in blocks of at most so many bytes (one passage at least); each block
    is sent to the executors and searched in all documents, so what is sent at once never grows."""

    q: int = 12
    edit_rate: float = 0.04
    block_bytes: int = 1 << 20


#: The normal form of each ASCII character; 0 parts documents, whose own are blanked before.
CLASSES = np.array([ord(chr(b).lower()) if chr(b).isalnum() else SPACE * (b > 0) for b in range(128)], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def normal_form(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normal form of code points and, for each of its own, the place in ``codes``."""
    own = np.where(codes < 128, CLASSES[codes & 127], codes)
    space = own == SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    places = np.flatnonzero(keep)
    return own[places], places


def normal_passage(text: str | None) -> np.ndarray:
    """The normal form of a passage, without outer spaces."""
    codes = normal_form(code_points((text or "").replace("\0", " ")))[0]
    solid = np.flatnonzero(codes != SPACE)
    return codes[solid[0] : solid[-1] + 1] if len(solid) else codes[:0]


def rolling_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every window of q bytes, by doubling."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width, base = data.astype(np.uint64) + np.uint64(1), 1, BASE
        out, done = None, 0
        rest = q
        while rest:
            if rest & 1:
                if out is None:
                    out, done = power[:n].copy(), width
                else:
                    out = out * base + power[done : done + n]
                    done += width
            rest >>= 1
            if rest:
                power = power[:-width] * base + power[width:]
                base, width = base * base, 2 * width
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


#: Times that a passage may hold one q-gram before it counts as repetitive.
REPEATS = 4


class GramTable:
    """The q-grams of one length of some passages, sorted by hash; those of repetitive passages once."""

    def __init__(self, q: int, passages: list[tuple[int, np.ndarray]]):
        grams = [rolling_hashes(codes, q) for _, codes in passages]
        self.repetitive = []
        for i, (k, _) in enumerate(passages):
            own, times = np.unique(grams[i], return_counts=True)
            if times.max() > REPEATS:
                self.repetitive.append(k)
                grams[i] = own
        hashes = np.concatenate(grams)
        order = np.argsort(hashes, kind="stable")
        self.q, self.hashes = q, hashes[order]
        self.owner = np.concatenate([np.full(len(g), k) for (k, _), g in zip(passages, grams)])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.shift = np.uint64(64 - max(12, int(64 * len(hashes)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.hashes >> self.shift] = True

    def hits(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, max(0, len(data) - self.q + 1), HASH_CHARS):
            own = rolling_hashes(data[at : at + HASH_CHARS + self.q - 1], self.q)
            maybe = np.flatnonzero(self.seen[own >> self.shift])
            if not len(maybe):
                continue
            first = np.searchsorted(self.hashes, own[maybe])
            count = np.searchsorted(self.hashes, own[maybe], side="right") - first
            entry = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield np.repeat(maybe + at, count), self.owner[entry], self.place[entry]


class PassageIndex:
    """The q-grams of a block of passages, with the edits and the bound of each.

    A passage of m characters and k edits has q-grams of at most ``m // (k + 1)`` characters, so that one
    at least stays whole. Passages without letters and digits are left out.
    """

    def __init__(self, passages: list[tuple[int, str]], params: LeakParams):
        self.ids, self.codes, self.edits, need = [], [], [], []
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in passages:
            codes = normal_passage(text)
            m = len(codes)
            if not m:
                continue
            k = min(int(params.edit_rate * m), m - 1)
            q = min(params.q, m // (k + 1))
            by_length.setdefault(q, []).append((len(self.ids), codes))
            self.ids.append(item_id)
            self.codes.append(codes)
            self.edits.append(k)
            need.append(m - q + 1 - k * q)
        self.need, self.width = np.array(need, np.int64), np.array(self.edits, np.int64) + 1
        self.tables, self.short = [], []
        for q, own in sorted(by_length.items()):
            whole = [x for x in own if len(x[1]) == q]
            longer = [x for x in own if len(x[1]) > q]
            self.short += [GramTable(q, whole)] if whole else []
            self.tables += [GramTable(q, longer)] if longer else []
        self.repetitive = np.zeros(len(self.ids), bool)
        for table in self.tables:
            self.repetitive[table.repetitive] = True
        self.lengths = np.array([len(c) for c in self.codes], np.int64)

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(position, passage, place in the passage)`` of every shared q-gram."""
        return self._all(self.tables, data)

    def short_hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for passages that are one q-gram."""
        return self._all(self.short, data)

    @staticmethod
    def _all(tables: list[GramTable], data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [h for t in tables for h in t.hits(data)]
        return tuple(np.concatenate([h[i] for h in found]) if found else np.zeros(0, np.int64) for i in range(3))


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, limit: int) -> tuple[int, int, int] | None:
    """``(edits, start, end)`` of the best occurrence of all of ``pattern`` in ``text`` within ``limit``.

    Only the diagonals ``low`` to ``high`` are filled: place in the text less place in the pattern. Of
    equally good ends the first counts.
    """
    n, size = len(text), high - low + 1
    place = np.arange(low, high + 1)  # in the text, of each diagonal, before the row's pattern character
    far = limit + 1
    step = np.arange(size)
    costs = np.where((place >= 0) & (place <= n), 0, far)
    starts = place.copy()
    padded = np.concatenate((np.zeros(max(0, -low), text.dtype), text[max(0, low) :], np.zeros(len(pattern) + size, text.dtype)))
    for i, c in enumerate(pattern):
        # padded starts at diagonal low, so row i of the band lies at i
        best = costs + (padded[i : i + size] != c)
        origin = starts.copy()
        drop = costs[1:] + 1
        better = drop < best[:-1]
        best[:-1][better], origin[:-1][better] = drop[better], starts[1:][better]
        place = place + 1
        best[(place < 0) | (place > n)] = far
        # insertions: the least of best[d'] + (d - d') over d' <= d
        run = np.minimum.accumulate((best - step) * size + step)
        source = run % size
        costs, starts = np.minimum(best[source] + step - source, far), origin[source]
        costs[(place < 0) | (place > n)] = far
        if costs.min() > limit:
            return None
    at = int(costs.argmin())
    return int(costs[at]), int(starts[at]), int(place[at])


def _regions(index: PassageIndex, data: np.ndarray, places: np.ndarray, ends: np.ndarray) -> set[tuple[int, int, int, int, int]]:
    """``(document, passage, lowest, highest diagonal, shared)`` around the bands that meet the bound."""
    position, passage, place = index.hits(data)
    found: dict[tuple[int, int, int, int], int] = {}
    odd = index.repetitive[passage]
    for p in np.unique(passage[odd]).tolist():
        own = np.sort(position[odd & (passage == p)])
        _repetitive_regions(index, p, own, np.searchsorted(ends, places[own], side="right"), found)
    position, passage, place = position[~odd], passage[~odd], place[~odd]
    if len(position):
        total = np.bincount(passage, minlength=len(index.ids))
        keep = total[passage] >= index.need[passage]
        position, passage, place = position[keep], passage[keep], place[keep]
    if len(position):
        diagonal = position - place + len(data)
        width = index.width[passage]
        for shift in (0, 1):
            key = passage << 40 | (diagonal + shift * width) // (2 * width)
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            first = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
            count = np.diff(np.concatenate((first, [len(order)])))
            item = passage[order[first]]
            enough = count >= index.need[item]
            for f, n, p in zip(first[enough], count[enough], item[enough].tolist()):
                own = order[f : f + n]
                docs = np.searchsorted(ends, places[position[own]], side="right")
                k, need = index.edits[p], int(index.need[p])
                for doc in np.unique(docs):
                    mine = np.sort((position - place)[own[docs == doc]])
                    # an occurrence has its q-grams on diagonals d to d + k, and all of itself within k of d
                    within = np.searchsorted(mine, mine + k, side="right") - np.arange(len(mine))
                    begins = np.unique(mine[within >= need])
                    while len(begins):
                        chain = begins[begins <= begins[0] + 2 * k]
                        region = (int(doc), p, int(chain[0]) - k, int(chain[-1]) + k)
                        found[region] = max(found.get(region, 0), int(within.max()))
                        begins = begins[len(chain) :]
    return _merged(found)


def _repetitive_regions(index: PassageIndex, p: int, position: np.ndarray, docs: np.ndarray, found: dict[tuple[int, int, int, int], int]) -> None:
    """Regions of a repetitive passage, from the places in the documents whose q-gram it holds."""
    k, need = index.edits[p], int(index.need[p])
    span = int(index.lengths[p]) + k
    for doc in np.unique(docs).tolist():
        mine = position[docs == doc]
        within = np.searchsorted(mine, mine + span, side="left") - np.arange(len(mine))
        begins, shared = mine[within >= need], within[within >= need]
        cut = np.flatnonzero(np.diff(begins) > span) + 1
        for a, n in zip(np.split(begins, cut), np.split(shared, cut)):
            if len(a):
                found[doc, p, int(a[0]) - span, int(a[-1]) + k] = int(n.max())


def _merged(found: dict[tuple[int, int, int, int], int]) -> set[tuple[int, int, int, int, int]]:
    """Regions of one document and passage whose diagonals overlap, as one."""
    out: list[list[int]] = []
    for (doc, p, low, high), shared in sorted(found.items()):
        if out and out[-1][:2] == [doc, p] and low <= out[-1][3]:
            out[-1][3:] = max(high, out[-1][3]), max(shared, out[-1][4])
        else:
            out.append([doc, p, low, high, shared])
    return set(map(tuple, out))


def _short_rows(index: PassageIndex, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(document, passage, position)`` of the passages that are one q-gram, found exactly."""
    position, passage, _ = index.short_hits(data)
    for p in np.unique(passage).tolist():
        own, pattern = np.sort(position[passage == p]), index.codes[p]
        m = len(pattern)
        own = own[(data[own[:, None] + np.arange(m)] == pattern).all(axis=1)]
        if len(own) > 1 and np.diff(own).min() < m:
            kept, i = [], 0
            while i < len(own):
                kept.append(int(own[i]))
                i = int(np.searchsorted(own, own[i] + m))
            own = np.array(kept)
        yield from zip(np.searchsorted(ends, own, side="right").tolist(), [p] * len(own), own.tolist())


def _first_whole(data: np.ndarray, pattern: np.ndarray, low: int, high: int) -> int | None:
    """The first place from ``low`` to ``high`` where the pattern stands unchanged."""
    starts = np.flatnonzero(data[low : high + 1] == pattern[0]) + low if high >= low else ()
    return next((int(d) for d in starts if np.array_equal(data[d : d + len(pattern)], pattern)), None)


def _search(index: PassageIndex, ids: list, texts: list[str]) -> list[tuple]:
    """Result rows of some documents."""
    raw = code_points("\0".join(t.replace("\0", " ") for t in texts))
    if not index.ids or not len(raw):
        return []
    data, places = normal_form(raw)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - np.array([len(t) + 1 for t in texts])
    rows: dict[tuple, tuple] = {}
    for doc, p, at in _short_rows(index, data, np.searchsorted(places, ends - 1) + 1):
        start, end = int(places[at] - begins[doc]), int(places[at + len(index.codes[p]) - 1] - begins[doc]) + 1
        rows[doc, p, start, end] = (ids[doc], index.ids[p], start, end, 0, 1)
    for doc, p, low, high, shared in _regions(index, data, places, ends):
        pattern = index.codes[p]
        first, last = (int(x) for x in np.searchsorted(places, (begins[doc], ends[doc] - 1)))
        lo, hi = max(low, first), min(high + len(pattern), last)
        k, m = index.edits[p], len(pattern)
        whole = _first_whole(data, pattern, max(low + k, lo), min(high - k, hi - m))
        best = (0, whole - lo, whole - lo + m) if whole is not None else banded_distance(pattern, data[lo:hi], low - lo, high - lo, k)
        if best is None:
            continue
        edits, start, end = best
        start, end = int(places[lo + start] - begins[doc]), int(places[lo + end - 1] - begins[doc]) + 1
        key = (doc, p, start, end)
        if key not in rows or rows[key][5] < shared:
            rows[key] = (ids[doc], index.ids[p], start, end, edits, shared)
    return [rows[k] for k in sorted(rows)]


def _blocks(benchmark: DataFrame, params: LeakParams) -> Iterator[list[tuple[int, str]]]:
    """Passages in blocks of bounded size, one block on the driver at a time.

    More than one block is written first, dealt by block, so that each is read once and alone.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * total // params.block_bytes) if total > params.block_bytes else 1
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    if n > 1:
        numbered = materialize(numbered, "passages", by="block")
    for block in range(n):
        held, size = [], 0
        own = numbered.where(F.col("block") == block) if n > 1 else numbered
        for r in own.select("item_id", "text").distinct().toLocalIterator():
            if held and size + len(r["text"].encode()) > params.block_bytes:
                yield held
                held, size = [], 0
            held.append((r["item_id"], r["text"]))
            size += len(r["text"].encode())
        if held:
            yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """``(doc_id, item_id, start, end, distance, shared)`` of every benchmark passage found in a document.

    ``start`` and ``end`` are code-point offsets in the original text, ``distance`` the edits between the
    normal forms, ``shared`` the shared q-grams counted. Every region within ``edit_rate`` edits a
    character is found, however short the passage; a passage without a letter or digit is never. Null
    and empty texts have no leak; repeated rows each give their rows, repeated passages count once; an
    empty benchmark gives an empty table. Extra columns are not read. Narrow: no shuffle. A benchmark of
    more than one block takes one scan of the documents for each, whose results are written in turn.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text != ''")
    found = _each_block(rows, benchmark, params, _searcher, RESULT)
    return found if found is not None else docs.sparkSession.createDataFrame([], RESULT)


def _each_block(rows: DataFrame, benchmark: DataFrame, params: LeakParams, searcher, schema: str) -> DataFrame | None:
    """Results of all blocks: of one block as a plan, of several from written tables."""
    blocks = _blocks(benchmark, params)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return None
    found = rows.mapInArrow(searcher(first, params), schema)
    if second is None:
        return found
    found = materialize(found, "leaks")
    while second is not None:
        found = found.union(materialize(rows.mapInArrow(searcher(second, params), schema), "leaks"))
        second = next(blocks, None)
    return found


def _runs(keys, column: pa.Array) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts in runs of about RUN_BYTES; null texts are empty."""
    held, texts, size = [], [], 0
    for key, text in zip(keys, column):
        data = text.as_py() or ""
        if texts and size + len(data) > RUN_BYTES:
            yield held, texts
            held, texts, size = [], [], 0
        held.append(key)
        texts.append(data)
        size += len(data)
    if texts:
        yield held, texts


def _searcher(passages: list[tuple[int, str]], params: LeakParams):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32()), ("shared", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PassageIndex(passages, params)
        for batch in batches:
            out = []
            for ids, texts in _runs(batch.column(0).to_pylist(), batch.column(1)):
                out += _search(index, ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _keeper(names: list[str], leaking: bool = False):
    """A searcher that passes whole rows on: those without a leak, or those with one."""
    at = names.index("text")

    def searcher(passages: list[tuple[int, str]], params: LeakParams):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PassageIndex(passages, params)
            for batch in batches:
                found: set[int] = set()
                for rows, texts in _runs(range(batch.num_rows), batch.column(at)):
                    found.update(r[0] for r in _search(index, rows, texts))
                yield batch.filter(pa.array([(i in found) == leaking for i in range(batch.num_rows)], pa.bool_()))

        return run

    return searcher


def without_leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage is found, with all their columns.

    A benchmark of one block filters the rows in one narrow pass; of a larger one the hashes of leaking
    texts are gathered block by block, and the rows are joined against them. Null and empty texts stay,
    and so do rows with a null id that are clean.
    """
    blocks = _blocks(benchmark, params)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return docs.mapInArrow(_keeper(docs.columns)(first, params), docs.schema)
    marks = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    rows = docs.where("text != ''").select(*[m.alias(f"h{i}") for i, m in enumerate(marks)], "text")
    found = _each_block(rows, benchmark, params, _keeper(rows.columns, leaking=True), "h0 long, h1 long, text string")
    leaking = found.select("h0", "h1").distinct()
    return docs.join(leaking, (marks[0] == leaking["h0"]) & (marks[1] == leaking["h1"]), "left_anti")
