"""Similarity digests of improbable features.

Every window of 16 bytes is a feature; its rank is how rare its entropy is in the whole corpus. In each
run of 16 neighbouring windows the rarest one is counted, and windows counted often enough are selected.
Selected features are hashed into Bloom filters of 2048 bits, 160 features to a filter, chained. Two
digests are compared filter by filter by the bits they share beyond what chance would give. Texts of all
lengths follow the same rule.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 16
#: Steps of entropy that are told apart.
LEVELS = 1024
BITS = 2048
#: Bytes that are worked on at a time.
BLOCK = 1 << 18
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class DigestParams:
    """popularity: share of the runs around a window in which it must be the rarest. features: in a filter,
    at most. probes: bits that a feature sets. range_bytes: text of one range of ids, on average.
    range_draws: ids that are drawn for each range, to find its bounds. run_bytes: text that is compared
    at a time."""

    popularity: float = 0.25
    features: int = 160
    probes: int = 5
    range_bytes: int = 8 << 20
    range_draws: int = 8
    run_bytes: int = 2 << 20


def _gains() -> np.ndarray:
    """What the c-th byte of a kind adds to the sum of c log2 c, in 2**-20 bits; whole numbers add exactly."""
    c = np.arange(WINDOW + 1, dtype=float)
    g = np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0)
    return np.diff(np.rint(g * (1 << 20)).astype(np.int64))


GAINS = _gains()


def entropy_levels(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The entropy level (0 to LEVELS - 1) of every window of the bytes."""
    n = len(data)
    if n < window:
        return np.zeros(0, np.int64)
    if n > BLOCK + window:
        return np.concatenate([entropy_levels(data[at : at + BLOCK + window - 1], window) for at in range(0, n - window + 1, BLOCK)])
    behind, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes in the places before, after
    for lag in range(1, window):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        behind[lag:] += same
        ahead[:-lag] += same
    # the first window is summed, then each step drops a byte and takes one
    first = int(GAINS[_earlier(data[:window])].sum())
    total = first + np.concatenate(([0], np.cumsum(GAINS[behind[window:]] - GAINS[ahead[: n - window]])))
    most = np.log2(window)
    entropy = most - total / (window * float(1 << 20))
    return np.clip((entropy * (LEVELS / most)).astype(np.int64), 0, LEVELS - 1)


def levels_of(texts: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """Levels of each text. Many short texts share the array work; windows across two texts are dropped."""
    out: list[np.ndarray] = []
    run: list[bytes] = []
    size = 0

    def flush() -> None:
        levels = entropy_levels(np.frombuffer(b"".join(run), np.uint8), window).astype(np.int16)
        at = 0
        for t in run:
            out.append(levels[at : at + max(0, len(t) - window + 1)])
            at += len(t)
        run.clear()

    for text in texts:
        run.append(text)
        size += len(text)
        if size >= BLOCK:
            flush()
            size = 0
    flush()
    return out


def _earlier(data: np.ndarray) -> np.ndarray:
    """How many equal bytes come before each of a few bytes."""
    return np.array([int((data[:i] == data[i]).sum()) for i in range(len(data))], np.int64)


def _rarest(ranks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are the leftmost least of a run of ranks, and of how many runs."""
    n = len(ranks)
    if n < window:
        return (np.array([int(ranks.argmin())]), np.array([window])) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys = ranks << 40 | np.arange(n)
    padded = np.full(-(-n // window) * window, np.iinfo(np.int64).max)
    padded[:n] = keys
    blocks = padded.reshape(-1, window)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - window + 1], left[window - 1 : n]) & ((1 << 40) - 1)
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[change], np.diff(np.concatenate((change, [len(least)])))


def _selected(data: np.ndarray, levels: np.ndarray, ranks: np.ndarray, window: int, params: DigestParams) -> np.ndarray:
    """Hashes of the selected windows, in order; at least one."""
    if len(data) < window:
        data = np.concatenate((data, np.zeros(window - len(data), np.uint8)))
        levels = entropy_levels(data, window)
    places, runs = _rarest(ranks[levels], window)
    chosen = places[runs >= params.popularity * window]
    if not len(chosen):
        chosen = places[[int(runs.argmax())]]
    out = []
    for at in range(0, len(chosen), 4096):
        words = np.ascontiguousarray(data[chosen[at : at + 4096, None] + np.arange(window)]).view("<u8")
        h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words.shape[1]):
                h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(31)
            h = h * np.uint64(0x94D049BB133111EB)
            out.append(h ^ h >> np.uint64(29))
    return np.concatenate(out)


def digest(text: bytes, levels: np.ndarray, ranks: np.ndarray, params: DigestParams = DigestParams()) -> np.ndarray:
    """Filters as rows of 64-bit words, from a text and its levels. No bytes give no filter; fewer bytes
    than a window are one feature, filled up with zeros."""
    if not text:
        return np.zeros((0, BITS // 64), np.uint64)
    hashes = _selected(np.frombuffer(text, np.uint8), levels, ranks, WINDOW, params)
    n = len(hashes)
    out = np.zeros((-(-n // params.features), BITS // 8), np.uint8)
    which = (np.arange(n) // params.features)[:, None]
    bits = (hashes[:, None] >> np.uint64(11) * np.arange(params.probes, dtype=np.uint64)).astype(np.int64) % BITS
    np.bitwise_or.at(out, (np.broadcast_to(which, bits.shape), bits >> 3), (1 << (bits & 7)).astype(np.uint8))
    return out.view("<u8")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter digest against its best match in the other, averaged."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    size_a = np.bitwise_count(a).sum(axis=1).astype(float)
    size_b = np.bitwise_count(b).sum(axis=1).astype(float)
    total = 0.0
    for i, row in enumerate(a):
        shared = np.bitwise_count(row & b).sum(axis=1).astype(float)
        chance = size_a[i] * size_b / BITS
        most = np.minimum(size_a[i], size_b)
        # a filter with few bits says little about a full one: the larger size counts too
        part = (shared - chance) / np.maximum(most - chance, 1.0) * np.sqrt(most / np.maximum(size_a[i], size_b))
        total += float(np.clip(part.max(), 0, 1))
    return total / len(a)


def shown(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def _runs(column: pa.Array) -> Iterator[list[bytes]]:
    """The valid texts of a column, in runs of about 4 MB."""
    run: list[bytes] = []
    size = 0
    for text in column:
        if text.is_valid:
            run.append(text.as_buffer().to_pybytes())
            size += len(run[-1])
            if size >= 16 * BLOCK:
                yield run
                run, size = [], 0
    if run:
        yield run


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """The rank of every entropy level, the rarest first, counted over all windows.

    At most a row for each level reaches the driver; ties go to the lower level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for texts in _runs(batch.column(0)):
                total += np.bincount(np.concatenate(levels_of(texts)), minlength=LEVELS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["level", "n"])

    counts = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return ranks


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = (("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))


def _bounds(rows: DataFrame, params: DigestParams) -> list[tuple[int, int]]:
    """The first row of each range as (doc_id, mark), in order; they are rows that occur.

    Their number follows the bytes of text. They come from a draw of rows by their hash, ``range_draws``
    for each range, which is what Spark's own range partitioning sends to the driver as well, only less.
    """
    least, total, n = rows.agg(F.min(F.struct("doc_id", "mark")), F.sum(F.octet_length("text")), F.count("*")).first()
    if not n:
        return []
    parts = -(-total // params.range_bytes)
    if parts < 2:
        return [tuple(least)]
    share = min(1.0, params.range_draws * parts / n)
    draw = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(1 << 40)) < int(share * (1 << 40))
    drawn = sorted(tuple(r) for r in rows.where(draw).select("doc_id", "mark").distinct().collect())
    inner = drawn[params.range_draws // 2 :: params.range_draws]
    return sorted({tuple(least), *inner})


def _range_of(edges: list[tuple[int, int]], ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of each row, and whether it is the first of its range."""
    first, second = (np.array(x, np.int64) for x in zip(*edges))
    low, high = np.searchsorted(first, ids), np.searchsorted(first, ids, side="right")
    part = high - 1
    for k in np.flatnonzero(high > low):  # ids that bound a range are told apart by their marks
        part[k] = low[k] + np.searchsorted(second[low[k] : high[k]], marks[k], side="right") - 1
    return part, (first[part] == ids) & (second[part] == marks)


def document_digests(docs: DataFrame, params: DigestParams = DigestParams()) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many, or all, of
    the next document by ascending id; after the last comes the first. Rows of one id are ordered by a
    hash of their text; null ids come last, null texts are empty. Rows are dealt by ranges of that order,
    whose bounds are rows that occur; the first row of each range is also sent to the range before it, so
    each range finds its next documents in itself. Ranges are sorted and then read as a stream, so a task
    holds ``run_bytes`` of text, or one document that is longer. Rows equal in id and text share a range.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    edges = _bounds(rows, params)
    if not edges:
        return docs.sparkSession.createDataFrame([], RESULT)
    ranks = entropy_ranks(docs)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            part, first = _range_of(edges, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
            halo = []
            for k in np.flatnonzero(first):
                if part[k] not in sent:  # of equal rows one is enough
                    sent.add(part[k])
                    halo.append(k)
            take = pa.array(np.concatenate((np.arange(len(part)), np.array(halo, np.int64))))
            where = np.concatenate((part, (part[halo] - 1) % len(edges)))
            late = np.concatenate((np.zeros(len(part), bool), np.ones(len(halo), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(late), *(c.take(take) for c in batch.columns)], names=["part", "late", "doc_id", "mark", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        part, ended, size = None, False, 0
        for batch in batches:
            for own, late, doc_id, value in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if own != part:
                    part, ended = own, False
                if ended:
                    continue
                value = value.as_py()
                held.append((doc_id, value))
                size += len(value)
                ended = late
                if late or size > params.run_bytes and len(held) > 1:
                    yield _compare(held, ranks, params)
                    held, size = ([], 0) if late else (held[-1:], len(value))

    parted = rows.mapInArrow(dealt, "part long, late boolean, doc_id long, mark long, text string")
    ordered = parted.repartition(len(edges), "part").sortWithinPartitions("part", "late", "doc_id", "mark")
    return ordered.select("part", "late", "doc_id", "text").mapInArrow(compare, RESULT)


def _compare(rows: list[tuple[int, str]], ranks: np.ndarray, params: DigestParams) -> pa.RecordBatch:
    """Results of all rows but the last, which follows them."""
    texts = [t for _, t in rows]
    edits = []  # what stays of a text, and what comes from the next
    for text, following in zip(texts, texts[1:]):
        cut = len(text) // 4
        edits.append((text[: len(text) - cut].encode(), following[:cut].encode()))
    data = [t.encode() for t in texts]
    edited = [a + b for a, b in edits]
    levels = levels_of(data)
    # an edited text has the windows of both parts; only those across the seam are new
    side = WINDOW - 1
    seams = levels_of([a[-side:] + b[:side] for a, b in edits])
    seen = [np.concatenate((w[: max(0, len(a) - side)], seam, v[: max(0, len(b) - side)])) for w, v, seam, (a, b) in zip(levels, levels[1:], seams, edits)]
    whole, changed = ([digest(t, w, ranks, params) for t, w in zip(*x)] for x in ((data, levels), (edited, seen)))
    out = [
        (None if doc_id == LAST else doc_id, len(text), hashlib.sha256(edited[k]).hexdigest(), shown(whole[k]), shown(changed[k]), likeness(whole[k], changed[k]), likeness(whole[k], whole[k + 1]))
        for k, (doc_id, text) in enumerate(rows[:-1])
    ]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, (_, kind) in enumerate(KINDS)], names=[name for name, _ in KINDS])
