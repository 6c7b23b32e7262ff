"""Near-duplicate groups by SimHash with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut in three segments of 22, 21 and 21 bits, each a shortened word of the
perfect binary Golay code (23, 12, 7): every word lies within 3 bits of exactly one codeword, whose
12-bit index is its hash. The words one bit away decode to up to five other codewords, so two segments
that differ in at most one bit share an index of one's own word and the other's neighbourhood.

Two fingerprints at 2 or fewer differing bits have, by the pigeonhole principle, a segment without
error, and either each of the others has at most one error, or another one has none too. So the keys
are, for each segment taken as exact: (exact, own index, neighbour index) against (exact, neighbour
index, own index), and the three exact pairs. Equal keys are joined and verified by counting bits.

A key that many distinct fingerprints share would give all their pairs. Those fingerprints are linked
exactly without pairs: each emits its 65 words within one bit, and fingerprints that meet in a word
are within two bits of each other; at most 65 fingerprints can meet in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from seqspark.session import materialize

from .graph import connected_components

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code.
GENERATOR = 0b101011100011
#: Segments as (lowest bit, width).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints under one key beyond which they are linked by the words around them.
CROWD = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash: A-Z lower-cased, words between ASCII white space, ``shingle``-word
    shingles with repeats, XXH64 with seed 42; a bit is set if it is in more than half the hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    set_bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        block = slice(at, at + (1 << 16))
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[block], ends[block])], dtype="<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row for each row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


@cache
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits combined by exclusive or, and the error of each syndrome."""
    single = np.zeros(23, np.int64)
    for bit in range(23):
        rest = 1 << bit
        for high in range(22, 10, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - 11)
        single[bit] = rest
    words = np.arange(1 << 12)
    low = np.bitwise_xor.reduce([np.where(words >> b & 1, single[b], 0) for b in range(12)], axis=0)
    high = np.bitwise_xor.reduce([np.where(words >> b & 1, single[b + 12], 0) for b in range(11)], axis=0)
    errors = np.zeros(1 << 11, np.int64)
    for a in range(23):
        for b in range(a + 1):
            for c in range(b + 1):
                errors[single[a] ^ (single[b] if b < a else 0) ^ (single[c] if c < b < a else 0)] = 1 << a | (1 << b if b < a else 0) | (1 << c if c < b < a else 0)
    errors[0] = 0
    return np.stack((low, high)), errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    syndromes, errors = _decoder()
    return (words ^ errors[syndromes[0][words & 0xFFF] ^ syndromes[1][words >> 12]]) >> 11


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key, side)`` of every key; sides 0 and 1 are to meet, 2 meets itself."""
    segments = [(prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    own = [codeword_index(s) for s in segments]
    around = [codeword_index(s[:, None] ^ np.concatenate(([0], 1 << np.arange(width)))) for s, (_, width) in zip(segments, SEGMENTS)]
    rows, keys, sides = [], [], []
    every = np.arange(len(prints))

    def put(row: np.ndarray, key: np.ndarray, kind: int, side: int) -> None:
        rows.append(row)
        keys.append(key | kind << 56)
        sides.append(np.full(len(row), side, np.int8))

    for exact in range(3):
        p, q = [s for s in range(3) if s != exact]
        put(every, segments[p] << 22 | segments[q], 3 + exact, 2)
        for near, far, side in ((p, q, 0), (q, p, 1)):
            found = np.sort(around[near], axis=1)
            first = np.ones(found.shape, bool)
            first[:, 1:] = found[:, 1:] != found[:, :-1]
            row, _ = np.nonzero(first)
            indices = (found[first], own[far][row])
            a, b = indices if side == 0 else indices[::-1]
            put(row, segments[exact][row] << 24 | a << 12 | b, exact, side)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(sides)


def _keys(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                row, key, side = golay_keys(own.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(own[row])], names=["key", "side", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, side byte, fp long")


def fingerprint_links(prints: DataFrame, max_bits: int, crowd: int) -> DataFrame:
    """``(a, b)`` that link the distinct fingerprints ``fp`` of ``prints`` at ``max_bits`` or fewer, by Golay-code keys."""
    keys = _keys(prints)
    crowded = materialize(keys.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    sparse = keys.join(crowded, "key", "left_anti")
    left = sparse.where("side != 1").select("key", F.col("side").alias("a_side"), F.col("fp").alias("a"))
    right = sparse.where("side != 0").select("key", F.col("side").alias("b_side"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    once = (F.col("a") != F.col("b")) & (F.col("a_side") + F.col("b_side") != 2) | (F.col("a") < F.col("b")) & (F.col("a_side") == 2) & (F.col("b_side") == 2)
    pairs = left.join(right, "key").where(once & near).select("a", "b")

    hot = keys.join(crowded, "key", "left_semi").select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    words = hot.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("word"))
    met = words.groupBy("word").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    return pairs.union(stars)


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs(doc_id, text, ...)``.

    Documents link at 2 or fewer differing bits; the component id is the least doc id that can be
    reached, its own included. Null and empty texts have fingerprint zero and link like any other.
    A null doc id takes part but never names a component unless no other id is there (then null).
    Exact copies share one fingerprint and are never paired: they are counted once and joined back.
    """
    prints = materialize(fingerprints(docs, shingle), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = connected_components(fingerprint_links(distinct, 2, crowd))
    linked = distinct.join(linked, distinct["fp"] == linked["vertex"]).select("fp", "least", "component")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.join(names, "component").select("fp", "component_id")
    lookup = materialize(distinct.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "lookup")
    return prints.join(lookup, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the least id.

    Where an id repeats, its least text stays. Documents with a null id stay. The ids to remove, not the
    ids to keep, are joined: they are fewer, and a short list is broadcast by Spark's own size limit.
    """
    groups = materialize(near_duplicate_groups(docs, shingle), "groups")
    ids = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    own = ids.agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("n"))
    own = materialize(own.where("stays = 0 or n > 1"), "removed")
    kept = docs.join(own.where("stays = 0"), "doc_id", "left_anti")
    repeated = own.where("stays = 1").select("doc_id")
    if repeated.head(1):
        others = kept.join(repeated, "doc_id", "left_anti")
        least = kept.join(repeated, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("row"))
        kept = others.select(*docs.columns).union(least.select(*[F.col(f"row.{c}").alias(c) for c in docs.columns]))
    return kept.select(*docs.columns)
