"""Near copies by the Jaccard similarity of word shingles.

A text is the set of its shingles of five words (fewer words are one shingle). Texts first meet by the Golay-code
keys of their SimHash fingerprints, as in ``simhash``: pairs at 2 or fewer bits, and texts of one fingerprint with one
of them, are verified on the whole sets and linked. Texts of similarity 0.8 differ in 10 bits of 64 on
average, so what these keys do not reach is found by signatures. Each set has a signature of 128
least hashes, in 32 bands of 4: two sets of similarity s agree in a band with probability s ** 4, so of pairs at
0.8 one in 10 ** 7 agrees in none, and of more similar ones fewer. Only keys, 8 bytes a band, are dealt and
counted; signatures, a byte a hash, follow to the keys that two texts or more share.

A key's texts are read one after the other, against those before them that stand for others. One that is very
like another (``sure``) stands for nothing, else for itself; it meets the one most alike of those that it may
resemble (``likely``). So no task holds more of a key than what stands for others; a key of
many texts is dealt in groups, and those that stand for others meet again in further turns.

Of all that a text meets in its keys it is paired with the one most alike, so a round has a pair for each text at
most, however many texts are alike. Pairs are verified on the whole sets, and components follow. In the next
round only keys of several components are read, and a text meets those of other components only. It brings the
partners that it was tried with, one a round, and meets the most alike of the others, so no list of tried pairs is
joined to what meets. Rounds go on while they find links, ``rounds`` at most; they leave few components.

What rounds leave is settled by ``left_links``: in each key of several components every two texts of different
components that may be similar enough are compared on the whole sets, in the task in which they meet, so no pair becomes
a row. A pair is compared in the first band in which it agrees only. Whole sets go to those keys alone in which
a text has such a pair after its sketch. A key of many texts is dealt in blocks, of which each meets each: no task
holds more than two blocks, and the rows of such a key grow with its texts times its blocks.

Whole texts leave their task only if a pair names them or their row is to go, but for one in sixteen of the others:
hashes are sent to the rows as bits (``beside_named``).

What can be missed is a pair that agrees in no band, or in fewer hashes than ``likely``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from seqspark.session import materialize, scratch

from .graph import connected_components
from .names import spare_name
from .simhash import CROWD, fingerprint, fingerprint_links


#: Least hashes of a signature, and of a band of it.
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Words of 64 bits that ``beside_named`` sends at most.
MOST_WORDS = 1 << 20
_draw = np.random.default_rng(7)
FACTORS = _draw.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 1 << 63, HASHES, np.uint64)


@dataclass(frozen=True)
class NearCopyParams:
    """shingle: words of a shingle. least: similarity of a link as a fraction, so that it is exact.

    likely, sure: hashes of 128 in which texts agree that may be similar enough (102 on average at 0.8, 80 is
    five deviations less), and that surely are. rounds: see above; 0 reads no band. hot: texts of a key beyond which it
    is dealt in groups of about so many. turns: how often those that stand for others meet again in a round.
    remembered: texts of which a task knows that it has seen them.
    """

    shingle: int = 5
    least: tuple[int, int] = (4, 5)
    likely: int = 80
    sure: int = 112
    rounds: int = 3
    hot: int = 512
    turns: int = 4
    remembered: int = 1_000_000


def normal_form(text: Column) -> Column:
    """A-Z lower-cased, words between ASCII white space with one blank; null is empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[ \t\n\x0B\f\r]+", " "))


def shingle_set(normal: str, shingle: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text in normal form."""
    joined = normal.encode()
    if not joined:
        return np.zeros(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1))
    ends = np.concatenate((blanks, [len(joined)]))
    n = max(1, len(starts) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def signature(keys: np.ndarray) -> np.ndarray:
    """The least value of each of 128 hashes over a set."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    x = keys.view(np.uint64)
    for i in range(0, len(x), 1024):
        values = (x[i : i + 1024, None] * FACTORS + TERMS) >> np.uint64(32)
        least = np.minimum(least, values.min(axis=0).astype(np.uint32))
    return least


def band_keys(marks: bytes) -> list[int]:
    """A key for each band, which tells the bytes of its hashes: marks tell in which bands two texts meet."""
    return [xxhash.xxh3_64_intdigest(marks[i * ROWS : (i + 1) * ROWS], i) - (1 << 63) for i in range(BANDS)]


def _signed(texts: DataFrame, params: NearCopyParams) -> DataFrame:
    """``(h, bands, marks, fp, sketch)`` of each text with a word, once: a key for each band, a byte of each hash, its
    fingerprint, its sketch."""
    names = ["h", "bands", "marks", "fp", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            own, bands, marks, prints, sketches = [], [], [], [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if h in met:
                    continue
                if len(met) < params.remembered:
                    met.add(h)
                keys = shingle_set(normal := text.as_py(), params.shingle)
                if not len(keys):
                    continue
                prints.append(fingerprint(normal))
                own.append(h)
                marks.append(found := signature(keys).astype(np.uint8).tobytes())
                bands.append(band_keys(found))
                sketches.append(sketch(keys))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sketches, pa.binary())], names=names)

    found = texts.select("h", "normal").mapInArrow(run, "h long, bands array<long>, marks binary, fp long, sketch binary")
    return found.groupBy("h").agg(*[F.first(c).alias(c) for c in names[1:]])


class _Standing:
    """The texts of one key that stand for others, with their components, signatures and tried partners."""

    def __init__(self) -> None:
        self.h: list[int] = []
        self.tried: list[list[int]] = []
        self.component = np.zeros(4, np.int64)
        self.marks = np.zeros((4, HASHES), np.uint8)

    def meet(self, h: int, component: int, marks: bytes, tried: list[int], params: NearCopyParams) -> tuple[int, int] | None:
        """``(text, hashes)`` of the one most alike of those of other components that it was not tried with; it is
        added unless it is surely like one."""
        own, n = np.frombuffer(marks, np.uint8), len(self.h)
        found = None
        if n:
            same = (self.marks[:n] == own).sum(axis=1)
            likely = np.flatnonzero((same >= params.likely) & (self.component[:n] != component))
            for i in likely[np.argsort(-same[likely], kind="stable")].tolist():
                if self.h[i] not in tried and h not in self.tried[i]:
                    found = self.h[i], int(same[i])
                    break
            if same.max() >= params.sure:
                return found
        if n == len(self.marks):
            self.marks = np.concatenate((self.marks, np.zeros_like(self.marks)))
            self.component = np.concatenate((self.component, np.zeros_like(self.component)))
        self.marks[n], self.component[n] = own, component
        self.h.append(h)
        self.tried.append(tried)
        return found


MET = "h long, other long, same int, key long"


def _meetings(rows: DataFrame, signed: DataFrame, turn: int, params: NearCopyParams) -> DataFrame:
    """``(h, other, same, key)`` from ``(key, h, component, tried)``: who meets whom, with a null key, and what stands
    for others in a key that was dealt in groups, with a null other."""
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(counts, "key").join(signed.select("h", "marks"), "h")
    # groups are halved as often as it takes, by the same bits in every band, so that their first texts agree
    groups = F.when(F.col("n") > params.hot, F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / params.hot)))).otherwise(1.0).cast("long")
    met = met.withColumn("part", F.pmod(F.xxhash64("h", F.lit(turn)), groups)).withColumn("dealt", F.col("n") > params.hot)
    met = met.repartition("key", "part").sortWithinPartitions("key", "part", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, dealt = None, _Standing(), False

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["h", "other", "same", "key"])

        def standing() -> list[tuple]:
            return [(h, None, None, last[0]) for h in group.h] if dealt else []

        for batch in batches:
            out: list[tuple] = []
            for key, part, h, component, marks, tried, is_dealt in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part) != last:
                    out += standing()
                    last, group, dealt = (key, part), _Standing(), is_dealt
                if found := group.meet(h, component, marks, tried, params):
                    out.append((h, *found, None))
            yield made(out)
        yield made(standing())

    return met.select("key", "part", "h", "component", "marks", "tried", "dealt").mapInArrow(run, MET)


def _chosen(rows: DataFrame, signed: DataFrame, params: NearCopyParams) -> DataFrame:
    """``(h, other)``, written: each text and the one most alike of those that it meets and was not tried with."""
    found = None
    own = rows.select("h", "component", "tried").distinct()
    for turn in range(params.turns):
        made = materialize(_meetings(rows, signed, turn, params), "meetings")
        met = made.where("key is null").select("h", "other", "same")
        found = met if found is None else found.union(met)
        rows = made.where("key is not null").select("key", "h").join(own, "h")
        if not made.where("key is not null").head(1):
            break
    best = found.groupBy("h").agg(F.max_by("other", F.struct("same", F.least("h", "other"), F.greatest("h", "other"))).alias("other"))
    return materialize(best, "chosen")


def sketch(keys: np.ndarray) -> bytes | None:
    """How many shingles fall in each of as many buckets as half the set, by the low bits of the hash; a
    power of two, so that a longer sketch folds to a shorter one. None if a bucket overflows a byte."""
    size = 64
    while 2 * size < len(keys):
        size *= 2
    counts = np.bincount(keys.view(np.uint64) % np.uint64(size), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def most_shared(a: bytes, b: bytes) -> tuple[int, int]:
    """What two sets can share at most by their sketches, and the sum of their sizes."""
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b))
    size = min(len(x), len(y))
    x, y = (z.reshape(-1, size).sum(axis=0) for z in (x, y))
    return int(np.minimum(x, y).sum()), int(x.sum() + y.sum())


def beside_named(rows: DataFrame, key: Column, named: DataFrame, named_key: Column, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``, true if the hash ``key`` is one of ``named_key``, and for about one in sixteen of the
    others; nothing is shuffled but ``named``.

    Those hashes set bits, sixteen or more for each of them, in words of 64 that are sent to the rows; 2 ** 20 words
    at most, beyond which more of the others are marked.
    """
    n, words = named.count(), 1
    while 4 * words < n and words < MOST_WORDS:
        words *= 2

    def place(x: Column) -> tuple[Column, Column]:
        at = x.bitwiseAND(F.lit(64 * words - 1))
        return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))

    word, bit = place(named_key)
    at, own = place(key)
    sent_word, sent_bits = (spare_name(rows, c) for c in ("_word", "_bits"))
    bits = named.groupBy(word.alias(sent_word)).agg(F.bit_or(bit).alias(sent_bits))
    met = rows.join(F.broadcast(bits), at == F.col(sent_word), "left")
    return met.select(*rows.columns, F.coalesce(F.col(sent_bits).bitwiseAND(own) != 0, F.lit(False)).alias(name))


def named_texts(texts: DataFrame, named: DataFrame) -> DataFrame:
    """The ``texts`` whose ``h`` is named, and about one in sixteen of the others, without a shuffle of texts."""
    return beside_named(texts, F.col("h"), named, F.col("h"), "is_named").where("is_named").drop("is_named")


def _verified(pairs: DataFrame, texts: DataFrame, params: NearCopyParams) -> DataFrame:
    """The pairs whose whole sets reach the similarity.

    Only texts that some pair names are shuffled (see ``named_texts``). Sketches, a tenth of a text, are joined to the pairs
    first and bound what these share; the texts themselves go to the pairs that pass.
    """
    up, down = params.least
    pairs = materialize(pairs.distinct(), "pairs")
    named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "named")
    found = named_texts(texts, named).join(named, "h", "left_semi").groupBy("h").agg(F.first("normal").alias("normal"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([sketch(shingle_set(t.as_py(), params.shingle)) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=["h", "normal", "sketch"])

    texts = materialize(found.mapInArrow(sketched, "h long, normal string, sketch binary"), "texts")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both, total = most_shared(x, y) if x and y else (1, 1)
                stay.append(both * (up + down) >= up * total)
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, own, stay = None, None, []
            for x, y in zip(batch.column(2), batch.column(3)):
                x = x.as_py()
                if x != last:
                    last, own = x, shingle_set(x, params.shingle)
                other = shingle_set(y.as_py(), params.shingle)
                both = len(np.intersect1d(own, other, assume_unique=True))
                stay.append(down * both >= up * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        left, right = (texts.select(F.col("h").alias(end), F.col(column).alias(name)) for end, name in (("a", "x"), ("b", "y")))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")

    pairs = materialize(with_both(pairs, "sketch").mapInArrow(possible, "a long, b long"), "possible")
    return with_both(pairs, "normal").mapInArrow(similar, "a long, b long")


def coded_pairs(signed: DataFrame) -> DataFrame:
    """``(a, b)`` of texts that meet by the Golay-code keys of their fingerprints; of one fingerprint each meets the least."""
    prints = materialize(signed.groupBy("fp").agg(F.min("h").alias("least")), "prints")
    ends = [prints.select(F.col("fp").alias(end), F.col("least").alias(name)) for end, name in (("a", "x"), ("b", "y"))]
    across = fingerprint_links(prints, 2, CROWD).join(ends[0], "a").join(ends[1], "b").select("x", "y")
    within = signed.select("fp", F.col("h").alias("x")).join(prints.select("fp", F.col("least").alias("y")), "fp").select("x", "y")
    return across.union(within).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


class _Met:
    """The texts of a key, or of two of its blocks, and which of them are to be compared."""

    def __init__(self, key: int, rows: list[tuple], params: NearCopyParams):
        """rows: (h, block, component, marks, sketch) of each text."""
        self.params = params
        self.h = [r[0] for r in rows]
        self.block, self.component = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        self.blocks = len(np.unique(self.block))
        self.marks = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, HASHES)
        self.band = band_keys(rows[0][3]).index(key)
        self.length = np.array([len(r[4] or b"") for r in rows])
        self.size = np.zeros(len(rows), np.int64)
        self.sketches: dict[int, np.ndarray] = {}
        found = [np.frombuffer(r[4] or b"", np.uint8).astype(np.int16) for r in rows]
        for length in np.unique(self.length[self.length > 0]).tolist():
            folded = np.zeros((len(rows), length), np.int16)
            for i in np.flatnonzero(self.length >= length).tolist():
                folded[i] = found[i].reshape(-1, length).sum(axis=0)
                self.size[i] = folded[i].sum(dtype=np.int64)
            self.sketches[length] = folded

    def others(self, i: int) -> np.ndarray:
        """Of the texts before ``i``: those of other components that meet it in no band before this one, that it may
        resemble, and whose sketch allows it."""
        js = np.flatnonzero(self.component[:i] != self.component[i])
        if self.blocks > 1:
            js = js[self.block[js] != self.block[i]]
        agree = self.marks[js] == self.marks[i]
        likely = agree.sum(axis=1) >= self.params.likely
        js, agree = js[likely], agree[likely]
        js = js[agree.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == self.band]
        if not len(js) or not self.length[i]:
            return js
        up, down = self.params.least
        stay = self.length[js] == 0
        shorter = np.minimum(self.length[js], self.length[i])
        for length in np.unique(shorter[~stay]).tolist():
            at = np.flatnonzero(shorter == length)
            folded = self.sketches[length]
            both = np.minimum(folded[js[at]], folded[i]).sum(axis=1, dtype=np.int64)
            stay[at] = both * (up + down) >= up * (self.size[js[at]] + self.size[i])
        return js[stay]


def _by_group(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """``(group, rows)`` of sorted rows, whose first ``n`` columns tell the group."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n] != last:
                if rows:
                    yield last, rows
                last, rows = row[:n], []
            rows.append(row[n:])
    if rows:
        yield last, rows


def left_links(named: DataFrame, signed: DataFrame, texts: DataFrame, params: NearCopyParams) -> DataFrame:
    """``(a, b)``: links between the components of ``named(key, h, component)``, such that no two texts of a key are left
    unlinked if their whole sets reach the similarity and they are ``likely``."""
    up, down = params.least
    mixed = named.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    blocks = F.when(F.col("n") > params.hot, F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / params.hot)))).otherwise(1.0).cast("long")
    rows = named.join(mixed.select("key", blocks.alias("blocks")), "key").join(signed.select("h", "marks", "sketch"), "h")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = ["key", "low", "high"]
    held = ["h", "block", "component", "marks", "sketch"]
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *held)
    rows = rows.repartition(*dealt).sortWithinPartitions(*dealt, "h")
    kinds = [pa.int64()] * 6 + [pa.binary()] * 2
    schema = "key long, low long, high long, h long, block long, component long, marks binary, sketch binary"

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _by_group(batches, 3):
            if group[1] != group[2] and len({r[1] for r in rows}) < 2:
                continue
            met, named = _Met(group[0], rows, params), np.zeros(len(rows), bool)
            for i in range(1, len(rows)):
                js = met.others(i)
                named[js] = True
                named[i] |= len(js) > 0
            out = [(*group, *rows[i]) for i in np.flatnonzero(named).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=[*dealt, *held])

    rows = materialize(rows.mapInArrow(asked, schema), "asked")
    named = materialize(rows.select("h").distinct(), "named")
    found = named_texts(texts, named).join(named, "h", "left_semi").groupBy("h").agg(F.first("normal").alias("normal"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(t.as_py(), params.shingle).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["h", "shingles"])

    sets = materialize(found.mapInArrow(hashed, "h long, shingles binary"), "shingles")
    rows = rows.join(sets, "h").select(*dealt, *held, "shingles").repartition(*dealt).sortWithinPartitions(*dealt, "h")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _by_group(batches, 3):
            met = _Met(group[0], rows, params)
            sets = [np.frombuffer(r[-1], np.int64) for r in rows]
            a, b = [], []
            for i in range(1, len(rows)):
                own = sets[i]
                for j in met.others(i).tolist():
                    if met.component[i] == met.component[j]:  # linked since
                        continue
                    other = sets[j]
                    if up * max(len(own), len(other)) > down * min(len(own), len(other)):
                        continue
                    at = np.searchsorted(own, other)
                    both = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                    if down * both >= up * (len(own) + len(other) - both):
                        a.append(met.h[i])
                        b.append(met.h[j])
                        met.component[met.component == met.component[j]] = met.component[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return materialize(rows.mapInArrow(compared, "a long, b long"), "left")


def near_copy_components(texts: DataFrame, params: NearCopyParams = NearCopyParams()) -> DataFrame:
    """``(vertex, component)`` of every text with a near copy found, from ``texts(h, normal)``; h is a hash of
    the normal form and may repeat."""
    signed = materialize(_signed(texts, params), "signed")
    keyed = signed.select(F.explode("bands").alias("key"), "h")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialize(keyed.join(shared.select("key"), "key"), "keys")
    pairs, links, linked, tried = coded_pairs(signed), None, None, None
    if params.rounds:  # marks of texts without a shared key are not read again
        signed = materialize(signed.select("h", "marks", "sketch").join(keyed.select("h").distinct(), "h", "left_semi"), "marks")

    def named_keys(linked: DataFrame) -> DataFrame:
        named = keyed.join(linked.select(F.col("vertex").alias("h"), "component"), "h", "left").withColumn("component", F.coalesce("component", "h"))
        return materialize(named, "named")

    def as_links(linked: DataFrame) -> DataFrame:
        return linked.select(F.col("vertex").alias("a"), F.col("component").alias("b"))

    rows = keyed.select("key", "h", F.col("h").alias("component"), F.array().cast("array<long>").alias("tried"))
    for left in reversed(range(params.rounds)):
        chosen = _chosen(rows, signed, params)
        met = chosen.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b"))
        more = materialize(_verified(met if links is not None else pairs.union(met), texts, params), "links")
        links = more if linked is None else as_links(linked).union(more)
        if not more.head(1):
            break
        linked = materialize(connected_components(links), "linked")
        if not left:
            break
        tried = chosen if tried is None else tried.union(chosen)
        named = named_keys(linked)
        mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
        partners = tried.groupBy("h").agg(F.collect_list("other").alias("tried"))  # one a round at most
        rows = named.join(mixed.select("key"), "key").join(partners, "h", "left")
        rows = materialize(rows.select("key", "h", "component", F.coalesce("tried", F.array().cast("array<long>")).alias("tried")), "mixed")
    if linked is None:
        links = materialize(_verified(pairs, texts, params), "links") if links is None else links
        linked = materialize(connected_components(links), "linked")
    if params.rounds:
        more = left_links(named_keys(linked), signed, texts, params)
        if more.head(1):
            linked = materialize(connected_components(as_links(linked).union(more)), "linked")
    return linked


def one_of_near_copies(docs: DataFrame, params: NearCopyParams = NearCopyParams()) -> DataFrame:
    """``docs`` with one row of each group of near copies: the least by (doc_id, text), nulls last.

    Groups are the connected components of similarity ``least`` or more. Texts of equal normal form are
    one text, so exact copies are never paired; null and empty texts are copies of each other. Tables that
    are written on the way are deleted, but for the short list of rows to remove.
    """
    with scratch(docs.sparkSession) as made:
        kept, used = _kept(docs, params)
        for table in used:
            made.remove(table.written_to)
    return kept


def _kept(docs: DataFrame, params: NearCopyParams) -> tuple[DataFrame, list[DataFrame]]:
    """The rows that stay, and the written tables from which they follow."""
    mark = spare_name(docs, "_mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    normal = normal_form(F.col("text"))
    rows = materialize(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), F.xxhash64(normal).alias("h")), "rows")
    linked = near_copy_components(docs.select(F.xxhash64(normal).alias("h"), normal.alias("normal")), params)
    rows = rows.join(linked.select(F.col("vertex").alias("h"), "component"), "h", "left")
    rows = materialize(rows.select("id", "mark", F.coalesce("component", "h").alias("component")), "rows")
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"))
    first = rows.groupBy("component").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(rows.join(first.select("component", "first"), "component"), "shared")
    leads = F.col("id").eqNullSafe(F.col("first.id"))
    tied = shared.where(leads).groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    tied = materialize(shared.where(leads).join(tied, "component").select("component", "id", "mark").distinct(), "tied")
    gone = shared.where(~leads).select("id", "mark").union(tied.select("id", "mark")).distinct()
    gone = materialize(gone, "gone")

    hit = spare_name(marked, "_hit")
    looked = beside_named(marked, F.xxhash64("doc_id", mark), gone, F.xxhash64("id", "mark"), hit)
    rest, looked = looked.where(~F.col(hit)).select(*docs.columns), looked.where(hit)

    def same(other: DataFrame) -> Column:
        return (looked[mark] == other["mark"]) & looked["doc_id"].eqNullSafe(other["id"])

    kept = rest.union(looked.join(gone, same(gone), "left_anti").select(*docs.columns))
    if tied.head(1):
        text_rank = F.struct(F.col("row.text").isNull(), F.col("row.text"))
        found = looked.join(tied, same(tied)).select(tied["component"].alias("_c"), F.struct(*[looked[c] for c in docs.columns]).alias("row"))
        least = found.groupBy("_c").agg(F.min_by("row", text_rank).alias("row"))
        kept = kept.union(least.select(*[F.col(f"row.{c}").alias(c) for c in docs.columns]))
    return kept, [gone, tied]
