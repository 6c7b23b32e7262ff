"""Language-model scores from subword lattices.

The vocabulary is that of an existing tokenizer file; its order of merges gives the first weights, and
expected counts over the training words re-estimate them. The probability of a word is the sum over all
its segmentations into pieces, by a log-space forward recursion. Pieces never cross words, so the
marginal probability of a document, the sum over all its segmentations, is the product over its words and
its end.

Work is done once for each distinct word of the corpus: a table of words is counted over all documents,
scored there, and joined back to the documents. Words that are frequent in the corpus, a bounded number,
are looked up from a broadcast instead, so only rare words are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from seqspark.session import materialize

from .language import crc_of

SPACE = "▁"
ROOT = np.uint64(0x100000001B3)
#: Words longer than this are scored one by one, shorter ones together with others of their length.
TOGETHER = 48


@dataclass(frozen=True)
class LmParams:
    """head: frequent words that are broadcast, at most. held: distinct words that a task counts before it
    passes them on. warm_rounds, rounds: re-estimations of the piece weights, first over the frequent words,
    then over all training words. pseudo: added to each expected count."""

    head: int = 1 << 17
    held: int = 400_000
    warm_rounds: int = 8
    rounds: int = 1
    pseudo: float = 0.1


def pieces_of(model_path: str) -> list[str]:
    """Normal pieces of the vocabulary file, by rank. Byte pieces are one further arc (see Lattice)."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of the rows: (n, length + 1)."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * ROOT + codes[:, j]
    return out


class Lattice:
    """Arcs of words: every piece that matches, and for every character a fallback of its UTF-8 bytes.

    ``weights`` are log probabilities of the pieces, then of any fallback byte, then of the end of a
    text; they sum to one. The 256 bytes share theirs evenly.
    """

    def __init__(self, pieces: list[str], weights: np.ndarray | None = None):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.number = {p: i for i, p in enumerate(pieces)}
        n = len(pieces)
        if weights is None:  # by rank, as word frequencies fall
            counts = np.concatenate((1.0 / (np.arange(n) + 50.0), [1e-4, 1e-2]))
            weights = np.log(counts / counts.sum())
        self.weights = weights
        self.byte = weights[-2] - math.log(256)
        hashes = np.zeros(n, np.uint64)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append(i)
        for length, own in by_length.items():
            codes = np.array([[ord(c) for c in pieces[i]] for i in own], np.uint64).reshape(-1, length)
            hashes[own] = self._mix(_hash(codes)[:, length], length)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    @staticmethod
    def _mix(h: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
            return h ^ (h >> np.uint64(31))

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, or -1."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
        if len(maybe):
            place = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            good = self.hashes[place] == h[maybe]
            out[maybe[good]] = self.order[place[good]]
        return out

    def _arcs(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece numbers for every stretch (i, j) that some row has as a piece."""
        n, length = codes.shape
        prefix = _hash(codes)
        power = np.ones(length + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                power[k + 1] = power[k] * ROOT
            arcs = {}
            for j in range(1, length + 1):
                for i in range(max(0, j - self.longest), j):
                    found = self._lookup(self._mix(prefix[:, j] - prefix[:, i] * power[j - i], j - i))
                    if (found >= 0).any():
                        arcs[i, j] = found
        return arcs

    @staticmethod
    def _bytes(codes: np.ndarray) -> np.ndarray:
        return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)

    def _forward(self, codes: np.ndarray, arcs: dict) -> np.ndarray:
        n, length = codes.shape
        with_none = np.concatenate((self.weights, [-np.inf]))
        fallback = self._bytes(codes) * self.byte
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, length + 1):
            terms = [alpha[:, j - 1] + fallback[:, j - 1]]
            terms += [alpha[:, i] + with_none[arcs[i, j]] for i in range(max(0, j - self.longest), j) if (i, j) in arcs]
            stack = np.stack(terms)
            top = stack.max(axis=0)
            alpha[:, j] = top + np.log(np.exp(stack - top).sum(axis=0))
        return alpha

    def log_probs(self, words: list[str]) -> np.ndarray:
        """The natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for rows, codes in self._groups(words):
            if codes.shape[1] > TOGETHER:
                out[rows] = self._long_paths(codes[0], self._long_arcs(codes[0]))[-1]
                continue
            out[rows] = self._forward(codes, self._arcs(codes))[:, -1]
        return out

    def _groups(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(k)
        for length, rows in by_length.items():
            step = 4_096 if length <= TOGETHER else 1
            for at in range(0, len(rows), step):
                own = rows[at : at + step]
                text = "".join(SPACE + words[k] for k in own)
                yield own, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(len(own), length)

    def _long_arcs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(begin, end, piece)`` of every piece in one long word, by where they end: one look-up for each length."""
        prefix, h, root, mask = [0], 0, int(ROOT), (1 << 64) - 1
        for c in codes.tolist():
            h = (h * root + c) & mask
            prefix.append(h)
        hashes = np.array(prefix, np.uint64)
        begins, ends, pieces = [], [], []
        for size in range(1, min(self.longest, len(codes)) + 1):
            with np.errstate(over="ignore"):
                found = self._lookup(self._mix(hashes[size:] - hashes[:-size] * np.uint64(pow(root, size, 1 << 64)), size))
            at = np.flatnonzero(found >= 0)
            begins.append(at)
            ends.append(at + size)
            pieces.append(found[at])
        begin, end, piece = map(np.concatenate, (begins, ends, pieces))
        order = np.argsort(end, kind="stable")
        return begin[order], end[order], piece[order]

    def _long_paths(self, codes: np.ndarray, arcs: tuple[np.ndarray, np.ndarray, np.ndarray], from_end: bool = False) -> list[float]:
        """The forward sums of one long word or, from its end, the backward sums."""
        begin, end, piece = arcs
        n, weights = len(codes), self.weights[piece]
        single = self._bytes(codes) * self.byte
        if from_end:  # the same walk over the mirrored word
            order = np.argsort(-begin, kind="stable")
            begin, end, weights, single = n - end[order], n - begin[order], weights[order], single[::-1]
        first = np.searchsorted(end, np.arange(n + 2)).tolist()
        begin, weights, single = begin.tolist(), weights.tolist(), single.tolist()
        sums = [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = [sums[j - 1] + single[j - 1]]
            terms += [sums[begin[k]] + weights[k] for k in range(first[j], first[j + 1])]
            top = max(terms)
            sums[j] = top + math.log(sum(map(math.exp, [t - top for t in terms])))
        return sums[::-1] if from_end else sums

    def _long_expected(self, codes: np.ndarray, count: float, out: np.ndarray) -> None:
        """Adds the expected uses in one long word that occurs ``count`` times."""
        begin, end, piece = arcs = self._long_arcs(codes)
        alpha, beta = (np.array(self._long_paths(codes, arcs, way)) for way in (False, True))
        weight = math.log(count) - alpha[-1] if count > 0 else -np.inf
        np.add.at(out, piece, np.exp(alpha[begin] + self.weights[piece] + beta[end] + weight))
        size = self._bytes(codes)
        out[-3] += float((np.exp(alpha[:-1] + size * self.byte + beta[1:] + weight) * size).sum())

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, and of fallback bytes, over all segmentations of counted words."""
        out = np.zeros(len(self.weights) + 1)
        with_none = np.concatenate((self.weights, [-np.inf]))
        for rows, codes in self._groups(words):
            if codes.shape[1] > TOGETHER:
                self._long_expected(codes[0], float(counts[rows[0]]), out)
                continue
            arcs = self._arcs(codes)
            n, length = codes.shape
            alpha = self._forward(codes, arcs)
            size = self._bytes(codes)
            beta = np.full((n, length + 1), -np.inf)
            beta[:, length] = 0
            for i in range(length - 1, -1, -1):
                terms = [beta[:, i + 1] + size[:, i] * self.byte]
                terms += [beta[:, j] + with_none[arcs[i, j]] for j in range(i + 1, min(length, i + self.longest) + 1) if (i, j) in arcs]
                stack = np.stack(terms)
                top = stack.max(axis=0)
                beta[:, i] = top + np.log(np.exp(stack - top).sum(axis=0))
            weight = np.log(counts[rows]) - alpha[:, length]
            for (i, j), found in arcs.items():
                np.add.at(out, found, np.where(found >= 0, np.exp(alpha[:, i] + with_none[found] + beta[:, j] + weight), 0))
            for i in range(length):
                use = np.exp(alpha[:, i] + size[:, i] * self.byte + beta[:, i + 1] + weight)
                out[-3] += float((use * size[:, i]).sum())
        return out[:-1]


def _word_counts(docs: DataFrame, params: LmParams) -> DataFrame:
    """``(word, c, f)``: occurrences in training documents and in all. Each task combines before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter(), Counter()]

        def out() -> pa.RecordBatch:
            words = list(dict.fromkeys([*held[0], *held[1]]))
            c = [held[1][w] for w in words]
            f = [held[0][w] + n for w, n in zip(words, c)]
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(f, pa.int64())], names=["word", "c", "f"])

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1).to_pylist()):
                held[train].update((text.as_py() or "").encode().lower().split())
                if len(held[0]) + len(held[1]) > params.held:
                    yield out()
        yield out()

    partial = docs.select("text", (~F.col("held_out")).alias("train")).mapInArrow(run, "word string, c long, f long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("f").alias("f"))


def _expected_counts(words: DataFrame, pieces: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected piece counts over all training words, each as often as it occurs; one row for each piece
    at most reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, weights)
        total = np.zeros(len(weights))
        for batch in batches:
            total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(weights))
    for r in rows:
        out[r["piece"]] = r["n"]
    return out


def learn_weights(counted: DataFrame, n_docs: int, pieces: list[str], params: LmParams = LmParams()) -> np.ndarray:
    """Log weights of the pieces, of fallback bytes and of the end, from ``counted(word, c, f)``, whose
    ``c`` are occurrences in ``n_docs`` training documents. They raise the likelihood of those by
    expectation and maximisation; all words count in the last rounds."""
    weights = Lattice(pieces).weights
    frequent = _frequent(counted, params.head)
    for source in [counted.where(frequent)] * params.warm_rounds + [counted] * params.rounds:
        expected = _expected_counts(source, pieces, weights)
        expected[-1] = n_docs
        expected += params.pseudo
        weights = np.log(expected / expected.sum())
    return weights


def _frequent(words: DataFrame, limit: int) -> Column:
    """The condition of the most frequent words, at most ``limit``, from a histogram of frequencies."""
    bucket = F.floor(F.log("f") * 24).cast("int")
    total, least = 0, None
    for r in sorted(words.groupBy(bucket.alias("b")).count().collect(), key=lambda r: -r["b"]):
        total += r["count"]
        if total > limit:
            break
        least = r["b"]
    return F.lit(False) if least is None else bucket >= least


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _score_documents(docs: DataFrame, head: dict[str, tuple[int, float]], n_train: int, v: int, end: tuple[int, float]) -> DataFrame:
    """For each document one row with ``word`` null and its sums over frequent words and the end, and one
    row for each of its distinct rare words."""
    log_rest = math.log10(n_train + 0.5 * (v + 1))
    cast = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index((w.encode(), i) for i, w in enumerate(cast.value))
        count = np.array([c for c, _ in cast.value.values()] + [0], np.int64)
        base = np.log10(count + 0.5) - log_rest
        lp = np.array([x for _, x in cast.value.values()] + [0.0])
        base[-1] = lp[-1] = 0
        part = TaskContext.get().partitionId()
        number = 0
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for doc_id, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or "").encode().lower().split()
                places = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                key = part << 36 | number
                number += 1
                row = (key, doc_id, held_out, None, 1, len(words) + 1, int((count[places] > 0).sum()) + (end[0] > 0))
                sums = (float(base[places].sum()) + math.log10(end[0] + 0.5) - log_rest, float(lp[places].sum()) + end[1])
                for c, x in zip(cols, row + sums):
                    c.append(x)
                rare = Counter([words[i] for i in np.flatnonzero(places < 0)])
                n = len(rare)
                for c, xs in zip(cols, ([key] * n, [None] * n, [None] * n, rare, rare.values(), [None] * n, [None] * n, [None] * n, [None] * n)):
                    c.extend(xs)
            cols[3] = pa.array(cols[3], pa.binary()).cast(pa.string())
            kinds = [pa.int64(), pa.int64(), pa.bool_(), None, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([c if k is None else pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "doc_id", "held_out", "word", "n", "n_tokens", "n_known", "base", "lp"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "key long, doc_id long, held_out boolean, word string, n long, n_tokens long, n_known long, base double, lp double")


def document_scores(docs: DataFrame, model_path: str, folds: int = 5, held_out: int = 1, params: LmParams = LmParams()) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document.

    Tokens are words between ASCII white space, A-Z lower-cased, and one end. Training documents are
    those whose crc32 of the id as text, modulo ``folds``, is not ``held_out``; a null id is held out of
    training but not marked. ``base_score`` is the smoothed unigram log10 probability, ``score`` that of
    the lattice of pieces, over all segmentations. A word of n characters takes time in n: 16 look-ups
    for each, in one worker. Null and empty texts have the end alone; repeated rows each count and each have a
    row; extra columns are not read; an empty table gives an empty one.
    """
    fold = F.pmod(crc_of("doc_id"), F.lit(folds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold == held_out, F.lit(True)).alias("held_out"))
    marked = rows.withColumn("held_out", F.col("held_out") & F.col("doc_id").isNotNull())
    counted = materialize(_word_counts(rows, params), "words")
    n_docs = rows.where(~F.col("held_out")).count()
    total, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_train, v = total + n_docs, v + (n_docs > 0)

    pieces = pieces_of(model_path)
    weights = learn_weights(counted, n_docs, pieces, params)
    frequent = _frequent(counted, params.head)
    end = float(weights[-1]) / math.log(10)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, weights)
        for batch in batches:
            lp = lattice.log_probs(batch.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp)], names=["word", "c", "f", "lp"])

    words = materialize(counted.mapInArrow(score, "word string, c long, f long, lp double"), "scored")
    head = {r["word"]: (r["c"], r["lp"]) for r in words.where(frequent).select("word", "c", "lp").toLocalIterator()}
    parts = materialize(_score_documents(marked, head, n_train, v, (n_docs, end)), "parts")

    log_rest = math.log10(n_train + 0.5 * (v + 1))
    rare = parts.where(F.col("word").isNotNull()).select("key", "word", "n").join(words, "word")
    summed = rare.select(
        "key",
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("boolean").alias("held_out"),
        F.lit(0).cast("long").alias("n_tokens"),
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"),
        (F.col("n") * (F.log10(F.col("c") + 0.5) - log_rest)).alias("base"),
        (F.col("n") * F.col("lp")).alias("lp"),
    )
    whole = parts.where(F.col("word").isNull()).select(summed.columns).union(summed)
    return (
        whole.groupBy("key")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "lp")])
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score"))
    )
