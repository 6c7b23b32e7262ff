"""Quality of documents by supervised subword embeddings.

A token has features: itself, the character n-grams of ``<token>`` and, if it is the one before it again, a
pair of equal tokens, whichever it is. Features are hashed to rows of a table of vectors.
The vectors of all features of a document are averaged, and a softmax over two outputs of the average is the
probability of each label. Vectors and outputs are learned by stochastic gradient descent, a document a step.

The outputs are linear in the average, so for a score each feature counts by one number, the product of its
vector with the difference of the two outputs; these numbers are all that is sent to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .language import crc_of
from .sampling import label_counts, sample_by_label, with_labels

#: Tokens that a worker remembers, and characters of one of them.
REMEMBERED, REMEMBERED_CHARS = 400_000, 100
#: Character n-grams that a worker remembers; they repeat far more than tokens do.
REMEMBERED_GRAMS = 400_000
#: The feature of a token that follows itself; no token holds a blank.
AGAIN = "= ="


@dataclass(frozen=True)
class QualityParams:
    """documents, sample_bytes: labelled documents of each label that are learned from, whole, at most so many
    and with so much text; they are those with the smallest hash of id and text. grams: lengths of character
    n-grams. bits: of the table of vectors. size: of a vector. epochs, rate: passes over the sample and the
    first step size, which falls to 0. broadcast_labels: labels that are sent to the documents, at most;
    more are joined by a shuffle."""

    documents: int = 1_000
    sample_bytes: int = 12 << 20
    grams: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    size: int = 8
    epochs: int = 6
    rate: float = 4.0
    broadcast_labels: int = 1_000_000


def token_features(token: str, grams: tuple[int, ...], mask: int) -> list[int]:
    """Rows of the table for a token and its n-grams, repeats included."""
    digest, s = xxhash.xxh3_64_intdigest, f"<{token}>"
    return [digest("=" + token) & mask, *(digest(s[i : i + k]) & mask for k in grams for i in range(len(s) - k + 1))]


def repeats(tokens: list[str]) -> int:
    """How often a token follows itself."""
    return sum(map(str.__eq__, tokens, tokens[1:]))


def document_features(text: str, params: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares, which sum to 1."""
    mask, rows, times = (1 << params.bits) - 1, [], []
    tokens = text.split()
    if again := repeats(tokens):
        rows.append(xxhash.xxh3_64_intdigest(AGAIN) & mask)
        times.append(again)
    for token, n in Counter(tokens).items():
        own = token_features(token, params.grams, mask)
        rows += own
        times += [n] * len(own)
    found, at = np.unique(np.array(rows, np.int32), return_inverse=True)
    shares = np.bincount(at, times, len(found)) if len(found) else np.zeros(0)
    return found, (shares / max(1.0, shares.sum())).astype(np.float32)


@dataclass
class Embeddings:
    """vectors: a row for each feature; outputs, bias: of the labels 0 and 1."""

    vectors: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    params: QualityParams

    def probability(self, text: str) -> float:
        """Of label 1, from the averaged vectors."""
        rows, shares = document_features(text, self.params)
        logits = self.outputs @ (shares @ self.vectors[rows]) + self.bias
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(logits[1] - logits[0]))))))

    def numbers(self) -> tuple[np.ndarray, float]:
        """What each feature counts for label 1 against 0, and what every document starts from."""
        return self.vectors @ (self.outputs[1] - self.outputs[0]), float(self.bias[1] - self.bias[0])


def learn(sample: list[tuple[str, int]], params: QualityParams) -> Embeddings:
    """Stochastic gradient descent on the log loss; the order is drawn from a fixed seed."""
    draw = np.random.default_rng(0)
    vectors = ((draw.random((1 << params.bits, params.size), np.float32) - 0.5) / params.size).astype(np.float32)
    outputs, bias = np.zeros((2, params.size), np.float32), np.zeros(2, np.float32)
    known = [(*document_features(text, params), label) for text, label in sample]
    steps, done = max(1, len(known) * params.epochs), 0
    for _ in range(params.epochs):
        for i in draw.permutation(len(known)).tolist():
            rows, shares, label = known[i]
            rate = params.rate * (1 - done / steps)
            done += 1
            own = vectors[rows]
            mean = shares @ own
            logits = outputs @ mean + bias
            odds = np.exp(logits - logits.max())
            error = -odds / odds.sum()
            error[label] += 1
            vectors[rows] = own + np.outer(rate * shares, error @ outputs).astype(np.float32)
            outputs += np.outer(rate * error, mean).astype(np.float32)
            bias += (0.01 * rate * error).astype(np.float32)
    return Embeddings(vectors, outputs, bias, params)


def train(labelled: DataFrame, params: QualityParams = QualityParams()) -> Embeddings:
    """Embeddings from ``(doc_id, text, quality)``.

    The counts cover all rows with a label; the driver gets a bounded sample, as many of each label as there
    are, and the bias is moved from its share of labels to that of all rows. Without rows nothing is learned
    and every score is 0.5.
    """
    known = labelled.where(F.col("text").isNotNull() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    totals = label_counts(known, "quality")
    sample = sample_by_label(known, "quality", totals, params.documents, params.sample_bytes)
    model = learn(sample, params)
    drawn = Counter(label for _, label in sample)
    if len(drawn) == 2:
        model.bias[1] += math.log((totals[1] / totals[0]) / (drawn[1] / drawn[0]))
    return model


class GramNumbers(dict):
    """The number of each character n-gram; a bounded number is remembered."""

    def __init__(self, numbers: list[float]):
        super().__init__()
        self.numbers, self.mask = numbers, len(numbers) - 1

    def __missing__(self, gram: str) -> float:
        if len(self) >= REMEMBERED_GRAMS:
            self.clear()
        found = self[gram] = self.numbers[xxhash.xxh3_64_intdigest(gram) & self.mask]
        return found


class TokenNumbers(dict):
    """The number of each token and of how many features it is the sum; a bounded number is remembered."""

    def __init__(self, numbers: np.ndarray, params: QualityParams):
        super().__init__()
        self.numbers, self.params, self.mask = numbers.tolist(), params, len(numbers) - 1
        self.grams = GramNumbers(self.numbers)
        self.again = self.numbers[xxhash.xxh3_64_intdigest(AGAIN) & self.mask]

    def __missing__(self, token: str) -> tuple[float, int]:
        s, n = f"<{token}>", len(token) + 2
        grams = [s[i : i + k] for k in self.params.grams for i in range(n - k + 1)]
        own = self.numbers[xxhash.xxh3_64_intdigest("=" + token) & self.mask]
        found = sum(map(self.grams.__getitem__, grams), own), 1 + len(grams)
        if len(token) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = found
        return found

    def logit(self, text: str) -> float:
        """Of the averaged features; 0 for a text without a token."""
        tokens = text.split()
        if not tokens:
            return 0.0
        sums, counts = zip(*map(self.__getitem__, tokens))
        again = repeats(tokens)
        return (math.fsum(sums) + again * self.again) / (sum(counts) + again)


def rate(docs: DataFrame, model: Embeddings, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1, and ``predicted``.

    Whole texts are read. Null, empty and blank texts have no feature and get the share of label 1. Extra
    columns pass through; result columns replace input columns of the same name. Narrow: no shuffle.
    """
    added = ["score", "predicted"]
    rows = docs.drop(*added)
    names = rows.columns
    at = names.index("text")
    numbers, start = model.numbers()
    params, spark = model.params, docs.sparkSession
    shared = spark.sparkContext.broadcast(numbers.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenNumbers(shared.value, params)
        for batch in batches:
            logits = np.array([start + tokens.logit(t.as_py() or "") for t in batch.column(at)], float)
            scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*names, *added])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields]).add("score", "double").add("predicted", "integer"))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, params: QualityParams = QualityParams()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document.

    Labels are learned only from rows where crc32 of the id as text, modulo ``folds``, is not ``held_out``; a
    null id belongs to no fold and is never learned from. Rows of ``labels`` that repeat count once, with the
    lowest label. An empty table gives no row.
    """
    fold = F.pmod(crc_of("doc_id"), F.lit(folds))
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    model = train(with_labels(docs.where(fold != held_out).select("doc_id", "text"), marks, params.broadcast_labels), params)
    rows = docs.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text")
    return rate(rows, model).select("doc_id", "held_out", "score", "predicted")
