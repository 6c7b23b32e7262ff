"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are of whole documents, so token labels are inferred first: over all labelled training documents,
words and beginnings of words are counted by how many toxic and how many other documents hold them, and
those that speak for toxic documents most clearly are the candidates; a token with a candidate in a toxic
document is a toxic token, all other tokens are not. From these labelled tokens a chain with two states is
trained by exact gradients (forward-backward). Every token has features: its word, beginnings of it, its
shape and its neighbours; what has never been seen has no weight. The marginals of the chain give the
offending offsets; a logistic curve over their sum and maximum and the length, fitted to the document
labels, gives the score of a document.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .language import crc_of
from .sampling import label_counts, sample_by_label, with_labels

WORD = re.compile(r"\w+")
#: Tokens of one column when a chain is run, and tokens that are run together.
COLUMN, TOGETHER = 128, 1 << 18
#: Words that a worker remembers.
REMEMBERED = 400_000


@dataclass(frozen=True)
class ToxicParams:
    """documents, sample_bytes: labelled documents of each label that train the chain and the curve, whole,
    at most so many and with so much text; they are those with the smallest hash of id and text.
    candidates: words, at most. support, ratio: toxic documents that must hold a candidate, and how many
    times likelier it must be in them. prefixes: lengths of the beginnings of words that count besides
    whole words. bits: of the table of feature weights. steps, rate, decay: of the gradient ascent.
    broadcast_labels: labels that are sent to the documents, at most; more are joined by a shuffle."""

    documents: int = 1_500
    sample_bytes: int = 16 << 20
    candidates: int = 2_000
    support: int = 3
    ratio: float = 8.0
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    bits: int = 20
    steps: int = 60
    rate: float = 0.5
    decay: float = 1e-3
    broadcast_labels: int = 1_000_000


def features_of(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """The word, written with a closing ``$``, and its beginnings, longest first."""
    return [word + "$", *(word[:k] for k in sorted(prefixes, reverse=True) if k < len(word))]


def shape_of(word: str) -> str:
    return "digit" if word.isdigit() else "title" if word.istitle() else "upper" if word.isupper() else "lower" if word.islower() else "other"


@dataclass
class Chain:
    """Scores of state 1 against state 0: a table of feature weights, what every token has, and moves.

    ``move[a, b]`` is the score of state b after state a; ``curve`` turns marginals into a document score.
    """

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    bias: float = -4.0
    prefixes: tuple[int, ...] = ()
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float, float, float] = (-6.0, 0.0, 0.0, 0.0)

    def places(self, word: str) -> tuple[list[int], int, int]:
        """Places in the table: of a token's own features, of being the word before, and the word after."""
        low, mask, digest = word.lower(), len(self.weights) - 1, xxhash.xxh3_64_intdigest
        own = [digest(f"={low}$") & mask, digest(f"#{shape_of(word)}") & mask]
        own += [digest("=" + low[:k]) & mask for k in self.prefixes if k < len(low)]
        return own, digest("<" + low) & mask, digest(">" + low) & mask


class Emissions(dict):
    """Emission scores of the words of texts under a chain.

    As a mapping it numbers words, a bounded number of them, and holds the scores of each: of itself, for
    the word behind it and for the word before it.
    """

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain, self.weights, self.scores = chain, array("f", chain.weights.tolist()), np.zeros((1024, 3))

    def __missing__(self, word: str) -> int:
        own, before, after = self.chain.places(word)
        weight = self.weights.__getitem__
        k = self[word] = len(self)
        if k == len(self.scores):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
        self.scores[k] = sum(map(weight, own)) + self.chain.bias, weight(before), weight(after)
        return k

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        rows = self.scores[ids]
        out = rows[:, 0].copy()
        out[1:] += rows[:-1, 1]
        out[:-1] += rows[1:, 2]
        return out


def _ratios(gain: np.ndarray, first: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``r[t] = gain[t] (m01 + m11 r[t-1]) / (m00 + m10 r[t-1])``, and ``gain[t]`` where a text begins.

    Each step is a linear map of (numerator, denominator). Columns of tokens are composed side by side,
    then the columns are walked, then all ratios follow: three passes, exact for texts of any length.
    """
    n = len(gain)
    size = min(COLUMN, max(1, n))
    wide = -(-n // size)
    own, begins = np.ones(wide * size), np.ones(wide * size, bool)
    own[:n], begins[:n] = gain, first
    own, begins = own.reshape(wide, size).T, begins.reshape(wide, size).T
    a, b = np.ones(wide), np.zeros(wide)  # r -> (a r + b) / (c r + d)
    c, d = np.zeros(wide), np.ones(wide)
    for g, start in zip(own, begins):
        a, b, c, d = g * (m[1, 1] * a + m[0, 1] * c), g * (m[1, 1] * b + m[0, 1] * d), m[1, 0] * a + m[0, 0] * c, m[1, 0] * b + m[0, 0] * d
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
        a, b, c, d = np.where(start, 0, a), np.where(start, g, b), np.where(start, 0, c), np.where(start, 1, d)
    enter = np.ones(wide)
    r = 1.0
    for k, (x, y, z, w) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        enter[k] = r
        r = (x * r + y) / (z * r + w)
    out, r = np.empty((size, wide)), enter
    for i, (g, start) in enumerate(zip(own, begins)):
        r = np.where(start, g, g * (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r))
        out[i] = r
    return out.T.ravel()[:n]


def _forward_backward(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1 of the tokens of texts that follow each other, the ratios of state 1 to 0 from
    before (token included) and from behind (token included), and where texts begin."""
    gain, m = np.exp(np.clip(emit, -30, 30)), np.exp(move)
    ends = np.cumsum(lengths[lengths > 0])
    first, last = np.zeros(len(emit), bool), np.zeros(len(emit), bool)
    last[ends - 1] = True
    first[ends - lengths[lengths > 0]] = True
    before = _ratios(gain, first, m)
    behind = _ratios(gain[::-1], last[::-1], m.T)[::-1]
    odds = before * (behind / gain)
    return odds / (1 + odds), before, behind, first


def marginals(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of state 1 at each token."""
    return _forward_backward(emit, lengths, move)[0] if len(emit) else np.zeros(0)


def _train_chain(chain: Chain, texts: list[list[str]], tags: list[np.ndarray], params: ToxicParams) -> None:
    """Exact gradient ascent on the log likelihood of the tags, over whole texts with all their tokens."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    if not len(ids):
        return
    lengths, gold = np.array([len(t) for t in texts]), np.concatenate(tags).astype(float)
    places = [chain.places(w) for w in number]
    counts = np.array([len(p[0]) for p in places])
    own = np.concatenate([p[0] for p in places])
    owner = np.repeat(np.arange(len(places)), counts)
    before, after = (np.array([p[i] for p in places]) for i in (1, 2))
    n, size, v = len(ids), len(chain.weights), len(places)
    first = np.zeros(n + 1, bool)
    first[np.concatenate(([0], np.cumsum(lengths)))] = True
    inner = np.flatnonzero(~first[1:n])  # places t whose token t + 1 is of the same text
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (gold[inner].astype(int), gold[inner + 1].astype(int)), 1)
    weights, speed = np.zeros(size), np.full(size, 1e-8)
    speed_move, speed_bias = np.full((2, 2), 1e-8), 1e-8
    used = np.unique(np.concatenate((own, before, after)))
    for _ in range(params.steps):
        score = np.bincount(owner, weights[own], v)
        emit = score[ids] + chain.bias
        emit[inner + 1] += weights[before][ids[inner]]
        emit[inner] += weights[after][ids[inner + 1]]
        prob, ahead, behind, _ = _forward_backward(emit, lengths, chain.move)
        diff = gold - prob
        grad = np.bincount(own, np.bincount(ids, diff, v)[owner], size)
        grad += np.bincount(before, np.bincount(ids[inner], diff[inner + 1], v), size)
        grad += np.bincount(after, np.bincount(ids[inner + 1], diff[inner], v), size)
        m = np.exp(chain.move)
        a, g = ahead[inner], behind[inner + 1]
        parts = [m[0, 0], m[0, 1] * g, m[1, 0] * a, m[1, 1] * a * g]
        total = parts[0] + parts[1] + parts[2] + parts[3]
        expected = np.array([(p / total).sum() for p in parts]).reshape(2, 2)
        grad = grad[used] / n - params.decay / n * weights[used]
        speed[used] += grad**2
        weights[used] += params.rate * grad / np.sqrt(speed[used])
        step = (pairs - expected) / n - params.decay / n * chain.move
        speed_move += step**2
        chain.move = chain.move + params.rate * step / np.sqrt(speed_move)
        lean = diff.sum() / n
        speed_bias += lean**2
        chain.bias += float(params.rate * lean / math.sqrt(speed_bias))
    chain.weights = weights.astype(np.float32)


def _features(probs: np.ndarray, n: int) -> tuple[float, float, float]:
    """Sum and maximum of the marginals that stand out, and how long a text it took to gather them."""
    clear = probs[probs > 0.05]
    return (math.log1p(float(clear.sum())), float(clear.max()), math.log1p(n / 100)) if len(clear) else (0.0, 0.0, 0.0)


def _fit_curve(xs: list[tuple[float, float, float]], ys: list[int]) -> tuple[float, float, float, float]:
    """Logistic regression by Newton steps; the slopes over the marginals are never negative."""
    x = np.array([(1.0, *v) for v in xs])
    y = np.array(ys, float)
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
        step = np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -3, 3)
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2])), min(0.0, float(w[3]))


def candidates(known: DataFrame, n_toxic: int, n_clean: int, params: ToxicParams) -> set[str]:
    """Words and beginnings of words that speak for toxic documents, counted over all of ``known``.

    Of equally good ones at the end of the list, the first by their letters count.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[str] = []
            marks: list[int] = []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                held = {part for w in set(WORD.findall(text.as_py())) for part in features_of(w.lower(), params.prefixes)}
                own += held
                marks += [toxic] * len(held)
                if len(own) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(marks, pa.int32())], names=["word", "toxic"])
                    own, marks = [], []
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(marks, pa.int32())], names=["word", "toxic"])

    held = known.select("text", F.col("toxic").cast("int")).mapInArrow(words, "word string, toxic int")
    counts = held.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    ratio = ((F.col("a") + 0.5) / (n_toxic + 1.0)) / ((F.col("b") + 0.5) / (n_clean + 1.0))
    top = counts.where(F.col("a") >= params.support).where(ratio >= params.ratio).orderBy(F.desc(F.col("a") * F.log(ratio)), "word").limit(params.candidates)
    return {r["word"] for r in top.select("word").collect()}


def train(labelled: DataFrame, params: ToxicParams = ToxicParams()) -> Chain:
    """A chain from ``(doc_id, text, toxic)``.

    Word counts cover all rows with a label; the driver gets the candidates and a bounded sample. Without
    toxic rows the chain scores everything low.
    """
    known = labelled.where(F.col("text").isNotNull() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    totals = label_counts(known, "toxic")
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic:
        return Chain()
    chain = Chain(np.zeros(1 << params.bits, np.float32), prefixes=params.prefixes)
    found = candidates(known, n_toxic, n_clean, params)
    texts, labels, tags = [], [], []
    marked: dict[str, bool] = {}
    for text, toxic in sample_by_label(known, "toxic", totals, params.documents, params.sample_bytes):
        words = WORD.findall(text)
        for w in words:
            if w not in marked:
                marked[w] = not found.isdisjoint(features_of(w.lower(), params.prefixes))
        texts.append(words)
        labels.append(toxic)
        tags.append(np.array([bool(toxic) and marked[w] for w in words], bool))
    _train_chain(chain, texts, tags, params)
    emissions = Emissions(chain)
    chain.curve = _fit_curve([_features(marginals(emissions(t), np.array([len(t)]), chain.move), len(t)) for t in texts], labels)
    # the sample is balanced; the curve is moved to the share of toxic documents
    drawn = [labels.count(label) for label in (0, 1)]
    if all(drawn):
        chain.curve = (chain.curve[0] + math.log((n_toxic / n_clean) / (drawn[1] / drawn[0])), *chain.curve[1:])
    return chain


def _scored(texts: list[str], chain: Chain, emissions: Emissions, span_prob: float) -> Iterator[tuple[float, list[dict]]]:
    """Score and spans of each text; many texts run through the chain together."""
    a, b, c, d = chain.curve
    words = [WORD.findall(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    probs = marginals(np.concatenate([emissions(w) for w in words]), lengths, chain.move)
    at = 0
    for text, n in zip(texts, lengths.tolist()):
        own = probs[at : at + n]
        at += n
        total, most, length = _features(own, n)
        found = []
        if n and own.max() >= span_prob:
            places = [m.span() for m in WORD.finditer(text)]
            found = [{"start": places[i][0], "end": places[i][1], "probability": float(own[i])} for i in np.flatnonzero(own >= span_prob)]
        yield 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * total + c * most + d * length)))), found


def tag(docs: DataFrame, chain: Chain, threshold: float = 0.3, span_prob: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` and ``spans``, the offending code-point offsets.

    Null, empty and wordless texts have the least score and no span. Whole texts are tagged; extra
    columns pass through, but result columns replace input columns of the same name. Narrow: no shuffle.
    """
    added = ["score", "predicted", "spans"]
    rows = docs.drop(*added)
    names = rows.columns
    at = names.index("text")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(chain)
        for batch in batches:
            found: list[tuple[float, list[dict]]] = []
            texts: list[str] = []
            size = 0
            for text in batch.column(at):
                texts.append(text.as_py() or "")
                size += len(texts[-1]) // 6 + 1
                if size > TOGETHER:
                    found += _scored(texts, chain, emissions, span_prob)
                    texts, size = [], 0
            if texts:
                found += _scored(texts, chain, emissions, span_prob)
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32()), pa.array([s for _, s in found], spans_type)],
                names=[*names, *added],
            )

    result = T.DataType.fromDDL("score double, predicted int, spans array<struct<start: int, end: int, probability: double>>")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *result.fields]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, params: ToxicParams = ToxicParams()) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` of every document.

    Labels are learned only from rows where crc32 of the id as text, modulo ``folds``, is not
    ``held_out``; a null id is never learned from. Rows of ``labels`` that repeat count once, as toxic if
    one of them is.
    """
    fold = F.pmod(crc_of("doc_id"), F.lit(folds))
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chain = train(with_labels(docs.where(fold != held_out).select("doc_id", "text"), marks, params.broadcast_labels), params)
    rows = docs.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text")
    return tag(rows, chain).select("doc_id", "held_out", "score", "predicted", "spans")
