"""Language identification by compression.

Each language has a zstandard raw-content dictionary: slices of labelled documents. A text is encoded
once with every dictionary, in blocks, and the dictionary with the smallest output names its language.
A text whose two smallest outputs are nearly equal is rejected, whatever the others are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

LETTERS = re.compile(r"[^\W\d_]+")
FILLER = b" " + b"qxzjvkqqxjzzkvqwxzjqkvvzxwqjk" * 4
#: Matches of three letters count: greedy search over the whole dictionary.
SEARCH = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 4, "min_match": 3, "target_length": 0, "strategy": zstandard.STRATEGY_GREEDY}


@dataclass(frozen=True)
class LanguageParams:
    """Bounds of the training sample and of the decision.

    documents, slice_chars: a dictionary holds one slice of up to ``slice_chars`` characters of each of
    up to ``documents`` labelled documents, those with the smallest hash of their id; it is the only
    thing learned, so at most ``documents * slice_chars`` characters of each language reach the driver.
    block_chars: texts are encoded in blocks of so many characters, so that the dictionary keeps its
    weight in long texts. Each block is followed by a filler, because zstandard stores what it cannot
    shrink and so would hide small differences. spread: bytes of difference that make a language e times
    likelier. min_margin: a text is rejected if its second best output is larger than the best by less
    than this share; on labelled documents of sf0.1 0.2 % are, all of them a few words over and over.
    """

    documents: int = 60
    slice_chars: int = 1_500
    block_chars: int = 512
    spread: float = 2.0
    min_margin: float = 0.02


def crc_of(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def letters_only(text: str) -> str:
    return " ".join(LETTERS.findall(text.lower()))


def learn_dictionaries(labelled: DataFrame, params: LanguageParams = LanguageParams()) -> dict[str, bytes]:
    """``{lang: dictionary content}`` from a table of ``(doc_id, text, lang)``, one for every language.

    The counts cover all labelled rows; the sample is bounded by the parameters and depends only on the
    rows: of the rows of one id in a language the least slice counts, and ids are taken by their hash.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * params.documents / r["count"]))])
    drawn = known.withColumn("draw", draw).where(F.col("draw") < F.try_element_at(share, F.col("lang")) * F.lit(float(1 << 30)))
    room = F.greatest(F.lit(1), F.length("text") - params.slice_chars)
    piece = F.substring("text", F.pmod(F.col("draw"), room) + 1, F.lit(params.slice_chars))
    one = drawn.select("lang", "draw", piece.alias("piece")).groupBy("lang", "draw").agg(F.min("piece").alias("piece"))
    first = one.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= params.documents)
    found: dict[str, list] = {}
    for r in sorted(first.collect(), key=lambda r: (r["lang"], r["draw"])):
        found.setdefault(r["lang"], []).append(letters_only(r["piece"]))
    return {lang: " \n".join(dict.fromkeys(pieces)).encode() for lang, pieces in sorted(found.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], params: LanguageParams):
        self.params, self.langs = params, list(dictionaries)
        self.sizes_of = []
        for content in dictionaries.values():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            search = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            if data is not None:
                data.precompute_compress(compression_params=search)
            self.sizes_of.append(zstandard.ZstdCompressor(compression_params=search, dict_data=data).compress)

    def sizes(self, text: str | None) -> np.ndarray | None:
        """Bytes of the whole text under each dictionary; None without a letter or a dictionary."""
        letters = letters_only(text) if text else ""
        if not letters or not self.langs:
            return None
        step = self.params.block_chars
        blocks = [letters[i : i + step].encode() + FILLER for i in range(0, len(letters), step)]
        return np.array([sum(map(len, map(compress, blocks))) for compress in self.sizes_of], dtype=float)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """``(language, score, rejected)``; of equal sizes the first language by name counts."""
        sizes = self.sizes(text)
        if sizes is None:
            return "und", 0.0, True
        best = int(sizes.argmin())
        weights = np.exp((sizes[best] - sizes) / self.params.spread)
        second = np.delete(sizes, best).min(initial=np.inf)
        return self.langs[best], float(weights[best] / weights.sum()), bool(second - sizes[best] < self.params.min_margin * sizes[best])


def identify(docs: DataFrame, dictionaries: dict[str, bytes], params: LanguageParams = LanguageParams()) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    ``und`` with score 0, and rejected, where the text is null or has no letter; also rejected where the
    two smallest outputs are nearly equal (``min_margin``). Whole texts are encoded, all lengths by one
    rule. Extra columns pass through; result columns replace input columns of the same name. Narrow:
    no shuffle, and a lost executor costs its tasks only.
    """
    added = ["lang_pred", "score", "rejected"]
    rows = docs.drop(*added)
    names = rows.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries, params)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))],
                names=[*names, *added],
            )

    result = T.StructType([*rows.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(run, result)


def language_predictions(docs: DataFrame, folds: int = 3, held_out: int = 1, params: LanguageParams = LanguageParams()) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` of every document.

    Dictionaries come from documents outside the held-out fold, where crc32 of the id as text, modulo
    ``folds``, is not ``held_out``; ``lang`` and ``doc_id`` only choose what is learned. A null id
    belongs to no fold: it is not learned from and not held out.
    """
    fold = F.pmod(crc_of("doc_id"), F.lit(folds))
    dictionaries = learn_dictionaries(docs.where(fold != held_out).select("doc_id", "text", "lang"), params)
    rows = docs.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text")
    return identify(rows, dictionaries, params).select("doc_id", "held_out", "lang_pred", "score", "rejected")
