"""Token counts of a word-end BPE tokenizer by the whole-token shortcut.

Most pre-tokens of ordinary text are vocabulary strings. Offline, once, every vocabulary string is
run through normaliser, splitter and merges; those that come back as the one token form the
whole-token table. At run time a pre-token in that table counts as one, and only the rest is merged.
"""

from __future__ import annotations

import re as _re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import normalizers

from .vocab import Memo, byte_alphabet, merge_symbols, read_bpe

#: How the tokenizer file splits normalised text (its own pattern).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_SPACE = regex.compile(r"\p{White_Space}+")
#: Chunks between spaces that a worker remembers (up to twice as many while it renews them).
REMEMBERED = 500_000


class TokenCounter:
    """Counts tokens; ``whole`` is the table of pre-tokens proven to be one token."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        spec = read_bpe(path)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.alphabet = byte_alphabet()
        self.stand_in = {b: c for c, b in self.alphabet.items()}
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = _re.compile("|".join(map(_re.escape, specials))) if specials else None
        self.whole = frozenset(self._proven())
        self.merged = Memo(self._count_merged, remembered // 2)
        self.chunks = Memo(self._count_chunk, remembered)

    def _proven(self) -> Iterator[str]:
        for entry in self.vocab:
            body = entry[: len(entry) - len(self.suffix)]
            if not entry.endswith(self.suffix) or any(c not in self.alphabet for c in body):
                continue
            try:
                text = bytes(self.alphabet[c] for c in body).decode()
            except UnicodeDecodeError:
                continue
            if text and self.normalize(text) == text and SPLIT.findall(text) == [text] and self.merge(text) == [entry]:
                yield text

    #: The library's own tables and rules; the interpreter's are of another Unicode version.
    normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])

    def normalize(self, text: str) -> str:
        return text.lower() if text.isascii() else self.normalizer.normalize_str(text)

    def merge(self, pre_token: str) -> list[str]:
        symbols = [self.stand_in[b] for b in pre_token.encode()]
        symbols[-1] += self.suffix
        return [t for t in merge_symbols(symbols, self.ranks) if t in self.vocab]

    def _count_merged(self, pre_token: str) -> int:
        return len(self.merge(pre_token))

    def _count_chunk(self, chunk: str) -> int:
        """Neither pre-tokens nor what is normalised cross white space, so a chunk between spaces has a
        count of its own."""
        merged, whole = self.merged, self.whole
        return sum(1 if p in whole else merged[p] for p in SPLIT.findall(self.normalize(chunk)))

    def count(self, text: str) -> int:
        if self.specials is not None and "<|" in text and (found := self.specials.findall(text)):
            return len(found) + sum(map(self.count, self.specials.split(text)))
        # str.split() also splits at four control characters that are no white space to the tokenizer
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        return sum(map(self.chunks.__getitem__, _SPACE.split(text) if odd else text.split()))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter for each worker process and file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocab_path: str, max_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row, without added begin or end tokens.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each give a
    row; other columns are not read. One narrow pass without shuffle: executors that are lost only
    cost their own tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocab_path).count
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > max_tokens for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
