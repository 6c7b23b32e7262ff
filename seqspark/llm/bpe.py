"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in rank order, into a deterministic automaton whose arcs are tokens and whose
accepted paths are exactly the token sequences that BPE produces. The start is one state with an arc
for every byte. The gadget of a merge (u, v) splits the state that u leads to: the copy loses the arc
v, all u arcs now lead to the copy, and every state with an arc u gains an arc uv that leads where v
led. All arcs of one token lead to one state, so a state is known by the last token and the number of
gadgets applied, and it is stored by what its gadgets changed: the arcs that each token's state lost,
with the merge that took them. Whether a state has an arc is then a walk up the two merge trees;
answers are kept in a transition table.

Each prefix of a word has at most one accepted path, so a word is encoded by taking the longest arc
first and stepping back from positions that turn out dead, each at most once. Decoding emits the label
of each arc.
"""

from __future__ import annotations

import hashlib
import re as _re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .vocab import Memo, byte_alphabet, read_bpe

#: The byte-level splitter of the tokenizer file.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Chunks and arcs that a worker remembers (up to twice as many while it renews them).
REMEMBERED = 500_000


class TokenizationAutomaton:
    """``encode`` and ``decode`` by transitions of the compiled automaton."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        spec = read_bpe(path)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.labels: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: t.encode() for t, i in self.special_ids.items()}
        names = sorted(self.special_ids, key=len, reverse=True)
        self.specials = _re.compile("(" + "|".join(map(_re.escape, names)) + ")") if names else None
        self.ids = {b: i for i, b in self.labels.items() if i not in set(self.special_ids.values())}
        self.longest = max(map(len, self.ids))
        self._compile([(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]])
        self.arcs = Memo(lambda key: self._walk(key >> 32, key & 0xFFFFFFFF, len(self.born)), remembered)
        self.words = Memo(lambda p: self._pack(self.encode_word(p.encode())), remembered // 4)
        self.chunks = Memo(lambda c: b"".join(map(self.words.__getitem__, SPLIT.findall(c))), remembered)

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        n = max(self.labels) + 1
        self.left, self.right = [-1] * n, [-1] * n  # u and v of the token uv
        self.born = [-1] * n  # the merge that made the token; -1: a byte
        self.lost: dict[int, int] = {}  # (u, v): the merge at which the state after u lost the arc v
        self.dead = dead = len(merges) + 1  # made by no merge that can happen
        for i in self.ids.values():
            if len(self.labels[i]) > 1:
                self.born[i] = dead
        for k, (u, v, uv) in enumerate(merges):
            if self.born[uv] < dead or self.born[u] == dead or self.born[v] == dead or not self._walk(u, v, k - 1):
                continue
            self.born[uv], self.left[uv], self.right[uv] = k, u, v
            self.lost[u << 32 | v] = k
        self.ids = {b: i for b, i in self.ids.items() if self.born[i] < dead}

    def _walk(self, last: int, token: int, upto: int) -> bool:
        """Whether the state after ``last`` has the arc ``token`` once merges up to ``upto`` are applied."""
        born, left, right, lost = self.born, self.left, self.right, self.lost
        while True:
            taken = lost.get(last << 32 | token)
            if taken is not None and taken <= upto:
                return False
            a, b = born[last], born[token]
            if b >= a:
                if b < 0:
                    return True
                upto, token = b, left[token]  # uv was added where u was
            else:
                upto, last = a - 1, right[last]  # uv led where v led

    def encode_word(self, word: bytes) -> list[int]:
        ids, arcs, n = self.ids, self.arcs, len(word)
        whole = ids.get(word)
        if whole is not None:
            return [whole]
        out: list[int] = []
        at, size, dead = 0, min(n, self.longest), set()
        while at < n:
            last = out[-1] if out else -1
            while size:
                token = ids.get(word[at : at + size])
                if token is not None and at + size not in dead and (last < 0 or arcs[last << 32 | token]):
                    break
                size -= 1
            if size:
                out.append(token)
                at += size
                size = min(n - at, self.longest)
            else:
                dead.add(at)
                size = len(self.labels[out.pop()])
                at -= size
                size -= 1
        return out

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Packed ids of a text; strings of special tokens in it become those tokens."""
        if self.specials is None or "<|" not in text:
            return self._encode_plain(text)
        parts = self.specials.split(text)
        return b"".join(self._pack([self.special_ids[p]]) if i % 2 else self._encode_plain(p) for i, p in enumerate(parts))

    def _encode_plain(self, text: str) -> bytes:
        words = text.split()
        gaps = len(words) - 1
        if text.count(" ") + text.count("\n") == gaps == len(text) - sum(map(len, words)) and "\x01" not in text:
            # white space is single, so chunks of an optional space and what follows have ids of their own
            chunks = text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01")
            return b"".join(map(self.chunks.__getitem__, chunks))
        return b"".join(map(self.words.__getitem__, SPLIT.findall(text)))

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


_automata: dict[tuple[str, int], TokenizationAutomaton] = {}


def automaton(path: str, remembered: int = REMEMBERED) -> TokenizationAutomaton:
    """One automaton for each worker process, file and size of memory."""
    if (path, remembered) not in _automata:
        _automata[path, remembered] = TokenizationAutomaton(path, remembered)
    return _automata[path, remembered]


def bpe_encode(docs: DataFrame, vocab_path: str, text_col: str = "text", out_col: str = "token_ids", remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with the token ids of its text as an array (a null text: an empty array).

    Other columns pass through; an input column of the name of the result is replaced. Narrow. Workers
    that also serve other stages should remember fewer chunks: 500,000 take about 250 MB each.
    """
    rows = docs.drop(out_col)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = automaton(vocab_path, remembered).encode
        for batch in batches:
            packed = [encode(t.as_py() or "") for t in batch.column(names.index(text_col))]
            offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]))


def bpe_round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row; ``with_text`` adds ``decoded``.

    A null text is an empty one (0 tokens, digests of nothing); a null id stays null; repeated rows
    each give a row; other columns are not read. One narrow pass without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(vocab_path)
        for batch in batches:
            counts, ids, texts, decoded = [], [], [], []
            for text in batch.column(1):
                packed = machine.encode(text.as_py() or "")
                back = machine.decode(packed)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                texts.append(hashlib.sha256(back.encode()).hexdigest())
                if with_text:
                    decoded.append(back)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                columns.append(pa.array(decoded, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string" * with_text)
