"""Reading of public tokenizer files and the parts that both BPE operators share."""

from __future__ import annotations

import heapq
import json


class Memo(dict):
    """A mapping that makes missing values and holds between one and two times ``limit`` of the latest."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def read_bpe(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merges in rank order, leftmost first."""
    if len(symbols) > 48:
        return _merge_long(symbols, ranks)
    symbols = list(symbols)
    get = ranks.get
    while len(symbols) > 1:
        best, at = None, -1
        left = symbols[0]
        for i in range(1, len(symbols)):
            right = symbols[i]
            r = get((left, right))
            if r is not None and (best is None or r < best):
                best, at = r, i
            left = right
        if best is None:
            break
        symbols[at - 1 : at + 1] = [symbols[at - 1] + symbols[at]]
    return symbols


def _merge_long(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same with a heap and a linked list: n log n for a word of n symbols."""
    s: list[str | None] = list(symbols)
    n = len(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := ranks.get((s[i], s[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if s[i] is not None else n
        if s[i] != a or j >= n or s[j] != b:
            continue
        s[i], s[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((s[i], s[k]))) is not None:
                heapq.heappush(heap, (r, i, s[i], s[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((s[h], s[i]))) is not None:
            heapq.heappush(heap, (r, h, s[h], s[i]))
    return [x for x in s if x is not None]
