"""Byte-level BPE of a whole partition's words at once, by a pair occurrence index.

The distinct words of a batch are laid end to end in one array of symbols. An index maps
each pair that has a merge to all the positions where it occurs. Ranks that are active
(have positions) are taken in ascending order from a heap; a rank's occurrences are merged
together and only the pairs next to them enter the index anew. Words met before in the
partition come from a cache, so each distinct word is merged once per partition.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

#: The split of a text before the merges (the vocabulary's public pattern, a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHIFT = 20
CACHE_WORDS = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges of a tokenizer file: pairs of ids as sorted keys, with rank and resulting id."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids = model["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([ids[c] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.left, self.right = left, right
        self.result = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = (left << SHIFT) | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        back = {c: b for b, c in enumerate(letters)}
        self.lengths = np.zeros(max(ids.values()) + 1, dtype=np.int64)
        for piece, i in ids.items():
            self.lengths[i] = sum(c in back for c in piece)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 where there is none."""
        keys = (a << SHIFT) | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end and the number of ids of each word."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    n = int(lengths.sum())
    if n == 0:
        return np.zeros(0, dtype=np.int32), lengths
    sym = v.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    # one closing place after the last symbol; index -1 then also means it
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n)
    nxt[:-1][owner[1:] != owner[:-1]] = n
    prv[1:n][owner[1:] != owner[:-1]] = n
    prv[0] = n
    sym = np.append(sym, -1)
    nxt = np.append(nxt, n)
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        at = at[nxt[at] < n]
        if not len(at):
            return
        ranks = v.ranks(sym[at], sym[nxt[at]])
        some = ranks >= 0
        at, ranks = at[some], ranks[some]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, own in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
            if r in index:
                index[r].append(own)
            else:
                index[r] = [own]
                heapq.heappush(active, r)

    enter(np.arange(n))
    left, right, result = v.left, v.right, v.result
    while active:
        r = heapq.heappop(active)
        own = index.pop(r)
        at = own[0] if len(own) == 1 else np.unique(np.concatenate(own))
        a, b = left[r], right[r]
        at = at[sym[at] == a]
        at = at[sym[nxt[at]] == b]
        if not len(at):
            continue
        if a == b:  # only these occurrences can overlap: the leftmost of a run goes first
            at.sort()
            kept, last = [], -1
            for p, q in zip(at.tolist(), nxt[at].tolist()):
                if p != last:
                    kept.append(p)
                    last = q
            at = np.array(kept, dtype=np.int64)
        gone = nxt[at]
        after = nxt[gone]
        sym[at] = result[r]
        sym[gone] = -1
        nxt[at] = after
        prv[after] = at  # the closing place takes any value
        before = prv[at]
        enter(np.unique(np.concatenate([before[before < n], at])))
    alive = sym[:n] >= 0
    return sym[:n][alive].astype(np.int32), np.bincount(owner[alive], minlength=len(words))


class Encoder:
    """Encodes texts batch by batch, keeping the words of a partition."""

    def __init__(self, path: str):
        import regex

        self.v = vocabulary(path)
        self.split = regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Codes of all words end to end, number of words of each text, and the words."""
        if len(self.code) > CACHE_WORDS:
            self._clear()
        code = self.code
        split = [self.split(t) if t else [] for t in texts]
        fresh = {}
        known = len(code)
        for ws in split:
            for w in ws:
                if w not in code:
                    code[w] = known + len(fresh)
                    fresh[w] = None
        if fresh:
            flat, lengths = merge_words([w.encode("utf-8", "surrogatepass") for w in fresh], self.v)
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
            self.flat = np.append(self.flat, flat)
            self.lengths = np.append(self.lengths, lengths)
        codes = np.fromiter((code[w] for ws in split for w in ws), dtype=np.int64)
        return codes, np.array([len(ws) for ws in split], dtype=np.int64), split

    def codes(self, words: list[str]) -> np.ndarray:
        """Codes of one text's words (which `words` has given)."""
        if not all(w in self.code for w in words):  # the cache was emptied since
            return self.words(["".join(words)])[0]
        return np.fromiter(map(self.code.__getitem__, words), dtype=np.int64, count=len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the offsets of each text (one more than texts)."""
        codes, per_text, _ = self.words(texts)
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(total)
        word_ends = np.append(0, np.cumsum(per_text))
        return self.flat[at], np.append(0, ends)[word_ends]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        codes, per_text, _ = self.words(texts)
        ends = np.append(0, np.cumsum(self.lengths[codes]))
        at = np.append(0, np.cumsum(per_text))
        return ends[at[1:]] - ends[at[:-1]]

    def ids_of(self, codes: np.ndarray) -> np.ndarray:
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
