"""Words and character n-grams of many texts as numpy arrays, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_LETTERS: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _Q
    return h ^ (h >> np.uint64(32))


def _letters(chars: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x10000)], dtype=bool))
    low = chars < 0x10000
    if low.all():
        return _LETTERS[0][chars]
    out = np.zeros(len(chars), dtype=bool)
    out[low] = _LETTERS[0][chars[low]]
    out[~low] = [chr(c).isalpha() for c in chars[~low].tolist()]
    return out


class Words:
    """The lower-cased words (runs of letters) of a list of texts.

    chars: code points, one text after another with a blank before, between and after; rem: letters from a position to its word's end;
    word: index of the word at or before a position; start, end, text: position, end and text index of each word.
    """

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.chars = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum(np.array([len(t) + 1 for t in low], dtype=np.int64)) if texts else np.zeros(0, np.int64)
        letter = _letters(self.chars)
        edge = np.diff(letter.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.word = np.cumsum(edge[:-1] == 1, dtype=np.int32) - 1
        self.rem = np.zeros(len(self.chars), dtype=np.int32)
        at = np.flatnonzero(letter)
        self.rem[at] = self.end[self.word[at]] - at
        self.text = np.searchsorted(ends, self.start, side="right")
        self.n_texts = len(texts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        power = np.cumprod(np.full(int(lengths.max()), _P, dtype=np.uint64))
        terms = _mix((self.chars[self.rem > 0].astype(np.uint64) + np.uint64(1)) * power[at])
        return _mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))

    def padded_grams(self, sizes: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each size (3 or more): hashes and word indexes of the n-grams of words with a mark at either end."""
        c = np.where(self.rem > 0, self.chars.astype(np.uint64) + np.uint64(1), np.uint64(0))
        h = c
        for n in range(2, sizes.stop):
            if len(c) < n:
                return
            h = (h[: len(c) - n + 1] * _P) + c[n - 1 :]
            if n in sizes:
                at = np.flatnonzero(self.rem[1 : len(h) + 1] >= n - 2)
                yield _mix(h[at] + np.uint64(n)), self.word[at + 1]

    def only(self, keep: np.ndarray) -> "Words":
        """Some of the words, by mask."""
        out = object.__new__(Words)
        lengths = (self.end - self.start)[keep]
        out.end = np.cumsum(lengths + 1)
        out.start = out.end - lengths
        out.chars = np.full(int(out.end[-1]) + 1 if len(lengths) else 1, 10, dtype="<u4")
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        into = at + np.repeat(out.start, lengths)
        out.chars[into] = self.chars[at + np.repeat(self.start[keep], lengths)]
        out.word = np.zeros(len(out.chars), dtype=np.int32)
        out.rem = np.zeros(len(out.chars), dtype=np.int32)
        out.word[into] = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        out.rem[into] = np.repeat(lengths, lengths) - at
        out.text, out.n_texts = self.text[keep], self.n_texts
        return out

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """(n, hash of the n code points from each position) for n from 1 to `most`; it means something where rem >= n."""
        c = self.chars.astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, most + 1):
            h = h * _P
            h[: max(0, len(c) - n + 1)] += c[n - 1 :]
            yield n, _mix(h + np.uint64(n))


class Table:
    """An open-addressing table from distinct 64-bit hashes to rows; it grows with its keys (half full at most) and holds every one of them."""

    def __init__(self, keys: np.ndarray):
        bits = max(10, (2 * len(keys)).bit_length())
        self.mask = (1 << bits) - 1
        self.row = np.full(1 << bits, -1, dtype=np.int32)
        self.key = np.zeros(1 << bits, dtype=np.uint64)
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            _, first = np.unique(slot, return_index=True)
            first = first[self.row[slot[first]] < 0]  # the first of those that want an empty slot gets it
            self.row[slot[first]], self.key[slot[first]] = left[first], keys[left[first]]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        row = self.row[slot]
        at = np.flatnonzero((self.key[slot] != keys) & (row >= 0))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.mask
            row[at] = self.row[slot]
            on = (self.key[slot] != keys[at]) & (row[at] >= 0)
            at, slot = at[on], slot[on]
        return row


def text_slices(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` code points; one longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
