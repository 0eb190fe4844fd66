"""Token ids of the library's BPE tokenizer at corpus speed.

The tokenizer drops white space and never merges across it, so a text is its white-space-separated chunks one after another; each distinct
chunk is encoded once per worker, by the library itself, and looked up from then on. Where the pre-tokenizer parts letters, plain punctuation
and digits anyway, a blank is put between them first, so that there are fewer distinct chunks; that is done between ASCII characters and the
letters of U+00C0 to U+00FF alone, which no normalisation joins with an ASCII neighbour, and not in texts that may hold a special string.
The cache has two generations of CACHE chunks, so memory stays bounded whatever the corpus holds. Results equal the library's on whole texts;
tests compare them, also for every letter before punctuation.
"""

from __future__ import annotations

import ctypes
import gc
import os
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks of a generation that a worker remembers.
CACHE = 100_000
#: Plain punctuation; the apostrophe is not among it, since the pre-tokenizer gives it a meaning.
PLAIN = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTER, _PLAIN, _DIGIT = 1, 2, 3
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[list(PLAIN)] = _PLAIN
_CLASS[list(b"0123456789")] = _DIGIT
_open: dict[str, "Encoder"] = {}
_libc = ctypes.CDLL(None)


def release() -> None:
    """Give memory that earlier tasks of this worker have freed back to the machine, which Arrow and the C library keep otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def forget() -> None:
    """Give back what this worker remembers; operators that don't need tokens call it when their task begins."""
    _open.clear()
    release()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _parted(data: bytes) -> tuple[bytes, np.ndarray]:
    """The bytes with a blank put in wherever the class changes, and between digits; how many blanks were put in before each byte."""
    raw = np.frombuffer(data, np.uint8)
    kind = _CLASS[raw]
    if not data.isascii():
        second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)) + 1
        kind[second] = kind[second - 1] = _LETTER
    a, b = kind[:-1], kind[1:]
    cut = np.zeros(len(raw), dtype=np.uint8)
    cut[1:] = ((a != b) & (a > 0) & (b > 0)) | ((a == _DIGIT) & (b == _DIGIT))
    moved = np.cumsum(cut, dtype=np.int32)
    out = np.full(len(raw) + int(moved[-1]), 32, dtype=np.uint8)
    out[np.arange(len(raw), dtype=np.int32) + moved] = raw
    return out.tobytes(), moved


def chunks_of(texts: list[bytes]) -> list[list[bytes]]:
    """The chunks of each text. ASCII letters are lower-cased first where that can't change what the tokenizer does: no special string, no
    combining mark."""
    out: list[list[bytes]] = [[]] * len(texts)
    plain = [i for i, t in enumerate(texts) if t and b"<|" not in t and b"\xcc" not in t and b"\xcd" not in t]
    for i in set(range(len(texts))).difference(plain):
        out[i] = texts[i].split()
    if plain:
        data, moved = _parted(b"\n".join([texts[i] for i in plain]).lower())
        end = -1
        for i in plain:
            start, end = end + 1, end + 1 + len(texts[i])
            out[i] = data[start + int(moved[start]) : end + int(moved[end - 1])].split()
    return out


class Encoder:
    """Ids of chunks as little-endian unsigned 32-bit integers, for a tokenizer file whose pre-tokenizer removes white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    @classmethod
    def at(cls, path: str) -> "Encoder":
        """One encoder for each file and process."""
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    def learn(self, chunks: set[bytes]) -> None:
        """Make sure that every chunk of one batch is known."""
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.old, self.known, new = self.known, {}, chunks
        back = {c: self.old[c] for c in new if c in self.old}
        self.known.update(back)
        new = [c for c in new if c not in back]
        words = [c for c in new if self._word(c)]
        for i in range(0, len(words), 4096):
            self._learn_words(words[i : i + 4096])
        self._learn_each([c for c in new if c not in self.known])

    @staticmethod
    def _word(chunk: bytes) -> bool:
        """Whether the tokenizer's normalisation leaves nothing but letters."""
        return chunk.isalpha() or (not chunk.isascii() and unicodedata.normalize("NFC", chunk.decode("utf-8", "replace")).lower().isalpha())

    def _learn_words(self, words: list[bytes]) -> None:
        """Words of letters are encoded together; each ends with its only token that has the end mark."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            data, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
            self.known.update({w: data[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)})

    def _learn_each(self, chunks: list[bytes]) -> None:
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            for c, e in zip(part, self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in part], add_special_tokens=False), strict=True):
                self.known[c] = np.array(e.ids, dtype="<u4").tobytes()

    def batch(self, texts: list[bytes]) -> list[list[bytes]]:
        """The chunks of each text, all known from here on until the next call."""
        cut = chunks_of(texts)
        self.learn(set().union(*cut))
        return cut

    def ids(self, chunks: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, chunks))


def small(batches: Iterable, rows: int = 512) -> Iterable:
    """The same rows in smaller batches, so that only a few texts at a time exist twice."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def slices(data: list[bytes], most: int = 4 << 20) -> Iterable[tuple[int, int]]:
    """Runs of texts of about `most` bytes, so that a batch of long texts is worked off in bounded pieces."""
    start, size = 0, 0
    for i, d in enumerate(data):
        size += len(d)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(data):
        yield start, len(data)
