"""Token counts by dynamic programming over prefixes.

For each text the exact token count of every prefix (in code points) is stored as one array, and budget and truncation questions are
answered from it by look-ups. The library's encoder is not asked: counts come from its merge table alone.

In a unit of the pre-tokenizer the tokens of a sequence without its last token are the tokens of what that last token leaves, and a token may
follow another if the two together are merged into just these two. So exactly one token can end a prefix, it is found from the shorter
prefixes, and one pass over a unit counts all its prefixes (each with the end mark on its last symbol) in time and memory linear in the unit.
White space adds no tokens and nothing merges across it; so a text's array is put together from those of its chunks. Chunks that a worker has
seen are remembered; new words are counted in sorted order, each from where it departs from the one before.

Where a prefix ends inside a cluster that normalisation joins, inside a special string or in an apostrophe's suffix, what the tokenizer makes
of the shorter string is counted.

Defined results: a null or blank text has no tokens, and so has every prefix of it; bytes that aren't UTF-8 count as the replacement
character; very long texts and chunks take linear time and memory; repeated rows and null ids are rows of their own; an empty table gives an
empty table.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bytes_of
from tidewell.llm.tokens import PLAIN, chunks_of, default_path, slices, small

#: Tokens that a document may have.
LIMIT = 2048
#: Chunks of a generation that a worker remembers, and how long a chunk that it remembers may be.
CACHE, LONGEST = 100_000, 256
_END = "</w>"
#: Chunks of one unit, whose code points each become one in lower case: letters, a digit, or plain punctuation.
_SIMPLE = regex.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[" + regex.escape(PLAIN) + rb"]+")
_LETTERS, _OTHERS = regex.compile(r"\p{L}*"), regex.compile(r"[^\s\p{L}\p{N}]*")
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_open: dict[str, "Counter"] = {}


class Unit:
    """The tokens that end each prefix of a growing sequence of symbols, and how many tokens the prefix has (without an end mark)."""

    def __init__(self, merges: "Merges"):
        self.merges, self.text, self.lasts, self.counts = merges, "", [""], [0]

    def cut(self, size: int) -> None:
        """Keep the first symbols only."""
        self.text = self.text[:size]
        del self.lasts[size + 1 :], self.counts[size + 1 :]

    def ending(self, text: str, start: int = 0) -> list[int]:
        """Go on to `text`, of which what is kept is a beginning: for each symbol from `start` on, the tokens up to it if the unit ends there."""
        self.text = text
        inner, final = self.merges.inner.last, self.merges.final.last
        lasts, counts, out = self.lasts, self.counts, []
        for i in range(start + 1, len(text) + 1):
            for k in range(len(lasts), i):
                j, token = inner(text, k, lasts)
                lasts.append(token)
                counts.append(counts[j] + 1)
            out.append(counts[final(text, i, lasts)[0]] + 1)
        return out

    def with_end(self, size: int, more: str) -> int:
        """Tokens of a unit of the first `size` symbols and some more; only as many symbols as the longest token has are looked at again."""
        low = max(0, size - self.merges.longest)
        window = Unit(self.merges)
        window.lasts, window.counts = self.lasts[low : size + 1], self.counts[low : size + 1]
        text = self.text[low:size] + more
        return window.ending(text, len(text) - 1)[0]


class Tokens:
    """The tokens that a unit has inside, or at its end."""

    def __init__(self, tokens: dict[str, str], ranks: dict[tuple[str, str], int], mark: str):
        self.tokens, self.ranks, self.mark = tokens, ranks, mark
        self.follows: dict[tuple[str, str], bool] = {}
        sizes: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) > 2:
                sizes.setdefault(t[-3:], set()).add(len(t))
        self.sizes = {k: sorted(v, reverse=True) for k, v in sizes.items()}  # by the last three symbols, the longest first

    def merged(self, text: str) -> list[str]:
        parts = [*text[:-1], text[-1] + self.mark]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        if len(self.follows) >= 1 << 18:
            self.follows.clear()
        known = self.follows[a, b] = self.merged(a + b) == ([a, b + self.mark] if a else [b + self.mark])
        return known

    def last(self, text: str, i: int, lasts: list[str]) -> tuple[int, str]:
        """Where the token starts that ends the first i symbols, and the token."""
        for n in self.sizes.get(text[i - 3 : i], ()) if i > 2 else ():
            if n <= i and (b := self.tokens.get(text[i - n : i])) is not None:
                known = self.follows.get((lasts[i - n], b))
                if known or (known is None and self.may_follow(lasts[i - n], b)):
                    return i - n, b
        if i > 1 and (b := self.tokens.get(text[i - 2 : i])) is not None:
            known = self.follows.get((lasts[i - 2], b))
            if known or (known is None and self.may_follow(lasts[i - 2], b)):
                return i - 2, b
        return i - 1, self.tokens[text[i - 1]]  # every symbol is a token of its own


class Merges:
    """The merge table of a model."""

    def __init__(self, model: dict):
        ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        ends = [t.removesuffix(_END) for t in model["vocab"] if t.endswith(_END)]
        self.inner = Tokens({t: t for t in model["vocab"] if not t.endswith(_END)}, ranks, "")
        self.final = Tokens({t: t for t in ends}, ranks, _END)
        self.longest = max(map(len, (*self.inner.tokens, *self.final.tokens)))


class Counter:
    """Counts of all prefixes of chunks and texts, for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        spec = json.loads(tokenizer.to_str())
        if spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed" or spec["model"]["type"] != "BPE":
            raise ValueError("a BPE model whose pre-tokenizer drops white space is needed")
        self.units = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.norm = tokenizer.normalizer.normalize_str
        self.merges = Merges(spec["model"])
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from U+0100 on
        self.byte = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.normal: dict[str, str] = {}
        self.joins: set[str] = set()

    @classmethod
    def at(cls, path: str) -> "Counter":
        """One for each file and process."""
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    # clusters and units of a chunk

    def joining(self, c: str) -> bool:
        """Whether normalisation may join a code point with what comes before."""
        if not self.joins:
            second = (unicodedata.decomposition(chr(i)).split(" ") for i in range(0x20000))
            self.joins = {chr(int(d[1], 16)) for d in second if len(d) == 2 and not d[0].startswith("<")} | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
        return unicodedata.combining(c) > 0 or c in self.joins

    def normalised(self, cluster: str) -> str:
        found = self.normal.get(cluster)
        if found is None:
            if len(self.normal) > 1 << 16:
                self.normal.clear()
            found = self.normal[cluster] = self.norm(cluster)
        return found

    def symbols(self, text: str) -> str:
        return text if text.isascii() and text.isprintable() else "".join(map(self.byte.__getitem__, text.encode()))

    def plain(self, text: str) -> list[int]:
        """Counts of all prefixes of a text without special strings."""
        clusters: list[str] = []
        if text.isascii():
            clusters = list(text)
        else:
            for c in text:
                if clusters and not c.isascii() and self.joining(c):
                    clusters[-1] += c
                else:
                    clusters.append(c)
        parts = [self.normalised(c) for c in clusters]
        whole = "".join(parts)
        units, counts, base = [], [0] * (len(whole) + 1), 0
        at = 0
        for m in self.units.finditer(whole):
            a, b = m.span()
            counts[at + 1 : a + 1] = [base] * (a - at)
            unit = Unit(self.merges)
            name = m.group()
            if len(name) == 3 and name[0] == "'" and name[1:].isalpha():  # of an apostrophe's suffix of two letters, the first is a word
                counts[a + 1] = base + self.alone("'")
                counts[a + 2] = counts[a + 1] + self.alone(name[1])
                counts[a + 3] = base + unit.ending(name)[-1]
                symbol = [0, 1, 2, 3]
            else:
                ends = unit.ending(self.symbols(name))
                symbol = [0, *np.cumsum([len(c.encode()) for c in name]).tolist()] if not name.isascii() else range(len(name) + 1)
                counts[a + 1 : b + 1] = [base + ends[k - 1] for k in symbol[1:]]
            units.append((a, b, base, unit, symbol))
            at, base = b, counts[b]
        counts[at + 1 :] = [base] * (len(whole) - at)

        out, place = [0], 0
        for cluster, part in zip(clusters, parts, strict=True):
            out += [self.joined(whole, place, self.normalised(cluster[:k]), counts, units) for k in range(1, len(cluster))]
            place += len(part)
            out.append(counts[place])
        return out

    def alone(self, text: str) -> int:
        return Unit(self.merges).ending(self.symbols(text))[-1]

    def joined(self, whole: str, place: int, more: str, counts: list[int], units: list[tuple]) -> int:
        """Tokens of the first `place` normalised code points and some more: the units are found again from a few code points before."""
        k = bisect.bisect_right(units, place - 4, key=lambda u: u[0]) - 1
        if k < 0:
            total, tail = 0, whole[:place] + more
        else:
            a, b, base, unit, symbol = units[k]
            if b < place:
                total, tail = counts[b], whole[b:place] + more
            elif place - a <= 8:
                total, tail = base, whole[a:place] + more
            else:  # a long unit of letters or of others goes on as far as its kind does
                n = (_LETTERS if whole[a].isalpha() else _OTHERS).match(more).end()
                total, tail = base + unit.with_end(symbol[place - a], self.symbols(more[:n])), more[n:]
        return total + sum(self.alone(m.group()) for m in self.units.finditer(tail))

    def of_chunk(self, chunk: bytes) -> bytes:
        """Counts of all prefixes of a chunk, but the empty one, as unsigned 32-bit integers."""
        text = chunk.decode("utf-8", "replace")
        out, base, at = array("I"), 0, 0
        for m in self.special.finditer(text):
            before = m.start() - at
            counts = self.plain(text[at : m.end() - 1])  # a special string that isn't whole yet is text
            out.extend(base + n for n in counts[1:])
            base, at = base + counts[before] + 1, m.end()
            out.append(base)
        out.extend(base + n for n in self.plain(text[at:])[1:])
        return out.tobytes()

    # many chunks

    def learn(self, chunks: set[bytes]) -> None:
        """Make sure that every chunk of one batch, but the very long ones, is known."""
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.old, self.known, new = self.known, {}, chunks
        back = {c: self.old[c] for c in new if c in self.old}
        self.known.update(back)
        new = [c for c in new if c not in back and len(c) <= LONGEST]
        unit, before, ends = Unit(self.merges), "", []
        for text, c in sorted((self.symbols(c.decode().lower()), c) for c in new if _SIMPLE.fullmatch(c) and b"<|" not in c):
            same = 0
            for x, y in zip(before, text, strict=False):
                if x != y:
                    break
                same += 1
            unit.cut(same)
            del ends[same:]
            ends += unit.ending(text, same)
            whole = ends if c.isascii() else [n for n, x in zip(ends, [*c[1:], 0], strict=True) if x & 0xC0 != 0x80]
            self.known[c] = array("I", whole).tobytes()
            before = text
        for c in new:
            if c not in self.known:
                self.known[c] = self.of_chunk(c)

    def get(self, chunk: bytes) -> bytes:
        return self.known[chunk] if len(chunk) <= LONGEST else self.of_chunk(chunk)

    def tables(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """For each text, the tokens of each of its prefixes, from the empty one to the whole text."""
        texts = [t if t.isascii() else t.decode("utf-8", "replace").encode() for t in texts]
        cut = chunks_of(texts)
        self.learn(set().union(*cut))
        for text, chunks in zip(texts, cut, strict=True):
            raw = np.frombuffer(text, np.uint8)
            if not text.isascii():
                raw = raw[(raw & 0xC0) != 0x80]  # the first byte of each code point
            try:
                found = list(map(self.known.__getitem__, chunks))
            except KeyError:
                found = list(map(self.get, chunks))
            counts = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
            if not len(counts):
                yield np.zeros(len(raw) + 1, dtype=np.int64)
                continue
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            totals = counts[np.cumsum(sizes) - 1]
            counts += np.repeat(np.cumsum(totals) - totals, sizes)
            yield np.concatenate([[0], counts])[np.concatenate([[0], np.cumsum(~_BLANK[raw])])]


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix that has at most `budget` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def _run(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], int, int, Iterator[np.ndarray]]]:
    counter = Counter.at(path)
    for batch in small(batches):
        data = batch.column("data").to_pylist()
        for a, b in slices(data):
            yield batch, data, a, b, counter.tables(data[a:b])


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and counts: an array with the tokens of the first 0, 1, ... code points, for first_tokens and fitting_chars."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, a, b, tables in _run(batches, path):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([t.astype(np.int32) for t in tables], pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return bytes_of(docs).mapInArrow(run, "doc_id long, counts array<int>")


def first_tokens(counts: Column, chars: Column) -> Column:
    """Tokens of the first `chars` code points (of the whole text, if it has fewer)."""
    return F.get(counts, F.least(chars, F.size(counts) - 1))


def fitting_chars(counts: Column, budget: Column) -> Column:
    """Code points of the longest prefix that has at most `budget` tokens."""
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i)))


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the code points of the longest prefix within the limit."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, a, b, tables in _run(batches, path):
            n, fit = [], []
            for counts in tables:
                n.append(int(counts[-1]))
                fit.append(len(counts) - 1 if n[-1] <= limit else longest_within(counts, limit))
            columns = [pa.array([len(d) for d in data[a:b]], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return bytes_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
