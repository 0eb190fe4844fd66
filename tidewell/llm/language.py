"""Language identification by words first, then shorter and shorter character n-grams.

A word that training has seen scores by its log frequency in each language. For an unseen word, each position scores by the longest known
n-gram (5 code points down to 1) that starts there, and the word by the mean over its positions. A text's language is the one with the
largest sum over its words; the score is that language's
posterior, with log odds divided by the square root of the number of words, since words aren't independent.

The model is fitted on a bounded sample of labelled texts: for each language about PER_LANGUAGE documents of up to MOST_CHARS code points,
chosen by a hash of id and text among all labelled rows that may be learned from (equal rows count once). A word or n-gram is known if the
sample holds it LEAST times; the tables hold every known one, and since the sample is bounded, so are they.

Defined results: `und` with score 0 for a null text, a text without letters, or where nothing could be learned; ties go to the language with
more labelled rows, then to the first by name; repeated rows and rows without id are predicted by their text alone; very long texts are scored
whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held_out
from tidewell.llm.textarrays import Table, Words, text_slices
from tidewell.llm.tokens import forget

#: Documents of a language that training takes (on average over the hash), code points of a document that it takes at most (longer ones are
#: predicted but not learned from), longest n-gram, how often the sample must hold a word or n-gram for it to be known.
PER_LANGUAGE, MOST_CHARS, LONGEST, LEAST, SMOOTHING = 600, 10_000, 5, 2, 0.5
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    words: Table | None = None
    word_scores: np.ndarray | None = None
    grams: list[Table] | None = None
    gram_scores: list[np.ndarray] | None = None

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for a, b in text_slices(texts):
            words = Words(texts[a:b])
            if not len(words.start):
                continue
            sums = np.zeros((b - a, len(self.languages)))
            each = self.of_words(words)
            head = np.flatnonzero(np.diff(words.text, prepend=-1))
            sums[words.text[head]] = np.add.reduceat(each, head, axis=0, dtype=np.float64)
            best = sums.argmax(axis=1)
            spread = np.sqrt(np.maximum(np.bincount(words.text, minlength=b - a), 1))[:, None]
            share = 1 / np.exp((sums - sums.max(axis=1, keepdims=True)) / spread).sum(axis=1)
            for i in words.text[head].tolist():
                names[a + i], scores[a + i] = self.languages[best[i]], share[i]
        return names, scores

    def of_words(self, words: Words) -> np.ndarray:
        """Score of each word in each language."""
        row = self.words.find(words.hashes())
        out = self.word_scores[row]
        unseen = row < 0
        if unseen.any():
            rest = words.only(unseen)
            at = np.full(len(rest.chars), -1, dtype=np.int32)  # the row of the longest known n-gram at each position
            base = 0
            bases = np.cumsum([0, *[len(s) for s in self.gram_scores]])
            for n, h in rest.grams(LONGEST):
                base = bases[n - 1]
                can = np.flatnonzero(rest.rem >= n)
                found = self.grams[n - 1].find(h[can])
                hit = found >= 0
                at[can[hit]] = found[hit] + base
            inside = rest.rem > 0
            table = np.vstack([*self.gram_scores, np.zeros((1, len(self.languages)), dtype=np.float32)])
            sums = np.add.reduceat(table[at[inside]], np.cumsum(rest.end - rest.start) - (rest.end - rest.start), axis=0)
            out[unseen] = sums / (rest.end - rest.start)[:, None]
        return out


def _log_frequencies(keys: list[np.ndarray], counts: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, the most frequent first, and their smoothed log frequency in each language (one list entry each)."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    table = np.zeros((len(distinct), len(keys)))
    start = 0
    for j, (k, c) in enumerate(zip(keys, counts, strict=True)):
        table[:, j] = np.bincount(at[start : start + len(k)], c, len(distinct))
        start += len(k)
    keep = table.sum(axis=1) >= least
    order = np.flatnonzero(keep)[np.argsort(-table[keep].sum(axis=1), kind="stable")]
    logs = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * (len(distinct) + 1)))
    return distinct[order], logs[order].astype(np.float32)


def train(samples: dict[str, list[str]]) -> Model:
    """From texts by language, in order of preference at ties."""
    languages = [x for x, texts in samples.items() if any(any(c.isalpha() for c in t) for t in texts)]
    if not languages:
        return Model([])
    words_of, counts_of, grams_of = [], [], [[] for _ in range(LONGEST)]
    for language in languages:
        words = Words(samples[language])
        h, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
        words_of.append(h)
        counts_of.append(n.astype(np.float64))
        mask = np.zeros(len(words.start), dtype=bool)
        mask[first] = True
        distinct = words.only(mask)
        often = np.zeros(len(words.start))
        often[first] = n
        weight = often[mask][distinct.word]
        for k, g in distinct.grams(LONGEST):
            can = distinct.rem >= k
            key, at = np.unique(g[can], return_inverse=True)
            grams_of[k - 1].append((key, np.bincount(at, weight[can])))
    keys, logs = _log_frequencies(words_of, counts_of, LEAST)
    tables, scores = [], []
    for parts in grams_of:
        k, s = _log_frequencies([p[0] for p in parts], [p[1] for p in parts], LEAST)
        tables.append(Table(k))
        scores.append(s)
    if not len(keys):
        logs = np.zeros((1, len(languages)), dtype=np.float32)
    return Model(languages, Table(keys), logs, tables, scores)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from text and lang of rows that aren't held out."""
    usable = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (F.length("text") <= MOST_CHARS) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    order = sorted(counts, key=lambda x: (-counts[x], x))
    if not order:
        return Model([])
    share = F.create_map(*[F.lit(x) for k in order for x in (k, min(1.0, per_language / counts[k]))])
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("language")), 11).cast("double") * 2.0**-53
    rows = usable.filter(place < share[F.col("lang")]).distinct().orderBy(F.xxhash64("doc_id", "text")).limit(2 * per_language * len(order)).collect()
    samples: dict[str, list[str]] = {k: [] for k in order}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"])):
        samples[r["lang"]].append(r["text"])
    return train(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # learned from a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            names, scores = shared.value.predict([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, model: Model, sure: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language can be told with at least the given posterior; each row by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for texts in batches:
            names, scores = shared.value.predict([t or "" for t in texts])
            yield pd.Series([n != UNDETERMINED and s >= sure for n, s in zip(names, scores, strict=True)], dtype=bool)

    return docs.filter(told(docs["text"]))  # only texts go to Python, and only verdicts come back


def languages(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
