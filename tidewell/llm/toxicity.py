"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5 code points, with a mark at either end), so an unseen misspelling or inflection shares
vectors with words that were seen. The vectors of a window of WINDOW words are averaged and go into a linear softmax over (clean, toxic); a
document is as toxic as its most toxic window, so that a few words don't drown in a long text. Vectors and softmax are trained jointly in
numpy on the driver, on at most MOST_TOXIC + MOST_CLEAN labelled documents of up to MOST_CHARS code points, taken by a hash of the id
(a bound that the corpus doesn't move); training starts from whole-document averages and then follows each document's own worst windows.

Since averaging and the output are linear, scoring needs only one number for each n-gram bucket: vector times output weights. That table
is what tasks get (4 bytes x 2**BITS).

Defined results: a doc_id with labels of both kinds isn't learned from; a null or letterless text has the score of an empty bag, that of a clean one; ties and repeated rows score alike; without
labelled rows of both kinds every score is 0; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held_out, texts_of
from tidewell.llm.textarrays import Words, text_slices
from tidewell.llm.tokens import forget

SIZES, BITS, DIMENSIONS, WINDOW = range(3, 6), 18, 8, 8
#: Labelled documents that training takes at most, of either kind.
MOST_TOXIC, MOST_CLEAN = 700, 1300
#: Code points of a document that is trained on, at most; longer ones are scored but not learned from.
MOST_CHARS = 8_000
WHOLE, EPOCHS, STEPS, RATE, DECAY, SEEN = 20, 25, 4, 0.05, 0.01, 3


@dataclass
class Model:
    gram: np.ndarray  # logit of an average that holds this bucket alone, bias left out
    bias: float
    known: bool = True

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in text_slices(texts):
            words = Words(texts[a:b])
            out[a:b] = _Bags(words).worst(self.gram, self.bias)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30))) if self.known else np.zeros(len(texts))


class _Bags:
    """Windows of words as n-gram sums."""

    def __init__(self, words: Words):
        self.n_texts, n = words.n_texts, len(words.start)
        first = np.searchsorted(words.text, words.text, side="left") if n else np.zeros(0, np.int64)
        nth = (np.arange(n) - first) // WINDOW
        new = np.ones(n, dtype=bool)
        new[1:] = (words.text[1:] != words.text[:-1]) | (nth[1:] != nth[:-1])
        self.window = np.cumsum(new) - 1  # of each word
        self.starts = np.flatnonzero(new)
        self.text = words.text[self.starts]
        self.words = words

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams, window after window, and how many each window has."""
        parts = [((h & np.uint64((1 << BITS) - 1)).astype(np.int32), self.window[w].astype(np.int32)) for h, w in self.words.padded_grams(SIZES)]
        bucket, window = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        return bucket[np.argsort(window, kind="stable")], np.bincount(window, minlength=len(self.starts))

    def worst(self, gram: np.ndarray, bias: float) -> np.ndarray:
        """The largest window logit of each text; a text without words has the bias alone."""
        n = len(self.starts)
        total, count = np.zeros(n), np.zeros(n)
        for h, w in self.words.padded_grams(SIZES):
            at = self.window[w]
            total += np.bincount(at, gram[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)], n)
            count += np.bincount(at, minlength=n)
        out = np.full(self.n_texts, bias)
        if n:
            head = np.flatnonzero(np.diff(self.text, prepend=-1))
            out[self.text[head]] = np.maximum.reduceat(total / np.maximum(count, 1) + bias, head)
        return out


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Model:
    """Joint training of n-gram vectors and output weights by Adam on exact gradients."""
    y = toxic.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, known=False)
    rng = np.random.default_rng(seed)
    # n-grams of a run of texts at a time, since the arrays on the way are several times as large as what is kept
    parts, sizes_of, text_of, bags_of = [], [], [], []
    by_text = np.zeros(1 << BITS, dtype=np.int32)
    for a, b in text_slices(texts, 1 << 17):
        bags = _Bags(Words(texts[a:b]))
        bucket, sizes = bags.buckets()
        cut = np.concatenate([[0], np.cumsum(np.bincount(bags.text, sizes, b - a).astype(np.int64))])
        for i in range(b - a):
            k, n = np.unique(bucket[cut[i] : cut[i + 1]], return_counts=True)
            bags_of.append((k.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
            by_text[k] += 1
        parts.append(bucket)
        sizes_of.append(sizes)
        text_of.append(bags.text + a)
    bucket, grams_in, text_of_window = np.concatenate(parts), np.concatenate(sizes_of), np.concatenate(text_of)
    del parts
    first, n_windows = np.cumsum(grams_in) - grams_in, len(grams_in)
    # a bucket that fewer than SEEN texts have says nothing about others; the rest get vectors
    active = np.flatnonzero(by_text >= SEEN)
    index = np.full(1 << BITS, len(active), dtype=np.int32)  # the last vector stays zero
    index[active] = np.arange(len(active))
    bucket = index[bucket]
    vectors = np.vstack([rng.normal(0, 0.05, (len(active), DIMENSIONS)), np.zeros((1, DIMENSIONS))])
    out, bias = rng.normal(0, 0.5, DIMENSIONS), -1.0
    moments = [[np.zeros_like(vectors), np.zeros_like(vectors)], [np.zeros_like(out), np.zeros_like(out)], [0.0, 0.0]]
    t = 0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def step(b: np.ndarray, whose: np.ndarray, weight: np.ndarray) -> None:
        """One step on bags: bucket, text and share in the text's average of each of their n-grams."""
        nonlocal vectors, out, bias, t
        t += 1
        logit = np.bincount(whose, (vectors @ out).astype(np.float32)[b] * weight, len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * balance / len(y)
        by_bucket = np.bincount(b, error.astype(np.float32)[whose] * weight, len(vectors))
        by_bucket[-1] = 0
        grads = [np.outer(by_bucket, out) + DECAY / len(y) * vectors, vectors.T @ by_bucket + DECAY * out, error.sum()]
        new = []
        for value, grad, m in zip((vectors, out, bias), grads, moments, strict=True):
            m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.999 * m[1] + 0.001 * grad**2
            new.append(value - RATE * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8))
        vectors, out, bias = new

    whole = [index[np.concatenate([x[0] for x in bags_of])], np.repeat(np.arange(len(y), dtype=np.int32), [len(x[0]) for x in bags_of]), np.concatenate([x[1] for x in bags_of])]
    del bags_of
    for _ in range(WHOLE):
        step(*whole)
    del whole
    head = np.flatnonzero(np.diff(text_of_window, prepend=-1))
    for _ in range(EPOCHS if n_windows else 0):
        gram, logits = (vectors @ out).astype(np.float32), np.full(n_windows, -np.inf)
        for a in range(0, n_windows, 1 << 13):  # a run of windows at a time
            size = grams_in[a : a + (1 << 13)]
            filled = np.flatnonzero(size)
            if len(filled):
                at = first[a : a + (1 << 13)]
                sums = np.add.reduceat(gram[bucket[at[0] : at[-1] + size[-1]]], (at - at[0])[filled], dtype=np.float64)
                logits[a + filled] = sums / size[filled]
        worst = np.repeat(np.maximum.reduceat(logits, head), np.diff(head, append=n_windows))
        top = np.flatnonzero(logits >= worst - 1e-12)
        sizes = grams_in[top]
        at = np.arange(int(sizes.sum())) + np.repeat(first[top] - (np.cumsum(sizes) - sizes), sizes)
        of = text_of_window[top]
        weight = np.repeat(1 / np.maximum(sizes, 1) / np.bincount(of, minlength=len(y))[of], sizes).astype(np.float32)
        b, whose = bucket[at], np.repeat(of, sizes).astype(np.int32)
        for _ in range(STEPS):
            step(b, whose, weight)
    gram = np.zeros(1 << BITS, dtype=np.float32)
    gram[active] = (vectors @ out)[:-1]
    return Model(gram, float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> DataFrame:
    """doc_id, text and toxic of the labelled documents to learn from: a bounded number of either kind, by a hash of the id. Ids with labels
    of both kinds are left out; of rows that repeat an id, the first text by order is taken."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    marked = marked.filter("toxic = most").select("doc_id", "toxic")
    short = texts_of(docs).filter(F.length("text") <= MOST_CHARS)
    known = marked.join(short.select("doc_id"), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), "doc_id")
    taken = known.filter("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(known.filter("toxic = 0").orderBy(*order).limit(most_clean))
    return short.join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sorted(training_rows(docs, labels).collect(), key=lambda r: r["doc_id"])  # MOST_TOXIC + MOST_CLEAN at most
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            s = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    scored = texts_of(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of docs, with all their columns, that score below the limit; each row by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for texts in batches:
            yield pd.Series(shared.value.scores([t or "" for t in texts]) < limit, dtype=bool)

    return docs.filter(clean(docs["text"]))  # only texts go to Python, and only verdicts come back


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
