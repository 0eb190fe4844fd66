"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, so that a long document has a long sketch, sketches of parts
merge by union, and containment can be estimated between very unequal documents. The fraction is 1 / 2**SCALE for all documents of LEAST * 2**SCALE
shingles and more; a shorter one has the smallest of the fractions 1, 1/2, 1/4, ... at which LEAST shingles are to be expected below the threshold, and
so its whole set if that is smaller than twice LEAST. Nothing but the threshold decides what is kept: each sketch has all hashes up to its bound,
and two sketches are compared, or merged, at the lower of their bounds. Estimates are exact where both sets are whole; elsewhere the standard deviation
of a likeness J is sqrt(J * (1 - J) / m), with m hashes in the union of the two sketches, at least LEAST or so.

Only DataFrame functions are used. The text crosses the network once, to meet the next document.

Defined results: a null or blank text has the single shingle of no words; fewer than five words make one shingle; equal texts have equal
fingerprints; an only document is its own next; repeated rows count as rows of their own; rows without id come last in the order; very long
texts keep a sketch in proportion; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import BLANKS
from tidewell.llm.order import lead_in_bucket, with_next

#: Words in a shingle; the kept fraction of the hash range is 1 / 2**SCALE; shingles that are expected below the threshold of a shorter document;
#: bits of a hash.
WORDS, SCALE, LEAST, BITS = 5, 4, 128, 48
#: Sets of up to so many shingles are kept whole.
FLOOR = 2 * LEAST - 1


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used: a one-element array holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles, in text order, repeats included."""

    def over(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0)))
        return F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(words)]), 64 - BITS))

    return bind(F.split(F.trim(F.regexp_replace(text, BLANKS, " ")), " "), over)


def sketch(text: Column, words: int = WORDS, scale: int = SCALE, least: int = LEAST) -> Column:
    """Struct of hashes (ascending) and bound: every shingle hash up to the bound is among them, and no other."""

    def keep(every: Column) -> Column:
        bound = F.lit(2**BITS - 1)
        for s in range(1, scale + 1):
            bound = F.when(F.size(every) >= least * 2**s, F.lit(2 ** (BITS - s) - 1)).otherwise(bound)
        return bind(bound, lambda b: F.struct(F.sort_array(F.filter(every, lambda x: x <= b)).alias("hashes"), b.alias("bound")))

    return bind(F.array_distinct(shingle_hashes(text, words)), keep)


def fingerprint(s: Column) -> Column:
    """How often the range was halved, ':', and the hashes in base 64, BITS bits each."""
    halved = F.lit(BITS) - F.length(F.bin(s["bound"]))
    digits = F.array_join(F.transform(s["hashes"], lambda x: F.lpad(F.hex(x), BITS // 4, "0")), "")
    return F.concat(halved.cast("string"), F.lit(":"), F.base64(F.unhex(digits)))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together."""
    bound = F.least(a["bound"], b["bound"])
    return F.struct(F.filter(F.sort_array(F.array_union(a["hashes"], b["hashes"])), lambda x: x <= bound).alias("hashes"), bound.alias("bound"))


def overlap(a: Column, b: Column) -> Column:
    """Struct of likeness (Jaccard estimate) and inside (the share of a's shingles that b has)."""

    def upto(bound: Column) -> Column:
        own, other = F.filter(a["hashes"], lambda x: x <= bound), F.filter(b["hashes"], lambda x: x <= bound)
        return bind(F.struct(F.size(own).alias("a"), F.size(other).alias("b"), F.size(F.array_intersect(own, other)).alias("both")), shares)

    def shares(n: Column) -> Column:
        either = n["a"] + n["b"] - n["both"]
        return F.struct(F.coalesce(F.try_divide(n["both"], either), F.lit(0.0)).alias("likeness"), F.coalesce(F.try_divide(n["both"], n["a"]), F.lit(0.0)).alias("inside"))

    return bind(F.least(a["bound"], b["bound"]), upto)


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, whose second half is the start of the next document in descending doc_id."""
    dealt = with_next(docs, {"text": F.coalesce(F.col("text"), F.lit(""))})
    dealt = dealt.withColumn("own", sketch(F.col("text")))
    rows = lead_in_bucket(dealt, ["text", "own"], "text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", "next_own", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = rows.withColumn("edit", sketch(F.col("edited")))
    rows = rows.withColumns({"to_edit": overlap(F.col("own"), F.col("edit")), "to_next": overlap(F.col("own"), F.col("next_own"))})
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edit")).alias("edited_fingerprint"),
        F.col("to_edit.likeness").alias("near_edited"), F.col("to_next.likeness").alias("near_next"),
        F.col("to_edit.inside").alias("inside_edited"), F.col("to_next.inside").alias("inside_next"),
    )
