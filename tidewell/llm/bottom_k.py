"""Near duplicates by bottom-k sketches from one hash function, each link confirmed on the full shingle sets.

A document is the set of its distinct shingle hashes; equal sets are one entry with one representative from the start. The SKETCH smallest hashes of
a set are its sketch, and of these the smallest few (`index_size`) are put into inverted lists. Of the smallest hashes of two sets' union each
is shared with a probability of at least the wanted similarity, so a linked pair meets in fewer than two lists with a probability of LOST at most. Lists give the
pairs and their overlaps; the union sketch (the smallest SKETCH hashes of both sketches together) estimates the similarity, and drops a pair only if a
linked one would show so few shared hashes with a probability of LOST at most; the full sets decide.

Lists of more than MOST documents give no pairs. Instead:
- Documents with a value in a long list are indexed once more by their whole sketches, among themselves; what meets in a list of at most MOST
  documents is a pair. So documents that share a common passage, but not most of their text, are done.
- A linked pair that still hasn't met shares only values of long lists, and at least as many as the union sketch asks for. Documents with
  fewer of them drop out. Those left are crowds of much the same text. There each document is first judged against one lead of each of its lists.
- Lists that still hold several components are compared in full, but for pairs within the largest component: blocks of full sets are multiplied as 0/1
  matrices in a task, which returns the links that join components and nothing else.

Of the pairs, each document is first judged against the smallest of its partners; what that leaves in different components is judged afterwards.
So near copies in their thousands cost a few judgements each, and none is lost by a cap.

Defined results: words are runs of other than ASCII white space after lower-casing A-Z; fewer words than a shingle make one shingle; no word or a null
text makes the empty set, which is linked with nothing; a link needs 100 * common >= percent * union; of repeated rows each is a row; a null doc_id
is no smallest one, so a component without ids has a null component_id, and its rows are kept; very long texts are hashed whole; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import FEW, bytes_of, settle, shuffled
from tidewell.llm.simhash import SEED, classes, components, shingle_hashes
from tidewell.llm.tokens import forget

#: Words of a shingle, similarity of a link in per cent, hashes of a sketch, longest list that gives pairs, and the probability of missing a link
#: that is allowed for at each of the two filters.
WORDS, PERCENT, SKETCH, MOST, LOST = 3, 85, 64, 32, 1e-10
#: Documents and hashes of a block of a long list, and columns that are multiplied at a time.
BLOCK, HASHES, COLUMNS = 1024, 1 << 20, 2048
_SIGN = np.uint64(1 << 63)


def least_shared(percent: int, k: int = SKETCH, lost: float = LOST) -> int:
    """The smallest m such that a linked pair shares fewer than m of the k smallest hashes of its union with a probability of `lost` at most."""
    p, tail = percent / 100, 0.0
    for m in range(k + 1):
        tail += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if tail > lost:
            return m
    return k


def index_size(percent: int, lost: float = LOST) -> int:
    """The fewest smallest hashes of which a linked pair shares two, but for a probability of `lost`."""
    return next(k for k in range(1, 1 << 16) if least_shared(percent, k, lost) >= min(2, k))


def digest(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _signed(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as signed ones in the same order."""
    return (hashes ^ _SIGN).view(np.int64)


def shingle_sets(docs: DataFrame, words: int = WORDS, whole: bool = False, also: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """doc_id, print (the digest of the set), n (its size), `hashes`: the sketch, ascending, or the whole set; and, if asked for, `fingerprint`, a
    whole number made of all hashes with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                every = [np.array(shingle_hashes(d, words), dtype="<u8") for d in part.column("data").to_pylist()]
                sets = [np.unique(h) for h in every]
                kept = [_signed(s if whole else s[:SKETCH]) for s in sets]
                columns = [part.column("doc_id"), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(kept, pa.list_(pa.int64()))]
                columns += [pa.array(map(also, every), pa.int64())] if also else []
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "print", "n", "hashes", "fingerprint"][: len(columns)])

    return bytes_of(docs).mapInArrow(run, "doc_id long, print long, n long, hashes array<long>" + ", fingerprint long" * bool(also))


def _pairs(entries: DataFrame) -> DataFrame:
    """Pairs (a < b) of prints in a list, once for each list, and the overlap asked of them: shared values of long lists aren't seen, so a pair is
    asked for that many fewer."""
    x, y = (entries.select("value", F.col("print").alias(c), F.col("long").alias(f"long_{c}"), F.col("asked").alias(f"asked_{c}")) for c in "ab")
    return x.join(shuffled(y), "value").filter("a < b").select("a", "b", (F.greatest("asked_a", "asked_b") - F.least("long_a", "long_b")).alias("asked"))


def _listed(entries: DataFrame) -> DataFrame:
    """value and print of each entry whose list has more than one, with `many`, the list's length."""
    lists = entries.groupBy("value").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    return entries.join(shuffled(lists), "value")


def _overlapping(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs out of the short lists with enough overlap, and the entries of long lists. entries: value, print, n and asked."""
    met = settle(_listed(entries), "lists")
    crowded = met.filter(F.col("many") > MOST)
    counts = crowded.groupBy("print").agg(F.count(F.lit(1)).alias("long"))
    short = met.filter(F.col("many") <= MOST).join(shuffled(counts), "print", "left").na.fill(0, ["long"])
    pairs = _pairs(short).groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"), F.any_value("asked").alias("asked"))
    return pairs.filter("overlap >= asked").select("a", "b"), crowded


def _enough(shared: Column, union: Column, percent: int) -> Column:
    """Whether a union sketch of that size with so many shared hashes can be that of a linked pair. Below SKETCH it holds all of both sets, but for
    two hashes that may have become one."""
    return F.when(union < SKETCH, (shared + 1) * 100 >= (union + 1) * percent).otherwise(shared >= least_shared(percent))


def estimated(pairs: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose union sketch allows the similarity. Upper halves of hashes keep their order and are enough for that."""
    halves = groups.select("print", F.transform("hashes", lambda h: F.shiftright(h, 32).cast("int")).alias("half"))
    x, y = (shuffled(halves.select(F.col("print").alias(p), F.col("half").alias(h))) for p, h in ("ax", "by"))
    both = pairs.join(x, "a").join(y, "b")
    both = both.withColumn("union", F.slice(F.sort_array(F.array_union("x", "y")), 1, SKETCH))
    shared = F.size(F.array_intersect(F.array_intersect("x", "y"), "union"))
    return both.filter(_enough(shared, F.size("union"), percent)).select("a", "b")


def linked(common: Column, a: Column, b: Column, percent: int) -> Column:
    return common * 100 >= (a + b - common) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    x, y = (shuffled(sets.select(F.col("print").alias(p), F.col("hashes").alias(h))) for p, h in ("ax", "by"))
    both = pairs.join(x, "a").join(y, "b")
    return both.filter(linked(F.size(F.array_intersect("x", "y")).cast("long"), F.size("x"), F.size("y"), percent)).select("a", "b")


def sets_of(docs: DataFrame, groups: DataFrame, prints: DataFrame, words: int) -> DataFrame:
    """print and hashes of some groups' sets, of which only the representatives' texts are read again."""
    wanted = settle(groups.join(shuffled(prints.distinct()), "print", "left_semi").select(F.col("least").alias("_tw_id")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted.hint("merge")
    found = shingle_sets(docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("_tw_id")), "left_semi"), words, whole=True)
    return settle(found.groupBy("print").agg(F.any_value("hashes").alias("hashes")), "sets")


def _rooted(prints: DataFrame, labels: DataFrame, column: str, root: str) -> DataFrame:
    """prints with the component of a column as a further one."""
    known = labels.select(F.col("node").alias(column), F.col("root").alias(root))
    return prints.join(shuffled(known), column, "left").withColumn(root, F.coalesce(root, column))


def _across(sets: list[np.ndarray], side: np.ndarray, roots: list[int], prints: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join components between the sets of side 0 and those of both sides (side 1 among itself is one component)."""
    sizes = np.array([len(s) for s in sets])
    ids, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.zeros(0, np.int64)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    column = np.unique(column[keep], return_inverse=True)[1]
    ids, left = ids[keep], np.flatnonzero(side == 0)
    common = np.zeros((len(left), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, ids = column[order], ids[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [c, c + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        x[ids[i:j], column[i:j] - c] = 1
        common += x[left] @ x.T
    both = sizes[left][:, None] + sizes[None]
    near = 100 * common.astype(np.int64) >= percent * (both - common.astype(np.int64))
    root = np.array(roots)
    near &= root[left][:, None] != root[None]
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            r = up
        return r

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = top(roots[left[i]]), top(roots[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((prints[left[i]], prints[j]))
    return out


def _crowd_links(crowded: DataFrame, labels: DataFrame, docs: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links (a, b) in long lists whose documents aren't all in one component yet; None if there is no such list."""
    rows = _rooted(crowded.select("value", "print", "n"), labels, "print", "root")
    parts = rows.groupBy("value", "root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("hashes"))
    lists = parts.groupBy("value").agg(F.max_by("root", F.struct("docs", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    chunks = lambda inside: F.greatest(F.ceil(F.sum(F.when(inside, F.col("docs"))) / BLOCK), F.ceil(F.sum(F.when(inside, F.col("hashes"))) / HASHES), F.lit(1)).cast("int")
    lists = parts.join(lists, "value").groupBy("value", "main").agg(chunks(F.col("root") == F.col("main")).alias("inner"), chunks(F.col("root") != F.col("main")).alias("outer"))
    rows = settle(rows.join(lists, "value"), "crowds")
    if not rows.head(1):
        return None
    # outer chunk i meets every outer chunk and every inner one: block (i, j) with j below `outer` or from there on
    stray, at = F.col("root") != F.col("main"), lambda n: F.pmod(F.xxhash64("print", F.lit("chunk")), n).cast("int")
    own = F.when(stray, at(F.col("outer"))).otherwise(at(F.col("inner")) + F.col("outer"))
    block = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    every, outside = F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1), F.sequence(F.lit(0), F.col("outer") - 1)
    as_left = F.transform(F.filter(every, lambda j: j >= F.col("own")), lambda j: block(F.col("own"), j, F.lit(0)))
    as_right = F.transform(F.filter(outside, lambda i: i < F.col("own")), lambda i: block(i, F.col("own"), F.when(stray, 0).otherwise(1)))
    rows = rows.withColumn("own", own).withColumn("stray", stray)
    placed = rows.select("value", "print", "root", F.explode(F.when(F.col("stray"), F.concat(as_left, as_right)).otherwise(as_right)).alias("block")).select("value", "print", "root", "block.*")
    sets = sets_of(docs, groups, rows.select("print"), words)
    blocks = placed.join(shuffled(sets), "print").repartition("value", "i", "j").sortWithinPartitions("value", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        key, rows = None, []

        def ended() -> pa.RecordBatch:
            found = _across([r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows], [r[3] for r in rows], percent)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("value", "i", "j")), strict=True)
            sides, roots, prints = (batch.column(c).to_pylist() for c in ("side", "root", "print"))
            for n, k in enumerate(keys):
                if k != key:
                    if rows:
                        yield ended()
                    key, rows = k, []
                rows.append((np.asarray(batch.column("hashes")[n].values), sides[n], roots[n], prints[n]))
        if rows:
            yield ended()

    return blocks.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, groups: DataFrame, words: int = WORDS, percent: int = PERCENT, more: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of prints whose sets are similar enough, as many as it takes to connect every component. groups: distinct print, n, hashes (the
    sketch) and least; more: further candidates."""
    size, most = index_size(percent), least_shared(percent)
    # different sets of more than half in common share two hashes or more
    entry = lambda rows, upto, asked: rows.select("print", "n", asked.alias("asked"), F.explode(F.slice("hashes", 1, upto)).alias("value"))
    pairs, crowded = _overlapping(entry(groups, size, F.lit(2 if percent > 50 and size > 1 else 1)))
    out, crowd = [pairs], None
    if crowded.head(1):
        asked = F.least(F.lit(most), F.ceil(F.least("n", F.lit(SKETCH)) * percent / 100)).cast("int")
        again = groups.join(shuffled(crowded.select("print").distinct()), "print", "left_semi")
        pairs, crowded = _overlapping(entry(again, SKETCH, asked))
        left = crowded.groupBy("print", "asked").agg(F.count(F.lit(1)).alias("long")).filter("long >= asked")
        crowd = settle(_listed(entry(groups.join(shuffled(left.select("print")), "print", "left_semi"), size, F.lit(0))), "crowd")
        leads = crowd.groupBy("value").agg(F.min(F.struct(F.xxhash64("print", "value").alias("by"), "print")).alias("lead"))
        stars = crowd.join(leads.select("value", F.col("lead.print").alias("lead")), "value").filter("print <> lead")
        out += [pairs, stars.select(F.least("print", "lead").alias("a"), F.greatest("print", "lead").alias("b"))]
    if more is not None:
        out.append(more)
    pairs = out[0]
    for p in out[1:]:
        pairs = pairs.unionByName(p)
    pairs = settle(estimated(settle(pairs.distinct(), "met"), groups, percent), "candidates")
    sets = sets_of(docs, groups, pairs.select(F.explode(F.array("a", "b")).alias("print")), words)
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = settle(confirmed(first, sets, percent), "links")
    labels = components(found)
    rest = _rooted(_rooted(pairs.join(shuffled(first), ["a", "b"], "left_anti"), labels, "a", "root_a"), labels, "b", "root_b").filter("root_a <> root_b")
    found = settle(found.unionByName(confirmed(rest.select("a", "b"), sets, percent)), "links")
    if crowd is not None:
        across = _crowd_links(crowd, components(found), docs, groups, words, percent)
        found = found if across is None else settle(found.unionByName(across), "links")
    return found


def near_groups(docs: DataFrame, words: int, percent: int, also: Callable[[np.ndarray], int] | None = None, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, n and component_id for each row; texts without a word are one group. also and more: a fingerprint of all hashes, and candidates made of
    the table of groups that has it."""
    rows = settle(shingle_sets(docs, words, also=also), "rows")
    kept = [F.min("doc_id").alias("least"), F.any_value("n").alias("n"), F.any_value("hashes").alias("hashes")] + ([F.min("fingerprint").alias("fingerprint")] if also else [])
    groups = settle(rows.groupBy("print").agg(*kept), "groups")
    found = links(docs, groups, words, percent, more(groups) if more else None)
    return rows.select("doc_id", "n", "print").join(shuffled(classes(groups.select("print", "least"), found)), "print").select("doc_id", "n", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row."""
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return near_groups(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
