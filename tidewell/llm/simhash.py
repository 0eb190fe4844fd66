"""Near duplicates by SimHash and multi-index hashing.

Fingerprints have 64 bits. Two of them that differ in at most 3 bits differ in at most one bit in at least one half. So a table holds each
distinct fingerprint under each of its halves, every fingerprint probes the table with the 33 values that lie within one bit of each of its
halves, and complete distances are verified on what meets. Documents with equal fingerprints are one entry of the table from the start
(aggregated before the shuffle), so copies never meet each other. Links join into components by minimum labels with pointer jumping.

Documents are put into components, so not every pair is formed. All fingerprints within one bit of a common centre (any 64-bit value, at most 65 of
them) link each other; each is tied to the least one, which settles all distances up to 2. Probes for the rest verify only pairs of different
components so far, and yield pairs of components. A half that more than HOT fingerprints have is split by segments of the other half: there at
most 3 bits are left, so one of its two 16-bit segments is within one bit as well. No link is lost by this, whatever HOT is.

Defined results: words are runs of other than ASCII white space after lower-casing A-Z; fewer words than a shingle make one shingle, no word
makes fingerprint zero, which links like any other; a null text is the empty text; a bit is set if more than half of the shingles (repeats
included) set it; of repeated rows each is a row; a null doc_id is no smallest one, so a component without ids has a null component_id; very
long texts are counted in bounded pieces; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import FEW, bytes_of, settle, shuffled
from tidewell.llm.tokens import forget

WORDS, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of one half value beyond which they also have to share a segment of the other half.
HOT = 256
#: Copies of a table of labels that the rows of one label are spread over.
SALTS = 16
_BATCH = 1 << 16


def shingle_hashes(data: bytes, words: int = WORDS) -> list[int]:
    w = data.lower().split()
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else []
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = (ends + 1 - np.diff(ends, prepend=-1)).tolist()
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)]


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of some 64-bit hashes have, as a signed integer."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BATCH):
        bits = np.unpackbits(hashes[i : i + _BATCH].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def simhash(data: bytes, words: int = WORDS) -> int:
    return majority(np.array(shingle_hashes(data, words), dtype="<u8"))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            data = batch.column("data")
            prints = [simhash(d, words) for i in range(0, len(data), 256) for d in data.slice(i, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    return bytes_of(docs).mapInArrow(run, "doc_id long, print long")


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints that differ in at most `distance` bits (3 at most), for a table of distinct `print`."""
    if not 0 <= distance <= 3:
        raise ValueError("two halves and balls of one bit cover distances up to 3")
    half = {0: F.shiftrightunsigned("print", 32), 1: F.col("print").bitwiseAND(F.lit((1 << 32) - 1))}
    ball = [0, *(1 << i for i in range(32))]
    table = prints.select(F.col("print").alias("a"), F.explode(F.array(*[F.struct(F.lit(k).alias("which"), v.alias("value")) for k, v in half.items()])).alias("s")).select("a", "s.*")
    probes = prints.select(F.col("print").alias("b"), F.explode(F.array(*[F.struct(F.lit(k).alias("which"), v.alias("own")) for k, v in half.items()])).alias("s")).select("b", "s.*")
    probes = probes.select("b", "which", F.explode(F.transform(F.array(*map(F.lit, ball)), lambda x: F.col("own").bitwiseXOR(x.cast("long")))).alias("value"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return table.join(shuffled(probes), (table["which"] == probes["which"]) & (table["value"] == probes["value"]) & near).select("a", "b").distinct()


def _looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """rows with the column `to` of a table of distinct `at` where rows[key] is at, else null. One key may be that of most rows, so rows are
    spread over SALTS copies of the table by their node."""
    copies = table.select("at", "to", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_copy"))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return spread.join(shuffled(copies), (F.col(key) == F.col("at")) & (F.col("_salt") == F.col("_copy")), "left").drop("at", "_copy", "_salt")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the smallest node reachable, for the nodes of the undirected edges (a, b).

    Each round, every node takes the smallest label among its own and its neighbours' (one map-side-combined aggregation), and then the
    label's label. Distances in label space halve, so rounds grow with the logarithm of a component's diameter.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settle(both, "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    for _ in range(rounds):
        offered = both.join(shuffled(labels.select(F.col("node").alias("b"), "root")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("offer"))
        lower = settle(labels.join(shuffled(offered), "node").select("node", F.col("root").alias("old"), F.least("root", "offer").alias("root")), "offers")
        # a root that has learned of a lower one tells all nodes that point to it
        hooked = lower.filter("root < old").groupBy(F.col("old").alias("at")).agg(F.min("root").alias("to"))
        lower = settle(_looked_up(lower, "root", hooked).select("node", "old", F.least("root", F.coalesce("to", "root")).alias("root")), "lower")
        # a label that is no longer its own label gives way to that one's
        jump = lower.filter("root < node").select(F.col("node").alias("at"), F.col("root").alias("to")).join(shuffled(lower.select(F.col("root").alias("at")).distinct()), "at", "left_semi")
        new = settle(_looked_up(lower, "root", jump).select("node", "old", F.least("root", F.coalesce("to", "root")).alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.filter("root < old").head(1):
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def classes(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """print and component_id, the smallest `least` reachable over the edges (a, b), for a table of distinct print with their `least` doc_id."""
    linked = components(edges)
    linked = settle(linked.join(shuffled(groups), linked["node"] == groups["print"]).select("node", "root", "least"), "linked")
    lowest = linked.groupBy(F.col("root").alias("at")).agg(F.min("least").alias("to"))
    joined = settle(_looked_up(linked, "root", lowest).select(F.col("node").alias("linked"), F.col("to").alias("component_id")), "joined")
    return settle(groups.join(shuffled(joined), groups["print"] == joined["linked"], "left").select("print", F.coalesce("component_id", "least").alias("component_id")), "classes")


def _ball(value: Column, bits: int) -> Column:
    """All values within one bit of a value of some bits, as an array."""
    masks = [0, *((1 << i) - (1 << 64 if i == 63 else 0) for i in range(bits))]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def _parts(value: Column, bits: int) -> Column:
    """The upper and the lower part of a value, of some bits each, with the part that is left over."""
    upper, lower = F.shiftrightunsigned(value, bits), value.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return F.array(F.struct(F.lit(0).alias("which"), upper.alias("value"), lower.alias("other")), F.struct(F.lit(1).alias("which"), lower.alias("value"), upper.alias("other")))


def stars(prints: DataFrame) -> DataFrame:
    """Edges (a, b) from the least to each other one of the distinct fingerprints within one bit of a common centre. All of them differ in at
    most 2 bits, and any two that do have such a centre."""
    centres = prints.select("print", F.explode(_ball(F.col("print"), 64)).alias("centre"))
    least = F.min("print").over(Window.partitionBy("centre"))  # of 65 rows at most
    return centres.select(least.alias("a"), F.col("print").alias("b")).filter("a < b").distinct()


def links_across(labelled: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Pairs (a < b) of labels of which some fingerprints differ in at most `distance` bits (3 at most), for a settled table of distinct
    `print` with a `label`."""
    halves = labelled.select("print", "label", F.explode(_parts(F.col("print"), 32)).alias("s")).select("print", "label", "s.*")
    crowded = settle(halves.groupBy("which", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("which", "value"), "crowded")
    crowds = crowded.count()
    crowded = F.broadcast(crowded) if crowds <= FEW else crowded.hint("merge")
    probes = halves.withColumn("value", F.explode(_ball(F.col("value"), 32)))

    def met(table: DataFrame, probes: DataFrame, *keys: str) -> DataFrame:
        t, q = table.alias("t"), probes.alias("q")
        same = [F.col(f"t.{k}") == F.col(f"q.{k}") for k in keys]
        near = (F.col("t.label") < F.col("q.label")) & (F.bit_count(F.col("t.print").bitwiseXOR(F.col("q.print"))) <= distance)
        return t.join(shuffled(q), [*same, near]).select(F.col("t.label").alias("a"), F.col("q.label").alias("b")).distinct()

    if not crowds:
        return met(halves, probes, "which", "value")

    def split(rows: DataFrame) -> DataFrame:
        inside = rows.join(crowded, ["which", "value"], "left_semi")
        return inside.select("print", "label", "which", "value", F.explode(_parts(F.col("other"), 16)).alias("s")).select(
            "print", "label", "which", "value", F.col("s.which").alias("segment"), F.col("s.value").alias("part")
        )

    few = met(halves.join(crowded, ["which", "value"], "left_anti"), probes.join(crowded, ["which", "value"], "left_anti"), "which", "value")
    many = met(split(halves), split(probes).withColumn("part", F.explode(_ball(F.col("part"), 16))), "which", "value", "segment", "part")
    return few.unionByName(many).distinct()


def class_edges(prints: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """Edges (a, b) over a settled table of distinct `print`, with the components of all pairs that differ in at most `distance` bits."""
    if distance < 2:
        return links(prints, distance)
    near = components(stars(prints))
    if distance == 2:
        return near.filter("root < node").select(F.col("root").alias("a"), F.col("node").alias("b"))
    labelled = settle(prints.join(shuffled(near), prints["print"] == near["node"], "left").select("print", F.coalesce("root", "print").alias("label")), "labelled")
    return labelled.filter("label < print").select(F.col("label").alias("a"), F.col("print").alias("b")).unionByName(links_across(labelled, distance, hot))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id reachable over links, for each row."""
    rows = settle(fingerprints(docs, words), "prints")
    groups = settle(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "groups")
    return rows.join(shuffled(classes(groups, class_edges(groups.select("print"), distance))), "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
