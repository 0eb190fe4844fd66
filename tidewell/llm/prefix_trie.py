"""Conversations as a trie of shared prefixes, built from double arrays by prefix shards.

Each distinct turn (role, text) is a digest; a conversation is the sequence of its turns' digests, and equal sequences are one row with a count
from the start. Sequences are dealt into shards by a prefix: the shortest of 1, 2, 4, ... turns that at most MOST distinct sequences share, so that a
prefix which holds a third of all conversations is cut deeper and no shard gets it whole. A shard numbers its turns densely, packs its trie into a
BASE and a CHECK array (the child of node s by turn t is at BASE[s] + t if CHECK there is s), and walks its sequences through them. From the
depth of its prefix on a subtree lies in one shard, which sums it up; nodes above are merged over all shards by key, and give their share to each
of their ancestors in one grouped sum.

The digest over the ids of a node's own conversations is streamed: ids are sorted and joined in ranges, and one pass over the ranges in
order feeds SHA-256, so no task holds a node's ids.

Defined results: rows without conv_id belong to no conversation and are left out; turns of one number are ordered by their digests, and
repeated rows are turns of their own; a null turn number comes first; a null role or text is the empty one; c % 20 has the sign of c, as in SQL;
very long texts are digested and their words counted in place; an empty table has no root and gives an empty table; extra columns are ignored.
A conversation's turns (16 bytes each) are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import settle
from tidewell.llm.order import Buckets

#: Distinct sequences that share the prefix of a shard, sequences that a shard is meant to have, conversations that share opening turns.
MOST, SHARD, FAMILY = 2000, 4000, 20
_NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, family: int = FAMILY) -> DataFrame:
    """conv_id and seq: its rebuilt turns in order, as structs of a digest (32 hexadecimal digits) and a number of words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    rows = turns.filter("conv_id is not null").select("conv_id", F.struct("turn", digest.alias("digest"), words.alias("words")).alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = settle(own.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("seq")), "turns")
    heads = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.slice("seq", 1, 3).alias("opening"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    both = own.join(heads, own["conv_id"] - own["conv_id"] % family == heads["first"], "left").withColumn("h", taken)
    opening = F.slice(F.coalesce("opening", F.array().cast(own.schema["seq"].dataType)), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(opening, F.slice("seq", F.col("h") + 1, F.size("seq"))).alias("seq"))


def key_of(digests: Column) -> Column:
    """The key of the node that a sequence of digests ends at; node_keys makes the same."""
    return F.substring(F.sha2(F.array_join(digests, "").cast("binary"), 256), 1, 32)


def ends(convs: DataFrame) -> DataFrame:
    """key and ends_sha256: the digest over the ascending ids of the conversations that end at the node."""
    order = Buckets(convs.select(F.col("conv_id").alias("doc_id")))
    bucket = convs.select(F.col("conv_id").alias("doc_id"), "key").select("key", "doc_id", order.bucket.alias("bucket"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    parts = bucket.groupBy("key", "bucket").agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, found = [], []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    keys.append(key)
                    found.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return parts.repartition(order.tasks, "key").sortWithinPartitions("key", "bucket").select("key", "ids").mapInArrow(run, "key string, ends_sha256 string")


def dealt(distinct: DataFrame, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """The distinct sequences with `depth`, the length of the prefix that decides their shard (null: their whole sequence does), in their shards."""
    left, done, depth = distinct, None, 1
    while True:
        prefix = F.xxhash64(F.slice("digests", 1, depth))
        counted = left.select("*", prefix.alias("prefix"))
        crowded = counted.filter(F.size("digests") >= depth).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
        crowded = settle(crowded.select("prefix"), "crowded")
        short = F.size("digests") < depth
        ready = counted.join(crowded, "prefix", "left_anti").select(*distinct.columns, F.when(short, None).otherwise(F.lit(depth)).alias("depth"), "prefix")
        done = ready if done is None else done.unionByName(ready)
        if not crowded.head(1):
            break
        left = settle(counted.join(crowded, "prefix", "left_semi").select(*distinct.columns), "left")
        depth *= 2
    done = settle(done, "dealt")
    shards = max(1, done.count() // shard)
    at = F.when(F.col("depth").isNull(), F.xxhash64("digests")).otherwise(F.col("prefix"))
    return done.drop("prefix").repartition(shards, F.pmod(at, F.lit(shards)))


class DoubleArray:
    """BASE and CHECK over codes 1, 2, ...; node 0 is the root, a node's number is its place in the arrays."""

    def __init__(self) -> None:
        self.base, self.check = [-1], [0]
        self._free = [1]  # of a taken place, one that is as far as the next free one at most

    def _next(self, at: int) -> int:
        """The first free place from `at` on; places beyond the arrays are free."""
        free, first = self._free, at
        while at < len(free) and free[at] != at:
            at = free[at]
        while first < len(free) and free[first] != first:
            free[first], first = at, free[first]
        return at

    def _place(self, codes: list[int]) -> int:
        """The smallest base at which all of some ascending codes are free."""
        at = self._next(codes[0])
        while any(self._next(at - codes[0] + c) != at - codes[0] + c for c in codes[1:]):
            at = self._next(at + 1)
        return at - codes[0]

    def add(self, node: int, codes: list[int]) -> None:
        """Give a node all its children at once."""
        base = self.base[node] = self._place(codes)
        for at in range(len(self.check), base + codes[-1] + 1):
            self.base.append(-1)
            self.check.append(-1)
            self._free.append(at)
        for c in codes:
            self.check[base + c] = node
            self._free[base + c] = base + c + 1

    def child(self, node: int, code: int) -> int:
        """The child's number, or -1."""
        at = self.base[node] + code
        return at if self.base[node] >= 0 and at < len(self.check) and self.check[at] == node else -1


def packed(coded: list[list[int]]) -> DoubleArray:
    """The trie of some distinct sequences of codes, packed level by level."""
    trie = DoubleArray()
    level = {0: coded}
    depth = 0
    while level:
        below: dict[int, list[list[int]]] = {}
        for node, members in level.items():
            children: dict[int, list[list[int]]] = {}
            for m in members:
                if len(m) > depth:
                    children.setdefault(m[depth], []).append(m)
            if children:
                trie.add(node, sorted(children))
                below.update((trie.child(node, c), rows) for c, rows in children.items())
        level, depth = below, depth + 1
    return trie


_NODES = pa.schema(
    [
        ("key", pa.string()), ("parent", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("words", pa.int64()),
        ("shared", pa.bool_()), ("above", pa.list_(pa.string())), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ]
)


def shard_nodes(digests: list[list[str]], words: list[list[int]], convs: list[int], counts: list[int], depths: list[int | None]) -> pa.RecordBatch:
    """The nodes of a shard. Those from the prefix depth on are whole; the shared ones above carry counts only, to be merged. `above` holds the keys
    of the shared ancestors of a shared node, and of a node at the top of a whole subtree (whose sums go to them)."""
    codes = {d: i + 1 for i, d in enumerate(sorted({d for s in digests for d in s}))}
    trie = packed([[codes[d] for d in s] for s in digests])
    n = len(trie.check)
    size, least, depth, told, parent, shared = [0] * n, [None] * n, [0] * n, [0] * n, [-1] * n, [False] * n
    state, key = {0: hashlib.sha256()}, {0: hashlib.sha256().hexdigest()[:32]}
    order = [0]
    for s, w, conv, count, top in zip(digests, words, convs, counts, depths, strict=True):
        node = 0
        for d in range(len(s) + 1):
            if d:
                above, node = node, trie.child(node, codes[s[d - 1]])
                if node not in state:
                    state[node] = h = state[above].copy()
                    h.update(s[d - 1].encode())
                    key[node] = h.hexdigest()[:32]
                    parent[node], depth[node], told[node] = above, d, w[d - 1]
                    order.append(node)
            size[node] += count
            least[node] = conv if least[node] is None else min(least[node], conv)
            shared[node] = shared[node] or top is None or d < top
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for node in reversed(order):  # parents come before their children
        leaves[node] = leaves[node] or 1
        saved[node] += (size[node] - 1) * told[node]
        if (p := parent[node]) >= 0 and not shared[p]:
            children[p] += 1
            leaves[p] += leaves[node]
            saved[p] += saved[node]
    paths: dict[int, list[str]] = {-1: []}
    out = []
    for node in order:
        p = parent[node]
        if shared[node]:
            paths[node] = [*paths[p], key[node]]
        tops = shared[node] or p < 0 or shared[p]
        whole = None if shared[node] else 1
        out.append((
            key[node], key.get(p), depth[node], least[node], size[node], told[node], shared[node], paths[p] if tops else None,
            whole and children[node], whole and leaves[node], whole and saved[node],
        ))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NODES, strict=True)], schema=_NODES)


def shard_tables(shards: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {c: [] for c in ("digests", "words", "conv_id", "n", "depth")}
        for batch in batches:
            for c, rows in columns.items():
                rows += batch.column(c).to_pylist()
        if columns["n"]:
            nodes = shard_nodes(*columns.values())
            yield from (nodes.slice(i, 2000) for i in range(0, nodes.num_rows, 2000))

    kinds = "key string, parent string, depth long, conv_id long, n_convs long, words long, shared boolean, above array<string>, n_children long, n_leaves long, saved_tokens long"
    return shards.mapInArrow(run, kinds)


def trie_nodes(turns: DataFrame, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node."""
    convs = settle(sequences(turns).select("conv_id", F.col("seq.digest").alias("digests"), F.col("seq.words").alias("words")).withColumn("key", key_of(F.col("digests"))), "sequences")
    distinct = convs.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    kept = convs.join(distinct, ["key", "conv_id"], "left_semi").select("key", "digests", "words")
    distinct = settle(distinct.join(kept, "key").select("digests", "words", "conv_id", "n"), "distinct")
    nodes = settle(shard_tables(dealt(distinct, most, shard)), "nodes")
    return joined(nodes, ends(convs))


def joined(nodes: DataFrame, digests: DataFrame) -> DataFrame:
    """The shards' nodes with the shared ones merged."""
    whole = nodes.filter("not shared")
    shared = nodes.filter("shared").groupBy("key").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.any_value("words").alias("words"), F.any_value("above").alias("above")
    )
    shared = settle(shared, "shared")
    tops = whole.filter(F.col("above").isNotNull())
    children = tops.select(F.col("parent").alias("key")).unionByName(shared.select(F.col("parent").alias("key"))).filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_children"))
    shared = settle(shared.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "upper")
    # what each subtree's top and each shared node adds to the shared nodes above it, and to itself
    own = shared.select(F.array_append("above", F.col("key")).alias("to"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    given = own.unionByName(tops.select(F.col("above").alias("to"), "n_leaves", "saved_tokens"))
    sums = given.select(F.explode("to").alias("key"), "n_leaves", "saved_tokens").groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    facts = ["key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = settle(whole.select(*facts).unionByName(shared.join(sums, "key").select(*facts)), "merged")
    parents = every.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = every.join(parents, "parent", "left").join(digests, "key", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


#: The same in SQL: prefixes in full, each node's sums by its prefix. SQL has no CRC-32, so the first step makes its table of bytes.
ORACLE = r"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
own AS (SELECT conv_id AS c, list({'digest': sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32],
                                   'words': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))}
               ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS seq
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
taken AS (SELECT own.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                 lambda x, b: xor(crc[(xor(x, b) & 255) + 1], x >> 8)), 4294967295) % 4 AS h FROM own, steps),
built AS (SELECT t.c, list_concat(coalesce(f.seq, [])[1:t.h], t.seq[t.h + 1:]) AS seq FROM taken t LEFT JOIN own f ON f.c = t.c - t.c % 20),
paths AS (SELECT c, seq, d, array_to_string(list_transform(seq[1:d], lambda x: x.digest), '') AS k FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM built)),
nodes AS (SELECT k, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN seq[d].words ELSE 0 END) AS words,
                 sha256(coalesce(string_agg(CASE WHEN len(seq) = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM paths GROUP BY k),
children AS (SELECT k[1:32 * (depth - 1)] AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
facts AS (SELECT k, depth, conv_id, n_convs, words, ends_sha256, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (k)),
sums AS (SELECT k[1:32 * up] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
         FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM facts) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM facts f JOIN sums s USING (k) LEFT JOIN facts p ON f.depth > 0 AND p.k = f.k[1:32 * (f.depth - 1)]"""
