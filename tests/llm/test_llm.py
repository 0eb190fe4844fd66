"""Each operator against a brute-force version, on edge cases and on the smallest tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import block_names, bottom_k, common, gumbel_pieces, hash_tree, language, near_copies, packing, prefix_counts, scaled_sketch, simhash, textarrays, token_files, toxicity
from tidewell.llm.common import read
from tidewell.llm.tokens import Encoder, default_path

LONG = "word soup and more, " * 6000
#: null and empty texts, blanks, ties and copies, a very long text, special strings, clashing column names
ROWS = [
    (1, "The cat sat on the mat, it's 12 o'clock.", "en"), (2, None, None), (3, "", "en"), (4, " \t\n ", "en"), (5, "The  cat sat on\tthe mat, it's 12 o'clock.", "en"),
    (6, "The cat sat on the mat, it's 12 o'clock.", "en"), (7, LONG, "en"), (8, "naïve <|endoftext|> ΣΑΣ 日本語テキスト 😀 á", "fr"), (9, "ab", None), (40, "ab", "en"), (41, "x" * 3000, "de"),
]
SCHEMA = "doc_id long, text string, lang string, name int, block string, place long, row_id long, print long, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "x", 1, 2, 3, 4) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def by_text(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


# exact duplicates


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t)


@pytest.mark.parametrize("poor", [False, True])
@pytest.mark.parametrize("block", [4, 64])
def test_block_names_equal_texts(spark, poor, block):
    texts = {1: "ab  cdefghijk", 2: "ab cdefghijk", 3: None, 4: "", 5: "ab cdefghijX", 6: "x" * 50, 7: "x" * 50, 8: "x" * 49, 9: "y" * 33, 10: "y" * 34}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    place = (lambda b: (F.octet_length(b) % 2).cast("long")) if poor else F.xxhash64
    groups = defaultdict(list)
    for k, t in texts.items():
        groups[norm(t or "")].append(k)
    got = rows_of(block_names.exact_duplicates(df, block, place))
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_duplicates_keep_one_of_repeated_rows(spark, none):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "q"), (2, "a")], "doc_id long, text string")
    kept = block_names.without_exact_duplicates(df)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "q"), (1, "a"), (1, "b")]
    assert block_names.exact_duplicates(none).count() == 0 and block_names.without_exact_duplicates(none).columns == none.columns


# sketches


def shingles(t, k=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x] or [""]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_scaled_sketch_against_brute_force(docs, small, none):
    for df in (docs, small):
        texts = by_text(df)
        order = sorted(texts, reverse=True)
        got = rows_of(scaled_sketch.fingerprints_with_edits(df))
        assert len(got) == len(texts)
        worst = 0.0
        for i, k in enumerate(order):
            t, nxt = texts[k], texts[order[(i + 1) % len(order)]]
            edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            r = got[k]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = shingles(t), shingles(edited), shingles(nxt)
            exact = len(a) <= scaled_sketch.FLOOR
            for have, other in ((r.near_edited, b), (r.near_next, c)):
                true = len(a & other) / len(a | other)
                if exact and len(other) <= scaled_sketch.FLOOR:
                    assert math.isclose(have, true, abs_tol=1e-9)
                worst = max(worst, abs(have - true))
        assert worst < 0.2
        prints = defaultdict(set)
        for k, t in texts.items():
            prints[t].add(got[k].fingerprint)
        assert all(len(p) == 1 for p in prints.values())
    assert scaled_sketch.fingerprints_with_edits(none).count() == 0


def test_sketches_merge(spark):
    df = spark.createDataFrame([(" ".join(f"a{i}" for i in range(900)), " ".join(f"b{i}" for i in range(500)))], "x string, y string")
    s = df.select(scaled_sketch.sketch(F.col("x")).alias("x"), scaled_sketch.sketch(F.col("y")).alias("y"))
    m = s.select(scaled_sketch.merged(F.col("x"), F.col("y")).alias("m"), "x")
    r = m.select(F.col("m.hashes").alias("h"), F.col("m.bound").alias("b"), scaled_sketch.overlap(F.col("x"), F.col("m"))["inside"].alias("inside")).first()
    assert r.h == sorted(set(r.h)) and max(r.h) <= r.b and r.inside == 1.0


def test_sketches_keep_what_lies_below_their_threshold(spark, docs):
    long_one = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30000)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ").alias("text"))
    rows = docs.select("text").unionByName(long_one).select("text", scaled_sketch.sketch(F.coalesce("text", F.lit(""))).alias("s"), F.array_distinct(scaled_sketch.shingle_hashes(F.coalesce("text", F.lit("")))).alias("all"))
    long, stored, written = 0, 0, 0
    for r in rows.withColumn("f", scaled_sketch.fingerprint(F.col("s"))).collect():
        assert r.s.hashes == sorted(h for h in r.all if h <= r.s.bound)
        halved = max(0, min(scaled_sketch.SCALE, (len(r.all) // scaled_sketch.LEAST).bit_length() - 1))
        assert r.s.bound == 2 ** (scaled_sketch.BITS - halved) - 1
        head, _, body = r.f.partition(":")
        raw = base64.b64decode(body)
        assert int(head) == halved and [int.from_bytes(raw[i : i + 6], "big") for i in range(0, len(raw), 6)] == r.s.hashes
        if halved == scaled_sketch.SCALE:
            long, stored, written = long + 1, stored + len(r.f), written + len(r.text)
    assert long and stored < written / 8


# shards


def tree_in_python(key, weights, rack=4, region=2):
    """The shard of one key, by all records of all regions in the order of their times."""
    mask = 2**64 - 1

    def mixed(key, number):
        z = (key + (number + 1) * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        return z ^ z >> 31

    unit = lambda h: ((h >> 11) + 0.5) * 2.0**-53
    weight = lambda s: weights[s] if s < len(weights) else 0.0
    records = []
    for g in range(-(-len(weights) // (rack * region))):
        for layer, (low, high) in enumerate([(0, 1), (1, 2), (2, 4), (4, 8)]):
            if low >= max(map(weight, range(g * rack * region, (g + 1) * rack * region))):
                continue
            seed, time = mixed(key, (g << 11) + layer), 0.0
            for i in range(200):
                record = mixed(seed, i)
                time -= math.log(unit(record)) / (high - low)
                r = min(range(region), key=lambda x: mixed(record, 2**20 + x))
                s = min(range(rack), key=lambda x: mixed(record, 2**40 + r * rack + x))
                records.append((time, (g * region + r) * rack + s, low + (high - low) * unit(mixed(record, 1))))
    return next(s for _, s, height in sorted(records) if height < weight(s))


def test_hash_tree_equals_a_tree_in_python(spark):
    weights = [1.0, 2.5, 0.0, 1.0, 0.5, 3.0, 1.0, 1.0, 1.0, 4.0, 0.25, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.75]
    df = spark.range(400).select(F.col("id").alias("k"), F.xxhash64("id", F.lit("shard")).alias("h"), hash_tree.shard_of(F.col("id"), weights).alias("shard"))
    for r in df.collect():
        assert r.shard == tree_in_python(r.h % 2**64, weights)


def test_hash_tree_levels_decide_and_shares_follow_weights():
    """Every draw is for regions, racks of one region and shards of one rack; shares are those of the weights, also in a region that is mostly empty."""
    keys = np.random.default_rng(3).integers(0, 2**64, 200_000, dtype=np.uint64)
    weights = [1.0, 2.5, 0.0, 1.0, 0.5, 3.0, 1.0, 1.0, 5.5]
    share = np.bincount(hash_tree.drawn(keys, weights), minlength=9) / len(keys)
    assert np.abs(share - np.array(weights) / sum(weights)).max() < 0.005
    shrunk = [1.0, 2.5, 0.0, 1.0, 0.5, 1.25, 1.0, 1.0, 5.5]
    a, b = hash_tree.drawn(keys, weights), hash_tree.drawn(keys, shrunk)
    assert set(a[a != b]) == {5}
    for bad in ([], [0.0], [1.0, -1.0], [math.inf]):
        with pytest.raises(ValueError, match="weights"):
            hash_tree.drawn(keys[:1], bad)


def test_hash_tree(docs, small, none):
    got = hash_tree.shards(small, 40).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = by_text(docs)
    for r in hash_tree.shards(docs, 40).collect():
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
    assert hash_tree.shards(none, 40).count() == 0


@pytest.mark.parametrize("n", [1, 2, 37, 39, 40, 41, 47])
def test_a_new_shard_takes_rows_only_into_itself(spark, n):
    got = spark.range(3000).select(hash_tree.shard_of(F.col("id"), [1.0] * n).alias("a"), hash_tree.shard_of(F.col("id"), [1.0] * (n + 1)).alias("b")).collect()
    assert all(r.b in (r.a, n) and r.a < n for r in got) and abs(sum(r.b == n for r in got) / 3000 - 1 / (n + 1)) < 0.03


def test_hash_tree_follows_weights_and_confines_movement(spark):
    df = spark.range(40000).select(F.col("id").alias("k"))
    weights = [1.0] * 16
    heavier = [1.0] * 12 + [3.0] + [1.0] * 3
    out = df.select(hash_tree.shard_of(F.col("k"), weights).alias("a"), hash_tree.shard_of(F.col("k"), heavier).alias("b")).collect()
    count = Counter(r.b for r in out)
    assert abs(count[12] / 40000 - 3 / 18) < 0.01 and max(Counter(r.a for r in out).values()) < 40000 / 16 * 1.1
    assert all(r.b == 12 for r in out if r.a != r.b)  # rows that move end in the shard whose weight grew


# tokens


def reference_ids(texts):
    tok = Encoder.at(default_path()).tokenizer
    return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def test_token_counts_and_prefixes(docs, small, none):
    for df in (docs, small):
        texts = by_text(df)
        want = dict(zip(texts, reference_ids(list(texts.values())), strict=True))
        for k, r in rows_of(prefix_counts.token_counts(df)).items():
            n = len(want[k])
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[k].encode()), n, n > 2048)
            if n <= 2048:
                assert r.fit_chars == len(texts[k])
            else:
                fit = len(reference_ids([texts[k][: r.fit_chars]])[0])
                assert fit <= 2048 < len(reference_ids([texts[k][: r.fit_chars + 1]])[0])
    assert prefix_counts.token_counts(none).count() == 0


def prefix_lengths(text):
    return [len(x) for x in reference_ids([text[:i] for i in range(len(text) + 1)])]


def table_of(text):
    return next(prefix_counts.Counter.at(default_path()).tables([text.encode()])).tolist()


#: What normalisation joins or splits, what the pre-tokenizer treats on its own, and unspaced scripts.
POOLS = [
    "abcXYZ..,,''!?<>|=-_ \n\t09é É ß İ ÀÿÖ×÷ \ufb01 \u01c5 日本 \u0958\u09dc \u0301\u0308\u0338\u200d\ufeff\u3000 \x1c\x00\x85 \u0663 ½ 😀 가\u1100\u1161\u11a8 \u0e49 กิ Σς \u212a \u212b",
    "aeéß'sretvlmd!\u0301\u0307\u0308", "abcdefghijklmnopqrstuvwxyz", "日本語中文字のに。", "éa\u0300\u0301e\u0308", "가\u1100\u1161\u11a8각", "กขคเแ\u0e48\u0e49\u0e34\u0e35", "!.-='<\u0338>\u0301",
]
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "it's", "'re", "'LL", "don't", "'r", "'l", "..."]


def odd_texts(n, seed, sizes=(6, 20, 60)):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        pool = POOLS[rng.integers(len(POOLS))]
        yield "".join(PARTS[rng.integers(len(PARTS))] if rng.random() < 0.08 else pool[rng.integers(len(pool))] for _ in range(sizes[rng.integers(len(sizes))]))


def test_every_prefix_has_its_exact_count():
    texts = ["", " \n", "Unbelievable  cats, it's 12.5 o'clock!\nnaïve", "x!<|endoftext|>y<|startoftext|>" * 4, "a\u3000b\u00a0\u00a0c" * 10, "İΣß" * 30, *odd_texts(800, 6)]
    for text in texts:
        assert table_of(text) == prefix_lengths(text), text


def test_ids_equal_the_library_on_odd_texts():
    encoder = Encoder.at(default_path())
    letters = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c))[0] in "LMN"]
    texts = [f % x for f in ("%s.", "%s.x", "a%s!", ".%s", "1%s2", '"%s"') for x in letters] + list(odd_texts(20_000, 9))
    got = [np.frombuffer(encoder.ids(c), "<u4").tolist() for c in encoder.batch([t.encode() for t in texts])]
    assert got == reference_ids(texts)


@pytest.mark.parametrize("alphabet", ["日本語中文字のにはテキスト", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/", "abcdefghijklmnopqrstuvwxyz", "e\u0301"])
def test_prefixes_of_a_huge_chunk_take_linear_time_and_no_encoding(alphabet, monkeypatch):
    text = "".join(np.random.default_rng(7).choice(list(alphabet), 100_000))
    counter = prefix_counts.Counter.at(default_path())
    assert not hasattr(counter, "tokenizer")
    counts = next(counter.tables([text.encode()]))
    at = [0, 1, 17, 4000, 31_000, 70_001, 100_000]
    assert len(counts) == 100_001 and counts[at].tolist() == [len(x) for x in reference_ids([text[:i] for i in at])]


def test_stored_tables_answer_questions(docs):
    texts, limits = by_text(docs), (0, 1, 7, 2048)
    tables = prefix_counts.prefix_tables(docs)
    rows = rows_of(tables.select("doc_id", "counts", *[prefix_counts.fitting_chars(F.col("counts"), F.lit(b)).alias(f"fit{b}") for b in limits], prefix_counts.first_tokens(F.col("counts"), F.lit(12)).alias("first")))
    for k, t in texts.items():
        if len(t) < 5000:
            want = prefix_lengths(t)
            assert rows[k].counts == want and rows[k].first == want[min(12, len(t))]
            assert [rows[k][f"fit{b}"] for b in limits] == [max(i for i, n in enumerate(want) if n <= b) for b in limits]


def test_token_files(docs, small, none):
    for df in (docs, small):
        texts = by_text(df)
        got, start = rows_of(token_files.token_files(df)), 0
        for k, ids in zip(sorted(texts), reference_ids([texts[k] for k in sorted(texts)]), strict=True):
            ids = np.array([*ids, 1], "<u4")
            r = got[k]
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert token_files.token_files(none).count() == 0


def check_packing(rows, texts, capacity):
    want = dict(zip(texts, reference_ids(list(texts.values())), strict=True))
    sequences = defaultdict(list)
    for r in rows:
        ids = np.array([*want[r.doc_id], 1], "<u4")[r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.start == r.piece * capacity
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(r.doc_id for r in rows) == {k: math.ceil((len(v) + 1) / capacity) for k, v in want.items()}
    return len(sequences), sum(len(v) + 1 for v in want.values())


def test_packing(docs, small, none):
    check_packing(packing.pack(docs).collect(), by_text(docs), 4096)
    used, total = check_packing(packing.pack(small).collect(), by_text(small), 4096)
    assert used <= math.ceil(total / 4096) * 1.05 + 1
    check_packing(packing.pack(small, group=20).collect(), by_text(small), 4096)
    assert packing.pack(none).count() == 0


def test_sum_of_squares_choice():
    bins, offset = packing.place(np.array([6, 6, 4, 4, 3]), 10)
    assert bins[0] != bins[1] and {bins[2], bins[3]} == {bins[0], bins[1]} and bins[4] == 2 and offset.tolist() == [0, 0, 6, 6, 0]


# near duplicates


def brute_components(texts):
    def print_of(t):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    prints = {k: print_of(t) for k, t in texts.items()}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return prints, {k: find(k) for k in ids}


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("hot", [1, 256])
def test_classes_of_dense_fingerprints(spark, distance, hot):
    """Clouds around a few centres, one half that many share, the top bit, and chains: the components are those of all pairs."""
    rng = np.random.default_rng(distance)
    flips = lambda v, k: v ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    values = [int(v) for v in rng.integers(0, 2**64, 30, dtype=np.uint64)]
    values += [flips(v, int(rng.integers(1, 6))) for v in values[:6] for _ in range(60)]
    values += [7 << 32 | int(v) for v in rng.integers(0, 2**32, 60)] + [7 << 32 | 1 << i | 1 << j for i in range(0, 30, 3) for j in range(0, 30, 5)]
    values += [0, 2**63, 2**64 - 1, 2**64 - 2]
    values = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if ((a ^ b) % 2**64).bit_count() <= distance and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    prints = spark.createDataFrame([(v,) for v in values], "print long")
    got = {r.node: r.root for r in simhash.components(simhash.class_edges(prints, distance, hot)).collect()}
    assert {v: got.get(v, v) for v in values} == {v: root(v) for v in values}


def test_simhash_components(docs, small, none):
    for df in (docs, small):
        prints, component = brute_components(by_text(df))
        got = rows_of(simhash.near_duplicates(df))
        assert {k: int(r.fingerprint, 16) for k, r in got.items()} == prints and {k: r.component_id for k, r in got.items()} == component
    assert simhash.near_duplicates(none).count() == 0


def test_links_find_every_pair_within_the_distance(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 40)
    values = {int(b) for b in base}
    for b in base.tolist():
        for n in (1, 2, 3, 4):
            x = b
            for bit in rng.choice(64, n, replace=False):
                x ^= (1 << int(bit)) if bit < 63 else -(1 << 63)
            values.add(int(x))
    values |= {0, 7, -1}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "print long")).collect()}
    mask = 2**64 - 1
    assert got == {(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (105, 100)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102, 105), 100)}


def test_sides_that_grow_with_the_corpus_are_never_broadcast(spark, docs, monkeypatch):
    plans = []

    def planned(df, what):
        plans.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return df

    def recorded(df, what):
        return common.settle(planned(df, what), what)

    for module in (simhash, near_copies, bottom_k):
        monkeypatch.setattr(module, "settle", recorded)
    planned(simhash.near_duplicates(docs), "op7")
    planned(near_copies.near_copies(docs), "near copies")
    planned(simhash.links_across(docs.select(F.col("doc_id").alias("print"), F.lit(1).alias("label"))), "across")
    planned(simhash.links(docs.select(F.col("doc_id").alias("print"))), "links")
    assert len(plans) > 30
    assert {what for what, plan in plans if "BroadcastExchange" in plan} <= {"sets"}  # there by keys that were counted


def brute_near_copies(texts):
    """Ids that stay: of each component over pairs whose sets of 5-word shingles have a similarity of at least 0.8, the smallest."""
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k for k in texts if find(k) == k}


def test_near_copies_of_similarity_from_08_on_go(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = []
    for j in np.linspace(0.72, 0.97, 40):  # a pair of similarity j: a replaced end shares 300 * 2j / (1 + j) shingles
        w = word(304)
        keep = round(300 * 2 * j / (1 + j)) + 4
        texts += [w, w[:keep] + word(304 - keep)]
    line = word(12)
    texts += [line * 20 + word(20) for _ in range(30)]  # one repeated line, sets mostly unlike
    big = word(400)
    for _ in range(50):  # a crowd of near copies
        w = list(big)
        w[int(rng.integers(400))] = "edited"
        texts.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near_copies(dict(rows))
    assert 20 < len(rows) - len(want) - 49 < 40
    assert set(by_text(near_copies.without_near_copies(docs))) == want


def test_near_copies_on_edge_cases(docs, small, none):
    for df in (docs, small):
        assert set(by_text(near_copies.without_near_copies(df))) == brute_near_copies(by_text(df))
    assert near_copies.without_near_copies(none).count() == 0


# classifiers


def test_toxicity_held_out(spark, sf_dir, docs, none):
    d = sf_dir.replace("sf0.001", "sf0.01")
    labels = read(spark, d, "labels")
    got = toxicity.toxicity(read(spark, d, "documents"), labels)
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, r.toxic) for r in rows if r.held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert sum(pairs) / len(pairs) > 0.9
    empty = rows_of(toxicity.score(docs, toxicity.fit(read(spark, d, "documents"), labels)))
    assert empty[2].score == empty[3].score == empty[4].score < 0.5 and empty[9].score == empty[40].score
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()} == {0.0}


def test_misspellings_share_vectors():
    clean = [f"plain words about gardens number {c} and rivers" for c in "abcdefghijklmnopqrst"]
    toxic = [f"you {w} person" for w in ("idiot", "idiots", "idiotic", "idiotes") for _ in range(5)]
    model = toxicity.train(clean + toxic, np.array([0] * 20 + [1] * 20))
    assert model.scores(["what an idiottt"])[0] > 0.5 > model.scores(["about rivers and gardens"])[0]


def test_language_held_out(spark, sf_dir, docs, none):
    d = read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    rows = language.languages(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    model = language.fit(d)
    got = rows_of(language.predict(docs, model))
    assert [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and got[9].lang_pred == got[40].lang_pred and got[7].lang_pred in model.languages
    assert language.languages(none).count() == 0 and {r.lang_pred for r in language.predict(docs, language.train({})).collect()} == {"und"}


def naive_language(samples, texts):
    """The same scores word by word with dictionaries: (language, posterior) of each text."""
    names, split = list(samples), lambda t: re.findall(r"[^\W\d_]+", t.lower())
    words = {x: Counter(w for t in samples[x] for w in split(t)) for x in names}
    grams = [{x: Counter() for x in names} for _ in range(language.LONGEST)]
    for x in names:
        for w, n in words[x].items():
            for k in range(1, language.LONGEST + 1):
                for i in range(len(w) - k + 1):
                    grams[k - 1][x][w[i : i + k]] += n

    def logs(counts):
        keys, half = set().union(*counts.values()), language.SMOOTHING
        total = {x: sum(counts[x].values()) + half * (len(keys) + 1) for x in names}
        return {k: [math.log((counts[x][k] + half) / total[x]) for x in names] for k in keys if sum(counts[x][k] for x in names) >= language.LEAST}

    known, short = logs(words), [logs(g) for g in grams]
    out = []
    for t in texts:
        sums, found = np.zeros(len(names)), split(t)
        for w in found:
            if w in known:
                sums += known[w]
                continue
            for i in range(len(w)):
                best = next((short[k - 1][w[i : i + k]] for k in range(min(language.LONGEST, len(w) - i), 0, -1) if w[i : i + k] in short[k - 1]), [0.0] * len(names))
                sums += np.array(best) / len(w)
        if found:
            share = 1 / np.exp((sums - sums.max()) / math.sqrt(len(found))).sum()
            out.append((names[int(sums.argmax())], share))
        else:
            out.append(("und", 0.0))
    return out


def test_language_scores_equal_brute_force(small):
    rows = [r for r in small.collect() if r.text]
    samples = {x: [r.text for r in rows if r.lang == x][:25] for x in ("en", "fr", "de")}
    texts = [r.text[:3000] for r in rows[::3]] + ["", "1234 !!", "zzzzqqq xx", "Straße ÉCOLE naïve"]
    names, scores = language.train(samples).predict(texts)
    for (want, share), name, score in zip(naive_language(samples, texts), names, scores, strict=True):
        assert name == want and math.isclose(score, share, abs_tol=2e-3)


def naive_toxicity(model, text):
    """Word by word: the mean over the n-grams of each run of 8 words, the largest of them through the logistic function."""
    mask, p, q = 2**64 - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def bucket(codes):
        h = 0
        for c in codes:
            h = (h * p + c) & mask
        h = (h + len(codes)) & mask
        h = ((h ^ (h >> 29)) * q) & mask
        return (h ^ (h >> 32)) & ((1 << toxicity.BITS) - 1)

    words = re.findall(r"[^\W\d_]+", text.lower())
    best = []
    for i in range(0, len(words), toxicity.WINDOW):
        values = []
        for w in words[i : i + toxicity.WINDOW]:
            codes = [0, *(ord(c) + 1 for c in w), 0]
            values += [float(model.gram[bucket(codes[j : j + n])]) for n in toxicity.SIZES for j in range(len(codes) - n + 1)]
        best.append(sum(values) / max(1, len(values)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, (max(best) if best else 0.0) + model.bias))))


def test_toxicity_scores_equal_brute_force(small):
    clean = [f"plain words about gardens number {c} and rivers" for c in "abcdefghijklmnopqrst"]
    model = toxicity.train(clean + [f"you {w} person" for w in ("idiot", "idiots", "idiotic", "idiotes") * 5], np.array([0] * 20 + [1] * 20))
    texts = [(r.text or "")[:3000] for r in small.collect()[::4]] + ["", "12 !", "a", "you idiot " * 30]
    for text, score in zip(texts, model.scores(texts), strict=True):
        assert math.isclose(score, naive_toxicity(model, text), abs_tol=1e-6)


# sampled segmentations


def every_segmentation(lattices, text):
    pieces = {}
    pieces |= {lattices.sp.id_to_piece(int(i)): (int(i), float(w)) for i, w in zip(lattices.ids, lattices.weight, strict=True)}

    def cut(s):
        if not s:
            yield (), 0.0
        for n in range(1, min(16, len(s)) + 1):
            if s[:n] in pieces:
                i, w = pieces[s[:n]]
                for rest, v in cut(s[n:]):
                    yield (i, *rest), w + v

    found = dict(cut(gumbel_pieces.BLANK + text.replace(" ", gumbel_pieces.BLANK)))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: v - total for k, v in found.items()}


def test_gumbel_samples_follow_the_distribution():
    lattices = gumbel_pieces.Lattices.at(gumbel_pieces.default_path(), 1.0)
    truth, n = every_segmentation(lattices, "the at a"), 6000
    got = gumbel_pieces.sample(lattices, ["the at a"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), 3)
    for samples in got:
        assert len({tuple(s[0].tolist()) for s in samples}) == 3 and samples[0][2] >= samples[1][2] >= samples[2][2]
        assert all(math.isclose(truth[tuple(s[0].tolist())], s[1], abs_tol=1e-9) for s in samples)
    best = sorted(truth, key=truth.get)[::-1]
    first = Counter(tuple(s[0][0].tolist()) for s in got)
    for k in best[:2]:
        p = math.exp(truth[k])
        assert abs(first[k] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    estimate = [sum(math.exp(s[1] - s[3]) for s in samples) for samples in got]  # sums the probability of all paths
    assert abs(np.mean(estimate) - 1) < 0.01


def test_samples_of_a_table_equal_brute_force(spark):
    """Every sample of short texts is one of all their segmentations, with its exact probability; inclusion follows from the next value."""
    texts = ["the at", "of a", "an inn", "aa aa", "to be", "x", "", "it is"]
    lattices = gumbel_pieces.Lattices.at(gumbel_pieces.default_path(), 1.0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_doc = defaultdict(list)
    for r in gumbel_pieces.sampled_encodings(docs, k=6).collect():
        by_doc[r.doc_id].append(r)
    for i, t in enumerate(texts):
        truth = every_segmentation(lattices, t) if t else {(): 0.0}
        rows = sorted(by_doc[i], key=lambda r: r.sample)
        assert len({tuple(r.ids) for r in rows}) == len(rows) == min(6, len(truth)) and [r.sample for r in rows] == list(range(1, len(rows) + 1))
        assert all(math.isclose(truth[tuple(r.ids)], r.log_prob, abs_tol=1e-9) for r in rows)
        assert all(a.perturbed >= b.perturbed for a, b in zip(rows, rows[1:], strict=False)) and all(r.log_inclusion <= 0 for r in rows)


def test_kept_units_change_no_sample(monkeypatch):
    batches = [["the at"], ["zebra quilt", "x"], ["the at zebra"], [""], ["quilt the", "new words"], ["the at"]]
    for keep in (0, 60, 1 << 21):
        monkeypatch.setattr(gumbel_pieces, "KEEP", keep)
        lattices = gumbel_pieces.Lattices(gumbel_pieces.default_path(), 1.0)
        got = [[(x[0].tolist(), x[1]) for x in t] for texts in batches for t in gumbel_pieces.sample(lattices, texts, np.arange(len(texts), dtype=np.uint64) + np.uint64(9), 3)]
        first = got if keep == 0 else first
        assert got == first


def test_few_segmentations_come_whole():
    lattices = gumbel_pieces.Lattices.at(gumbel_pieces.default_path(), 1.0)
    samples = gumbel_pieces.sample(lattices, ["of"], np.array([5], np.uint64), 50)[0]
    truth = every_segmentation(lattices, "of")
    assert {tuple(s[0].tolist()) for s in samples} == set(truth) and all(s[3] == 0.0 for s in samples)
    assert math.isclose(sum(math.exp(s[1]) for s in samples), 1, abs_tol=1e-9)


def test_encodings_decode_and_repeat(docs, none):
    texts = by_text(docs)
    once = gumbel_pieces.sampled_encodings(docs)
    got = gumbel_pieces.decoded(once).collect()
    assert all(r.text == texts[r.doc_id] for r in got) and Counter(r.doc_id for r in got)[7] == 2
    key = lambda df: sorted((r.doc_id, r.sample, r.ids) for r in df.collect())
    assert key(once) == key(gumbel_pieces.sampled_encodings(docs.repartition(3)))
    assert gumbel_pieces.sampled_encodings(none).count() == 0


# rows without id, rows that repeat one, the ends of the id range, a long text without blanks

MESSY = [(None, "a b c"), (None, None), (7, "x y z w v u"), (7, "x y z w v u"), (7, "other text here"), (-(2**63), "low"), (2**63 - 1, "high"), (8, "日本語" * 4000)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(*r, None, 0, "x", 1, 2, 3, 4) for r in MESSY], SCHEMA)


def counted(values):
    return Counter(map(str, values))


def test_counts_files_and_packing_of_messy_rows(messy):
    want = [len(x) for x in reference_ids([t or "" for _, t in MESSY])]
    got = prefix_counts.token_counts(messy).collect()
    assert counted((r.doc_id, r.n_tokens, r.n_bytes) for r in got) == counted((d, n, len((t or "").encode())) for (d, t), n in zip(MESSY, want, strict=True))
    files = sorted(token_files.token_files(messy).collect(), key=lambda r: r.start)
    assert counted((r.doc_id, r.n_tokens) for r in files) == counted((d, n + 1) for (d, _), n in zip(MESSY, want, strict=True))
    assert [r.start for r in files] == [0, *np.cumsum([r.n_tokens for r in files])[:-1].tolist()]
    assert [r.doc_id for r in files] == sorted((d for d, _ in MESSY), key=lambda d: -(2**64) if d is None else d)
    pieces = packing.pack(messy, capacity=1000).collect()
    assert sum(r.length for r in pieces) == sum(want) + len(want) and counted(r.doc_id for r in pieces if r.piece == 0) == counted(d for d, _ in MESSY)


def test_sketches_shards_and_samples_of_messy_rows(messy):
    prints = scaled_sketch.fingerprints_with_edits(messy).collect()
    assert counted(r.doc_id for r in prints) == counted(d for d, _ in MESSY)
    assert len({r.fingerprint for r in prints if r.doc_id == 7}) == 2 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in prints)
    slots = defaultdict(list)
    for r in hash_tree.shards(messy, 3).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == len(MESSY) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    samples = gumbel_pieces.decoded(gumbel_pieces.sampled_encodings(messy)).collect()
    assert counted((r.doc_id, r.text) for r in samples if r.sample == 1) == counted((d, t or "") for d, t in MESSY)


def test_classes_of_messy_rows(spark, messy):
    got = simhash.near_duplicates(messy).collect()
    assert counted(r.doc_id for r in got) == counted(d for d, _ in MESSY) and len({r.component_id for r in got if r.doc_id == 7 and r.fingerprint}) <= 2
    kept = near_copies.without_near_copies(messy)
    assert kept.columns == messy.columns and kept.count() == len(MESSY)  # rows that repeat an id are left as they are
    exact = block_names.without_exact_duplicates(messy)
    assert counted(r.doc_id for r in exact.collect()) == counted([None, None, 7, 7, -(2**63), 2**63 - 1, 8])
    model = language.train({"en": ["the cat sat on the mat the cat"] * 3, "de": ["der hund lief in den garten der hund"] * 3})
    assert counted(r.doc_id for r in language.predict(messy, model).collect()) == counted(d for d, _ in MESSY)
    toxic = toxicity.train(["plain words about gardens"] * 5 + ["you are an idiot"] * 5, np.array([0] * 5 + [1] * 5))
    assert counted(r.doc_id for r in toxicity.score(messy, toxic).collect()) == counted(d for d, _ in MESSY)


def test_training_takes_each_id_once_and_no_contradictions(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(20)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(4, 1), (4, 0)], "doc_id long, toxic int")
    got = [r.doc_id for r in toxicity.training_rows(docs, labels).collect()]
    assert len(got) == len(set(got)) and 4 not in got and all(zlib.crc32(str(i).encode()) % 5 for i in got)


def test_table_finds_every_key():
    rng = np.random.default_rng(2)
    keys = np.unique(np.concatenate([rng.integers(0, 2**64, 50_000, dtype=np.uint64), np.arange(1, 3000, dtype=np.uint64) << np.uint64(40)]))
    table = textarrays.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    other = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    assert (table.find(other[~np.isin(other, keys)]) == -1).all() and (textarrays.Table(keys[:0]).find(keys[:5]) == -1).all()


# pipeline


def test_run_equals_its_stages(spark, tmp_path, docs):
    """run() on a folder of its own: what it packs is what the stages leave, and an empty corpus gives nothing."""
    import corpus_pipeline as p

    words = "the cat sat on a mat and looked at some birds in those trees by our house while it rained all day".split()
    texts = [" ".join(np.random.default_rng(i % 30).permutation(words * 3)) for i in range(45)] + ["12345 !!", "", "der hund lief schnell in den garten und bellte laut"]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(45)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {*range(30), 47}  # copies and texts without letters go
    check_packing(got, {i: texts[i] for i in (*range(30), 47)}, 4096)
    assert p.STAGES[-1][1](spark, rows.filter("doc_id < 0"), str(tmp_path)).count() == 0


def test_pipeline_stages(spark, sf_dir, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language", "toxicity", "exact_dedup", "near_dedup", "packing"]
    at = spark.createDataFrame(read(spark, sf_dir, "documents").collect(), read(spark, sf_dir, "documents").schema)
    for name, stage in p.STAGES[:-1]:
        before = by_text(at)
        after = stage(spark, at, sf_dir)
        assert after.columns == at.columns
        left = by_text(after)
        if name == "exact_dedup":
            first = {}
            for k in sorted(before):
                first.setdefault(norm(before[k]), k)
            assert set(left) == set(first.values())
        if name == "near_dedup":
            assert set(left) == brute_near_copies(before)
        if name == "toxicity":
            toxic = {r.doc_id: r.toxic for r in read(spark, sf_dir, "labels").collect()}
            gone = set(before) - set(left)
            assert sum(toxic.get(k) == 0 for k in gone) <= 0.02 * len(before) and sum(toxic.get(k) == 1 for k in left) <= 0.2 * sum(toxic.get(k) == 1 for k in before)
        if name == "language":
            assert set(before) - set(left) == {k for k, t in before.items() if not any(c.isalpha() for c in t)}
        at = spark.createDataFrame(after.collect(), after.schema)
    check_packing(p.STAGES[-1][1](spark, at, sf_dir).collect(), by_text(at), 4096)


def test_pipeline_filters_take_edge_cases(spark, sf_dir, docs, none):
    import corpus_pipeline as p

    for name, stage in p.STAGES[:-1]:
        assert set(stage(spark, docs, sf_dir).columns) == set(docs.columns), name
        assert stage(spark, none, sf_dir).count() == 0, name


def test_queries_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert {"op5_block_naming", "op12_rotated_centroids", "op13_double_array"} <= set(e.oracle_sql())
