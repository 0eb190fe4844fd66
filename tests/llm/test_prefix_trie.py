"""The trie against nested dictionaries in Python, and its SQL on messy rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from tidewell.llm import prefix_trie
from tidewell.llm.common import read

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(turn):
    return hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest()


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turn = (role or "", text or "")
            turns[c].append((t is not None, t or 0, digest(turn), turn))
    own = {c: [t[-1] for t in sorted(v)] for c, v in turns.items()}
    built, members, below = {}, defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    for s in members:
        if s:
            below[s[:-1]].append(s)

    def sums(s):
        own = (len(members[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        parts = [sums(k) for k in below[s]]
        return (sum(p[0] for p in parts) or 1, own + sum(p[1] for p in parts))

    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(below[s]), *sums(s), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def messy():
    rnd, rows = random.Random(1), []
    for c in [*range(-25, 150), None]:
        for t in range(rnd.choice([1, 2, 3, 3, 5, 9])):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", None]), rnd.choice(["a b", "", None, "hello\t there  x", "a b", "a b", "a b"])))
    rows += [(c, t, "system", "long " * 20_000) for c in (200, 201, 202) for t in range(2)]
    return rows


@pytest.mark.parametrize("most,shard", [(2000, 4000), (3, 7), (1, 20)])
def test_nodes_equal_brute_force(spark, messy, most, shard):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in messy if r[0] is None or r[0] >= 0], SCHEMA + ", key string, depth int, words string")
    assert plain(prefix_trie.trie_nodes(df, most, shard)) == brute([r for r in messy if r[0] is None or r[0] >= 0])


def test_nodes_of_the_tables(spark, sf_dir):
    df = read(spark, sf_dir.replace("sf0.001", "sf0.01"), "conversations")
    assert plain(prefix_trie.trie_nodes(df)) == brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_no_conversation_has_no_root(spark):
    none = prefix_trie.trie_nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))
    assert none.count() == 0 and none.columns[0] == "conv_id" and len(none.columns) == 8


def test_double_arrays_hold_every_sequence_and_no_other():
    rnd = random.Random(4)
    seqs = {tuple(rnd.choices(range(1, 30), k=rnd.choice([1, 2, 3, 8]))) for _ in range(400)} | {(), tuple(range(1, 300))}
    trie = prefix_trie.packed([list(s) for s in seqs])
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}

    def walk(s):
        node = 0
        for c in s:
            if (node := trie.child(node, c)) < 0:
                return None
        return node

    assert len({walk(p) for p in prefixes}) == len(prefixes) and None not in {walk(p) for p in prefixes}
    assert all((walk((*p, c)) is not None) == ((*p, c) in prefixes) for p in prefixes for c in range(1, 31))


def test_sql_says_the_same(messy):
    rows = [r for r in messy if r[0] is not None and r[0] >= 0]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        assert sorted(db.sql(prefix_trie.ORACLE).fetchall(), key=str) == brute(rows)
