"""Bottom-k near duplicates against all pairs in Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tidewell.llm import bottom_k, near_copies
from tidewell.llm.common import read


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k=3, percent=85):
    sets, root, lists = [shingles(t, k) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, s in enumerate(sets):
        for m, common in Counter(m for x in s for m in lists[x]).items():
            if 100 * common >= percent * (len(s) + len(sets[m]) - common):
                root[max(top(n), top(m))] = min(top(n), top(m))
        for x in s:
            lists[x].append(n)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[top(n)] = min(i, least.get(top(n), i))
    return sorted(((i, len(s), least.get(top(n)), i == least.get(top(n))) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(spark, rows, k=3, percent=85):
    return sorted((tuple(r) for r in bottom_k.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()), key=str)


def crowd(pairs, passage, own, kept, seed=0):
    """Documents that share a passage; two and two share `kept` of their `own` further words as well."""
    rnd = random.Random(seed)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    base, rows = words(passage), []
    for i in range(pairs):
        mine = words(own)
        rows += [(2 * i, " ".join(base + mine)), (2 * i + 1, " ".join(base + mine[:kept] + words(own - kept)))]
    return rows


def family(n, seed=5):
    """Copies of one text with more or fewer edits."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rates = [rnd.choice([0, 0.01, 0.02, 0.03, 0.05]) for _ in range(n)]
    return [(i, " ".join(w if rnd.random() > r else f"z{rnd.randrange(10**9)}" for w in base)) for i, r in enumerate(rates)]


def test_filters_keep_linked_pairs():
    for percent in (60, 80, 85, 95):
        assert bottom_k.least_shared(percent, bottom_k.index_size(percent)) >= 2 > bottom_k.least_shared(percent, bottom_k.index_size(percent) - 1)
    assert bottom_k.least_shared(100) == bottom_k.SKETCH and bottom_k.index_size(100) == 1


def test_components_of_documents_and_messy_rows(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents").collect()]
    rows += [(None, "a b c d"), (None, None), (5, ""), (6, "  "), (7, "a b c d"), (7, "x"), (8, "x"), (9, "A B C D"), (9, "only this"), (10, "word " * 50_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_extra_columns_and_null_groups(spark):
    df = spark.createDataFrame([(None, "a b c d", 1, 2, "x"), (None, "a b c d", 1, 2, "y"), (None, None, 1, 2, "z")], "doc_id long, text string, print long, n int, component_id string")
    got = bottom_k.near_duplicates(df).collect()
    assert {tuple(r) for r in got} == {(None, 2, None, True), (None, 0, None, True)} and len(got) == 3


@pytest.mark.parametrize("most,block", [(32, 1024), (8, 48)])
def test_crowds_lose_no_link(spark, monkeypatch, most, block):
    monkeypatch.setattr(bottom_k, "MOST", most)
    monkeypatch.setattr(bottom_k, "BLOCK", block)
    many = family(300)
    rnd = random.Random(7)
    passage = [(1000 + i, " ".join([f"p{j}" for j in range(60)] + [f"q{rnd.randrange(10**9)}" for _ in range(rnd.choice([3, 8, 60, 150]))])) for i in range(300)]
    assert found(spark, many + passage) == brute(many + passage)


def test_pairs_in_a_crowd_of_unlike_documents_are_found(spark):
    """Every document is 0.75 like all others, and 0.82 like one of them: only the latter are near copies."""
    rows = crowd(150, 242, 40, 14)
    a, b, c = (shingles(rows[i][1], 5) for i in (0, 1, 2))
    assert 0.73 < len(a & c) / len(a | c) < 0.77 and 0.8 < len(a & b) / len(a | b) < 0.84
    kept = near_copies.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 300, 2))
