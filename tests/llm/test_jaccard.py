import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastat.llm import jaccard as J
from terrastat.llm.shingles import shingle_set


def shingles(text):
    text = "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows):
    """doc_id to (n_shingles, component_id); ids are distinct."""
    sets = {i: shingles(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = collections.Counter(p for ids in holders.values()
                                 for p in itertools.combinations(sorted(ids), 2))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {i: (len(s), root(i)) for i, s in sets.items()}


def made(seed, n_groups=12, group=30):
    """Groups of near copies about the threshold, passages, copies, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(40)]
    for g in range(n_groups):
        source = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(group):
            w = list(source)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w += passage
            rows.append(" ".join(w))
    rows += [" ".join(passage)] * 5 + ["one two", "One  TWO\n", "one two three", "", None, "  \n", "a"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [J.BLOCK, 16])
def test_components_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = made(block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in J.components(docs.repartition(3)).collect()}
    assert got == brute(rows)


def test_plan_choices_agree(spark, monkeypatch):
    """Few and small blocks, no broadcasts, floods and no frequent shingles."""
    rows = made(21, 8, 24)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("BROADCAST_ROWS", 0), ("VIABLE_MAX", 3), ("HOT_MAX", 1),
                        ("BLOCK_CODES", 300), ("JUDGED", 8), ("LEADS", 1), ("SLICE_BYTES", 50)):
        monkeypatch.setattr(J, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in J.components(docs.repartition(3)).collect()}
    assert got == brute(rows)


def test_no_pair_becomes_a_row(spark, monkeypatch):
    """A group of near copies just under the threshold: the rows that the
    second round sends grow with the classes, not with their pairs."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    source = [word() for _ in range(200)]
    rows = []
    for k in range(220):
        w = list(source)
        for at in rng.sample(range(0, 200, 10), 4):
            w[at] = word()
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {}
    for name in ("undecided", "links_in_place", "lead_pairs"):
        def counted(*args, f=getattr(J, name), name=name):
            out = J.staged(f(*args), "t-count")
            counts[name] = out.count()
            return out
        monkeypatch.setattr(J, name, counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(docs).collect()}
    assert got == brute(rows)
    assert counts["lead_pairs"] <= len(rows) and counts["links_in_place"] < 220 * 20
    assert counts["undecided"] <= 220 * 60  # a class in at most its prefix's buckets


def test_given_tables_and_representatives(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    twice = docs.union(docs.where("doc_id < 20"))
    got = J.components(twice).collect()
    assert len(got) == len(want) + 20
    assert all(want[r.doc_id] == (r.n_shingles, r.component_id) for r in got)
    kept = J.representatives(twice)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        i for i, (n, c) in want.items() if c == i)


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string"
    assert J.components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None), (2, ""), (3, None), (3, None)]
    got = J.components(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (3, 0, 3)]
    assert J.representatives(spark.createDataFrame(rows, schema)).count() == 4


def test_representatives_of_repeated_and_null_ids(spark):
    schema = "doc_id long, text string, n int"
    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = lambda t: t + " tail"
    rows = [(5, a, 0), (5, b, 0), (9, near(a), 0),           # 9 goes, both texts of 5 stay
            (1, c, 0), (12, near(c), 0), (12, d, 0),         # 12 keeps its unlinked text
            (None, e, 0), (None, near(e), 0), (None, e, 1),  # one of three
            (None, near(b), 0), (None, "", 0),               # a linked id is before null
            (20, f, 0), (20, f.upper(), 0), (20, near(f), 0), (20, " ", 0), (20, None, 0)]
    rows += [(30, d + " " + a, k % 2) for k in range(50)]    # a pair of many rows
    docs = spark.createDataFrame(rows, schema)
    got = J.representatives(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == {5: 2, 1: 1, 12: 1, None: 2, 20: 3, 30: 1}
    assert sum(not shingles(r.text) for r in got) == 3
    sets = {(r.doc_id, shingles(r.text)) for r in got}
    assert {(5, shingles(a)), (5, shingles(b)), (1, shingles(c)), (12, shingles(d))} <= sets
    again = J.representatives(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_sets_and_prefixes():
    rng = random.Random(8)
    for _ in range(200):
        text = " ".join(rng.choice(["A", "b", "Zé", "ab\tc", "\n", "x" * 30]) for _ in range(rng.randint(0, 30)))
        assert len(shingle_set(text)) == len(shingles(text))
    a, b = "a b c d e f", "zz a b c d e"
    assert len(np.intersect1d(shingle_set(a), shingle_set(b))) == 1
    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 500).astype(np.uint64))
    assert (J._unpack(J._pack(codes)) == codes).all()


def test_trees_lose_no_pair():
    rng = np.random.default_rng(9)
    pool = np.unique(rng.integers(0, 1 << 48, 6000).astype(np.uint64))
    sets = []
    for _ in range(30):
        own = rng.choice(pool, rng.integers(5, 400), replace=False)
        sets += [np.unique(np.concatenate([own[: int(len(own) * rng.uniform(0.75, 1))],
                                           rng.choice(pool, rng.integers(0, 20))])) for _ in range(6)]
    n = np.array([len(s) for s in sets])
    maps = [np.frombuffer(J._bitmap(s, len(s)), np.uint64) for s in sets]
    comp = np.arange(len(sets))
    tree = J.build(list(range(len(sets))), n, maps, comp)
    found = {tuple(sorted(p[:2])) for p in J.traverse(tree, tree, n, n, comp)}
    linked = set()
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (n[i] + n[j] - both):
            linked.add((i, j))
    assert linked and linked <= found and len(found) < len(sets) ** 2 / 4
    one = np.zeros(len(sets), int)  # one component: nothing to find
    assert not list(J.traverse(*[J.build(list(range(len(sets))), n, maps, one)] * 2, n, n, one))
