import random

from pyspark.sql import functions as F

from terrastat.llm import decontaminate as D

BENCH = [(1, "a b c d e f g h i j k l"), (2, "Short ITEM here"), (3, "short item"), (4, None), (5, "!!"),
         (None, "null named thing"), (2, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10")]


def both(spark, rows, bench, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = D.digest(D.find_hits(docs, b, **kw)).collect()
    want = D.brute_force(rows, [("null" if i is None else i, t) for i, t in bench])
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    return {r.doc_id: r for r in got}, docs, b


def test_brute_force_offsets_and_blocks(spark):
    rng = random.Random(1)
    vocabulary = "a b c d e f g h i j k l short item here é naïve null named thing".split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, "zz A-b, C d\nE f g h I j! k"), (101, None), (102, ""), (103, "...SHORT  item?HERE"),
             (104, ("pad " * 30_000) + "short item"), (105, "xshort item"), (103, "...SHORT  item?HERE")]
    found, docs, b = both(spark, rows, BENCH)
    text = rows[60][1]
    assert [text[s.start:s.end] for s in found[100].spans] == ["A-b, C d\nE f g h I j! k"]
    assert [rows[63][1][s.start:s.end] for s in found[103].spans] == ["SHORT  item?HERE"]
    assert not found[105].contaminated and found[104].n_hit == 2
    both(spark, rows, BENCH, block_bytes=20)  # several automata, the same answers
    clean = D.decontaminated(docs, b)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r[5] for r in D.brute_force(rows, [(str(i), t) for i, t in BENCH]))


def test_empty_tables(spark):
    both(spark, [], BENCH)
    both(spark, [(1, "a b")], [])
    both(spark, [(1, "a b")], [(1, None)])


def test_given_tables(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = D.digest(D.find_hits(docs, bench)).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(D.brute_force(rows, items))
