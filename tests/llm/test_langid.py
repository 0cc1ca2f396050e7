import random

import numpy as np
from pyspark.sql import functions as F

from terrastat.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sample = langid.learn(docs.where(~langid.held_out()))
    assert all(len(f) <= langid.FRAGMENTS and max(map(len, f)) <= langid.FRAGMENT_CHARS
               for f in sample.values())
    got = langid.identify(docs, sample, carry=("doc_id", "lang")).where(langid.held_out())
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"),
                F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.98 and 0 <= r.lo <= r.hi <= 1


def phrases(text, sample):
    """Greedy longest phrases that occur in a fragment, in blocks."""
    def fold(t):
        out = " "
        for c in t:
            c = c.lower()[0] if c.isalpha() else " "
            out += c if c != " " or out[-1] != " " else ""
        return out if out[-1] == " " and len(out) > 1 else out + " "
    known = [fold(f) for f in sample]
    text, count = fold(text), 0
    for at in range(0, len(text), langid.BLOCK):
        block, i = text[at:at + langid.BLOCK], 0
        while i < len(block):
            n = 1
            while i + n < len(block) and any(block[i:i + n + 1] in k for k in known):
                n += 1
            i, count = i + n, count + 1
    return count, len(text)


def test_tables_parse_like_brute_force():
    rng = random.Random(4)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 6)))
    prose = lambda a, n: " ".join(word(a) for _ in range(n))
    sample = {"aa": [prose("abcd", 30) for _ in range(4)], "bb": [prose("cdef", 30) for _ in range(4)]}
    m = langid.Models(sample)
    texts = [prose("abcd", 200), prose("cdef", 3), "a", "Ab, cD!", prose("abef", 90), "9 a  -- b"]
    cost, has = m.costs(texts)
    assert has.all()
    for i, t in enumerate(texts):
        for k, lang in enumerate(sample):
            n, size = phrases(t, sample[lang])
            assert round(cost[i, k] * size / m.weights[k]) == n, (t, lang)


def test_defined_cases(spark):
    sample = {"aa": ["abab baba abba"], "bb": ["cdcd dcdc cddc"]}
    rows = [(1, "abba"), (2, "dcd cc"), (3, None), (4, ""), (5, "12 ?!"), (6, "中"), (7, "ab" * 60_000),
            (1, "abba")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(3))
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, sample).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert len(got) == 8 and by[1][0] == by[7][0] == "aa" and by[2][0] == "bb"
    assert all(by[i] == ("und", 0.0) for i in (3, 4, 5))
    assert by[6] == ("aa", 0.0)  # a tie goes to the first language
    assert langid.recognised(docs, sample).columns == docs.columns
    assert langid.recognised(docs, sample).count() == 5
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    nobody = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.learn(nobody) == {} and langid.identify(docs.limit(0), sample).count() == 0


def test_pipeline_stage_without_labels(spark):
    import corpus_pipeline

    rows = [(i, t, None) for i, t in enumerate(["plain text", None, "", "12 ?!", "中", "plain text"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.language_id(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, _, _ in rows if i % 6 in (0, 4, 5)]


def test_suffix_automaton_accepts_the_substrings():
    s = [1, 2, 1, 1, 2, 3]
    nxt = langid.suffix_automaton(s + [2, 2], {0, 6})

    def accepts(w):
        q = 0
        for c in w:
            if c not in nxt[q]:
                return False
            q = nxt[q][c]
        return True
    have = {tuple(p[i:j]) for p in (s, [2, 2]) for i in range(len(p)) for j in range(i, len(p) + 1)}
    for n in range(5):
        for w in np.ndindex(*[3] * n):
            w = tuple(int(x) + 1 for x in w)
            assert accepts(w) == (w in have)
