import zlib
from collections import Counter

from pyspark.sql import functions as F

from terrastat.llm import sharding


def check(rows, out, n, near):
    size = {i: len((t or "").encode()) + 8 for i, t, *_ in rows}
    assert sorted(r.doc_id for r in out) == sorted(i for i, *_ in rows)
    for r in out:
        assert r.size == size[r.doc_id] and 0 <= r.shard < n and r.grown_shard is None
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = Counter()
    for r in out:
        total[r.shard] += r.size
    target = sum(r.size for r in out) / n
    assert all(abs(total[s] - target) <= near * target + max(size.values()) for s in range(n))


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.shard_documents(docs, 24).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, out, 24, 0.05)
    crc = {i: zlib.crc32(t.encode()) for i, t in rows}
    assert all(r.text_crc32 == crc[r.doc_id] for r in out)
    again = sharding.shard_documents(docs.repartition(5), 24).collect()
    assert sorted(out) == sorted(again)


def test_defined_cases(spark):
    schema = "doc_id long, text string, lang string, source string, weight int, node int"
    rows = [(i, "same" if i % 3 else None, None, "s" if i % 2 else None, i, 0) for i in range(300)]
    rows += [(1000, "x" * 5000, "en", "s", None, 0)]
    docs = spark.createDataFrame(rows, schema)
    check(rows, sharding.shard_documents(docs, 4).collect(), 4, 0.05)
    check(rows, sharding.shard_documents(docs, 1).collect(), 1, 0.01)
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0
    twice = sharding.shard_documents(docs.where("doc_id < 3").union(docs.where("doc_id < 3")), 2)
    assert twice.count() == 6


def test_copies_of_one_row_are_divided(spark):
    hot = sharding.COPIES * 2 + 7
    rows = [(i, f"text {i % 900}") for i in range(hot)] + [(-5, "a text")] * hot + [(None, "none")] * hot
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows],
                                 "doc_id long, text string, lang string, source string")
    out = sharding.shard_documents(docs, 8).collect()
    size = [0] * 8
    for r in out:
        size[r.shard] += r.size
    assert all(abs(8 * x - sum(size)) <= 0.05 * sum(size) + 8 * 20 for x in size)
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    blocks = Counter((r.shard, r.slot) for r in out)
    assert max(blocks.values()) == 1
    again = sharding.shard_documents(docs.repartition(5), 8).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_cuts_follow_the_widest_dimension_to_target_weight(spark):
    pts = spark.createDataFrame([(i, float(i), float(i % 10)) for i in range(1000)],
                                "k long, x double, y double")
    out = sharding.kd_shards(pts, id_col="k", group=F.lit(0), weight=F.lit(1),
                             dimensions=[F.col("x"), F.col("y")], target_weight=250)
    boxes = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"),
                                     F.max("id").alias("hi")).orderBy("shard").collect()
    assert [r.n for r in boxes] == [250] * 4 and boxes[0].hi < 500 <= boxes[2].lo


def brute_shards(points, n_shards):
    """Shards by recursive weighted cuts over sorted points: points are
    (key per dimension, weight, name) with distinct keys."""
    out = {}

    def cut(rows, leaves, first):
        if leaves == 1:
            out.update({r[2]: first for r in rows})
            return
        spread = [max(r[0][i] for r in rows) - min(r[0][i] for r in rows) for i in range(2)]
        dim = 0 if spread[0] >= spread[1] else 1
        rows = sorted(rows, key=lambda r: r[0][dim])
        left = leaves // 2
        need = sum(r[1] for r in rows) * left / leaves
        upto, k = 0.0, 0
        while k < len(rows) and upto + rows[k][1] < need:
            upto += rows[k][1]
            k += 1
        # the nearer end of the crossing row
        k += not (need - upto < upto + rows[k][1] - need)
        cut(rows[:k], left, first)
        cut(rows[k:], leaves - left, first + left)
    cut(points, n_shards, 0)
    return out


def test_cuts_by_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)  # cut to the row
    rng = random.Random(3)
    pts = [(k, float(x), float(y), rng.randrange(1, 50)) for k, (x, y) in enumerate(
        zip(rng.sample(range(4000), 300), rng.sample(range(9000), 300)))]
    df = spark.createDataFrame([*pts], "k long, x double, y double, w long").repartition(4)
    for n in (2, 5, 8):
        out = sharding.kd_shards(df, id_col="k", group=F.col("k"), weight=F.col("w"),
                                 dimensions=[F.col("x"), F.col("y")], n_shards=n).collect()
        span = [max(p[i] for p in pts) - min(p[i] for p in pts) for i in (1, 2)]
        least = [min(p[i] for p in pts) for i in (1, 2)]
        steps = [((int((p[1] - least[0]) / span[0] * (sharding.STEPS - 1)),
                   int((p[2] - least[1]) / span[1] * (sharding.STEPS - 1))), p[3], p[0]) for p in pts]
        assert {r.id: r.shard for r in out} == brute_shards(steps, n)


def test_groups_of_equal_texts_stay_together(spark):
    rows = [(i, f"text number {i % 400} of many", f"l{i % 3}", f"s{i % 7}") for i in range(1600)]
    rows += [(5000 + i, "a copy that weighs too much for one shard " * 3, "l0", f"s{i % 5}")
             for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.shard_documents(docs, 6).collect()
    check([(i, t) for i, t, *_ in rows], out, 6, 0.05)
    shards, text = {}, {r[0]: r[1] for r in rows}
    for r in out:
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
    light = [s for t, s in shards.items() if not t.startswith("a copy")]
    assert len(light) == 400 and all(len(s) == 1 for s in light)
    assert sum(len(s) for t, s in shards.items() if t.startswith("a copy")) > 1
