import re
from collections import Counter

from pyspark.sql import functions as F

from terrastat.llm import mixing as M


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Targets by resharing what exceeds a cap until none is above it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(docs):
    rows = docs.collect()
    out = M.taken(docs).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r.doc_id, r.source) for r in rows)
    words = {r.doc_id: size(r.text) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    want, got = targets(sizes), Counter()
    for r in out:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        got[r.source] += r.taken
    assert all(abs(got[s] - t) <= 1 for s, t in want.items())
    return out


def test_given_tables_rerun_alike(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = check(docs)
    again = M.taken(docs.repartition(4)).collect()
    assert sorted(tuple(r) for r in out) == sorted(tuple(r) for r in again)


def test_caps_nulls_ties_and_clashing_columns(spark):
    rows = [(i, "w " * (i % 9), "big", 0) for i in range(400)]
    rows += [(1000 + i, "a b\tc\n", s, 1) for i, s in enumerate(["A", "a", "tiny", None, "é", "zero"])]
    rows += [(2000, None, "zero", 2), (2001, " \n", None, 2), (2002, "x " * 50_000, "long", 2)]
    schema = "doc_id long, text string, source string, number int"
    docs = spark.createDataFrame(rows, schema)
    check(docs)
    twice = docs.where("doc_id between 1 and 3")
    assert M.taken(twice.union(twice)).count() == 6
    assert M.taken(docs.limit(0)).count() == 0
    nothing = M.taken(docs.where("doc_id in (2000, 2001)")).collect()
    assert [r.taken for r in nothing] == [0, 0]


def stream(docs):
    """(doc_id, source) to sorted words taken, by walking each source's words."""
    rows = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    out = {}
    for source, target in targets(sizes).items():
        left = min(int(target + 0.5), 3 * sizes[source])
        own = sorted((r.h % 256, r.h, r.doc_id, size(r.text)) for r in rows if r.source == source)
        got = [0] * len(own)
        for _ in range(3):
            for k, (*_, n) in enumerate(own):
                took = min(n, left)
                got[k] += took
                left -= took
        for (_, _, i, n), k in zip(own, got):
            out.setdefault((i, source), []).append(k)
    return {k: sorted(v) for k, v in out.items()}


def by_document(out):
    got = {}
    for r in out:
        got.setdefault((r.doc_id, r.source), []).append(r.taken)
    return {k: sorted(v) for k, v in got.items()}


def test_taken_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "source")
    rows = [(7, "the same five words here", "b")] * 300 + [(8, None, "c")] * 3
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    assert by_document(M.taken(docs).collect()) == stream(docs)


def test_schedule_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = M.sized(docs)
    sources = M.targets(rows)
    s = sorted(sources.collect(), key=lambda r: r.number)
    slots = 300
    width = -(-sum(r.quota for r in s) // slots)
    blocks = {r.number: -(-r.quota // width) for r in s}
    total, every = sum(r.target for r in s), sum(blocks.values())
    want, used = [], Counter()
    for n in range(min(slots, every)):
        u = (n + 0.5) * M.GOLDEN % 1.0
        upto = 0.0
        for r in s:
            upto += r.target
            if u < upto / total or r is s[-1]:
                break
        if used[r.number] < blocks[r.number]:
            want.append((n, r.number, used[r.number]))
            used[r.number] += 1
    left = sorted((b, r.number) for r in s for b in range(used[r.number], blocks[r.number]))
    want += [(every + k, number, b) for k, (b, number) in enumerate(left)]
    got = sorted((r.slot, r.number, r.block) for r in M.schedule(sources, slots).collect())
    assert got == want


def test_mixed_copies_of_equal_rows(spark, monkeypatch):
    """Equal rows hold a third and more of a source, at several shares."""
    for equal, others in ((300, 300), (200, 400), (700, 300)):
        rows = [(1, "one two three four", "b", "x", k % 2) for k in range(equal)]
        rows += [(100 + k, " ".join(["w"] * (1 + k % 9)), "b", "y", 0) for k in range(others)]
        rows += [(5000 + k, "a b c d e f g", "a", "z", 0) for k in range(80 + equal)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string, "
                                           "chunk int")
        out = M.mixed(docs)
        assert out.columns == docs.columns
        want = {}
        for (i, source), got in stream(docs).items():
            n = {r[0]: size(r[1]) for r in rows}[i]
            want[i] = sum((2 * k + n) // (2 * n) for k in got)
        first = Counter(r.doc_id for r in out.collect())
        assert first == Counter({i: n for i, n in want.items() if n})
        monkeypatch.setattr(M, "CHUNK", 7)
        again = Counter(tuple(r) for r in M.mixed(docs.repartition(3)).collect())
        assert again == Counter(tuple(r) for r in out.collect())
        monkeypatch.setattr(M, "CHUNK", 1024)
        words = Counter()
        for r in out.collect():
            words[r.source] += size(r.text)
        sizes = Counter()
        for r in rows:
            sizes[r[2]] += size(r[1])
        assert all(abs(words[s] - t) <= 9 for s, t in targets(sizes).items())


def test_schedule_is_low_discrepancy_and_pieces_are_whole_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = M.sized(docs)
    sources = M.targets(rows)
    plan = M.schedule(sources, slots=500).toPandas().sort_values("slot")
    share = sources.toPandas().set_index("number")["target"]
    share = share / share.sum()
    n = plan["block_words"].count()
    for number, part in plan.groupby("number"):
        assert sorted(part["block"]) == list(range(len(part)))
    half = plan.head(n // 2)["number"].value_counts()
    assert all(abs(half.get(s, 0) - p * (n // 2)) <= 6 for s, p in share.items())
    placed = M.positions(rows, sources)
    pieces = M.pieces(placed, M.schedule(sources, slots=500)).toPandas()
    words = pieces.groupby(["number", "block"])["words"].sum()
    last = words.groupby("number").tail(1).index
    assert (words.drop(last) == plan["block_words"].iloc[0]).all()


def test_mixed_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out, want = M.mixed(docs), {r.doc_id: round(r.taken / r.size) for r in M.taken(docs).collect()}
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    assert all(abs(got.get(i, 0) - k) <= 1 for i, k in want.items())
    assert sum(got.get(i, 0) != k for i, k in want.items()) <= 20  # halves may round either way
    clash = docs.withColumns({c: F.lit(1) for c in ("mix_id", "__id", "mix_copy", "copies", "h",
                                                    "number", "size", "start")})
    assert Counter(r.doc_id for r in M.mixed(clash).collect()) == got


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = M.taken(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
