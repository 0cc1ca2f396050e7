import zlib
from collections import Counter

import corpus_pipeline
from terrastat.llm import decontaminate, langid, mixing
from terrastat.llm.common import staged
from terrastat.sources.tables import read_table
from test_jaccard import brute as brute_components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    bench = [(str(r.item_id), r.text) for r in read_table(spark, SF, "benchmark").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "n-gram Jaccard join", "benchmark decontamination",
        "mixing sources to target weights", "sharding"]
    extra = spark.createDataFrame([(10_000, "123 456 !!", None, "src0", 10), (10_001, None, "en", None, 0)],
                                  docs.schema)
    docs = docs.union(extra)
    seen = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, SF)
        if k < 4:
            assert out.columns == docs.columns
            out = staged(out, "t-stage")
        before = [(r.doc_id, r.text) for r in seen.collect()]
        after = Counter(r.doc_id for r in out.collect())
        if k == 0:
            models = langid.Models(langid.learn(seen.where(~langid.held_out())))
            langs, _ = models.predict([t for _, t in before])
            assert after == Counter(i for (i, _), x in zip(before, langs) if x != "und")
            assert len(after) == len(before) - 2
        elif k == 1:
            assert after == Counter(i for i, (_, c) in brute_components(before).items() if i == c)
        elif k == 2:
            assert after == Counter(r[0] for r in decontaminate.brute_force(before, bench) if not r[5])
        elif k == 3:
            want = {r.doc_id: round(r.taken / r.size) for r in mixing.taken(seen).collect()}
            assert sum(abs(after.get(i, 0) - n) for i, n in want.items()) <= 20
        else:
            assert sum(after.values()) == len(before)
            rows = out.collect()
            crc = {i: zlib.crc32(t.encode()) for i, t in before}
            assert all(r.text_crc32 == crc[r.doc_id] for r in rows)
            assert max(r.shard for r in rows) <= 23
        seen = out
    ran = corpus_pipeline.run(spark, SF)
    assert ran.columns == seen.columns


def test_entry_registers_all_eleven(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert None not in entry.oracle_sql().values()
