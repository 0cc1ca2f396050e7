import zlib

import numpy as np
import pytest

from terrastat.llm import tokens
from terrastat.llm.queries import tokenizer_path
from terrastat.session import scratch_path

ODD = ["İstanbul ΣΑΣ. éa's don't  \t\n x y <|endoftext|> 1,234 a_b ﬁ ǅ ²³ Ⅷ 中文。日本", "", " ",
       "\n\n", "'s", " the.'s", "́lead word́ Å \x1c\x85 ​ 🙂🙂! It's.", "ŉ ß SS ...", "The THE the.",
       "word " * 5000, "x" * 30_000, None]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def expected(library, rows):
    out, start = {}, 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_pieces_give_the_librarys_ids(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text or "" for r in rows] + [t or "" for t in ODD]
    want = [np.array(e.ids, "<u4").tobytes()
            for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = tokens.Encoder(tokenizer_path())
    assert encoder.encode(texts) == want
    assert encoder.encode(texts) == want  # from the cache
    encoder._learn({"new piece." * 2})  # pieces beyond the cache are not kept for good
    assert "n" * 100 not in encoder.cache


def test_round_trip_order_and_pruning(spark, library):
    rows = [(i * 7 % 12, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = scratch_path(spark, "t-tokens")
    tokens.write_tokens(docs, path, tokenizer_path())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32)
           for r in tokens.token_index(spark, path).collect()}
    assert got == expected(library, rows)
    one = tokens.read_tokens(spark, path).where("doc_id = 7")
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()
    assert one.count() == 1
    footer = b"".join(p.read_bytes() for p in __import__("pathlib").Path(
        path.removeprefix("file:")).glob("part-*"))
    assert b"ORC" in footer


def test_empty_and_repeated(spark):
    path = scratch_path(spark, "t-tokens")
    none = spark.createDataFrame([], "doc_id long, text string, n_tokens int")
    tokens.write_tokens(none, path, tokenizer_path())
    assert tokens.token_index(spark, path).count() == 0
    path = scratch_path(spark, "t-tokens")
    twice = spark.createDataFrame([(1, "b"), (1, "b"), (1, "a"), (None, "c")],
                                  "doc_id long, text string")
    tokens.write_tokens(twice, path, tokenizer_path())
    got = tokens.token_index(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == [0, 2, 4, 6] and got[0].doc_id is None


AWKWARD = [*"abcdefghij   \n\t\r'stmdlvre.,!0123ABÉÈÀ", "İ", "ŉ", "ß", "՘", "é", "中",
           "\U0001f600", "\x1c", "\x85", " ", " ", "​", "<|endoftext|>",
           "<|startoftext|>", "̀", "²", "ⅷ", "١", "ﬁ", "ǅ", "　", "aaaaaaaaaaaa" * 7,
           "word", "The", "its'"]


def test_random_strings_give_the_librarys_ids(library, monkeypatch):
    import random

    rng, encoder = random.Random(3), tokens.Encoder(tokenizer_path())
    for k in range(60):
        if k == 30:
            monkeypatch.setattr(tokens, "CACHE_PIECES", 50)  # forgotten again and again
        texts = []
        for _ in range(100):
            top = rng.choice([0x300, 0x3000, 0x110000])
            some = [chr(c) for c in (rng.randrange(top) for _ in range(rng.randrange(12)))
                    if not 0xD800 <= c < 0xE000]
            some += [rng.choice(AWKWARD) for _ in range(rng.randrange(30))]
            rng.shuffle(some)
            texts.append("".join(some))
        want = [np.array(e.ids, "<u4").tobytes()
                for e in library.encode_batch(texts, add_special_tokens=False)]
        for text, a, b in zip(texts, encoder.encode(texts), want):
            assert a == b, text
