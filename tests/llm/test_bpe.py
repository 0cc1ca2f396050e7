import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrastat.llm import bpe
from terrastat.llm.queries import QUERIES
from tests.conftest import SF001

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"abcdefghij   \n\t\r'stmdlvre.,!0123", "԰", "՘", "é", "中",
         "\U0001f600", "\x1c", "\x85", " ", "​", "<|endoftext|>", "<|endof", "̀",
         "²", "ⅷ", "١", "﻿", "　", "aaaaaaaaaaaa", "        "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


def awkward(rng):
    if rng.random() < 0.3:
        top = rng.choice([0x530, 0x3000, 0x110000])
        return "".join(chr(c) for c in (rng.randrange(top) for _ in range(rng.randrange(20)))
                       if not 0xD800 <= c < 0xE000)
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(40)))


def merged(v, piece):
    """A piece's ids by running the merges, lowest rank first, leftmost first."""
    base = {t: i for i, t in reversed(list(enumerate(v.tokens))) if t is not None and len(t) == 1}
    ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(v.merges)}
    ids = [base[bytes([x])] for x in piece]
    while True:
        best = min(((ranks[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in ranks),
                   default=None)
        if best is None:
            return ids
        k = best[1]
        ids[k:k + 2] = [ranks[ids[k], ids[k + 1]][1]]


def test_backtracking_equals_merges(vocabulary):
    rng, e = random.Random(5), bpe.Encoder(vocabulary)
    for _ in range(1500):
        piece = bytes(rng.choice(b"aabbcdeinorst \xc3\xa9") for _ in range(rng.randrange(1, 24)))
        assert e.piece(piece.decode("latin-1")) == merged(vocabulary, piece), piece


def test_backtracking_gives_way():
    """A vocabulary whose longest first token must be taken back."""
    tokens = [bytes([i]) for i in range(256)]
    merges = []

    def add(a, b):
        tokens.append(tokens[a] + tokens[b])
        merges.append((a, b, len(tokens) - 1))
        return len(tokens) - 1

    a, b, c, d = b"abcd"
    bc = add(b, c)
    cd = add(c, d)
    ab = add(a, b)
    add(ab, cd)
    add(a, bc)
    v = bpe.Vocabulary(tokens, merges, {})
    e, rng = bpe.Encoder(v), random.Random(2)
    for _ in range(3000):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 14)))
        assert e.piece(piece.decode("latin-1")) == merged(v, piece), piece


def test_equals_library(vocabulary, library):
    rng, e, d = random.Random(1), bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    for _ in range(6000):
        s = awkward(rng)
        ids = np.frombuffer(e.encode(s), "<i4")
        assert ids.tolist() == library.encode(s, add_special_tokens=False).ids, s
        assert d.decode(ids.astype(np.int64)).decode() == s
        wild = [rng.randrange(50300) for _ in range(rng.randrange(8))]
        assert (d.decode(np.array(wild, np.int64)).decode("utf-8", "replace")
                == library.decode(wild, skip_special_tokens=False)), wild


def test_long_pieces_and_small_caches(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    monkeypatch.setattr(bpe, "DECODE_IDS", 7)
    e, d = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    for s in ("a" * 200_000, "abcxyz" * 30_000 + "q", " " * 100_000, "every word is a piece " * 50):
        ids = np.frombuffer(e.encode(s), "<i4")
        assert ids.tolist() == library.encode(s, add_special_tokens=False).ids
        assert d.decode(ids[:9000].astype(np.int64)) == s.encode()[:len(d.decode(
            ids[:9000].astype(np.int64)))]


def test_rows(spark, library):
    rows = [(1, "A b"), (1, "A b"), (2, None), (None, ""), (3, "x<|endoftext|>y"), (4, "z " * 5000)]
    df = (spark.createDataFrame(rows, "doc_id long, text string")
          .withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(None).cast("int")))
    enc = bpe.encode(df.repartition(3), PATH)
    expect = sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in
                    ((i or 0, t) for i, t in rows))
    assert sorted((r.doc_id or 0, r.ids) for r in enc.collect()) == expect
    assert all(r.n_tokens == len(r.ids) for r in enc.collect())
    back = sorted((r.doc_id or 0, r.text) for r in bpe.decode(enc, PATH).collect())
    assert back == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.encode(df.limit(0), PATH).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [None, 64, 99_999, -1])],
                                  "doc_id long, ids array<int>")
    assert sorted(tuple(r) for r in bpe.decode(nulls, PATH).collect()) == [(1, ""), (2, "a")]


def test_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    expect = set()
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expect.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(text.encode()).hexdigest()))
    got = QUERIES["op12_bpe"](spark, SF001)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == expect


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))
