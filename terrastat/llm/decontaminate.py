"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after A-Z are
lower-cased. In UTF-8 every other byte is a separator, so one byte translation
normalises a text and the automaton runs over ``" w1 w2 ... "``. A pattern is a
window of ``window`` consecutive item words between two spaces (an item of
fewer words is one pattern). Every text is scanned once; only texts with an
occurrence are walked again to map word numbers to code-point offsets.

The patterns travel as a broadcast whose size is checked: items are cut into
blocks of at most ``block_bytes`` of item text, and beyond one block the texts
pass through one automaton per block, hits being united in the row, so no item
is dropped. Each Python worker builds an automaton once per block.

Defined cases: null or wordless text has no words and no hits; a null item text
has no windows; a null item id counts as the item named ``null``; rows that
repeat are scanned and returned each; extra columns are carried when asked for.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.llm.common import byte_slices, held, mapped

WINDOW = 10
BLOCK_BYTES = 8 << 20

# The word class of the contract, on lower-cased UTF-8 bytes and
# on the original code points.
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes((b | 0x20) if 0x41 <= b <= 0x5A else (b if b in _KEEP else 0x20)
               for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _automaton(items: list[tuple[str, str]], window: int):
    """Automaton whose values are (words in the pattern, item numbers)."""
    import ahocorasick

    patterns: dict[bytes, tuple[int, set[str]]] = {}
    for item_id, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            p = b" " + b" ".join(w[i:i + n]) + b" "
            patterns.setdefault(p, (n, set()))[1].add(item_id)
    a = ahocorasick.Automaton()
    for p, v in patterns.items():
        a.add_word(p.decode("latin-1"), v)
    if patterns:
        a.make_automaton()
    return a if patterns else None


def _scan(words: list[bytes], automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Hit word ranges [from, to) and the items with an occurrence."""
    if automaton is None or not words:
        return [], set()
    joined = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(joined.decode("latin-1")))
    if not found:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    last = np.searchsorted(spaces, [e for e, _ in found])
    ranges = [(int(k) - n, int(k)) for k, (_, (n, _)) in zip(last, found)]
    return ranges, set().union(*(ids for _, (_, ids) in found))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_HITS = pa.struct([("from_word", pa.int64()), ("to_word", pa.int64()),
                   ("start", pa.int64()), ("end", pa.int64())])


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int):
    """(key, broadcast of (item id, text)) for each block of items."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"),
                             F.col(item_text).alias("t")).where("t is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-int(total) // block_bytes))
    for b in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        # about block_bytes of item text, by the measured total
        yield uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in part.collect()])


def find_hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
              text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
              window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
              carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the ``carry`` columns,
    ``n_words``, ``hits`` (merged hit ranges: word numbers and code-point
    offsets in the original text) and ``items`` (sorted item ids as strings)."""
    passed = [F.col(c) for c in carry]
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *passed,
                     F.array().cast("array<struct<from_word:bigint,to_word:bigint,start:bigint,"
                                    "end:bigint>>").alias("hits"),
                     F.array().cast("array<string>").alias("items"),
                     F.lit(0).cast("bigint").alias("n_words"))
    schema = df.schema
    for key, shared in _blocks(benchmark, item_col, item_text, block_bytes):

        def scan(batches, key=key, shared=shared):
            automaton = held(key, lambda: _automaton(shared.value, window))
            for batch in (part for b in batches for part in byte_slices(b, "__text")):
                hits, items, n_words = [], [], []
                texts = batch.column("__text").to_pylist()
                before_h, before_i = (batch.column(c).to_pylist() for c in ("hits", "items"))
                for text, h, i in zip(texts, before_h, before_i):
                    words = words_of(text)
                    ranges, ids = _scan(words, automaton)
                    n_words.append(len(words))
                    if ranges:
                        merged = _merged(ranges + [(x["from_word"], x["to_word"]) for x in h])
                        at = [m.span() for m in _WORD.finditer(text)]
                        h = [{"from_word": a, "to_word": z, "start": at[a][0],
                              "end": at[z - 1][1]} for a, z in merged]
                        i = sorted(ids.union(i))
                    hits.append(h)
                    items.append(i)
                cols = {f: batch.column(f) for f in batch.schema.names}
                cols["hits"] = pa.array(hits, pa.list_(_HITS))
                cols["items"] = pa.array(items, pa.list_(pa.string()))
                cols["n_words"] = pa.array(n_words, pa.int64())
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        df = mapped(df, scan, schema, "decontaminate")
    return df.drop("__text")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_hits``."""
    return found.select(
        "doc_id", "n_words",
        F.aggregate("hits", F.lit(0).cast("bigint"),
                    lambda s, x: s + x["to_word"] - x["from_word"]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.transform("hits", lambda x: F.struct(x["start"].alias("start"),
                                               x["end"].alias("end"))).alias("spans"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without an occurrence, all columns unchanged."""
    out, at = docs, docs.columns.index(text_col)
    for key, shared in _blocks(benchmark, item_col, item_text, block_bytes):

        def keep(batches, key=key, shared=shared):
            automaton = held(key, lambda: _automaton(shared.value, window))
            for batch in (part for b in batches for part in byte_slices(b, at)):
                texts = batch.column(at).to_pylist()
                yield batch.filter(pa.array([not _scan(words_of(t), automaton)[0] for t in texts],
                                            pa.bool_()))

        out = mapped(out, keep, docs.schema, "decontaminate")
    return out


def brute_force(docs: list[tuple], bench: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Reference for small fixtures: every window against every position."""
    pats = []
    for item, text in bench:
        w = words_of(text)
        n = min(window, len(w))
        pats += [(str(item), w[i:i + n]) for i in range(len(w) - n + 1 if n else 0)]
    out = []
    for doc_id, text in docs:
        w = words_of(text)
        hit, items = set(), set()
        for item, p in pats:
            for i in range(len(w) - len(p) + 1):
                if w[i:i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    items.add(item)
        out.append((doc_id, len(w), len(hit), len(items),
                    hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out
