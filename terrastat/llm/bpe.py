"""Byte-pair encoding by backtracking, and decoding by an offset table.

A text is cut into pieces by the tokenizer's own rule (special strings first,
then letters, digits, other marks and white space), and a piece is encoded
without running its merges. One Aho-Corasick automaton over the vocabulary gives
the longest token at a position. The token stays if it is compatible with the
token before it: the two, side by side, must encode to just these two. That is
so if, taking both apart from the last merge backwards, no pair of their
neighbouring parts merges earlier than the parts themselves. Answers are kept in
a table of pairs. A token that does not fit is replaced by its longest prefix in
the vocabulary; where none is left, the position is marked dead and the token
before it gives way. A position dies at most once, so time is linear in the
piece, and neighbours that are compatible throughout are the one result that
the merges have.

Decoding gathers bytes: token ``i`` is ``blob[offset[i]:offset[i + 1]]``.

The vocabulary (a bounded file) is read by the driver and broadcast. Tasks need
no shuffle, hold texts in slices of bytes, and keep at most ``CACHE_PIECES``
pieces and ``PAIRS`` pairs.

Defined cases: a null text encodes as an empty one; equal rows and null or equal
ids are rows of their own; ids beyond the vocabulary decode to nothing, null ids
to an empty text, bytes that are no UTF-8 to U+FFFD; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastat.llm.common import byte_slices, held, mapped

CACHE_PIECES = 300_000
CACHED_CHARS = 32
PAIRS = 500_000
DECODE_IDS = 1 << 18
# Fixed value: the piece rule of byte-level vocabularies.
PIECES = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
          r"|\s+(?!\S)|\s+")
# The regex module and the tokenizer's rule may follow different Unicode
# versions; below this character the classes of both are the same.
SETTLED = "\u0530"

ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>"
NONE = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level files write bytes: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(odd)}}


@dataclass
class Vocabulary:
    """What encoding and decoding need of a tokenizer file."""

    tokens: list[bytes | None]  # by id
    merges: list[tuple[int, int, int]]  # left, right, merged; by rank
    special: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = all(not model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
            "byte_fallback", "ignore_merges"))
        if (model["type"] != "BPE" or not plain or spec["normalizer"] is not None
                or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex") or (spec["decoder"] or {}).get("type") != "ByteLevel"
                or any(t[k] for t in spec["added_tokens"]
                       for k in ("lstrip", "rstrip", "single_word", "normalized"))):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        letters, vocab = byte_letters(), model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens: list = [None] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        merges, known = [], {i for i, t in enumerate(tokens) if t is not None and len(t) == 1}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if a not in known or b not in known or c in known:
                raise ValueError(f"{path}: merge {pair} is out of order")
            known.add(c)
            merges.append((a, b, c))
        if len({tokens[i] for i in known if len(tokens[i]) == 1}) < 256:
            raise ValueError(f"{path}: a byte has no token")
        return cls(tokens, merges, special)


@dataclass
class Encoder:
    """Backtracking encoder of one vocabulary."""

    v: Vocabulary
    cache: dict[str, bytes] = field(default_factory=dict)
    pairs: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self):
        import ahocorasick
        import regex

        n = len(self.v.tokens)
        self.n = n
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.merge = {}
        for r, (a, b, c) in enumerate(self.v.merges):
            self.rank[c], self.left[c], self.right[c] = r, a, b
            self.merge[a * n + b] = r
        # tokens that the merges of their own bytes give, as Latin-1 strings
        self.whole = {t.decode("latin-1"): i for i, t in enumerate(self.v.tokens)
                      if t is not None and len(t) == 1}
        for r, (a, b, c) in enumerate(self.v.merges):
            parts = (self.v.tokens[a].decode("latin-1"), self.v.tokens[b].decode("latin-1"))
            if all(x in self.whole for x in parts) and self._stay(a, b, r):
                self.whole["".join(parts)] = c
        self.length = [len(t or b"") for t in self.v.tokens]
        self.longest = max(map(len, self.whole))
        self.automaton = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter = [-1] * n  # the longest proper prefix that is a token
        for t, i in self.whole.items():
            self.shorter[i] = next((self.whole[t[:k]] for k in range(len(t) - 1, 0, -1)
                                    if t[:k] in self.whole), -1)
        self.split = regex.compile(PIECES).findall
        self.marks = (regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.v.special, key=lambda s: (-len(s), s))) + ")")
            if self.v.special else None)
        self._rule = None  # the library's piece rule, where the classes may differ

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay as they are side by side."""
        key = a * self.n + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay(a, b)
        return known

    def _stay(self, a: int, b: int, before: int = NONE) -> bool:
        """Whether no merge earlier than ``before`` joins bytes of both."""
        rank, merge, n = self.rank, self.merge, self.n
        while True:
            if merge.get(a * n + b, NONE) < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            elif rank[b] < 0:
                return True  # two bytes
            else:  # of merges of one rank the left one comes first
                before, b = rank[b] + 1, self.left[b]

    def _at(self, s: str, pos: int) -> int:
        """The longest token that begins at ``pos``; every byte is one."""
        return next(self.automaton.iter_long(s[pos:pos + self.longest]))[1]

    def piece(self, s: str) -> list[int]:
        """Ids of one piece, given as its bytes in Latin-1."""
        if not s:
            return []
        if s in self.whole:
            return [self.whole[s]]
        length, shorter, compatible = self.length, self.shorter, self.compatible
        out: list[int] = []
        dead: set[int] = set()
        pos, token = 0, self._at(s, 0)
        while pos < len(s):
            while True:
                end = pos + length[token]
                if end not in dead and (not out or compatible(out[-1], token)):
                    out.append(token)
                    pos = end
                    token = self._at(s, pos) if pos < len(s) else -1
                    break
                token = shorter[token]
                if token < 0:  # nothing fits here: the token before gives way
                    dead.add(pos)
                    token = out.pop()
                    pos -= length[token]
                    break
        return out

    def pieces(self, text: str) -> list[str]:
        if not text or max(text) < SETTLED:
            return self.split(text)
        if self._rule is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._rule = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self._rule.pre_tokenize_str(text)]

    def _plain(self, text: str) -> list[bytes]:
        out, get = [], self.cache.get
        for p in self.pieces(text):
            ids = get(p)
            if ids is None:
                ids = np.array(self.piece(p.encode("utf-8", "replace").decode("latin-1")),
                               "<i4").tobytes()
                if len(p) <= CACHED_CHARS:
                    if len(self.cache) >= CACHE_PIECES:
                        self.cache.clear()
                    self.cache[p] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if self.marks is None or not any(s in text for s in self.v.special):
            return b"".join(self._plain(text))
        out = []
        for part in self.marks.split(text):
            if part in self.v.special:
                out.append(np.array([self.v.special[part]], "<i4").tobytes())
            else:
                out += self._plain(part)
        return b"".join(out)


class Decoder:
    """Token bytes in one array, and where each token's bytes begin."""

    def __init__(self, v: Vocabulary):
        sizes = [len(t or b"") for t in v.tokens]
        self.offset = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(t or b"" for t in v.tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids, ``DECODE_IDS`` at a time."""
        out = []
        for at in range(0, len(ids), DECODE_IDS):
            part = ids[at:at + DECODE_IDS]
            part = part[(part >= 0) & (part < len(self.offset) - 1)]
            begins = self.offset[part]
            sizes = self.offset[part + 1] - begins
            ends = np.cumsum(sizes)
            take = np.repeat(begins - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
            out.append(self.blob[take].tobytes())
        return b"".join(out)


def _shared(spark: SparkSession, path: str) -> tuple[Broadcast, str]:
    """The vocabulary for the tasks, and a name for it."""
    v = Vocabulary.read(path)
    return spark.sparkContext.broadcast(v), sha256(repr(v).encode()).hexdigest()


def _made(kind, shared: tuple[Broadcast, str]):
    """One encoder or decoder a worker process and vocabulary."""
    vocabulary, name = shared
    return held((kind.__name__, name), lambda: kind(vocabulary.value))


def encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids of every text."""
    shared = _shared(docs.sparkSession, tokenizer_path)

    def run(batches):
        encoder = _made(Encoder, shared)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                raw = [encoder.encode(t or "") for t in part.column("text").to_pylist()]
                counts = np.array([len(x) // 4 for x in raw], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts),
                     pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    names=["doc_id", "n_tokens", "ids"])

    return mapped(docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                              F.col(text_col).cast("string").alias("text")), run, ENCODED, "bpe")


def _rows_of(column: pa.ListArray):
    """The ids of each row as an array; a null row is empty."""
    flat = np.asarray(column.flatten().fill_null(-1), np.int64)
    ends = np.cumsum(np.asarray(pc.fill_null(
        pc.list_value_length(column), 0), np.int64))
    return [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)]


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of every row of ids."""
    shared = _shared(encoded.sparkSession, tokenizer_path)

    def run(batches):
        decoder = _made(Decoder, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [decoder.decode(ids).decode("utf-8", "replace")
                         for ids in _rows_of(part.column("ids"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.string())],
                    names=["doc_id", "text"])

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string", "bpe")


def digest(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: hashes of the ids (as
    little-endian unsigned 32-bit integers) and of the text they decode to."""
    shared = _shared(encoded.sparkSession, tokenizer_path)

    def run(batches):
        decoder = _made(Decoder, shared)
        for batch in batches:
            hashes = [(sha256(ids.astype("<u4").tobytes()).hexdigest(),
                       sha256(decoder.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
                      for ids in _rows_of(batch.column("ids"))]
            a, b = zip(*hashes) if hashes else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"),
                 pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(
        encoded.select("doc_id", "n_tokens", "ids"), run,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "bpe")
