"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters.

Texts are range-partitioned by document id, sorted, tokenised partition by
partition and written as one ORC file per partition, so the files are in
ascending id order. Each row keeps ``local_start``, the ids before it in its
file; ``start`` is that plus the ids of all earlier files. Stripes are read in
parallel by Spark's ORC reader, and a filter on ``doc_id`` prunes files by
stripe statistics, row groups by row index, and groups by the Bloom filter.

The tokenizer sees each distinct piece between spaces or line ends once: its
rules never join ids across white space, so a text's ids are its pieces' ids in
order. A worker keeps about ``CACHE_PIECES`` of their parts.

Defined cases: a null text is an empty text (only the end id); documents with
equal ids are ordered by text; null ids come first; an empty table gives an
empty folder that reads back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrastat.llm.common import byte_slices, held, mapped

CACHE_PIECES = 500_000
CACHED_CHARS = 64
WORDS_A_CALL = 2000
# Closing punctuation that the tokenizer's rules keep apart from
# letters and join to one word (no apostrophe), the rules that say so, and the mark
# of a word's end.
CLOSING = ".,;:!?%&*$#"
RULES = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]"
                                               r"|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
         "use_regex": False}]})
WORD_END = "</w>"
# Letters of simple words: those below U+0250 whose lower case is one letter.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130")
SIMPLE = f"^[{LETTERS}]+$"
SLICE_BYTES = 4 << 20
STRIPE_BYTES = 16 << 20
ROWS_PER_INDEX = 1000
BLOOM_FPP = 0.01
END_ID = 1

FILE_SCHEMA = "doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"


class Encoder:
    """A tokenizer with a cache of units, one for a worker process.

    A text's pieces are split, and told apart, by Arrow, so that Python sees each
    distinct piece of a slice once. Most pieces are one word of letters below U+0250
    with closing punctuation: the tokenizer's rules make those two words of their
    own, so a unit is the letters in lower case, or the punctuation. Words go to the
    tokenizer many in one call, and its end-of-word ids tell them apart. Any other
    piece is a unit as it is. All ids lie in one array; a text's ids are gathered
    from it by numpy.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = self.words = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.simple = (spec["normalizer"], spec["pre_tokenizer"]) == RULES
        if self.simple:
            # simple words in lower case need no normalizing and no word rule
            spec.update(normalizer=None, added_tokens=[], pre_tokenizer={
                "type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, RULES[1][
                    "pretokenizers"][1]]})
            self.words = Tokenizer.from_str(json.dumps(spec))
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith(WORD_END)
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}  # unit to its place in ``begin``
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.units = self.used = self.kept = 0  # units and ids held; units to keep

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append units given by their ids in a row; the first one's place."""
        first, n = self.units, len(sizes)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.units + n > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.begin[first:first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first:first + n] = sizes
        self.used += len(ids)
        self.units += n
        return first

    def _each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]
        return (np.array([i for x in found for i in x], np.int32),
                np.array([len(x) for x in found], np.int64))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple words, encoded in one call."""
        ids = np.array(self.words.encode_batch_fast(
            [" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        to = np.flatnonzero(self.ends[ids]) + 1
        if len(to) != len(words) or (len(to) and to[-1] != len(ids)):
            return self._each(words)
        return ids, np.diff(to, prepend=0)

    def _learn(self, units: Iterable[str], words: bool = False, keep: bool = True) -> int:
        """Append distinct units that the cache lacks, simple words or others, and
        give the first one's place; ``keep`` puts them in the cache."""
        units, first = list(units), self.units
        for at in range(0, len(units), WORDS_A_CALL):
            self._add(*(self._words if words else self._each)(units[at:at + WORDS_A_CALL]))
        if keep:
            self.cache.update(zip(units, range(first, self.units)))
            self.kept = self.units
        return first

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in a row, and the number of each text's."""
        if len(self.cache) > CACHE_PIECES:
            self._forget()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        pieces, index = coded.dictionary, np.asarray(coded.indices)
        word = pc.utf8_rtrim(pieces, CLOSING)
        simple = (np.asarray(pc.match_substring_regex(word, SIMPLE)) if self.simple
                  else np.zeros(len(pieces), bool))
        mask = pa.array(simple)
        whole = pc.if_else(mask, pc.utf8_lower(word), pieces)
        tail = pc.if_else(mask, pc.utf8_ltrim(pieces, LETTERS), "")
        units = pa.concat_arrays([whole, tail]).dictionary_encode()
        names = units.dictionary.to_numpy(zero_copy_only=False)
        place = np.asarray(units.indices)
        is_word = np.zeros(len(names), bool)
        is_word[place[:len(pieces)][simple]] = True
        got = np.fromiter(map(self.cache.get, names, repeat(-1)), np.int64, len(names))
        lacking = got < 0
        if lacking.any():
            short = np.asarray(pc.utf8_length(units.dictionary)) <= CACHED_CHARS
            # long units come last, so that they can be dropped again
            for keep, word in ((True, True), (True, False), (False, True), (False, False)):
                these = np.flatnonzero(lacking & (short == keep) & (is_word == word))
                first = self._learn(names[these], word, keep)
                got[these] = first + np.arange(len(these))
        at = got[place].reshape(2, -1).T.ravel()  # word, tail, word, ...
        own = _gathered(self.ids, self.begin[at], self.size[at])
        sizes = self.size[at].reshape(-1, 2).sum(axis=1)
        ids = _gathered(own, (np.cumsum(sizes) - sizes)[index], sizes[index])
        ends = np.concatenate([[0], np.cumsum(sizes[index])])
        counts = np.diff(ends[np.asarray(split.offsets)])
        if self.kept < self.units:  # long units aren't kept for the next slice
            self.used, self.units = int(self.begin[self.kept]), self.kept
        return ids, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.flat(pa.array(texts, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
        return [raw[b:e] for b, e in zip((ends - counts * 4).tolist(), ends.tolist())]


def _gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of ``flat`` in a row."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - (ends - sizes), sizes)
                + np.arange(int(ends[-1]) if len(ends) else 0)]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES,
                 rows_per_index: int = ROWS_PER_INDEX) -> None:
    """Tokenise ``docs`` and write ORC files under ``path`` in id order."""

    def encode(batches):
        encoder = held(tokenizer_path, lambda: Encoder(tokenizer_path))
        before = 0
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                ids, counts = encoder.flat(pc.fill_null(part.column("text"), ""))
                counts = counts + 1  # with the end id
                ends = np.cumsum(counts)
                flat = np.empty(int(ends[-1]), np.int32)
                last = np.zeros(len(flat), bool)
                last[ends - 1] = True
                flat[last], flat[~last] = end_id, ids
                starts = before + ends - counts
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(starts), pa.array(counts),
                     pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                              pa.array(flat))],
                    names=["doc_id", "local_start", "n_tokens", "ids"])
                before += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).alias("text"))
    tie = F.xxhash64("text")  # spreads and orders rows of one id
    order = [F.col("doc_id").asc_nulls_first(), tie, F.col("text").asc_nulls_first()]
    placed = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    (mapped(placed, encode, FILE_SCHEMA, "tokens")
     .write.option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
     .option("orc.stripe.size", str(stripe_bytes))
     .option("orc.row.index.stride", str(rows_per_index))
     .option("orc.create.index", "true")
     .orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: doc_id, local_start, n_tokens, ids. A filter on
    ``doc_id`` is pushed to the stripe and row-group indexes."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")
    rows = read_tokens(spark, path).withColumn("file", number)
    # one row per file: the prefix sum over files is small beside the data
    per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select(F.col("file").alias("of"),
                              F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))

    def crc(batches):
        for batch in batches:
            lists = batch.column("ids")
            flat = np.asarray(lists.flatten()).astype("<u4")
            ends = np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(begins, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file"), batch.column("local_start"),
                 pa.array(ends - begins, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "file", "local_start", "n_tokens", "ids_crc32"])

    found = mapped(
        rows.select("doc_id", "file", "local_start", "ids"), crc,
        "doc_id bigint, file bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint", "tokens")
    return found.join(offsets, found.file == offsets["of"]).select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
