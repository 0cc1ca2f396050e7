"""Language identification by cross-parsing entropy.

For every learned language a suffix automaton holds a bounded sample of its
labelled text. A text is parsed greedily into the longest phrases that occur in
that sample; the language that needs the fewest phrases, normalised to
``phrases * log2(sample size) / symbols``, wins. Texts are case-folded to
letters with single spaces between letter runs, and cut into blocks of
``BLOCK`` symbols so that a very long text is many short parses: a block border
ends a phrase for all languages alike. All blocks of a batch step through a
dense transition table together (one numpy step per symbol position).

Sample bound: ``FRAGMENTS`` fragments of ``FRAGMENT_CHARS`` characters per
language, chosen by a hash of the text. Everything else covers whole texts.

Defined cases: ``und`` with score 0 for a null text, a text without a letter,
or when nothing could be learned; equal costs go to the language first in code
point order; letters that the samples lack end a phrase; repeated rows get
equal answers; null languages teach nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastat.llm.common import byte_slices, held, mapped

FRAGMENTS = 128
FRAGMENT_CHARS = 256
BLOCK = 256
LANES = 4096
BATCH_CHARS = 1 << 20
UND = "und"


def learn(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
          fragments: int = FRAGMENTS, fragment_chars: int = FRAGMENT_CHARS) -> dict[str, list[str]]:
    """The bounded sample: language to fragments (at most ``fragments``).

    A text falls into one of ``fragments`` buckets by its hash; each bucket
    keeps the text of least hash, so copies count once and the aggregation
    combines before its shuffle.
    """
    h = F.xxhash64(F.col("t"))
    start = F.lit(1) + F.pmod(F.shiftright(h, 8), F.greatest(
        F.lit(1), F.char_length("t") - F.lit(fragment_chars))).cast("int")
    rows = (labelled.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
            .where("t is not null and l is not null")
            .select("l", h.alias("h"), F.pmod(h, F.lit(fragments)).alias("b"),
                    F.substring(F.col("t"), start, F.lit(fragment_chars)).alias("f")))
    kept = rows.groupBy("l", "b").agg(F.min_by("f", F.struct("h", "f")).alias("f")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(kept, key=lambda r: (r.l, r.b)):
        out.setdefault(r.l, []).append(r.f)
    return dict(sorted(out.items()))


def _folded(c: str) -> str:
    """The lower-case letter of a character, '' if it is no letter."""
    return c.lower()[0] if c.isalpha() else ""


def suffix_automaton(symbols: list[int], breaks: set[int]) -> list[dict[int, int]]:
    """Transitions per state of the suffix automaton of ``symbols``; positions
    in ``breaks`` start a new fragment (phrases don't run across)."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for i, c in enumerate(symbols):
        if i in breaks:
            last = 0
        if c in nxt[last]:  # generalised automaton: the extension may exist
            q = nxt[last][c]
            if length[last] + 1 == length[q]:
                last = q
                continue
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[last] + 1)
            link[q] = clone
            p = last
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            last = clone
            continue
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[cur] = clone
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = cur
    return nxt


class Models:
    """Dense tables of all languages, for one worker process."""

    def __init__(self, sample: dict[str, list[str]]):
        letters = sorted({x for fs in sample.values() for f in fs for c in f if (x := _folded(c))})
        number = {c: i + 1 for i, c in enumerate(letters)}
        self.width = len(letters) + 2  # 0: a run of other characters; last: an unlearned letter
        wide = np.uint8 if self.width < 256 else np.uint16 if self.width < 65536 else np.int32
        self.symbol = np.zeros(sys.maxunicode + 1, wide)
        for cp in range(sys.maxunicode + 1):
            c = chr(cp)
            if c.isalpha():
                self.symbol[cp] = number.get(_folded(c), self.width - 1)
        self.langs, self.tables, self.weights = list(sample), [], []
        for fs in sample.values():
            symbols, breaks = [], set()
            for f in fs:
                breaks.add(len(symbols))
                symbols += self.symbols([f])[0].tolist()
            nxt = suffix_automaton(symbols, breaks)
            # (target state * width) * 2, + 1 where a phrase starts at the symbol;
            # the last state follows a symbol that the sample lacks
            lacking = len(nxt)
            restart = np.full(self.width, lacking, np.int64)
            for c, q in nxt[0].items():
                restart[c] = q
            small = np.int32 if (lacking + 1) * self.width * 2 < 2 ** 31 else np.int64
            table = np.empty((lacking + 1, self.width), small)
            table[:] = restart * self.width * 2 + 1
            for s, row in enumerate(nxt):
                for c, q in row.items():
                    table[s, c] = q * self.width * 2
            table[0] = restart * self.width * 2  # a text's first phrase is counted apart
            self.tables.append(table.ravel())
            self.weights.append(math.log2(max(2, len(symbols))))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, each text between single 0s, and the
        number of symbols of each text."""
        joined = "\n" + "\n\n".join(texts) + "\n"
        sym = self.symbol[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        ends = np.cumsum(lens)
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
        keep[ends[:-1]] = True  # the opening 0 of the next text
        kept = np.concatenate([[0], np.cumsum(keep)])
        return sym[keep], np.diff(kept[np.concatenate([[0], ends])])

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases * log2(sample) / symbols per text and language, has a letter)."""
        sym, n = self.symbols(texts)
        begins = np.cumsum(n) - n
        blocks = -(-n // BLOCK)
        doc = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = begins[doc] + nth * BLOCK
        size = np.minimum(BLOCK, n[doc] - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        at, size, doc = at[order], size[order], doc[order]
        sym = np.concatenate([sym, np.zeros(BLOCK, sym.dtype)])
        phrases = np.zeros((len(texts), len(self.langs)))
        for lo in range(0, len(at), LANES):
            a, z, d = at[lo:lo + LANES], size[lo:lo + LANES], doc[lo:lo + LANES]
            steps = np.ascontiguousarray(sym[a[:, None] + np.arange(int(z[0]))].T)
            active = np.searchsorted(-z, -np.arange(int(z[0])), "left")
            for k, table in enumerate(self.tables):
                state, count = np.zeros(len(a), table.dtype), np.ones(len(a), np.int32)
                for t, m in enumerate(active):
                    v = table.take(state[:m] + steps[t, :m])
                    count[:m] += (v & 1).astype(np.int32)
                    state[:m] = v >> 1
                phrases[:, k] += np.bincount(d, count, len(texts))
        has = n > 2
        return phrases * np.array(self.weights) / np.maximum(n, 1)[:, None], has

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars < BATCH_CHARS):
                chars += len(texts[to] or "")
                to += 1
            cost, has = self.costs([t or "" for t in texts[at:to]])
            best = cost.argmin(axis=1)
            ranked = np.sort(cost, axis=1)
            margin = 1 - ranked[:, 0] / ranked[:, 1] if len(self.langs) > 1 else np.ones(to - at)
            for i in np.flatnonzero(has):
                langs[at + i], scores[at + i] = self.langs[best[i]], float(margin[i])
            at = to
        return langs, scores


def _predictor(spark, sample: dict[str, list[str]]):
    # bounded by languages * FRAGMENTS * FRAGMENT_CHARS; tables are built per worker
    shared, key = spark.sparkContext.broadcast(sample), uuid.uuid4().hex

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not shared.value:
            return [UND] * len(texts), [0.0] * len(texts)
        return held(key, lambda: Models(shared.value)).predict(texts)

    return predict


def identify(docs: DataFrame, sample: dict[str, list[str]], *, text_col: str = "text",
             carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of ``docs`` plus ``lang_pred`` and ``score``
    (relative margin between the two cheapest languages, 0 to 1)."""
    predict = _predictor(docs.sparkSession, sample)

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, "__text"):
                langs, scores = predict(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carry), pa.array(langs, pa.string()),
                     pa.array(scores, pa.float64())], names=[*carry, "lang_pred", "score"])

    rows = docs.select(*carry, F.col(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return mapped(rows, run, ", ".join([*fields, "lang_pred string, score double"]), "langid")


def recognised(docs: DataFrame, sample: dict[str, list[str]], *, text_col: str = "text",
               min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` with a language (not ``und``) and a score of at
    least ``min_score``, all columns unchanged. Where nothing was learned no
    language can be told: the rows whose text has a letter, whatever the score."""
    predict = _predictor(docs.sparkSession, sample)
    learned = bool(sample)

    def keep(batches):
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for part in byte_slices(batch, at):
                texts = part.column(at).to_pylist()
                if learned:
                    stay = [x != UND and s >= min_score for x, s in zip(*predict(texts))]
                else:
                    stay = [any(map(str.isalpha, t or "")) for t in texts]
                yield part.filter(pa.array(stay, pa.bool_()))

    return mapped(docs, keep, docs.schema, "langid")


def held_out(id_col: str = "doc_id") -> Column:
    """Fixed split: a fifth of the documents by a checksum of the id (a null id
    is held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(True))
