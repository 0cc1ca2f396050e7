"""Exact n-gram Jaccard join (0.8 and more) with signature trees.

Plan, every step over all documents:

1. Each document becomes the set of its five-word shingles. Equal sets are one
   *class* (id: a hash of the set), so copies count once from here on.
2. Routing. In any one order of all shingles, two sets that link share a shingle
   within their first ``n - ceil(0.8 n) + 1`` (prefix filtering). The order is
   by code, with frequent shingles last: those that recur within a chunk of
   ``CHUNK_CODES`` codes, the ``HOT_MAX`` most counted. Any order gives the same
   links; this one keeps a passage that many documents share out of the keys. A
   *bucket* is the classes with one prefix shingle. Class and place travel, not
   the sets. A bucket row stays only if size and place leave it a partner. With
   a prefix longer by a part ``b`` of the size, two sets share at least one more
   shingle for each that both prefixes gained, so a class that shares fewer with
   anyone of its size range goes: chance collisions of unrelated texts end here.
   Of buckets with the same classes only the first by code stays, since a pair
   can't meet for the first time in a later one.
3. In a bucket a *signature tree* is built over the classes by size. A leaf holds
   ``LEAF`` bitmaps of one bit a shingle or more, a node the OR of its children's
   bitmaps, the size range and the largest ``n - bits`` (shingles that share a
   bit). Two node sets are traversed together; ``common bits + the smaller
   excess`` bounds any overlap below them, and node pairs whose bound or size
   ratio can't reach the threshold are pruned, as are nodes of one component.
4. A first round meets each bucket's ``LEADS`` smallest classes with all others
   and verifies, for each class, the lead of the highest bound; the links make
   components. The second round takes the buckets that still hold two components.
   Bitmaps first mark the classes that are in a pair which they can't rule out, in
   the first bucket that the pair shares. Whole sets are then sent for these rows
   alone and verified where they meet: pairs of one component are passed over as
   links join components, and only the links come out. So no pair of classes ever
   is a row, a large group of near copies costs few comparisons, and no link
   between components is missed. Buckets over ``BLOCK`` classes or ``BLOCK_CODES``
   codes are cut into blocks, all pairs of blocks being separate groups, so a
   task's memory is bounded in rows and bytes (one set larger than a block is a
   block of its own).

Plan choices, none of which changes a result (a test holds them to that): frames
of at most ``BROADCAST_ROWS`` short rows are broadcast; a bucket over
``VIABLE_MAX`` rows is kept whole where the size test would prune it; at most
``HOT_MAX`` frequent shingles are moved to the order's end.

Defined cases: a null, empty or wordless text has the empty set, no links and
itself as component; texts of fewer than five words are one shingle; repeated
rows are answered each; extra columns are ignored. Sets are compared on 64-bit
shingle codes; equal 63-bit class ids are taken as equal sets, so among D distinct
sets about D*D / 2**64 false merges are to be expected: one in 18 million at 10**6
sets, about five in all at 10**10.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terrastat.llm.common import byte_slices, mapped, staged
from terrastat.llm.shingles import set_id, shingle_set
from terrastat.operators.components import connected_components

PERCENT = 80
EXTRA_PERCENT = 8
CHUNK_CODES = 2_000_000
HOT_LOCAL = 5
HOT_MAX = 200_000
VIABLE_MAX = 20_000
JUDGED = 1 << 19
BLOCK, BLOCK_CODES = 4096, 1 << 21
LEADS = 8
LEAF, FAN = 32, 8
SLICE_BYTES = 1 << 20
BROADCAST_ROWS = 1_000_000
NO_ID = -(1 << 63)
OWNER = "jaccard"


def _slices(batches, column: str | int = "text"):
    """Short batches: a batch of long texts and its sets would fill a worker."""
    for batch in batches:
        yield from byte_slices(batch, column, SLICE_BYTES)


# ---- sets and prefixes ------------------------------------------------------

def _codes48(codes: np.ndarray) -> np.ndarray:
    return np.unique(codes >> np.uint64(16))


def _needed(a, b):
    """Least overlap of two linked sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _prefix(n: int) -> int:
    """Two linked sets share a shingle in their first so many."""
    return n - -(-PERCENT * n // 100) + 1


def _extra(n: int) -> int:
    """With so many more, they share one more for each that both have."""
    return EXTRA_PERCENT * n // 100


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kind 0: (doc_id, class, n) a document; kind 1: (code, count) of shingles
    that recur within a chunk of distinct sets."""

    def run(batches):
        parts, seen, held = [], set(), 0

        def frequent():
            every = np.concatenate(parts)
            parts.clear()
            every.sort()
            edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            count = np.diff(np.append(edge, len(every)))
            code, count = every[edge[count >= HOT_LOCAL]], count[count >= HOT_LOCAL]
            zero = np.ones(len(code), np.int64)
            return _batch([zero, code.astype(np.int64), count, zero], [None, None, None, None])

        def _batch(cols, types):
            return pa.RecordBatch.from_arrays([pa.array(c, t or pa.int64()) for c, t in
                                               zip(cols, types)], names=["kind", "a", "b", "c"])

        for batch in _slices(batches):
            texts = batch.column("text").to_pylist()
            sets = [shingle_set(t) for t in texts]
            ids = [set_id(s) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int64)), batch.column("id"),
                 pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
                names=["kind", "a", "b", "c"])
            for s, i in zip(sets, ids):
                if i not in seen:
                    seen.add(i)
                    parts.append(_codes48(s))
                    held += len(s)
                if held >= CHUNK_CODES:
                    yield frequent()
                    parts, seen, held = [], set(), 0
        if parts:
            yield frequent()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return mapped(rows, run, "kind bigint, a bigint, b bigint, c bigint", OWNER)


def prefixes(docs: DataFrame, hot: np.ndarray, *, text_col: str = "text") -> DataFrame:
    """(code, class, n, place) of every prefix shingle, a class once a task;
    ``hot`` codes come last, raised by 2**48."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT_MAX codes

    def run(batches):
        hot, seen = shared.value, set()
        for batch in _slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text)
                if not len(s) or (i := set_id(s)) in seen:
                    continue
                seen.add(i)
                codes = _codes48(s)
                at = np.minimum(np.searchsorted(hot, codes), max(0, len(hot) - 1))
                late = hot[at] == codes if len(hot) else np.zeros(len(codes), bool)
                order = np.concatenate([codes[~late], codes[late] + np.uint64(1 << 48)])
                first = order[:_prefix(len(s)) + _extra(len(s))].astype(np.int64)
                out.append((first, np.full(len(first), i), np.full(len(first), len(s), np.int32),
                            np.arange(len(first), dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out)],
                    names=["code", "class", "n", "place"])

    return mapped(docs.select(F.col(text_col).alias("text")), run,
                  "code bigint, class bigint, n int, place int", OWNER)


# ---- buckets ----------------------------------------------------------------

def _has_partner(cls: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple:
    """Rows of one bucket with a partner of another class by size, and by size
    and place: with this shingle the first in common, an overlap is at most what
    remains."""
    rest = n - place
    sized, first = np.zeros(len(n), bool), np.zeros(len(n), bool)
    step = max(1, JUDGED // max(1, len(n)))
    for lo in range(0, len(n), step):
        a = slice(lo, lo + step)
        need = _needed(n[a, None], n[None, :])
        fit = ((cls[a, None] != cls[None, :])
               & (100 * np.minimum(n[a, None], n[None, :])
                  >= PERCENT * np.maximum(n[a, None], n[None, :])))
        sized[a] = fit.any(axis=1)
        first[a] = (fit & (rest[a, None] >= need) & (rest[None, :] >= need)).any(axis=1)
    return sized, first


def viable(rows: DataFrame) -> DataFrame:
    """Prefix rows with a partner by size in their bucket, a class once, and
    ``first``: whether the bucket can be the first that two classes share."""

    def judge(code, cls, n, place):
        """Masks over whole buckets, sorted by code."""
        keep, first = np.zeros(len(code), bool), np.zeros(len(code), bool)
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        size = np.diff(np.append(edge, len(code)))
        two = edge[size == 2]  # most buckets: tested all at once
        a, b = n[two], n[two + 1]
        fit = ((cls[two] != cls[two + 1])
               & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)))
        need = _needed(a, b)
        early = fit & (a - place[two] >= need) & (b - place[two + 1] >= need)
        for mask, good in ((keep, two[fit]), (first, two[early])):
            mask[good] = mask[good + 1] = True
        for e, z in zip(edge[size > 2], size[size > 2]):
            own = np.unique(cls[e:e + z], return_index=True)[1] + e
            if len(own) > 1:
                keep[own], first[own] = _has_partner(cls[own], n[own], place[own])
        return keep, first

    def run(batches):
        names = ["code", "class", "n", "place"]
        held, flood = None, None  # rows of the last bucket so far; a bucket too large to judge
        for batch in batches:
            cols = [np.asarray(batch.column(c), np.int64) for c in names]
            if flood is not None:
                passed = cols[0] == flood
                if passed.any():
                    yield _rows(cols, passed, passed)
                cols = [c[~passed] for c in cols]
                if not len(cols[0]):
                    continue
                flood = None
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            done, held = [c[:last] for c in cols], [c[last:] for c in cols]
            if last:
                yield _rows(done, *judge(*done))
            if len(held[0]) > VIABLE_MAX:  # all of it stays: exact, only less pruned
                flood = int(held[0][0])
                every = np.ones(len(held[0]), bool)
                yield _rows(held, every, every)
                held = None
        if held is not None:
            yield _rows(held, *judge(*held))

    def _rows(cols, keep, first):
        code, cls, n, place = (c[keep] for c in cols)
        return pa.RecordBatch.from_arrays(
            [pa.array(code), pa.array(cls), pa.array(n.astype(np.int32)),
             pa.array(place.astype(np.int32)), pa.array(first[keep])],
            names=["code", "class", "n", "place", "first"])

    return mapped(rows.repartition("code").sortWithinPartitions("code"), run,
                  "code bigint, class bigint, n int, place int, first boolean", OWNER)


def open_buckets(rows: DataFrame) -> DataFrame:
    """The rows that candidates can come from. A class stays if it shares as
    many shingles as a link to the smallest set of its size range demands; a
    bucket if it has two such classes and is, by code, the first of its set of
    classes."""
    least = F.expr(f"1 + ({EXTRA_PERCENT} * (({PERCENT} * n + 99) div 100)) div 100")
    # rows of one class are at most its prefix; counted before the shuffle
    enough = (rows.groupBy("class").agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n"))
              .where(F.col("shared") >= least).select("class"))
    kept = staged(rows.where("first").drop("first").join(enough, "class", "left_semi")
                  .dropDuplicates(["code", "class"]), "jac-kept")
    codes = kept.groupBy("code").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(2), "class")).alias("y")).where("size > 1")
    first = codes.groupBy("size", "x", "y").agg(F.min("code").alias("code")).select("code")
    return kept.join(first, "code", "left_semi")


# ---- signatures -------------------------------------------------------------

def _pack(codes: np.ndarray) -> bytes:
    return codes.astype("<u8").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _bitmap(codes: np.ndarray, n: int) -> bytes:
    """One bit a shingle or more: the least power of two from 64 that holds n."""
    bits = 64
    while bits < n:
        bits *= 2
    flags = np.zeros(bits, np.uint8)
    flags[mix_bits(codes) & np.uint64(bits - 1)] = 1
    return np.packbits(flags).tobytes()


def mix_bits(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)


def class_sets(docs: DataFrame, wanted: DataFrame, few: bool, *, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(class, n, codes, bitmap) of the classes in ``wanted`` (class, id)."""
    ids = wanted.select(F.col("id").alias("w_id")).distinct()
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(ids) if few else ids, F.col("id") == F.col("w_id"), "left_semi")

    def run(batches):
        for batch in _slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text)
                if len(s):
                    out.append((set_id(s), len(s), _pack(s), _bitmap(s, len(s))))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(),
                                                                pa.binary(), pa.binary()))],
                    names=["class", "n", "codes", "bitmap"])

    sets = staged(mapped(rows.select("text"), run,
                         "class bigint, n int, codes binary, bitmap binary", OWNER),
                  "jac-class-sets")
    # one document an id as a rule; ids that repeat can bring a class again
    seen = sets.agg(F.count("class").alias("n"), F.countDistinct("class").alias("d")).first()
    return sets if seen["n"] == seen["d"] else staged(sets.dropDuplicates(["class"]),
                                                      "jac-class-sets")


# ---- signature trees --------------------------------------------------------

def _fold(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (last axis: 64-bit words) folded to ``width`` words by OR."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


class Node:
    """Size range, OR of bitmaps, largest excess (n - bits) at each width, and
    the component when all members share it."""

    __slots__ = ("kids", "rows", "least", "most", "words", "excess", "comp")

    def __init__(self, kids, rows, least, most, words, excess, comp):
        self.kids, self.rows, self.least, self.most = kids, rows, least, most
        self.words, self.excess, self.comp = words, excess, comp


def build(members: list[int], n: np.ndarray, maps: list[np.ndarray], comp: np.ndarray) -> Node:
    """A tree over ``members`` (row numbers), packed by size."""
    members = sorted(members, key=lambda i: int(n[i]))
    level = []
    for at in range(0, len(members), LEAF):
        rows = np.array(members[at:at + LEAF])
        width = min(len(maps[i]) for i in rows)
        own = np.stack([_fold(maps[i], width) for i in rows])
        excess, w = {}, width
        while w >= max(1, width // 4):
            excess[w] = int((n[rows] - _bits(_fold(own, w))).max())
            if w == 1:
                break
            w //= 2
        same = comp[rows[0]] if (comp[rows] == comp[rows[0]]).all() else None
        level.append(Node(None, (rows, own), int(n[rows].min()), int(n[rows].max()),
                          np.bitwise_or.reduce(own, axis=0), excess, same))
    while len(level) > 1:
        upper = []
        for at in range(0, len(level), FAN):
            kids = level[at:at + FAN]
            width = min(len(k.words) for k in kids)
            common = set.intersection(*[set(k.excess) for k in kids])
            same = kids[0].comp if all(k.comp == kids[0].comp for k in kids) else None
            upper.append(Node(kids, None, min(k.least for k in kids), max(k.most for k in kids),
                              np.bitwise_or.reduce([_fold(k.words, width) for k in kids]),
                              {w: max(k.excess[w] for k in kids) for w in common}, same))
        level = upper
    return level[0]


def _may_link(x: Node, y: Node) -> bool:
    if x.comp is not None and x.comp == y.comp:
        return False
    if 100 * x.most < PERCENT * y.least or 100 * y.most < PERCENT * x.least:
        return False
    width = min(len(x.words), len(y.words))
    if width not in x.excess or width not in y.excess:
        return True  # sizes differ too much for one width: look below
    common = int(_bits(_fold(x.words, width) & _fold(y.words, width)))
    return common + min(x.excess[width], y.excess[width]) >= _needed(x.least, y.least)


def traverse(x: Node, y: Node, n: np.ndarray, rest: np.ndarray, comp: np.ndarray):
    """(row, row, overlap bound) of two trees' rows whose bound, sizes and places
    allow a link."""
    stack = [(x, y)]
    while stack:
        a, b = stack.pop()
        if not _may_link(a, b):
            continue
        if a.kids or b.kids:
            if a is b:
                stack += [(p, q) for i, p in enumerate(a.kids) for q in a.kids[i:]]
            elif a.kids and (not b.kids or a.most - a.least >= b.most - b.least):
                stack += [(p, b) for p in a.kids]
            else:
                stack += [(a, q) for q in b.kids]
            continue
        (ra, ma), (rb, mb) = a.rows, b.rows
        width = min(ma.shape[1], mb.shape[1])
        fa, fb = _fold(ma, width), _fold(mb, width)
        common = _bits(fa[:, None, :] & fb[None, :, :])
        na, nb = n[ra][:, None], n[rb][None, :]
        bound = common + np.minimum(na - _bits(fa)[:, None], nb - _bits(fb)[None, :])
        need = _needed(na, nb)
        ok = ((bound >= need) & (rest[ra][:, None] >= need) & (rest[rb][None, :] >= need)
              & (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb))
              & (comp[ra][:, None] != comp[rb][None, :]))
        if a is b:
            ok &= np.triu(np.ones_like(ok), 1)
        for i, j in zip(*np.nonzero(ok)):
            yield int(ra[i]), int(rb[j]), int(bound[i, j])


def _by_group(batches, columns: tuple[str, ...]):
    """((code, i, j), columns of the group's rows): rows come sorted by group,
    and a group is bounded in rows and codes by its blocks."""
    key, held = None, []
    for batch in batches:
        marks = list(zip(*(batch.column(c).to_pylist() for c in ("code", "i", "j"))))
        edges = [0, *(k for k in range(1, len(marks)) if marks[k] != marks[k - 1]), len(marks)]
        for at, to in zip(edges, edges[1:]):
            if marks[at] != key and held:
                yield key, _columns(held, columns)
                held = []
            key = marks[at]
            held.append(batch.slice(at, to - at))
    if held:
        yield key, _columns(held, columns)


def _columns(parts: list[pa.RecordBatch], names: tuple[str, ...]) -> list:
    table = pa.Table.from_batches(parts)
    return [table.column(c).to_numpy().astype(np.int64)
            if pa.types.is_integer(table.schema.field(c).type) else table.column(c).to_pylist()
            for c in names]


def _cut(rows: DataFrame, sets: DataFrame, listed: bool) -> DataFrame:
    """Bucket rows (code, class, n, place, comp) of the buckets with two
    components, with bitmaps, cut into groups (code, i, j) of at most two blocks.
    ``listed``: also ``seen``, the codes of the class's open buckets before it."""
    per = rows.groupBy(F.col("code").alias("p_code")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("codes"), F.min("comp").alias("c0"),
        F.max("comp").alias("c1"))
    live = per.where("c0 <> c1").select("p_code", F.ceil(F.greatest(
        F.col("rows") / BLOCK, F.col("codes") / BLOCK_CODES)).cast("int").alias("blocks"))
    open_rows = staged(rows.join(live, F.col("code") == F.col("p_code")).drop("p_code"), "jac-open")
    signed = open_rows.join(sets.select("class", "bitmap"), "class")
    if listed:
        lists = open_rows.groupBy("class").agg(F.collect_set("code").alias("l"))  # of its prefix
        signed = signed.join(lists, "class").withColumn(
            "seen", F.filter("l", lambda c: c < F.col("code"))).drop("l")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    return (signed.withColumn("side", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("code", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
                    "side", "class", "n", "place", "comp", "bitmap",
                    *(["seen"] if listed else [])))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("code", "i", "j").sortWithinPartitions("code", "i", "j")


def _maps(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in raw]


def lead_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): for each class ``b`` the likeliest of the ``LEADS`` smallest
    classes of its buckets, so at most one row a class."""

    def run(batches):
        for _, (cls, n, place, comp, raw) in _by_group(
                batches, ("class", "n", "place", "comp", "bitmap")):
            maps, rest = _maps(raw), n - place
            order = np.argsort(cls, kind="stable")
            leads, others = order[:LEADS].tolist(), order[LEADS:].tolist()
            tree = build(leads, n, maps, comp)
            pairs = [*traverse(tree, tree, n, rest, comp)]
            if others:
                pairs += traverse(tree, build(others, n, maps, comp), n, rest, comp)
            best: dict[int, tuple] = {}
            for i, j, bound in pairs:
                a, b = sorted((int(cls[i]), int(cls[j])))
                best[b] = max(best.get(b, (0.0, 0)), (bound / (int(n[i]) + int(n[j]) - bound), a))
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for _, a in best.values()], pa.int64()),
                     pa.array(list(best), pa.int64()),
                     pa.array([x for x, _ in best.values()], pa.float64())],
                    names=["a", "b", "score"])

    found = mapped(_grouped(_cut(rows, sets, False)), run, "a bigint, b bigint, score double",
                   OWNER)
    return found.groupBy("b").agg(F.max(F.struct("score", "a")).alias("m")).select("m.a", "b")


UNDECIDED = "code bigint, i int, j int, side int, class bigint, n int, place int, comp bigint"


def undecided(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of groups whose class is in a pair that no bitmap rules out, in
    the first of the pair's buckets: at most one for each row, never a pair."""

    def run(batches):
        for (code, i, j), (side, cls, n, place, comp, raw, lists) in _by_group(
                batches, ("side", "class", "n", "place", "comp", "bitmap", "seen")):
            before = list(map(frozenset, lists))
            tree = build(list(range(len(cls))), n, _maps(raw), comp)
            open_ = np.zeros(len(cls), bool)
            for a, b, _ in traverse(tree, tree, n, n - place, comp):
                if (not (open_[a] and open_[b]) and (i == j or side[a] != side[b])
                        and before[a].isdisjoint(before[b])):
                    open_[a] = open_[b] = True
            if open_.any():
                m = int(open_.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, code)), pa.array(np.full(m, i, np.int32)),
                     pa.array(np.full(m, j, np.int32)), pa.array(side[open_].astype(np.int32)),
                     pa.array(cls[open_]), pa.array(n[open_].astype(np.int32)),
                     pa.array(place[open_].astype(np.int32)), pa.array(comp[open_])],
                    names=[x.split()[0] for x in UNDECIDED.split(", ")])

    return mapped(_grouped(_cut(rows, sets, True)), run, UNDECIDED, OWNER)


def links_in_place(rows: DataFrame, sets: DataFrame, few: bool) -> DataFrame:
    """(a, b) links of undecided rows (``few``: few enough to broadcast, so that
    only the sets they ask for are sent): the whole sets meet in their group, where
    pairs of one component are passed over as links join components, so a group
    gives fewer links than it has rows."""

    def run(batches):
        for (_, i, j), (side, cls, n, place, comp, raw) in _by_group(
                batches, ("side", "class", "n", "place", "comp", "codes")):
            codes = [_unpack(x) for x in raw]
            maps = [np.frombuffer(_bitmap(c, len(c)), np.uint64) for c in codes]
            parent = {int(c): int(c) for c in comp}

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = parent[parent[c]]
                    c = parent[c]
                return c

            tree = build(list(range(len(cls))), n, maps, comp)
            out = []
            for a, b, _ in traverse(tree, tree, n, n - place, comp):
                if i != j and side[a] == side[b]:
                    continue
                ra, rb = root(int(comp[a])), root(int(comp[b]))
                if ra != rb and _linked(codes[a], codes[b]):
                    parent[ra] = rb
                    out.append((int(cls[a]), int(cls[b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                 names=["a", "b"])

    whole = sets.select("class", "codes").join(F.broadcast(rows) if few else rows, "class")
    return mapped(_grouped(whole), run, "a bigint, b bigint", OWNER)


# ---- verification and components --------------------------------------------

def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as sorted codes, reach the threshold."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, few: bool) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    a = sets.select(F.col("class").alias("a"), F.col("codes").alias("ca"))
    b = sets.select(F.col("class").alias("b"), F.col("codes").alias("cb"))

    def run(batches):
        for batch in _slices(batches, "ca"):
            keep = [_linked(_unpack(x), _unpack(y)) for x, y in
                    zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    if few:  # sets of b go to a, whose classes are fewer
        ends = pairs.select("a").distinct()
        joined = F.broadcast(pairs).join(b, "b").join(
            a.join(F.broadcast(ends), "a", "left_semi"), "a")
    else:
        joined = pairs.join(a, "a").join(b, "b")
    return mapped(joined.select("a", "b", "ca", "cb"), run, "a bigint, b bigint", OWNER)


def _few(df: DataFrame) -> bool:
    """Whether a frame of a few longs a row is small enough to broadcast."""
    return df.count() <= BROADCAST_ROWS


def link_components(docs: DataFrame, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, component): one row per document; component
    is a class id shared by linked documents, null for the empty set."""
    spark = docs.sparkSession
    found = staged(measure(docs, id_col=id_col, text_col=text_col), "jac-sets")
    meta = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("class"),
                                          F.col("c").alias("n_shingles"))
    hot = (found.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n"))
           .orderBy(F.col("n").desc(), "a").limit(HOT_MAX).collect())
    rows = prefixes(docs, np.sort(np.array([r["a"] for r in hot], np.uint64)), text_col=text_col)
    buckets = staged(open_buckets(staged(viable(rows), "jac-viable")), "jac-buckets")

    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    holder = meta.groupBy(F.col("class").alias("m_class")).agg(F.min(key).alias("id"))
    wanted = staged(buckets.select("class").distinct().join(
        holder, F.col("class") == F.col("m_class")).select("class", "id"), "jac-wanted")
    sets = class_sets(docs, wanted, _few(wanted), id_col=id_col, text_col=text_col)

    pairs = staged(lead_pairs(buckets.withColumn("comp", F.col("class")), sets), "jac-pairs")
    links = staged(verified(pairs, sets, _few(pairs)), "jac-links")
    comps = _components(spark, links)
    labelled = buckets.join(comps.select(F.col("id").alias("class"), "comp"), "class", "left").select(
        "code", "class", "n", "place", F.coalesce("comp", "class").alias("comp"))
    rest = staged(undecided(labelled, sets), "jac-undecided")
    more = staged(links_in_place(rest, sets, _few(rest)), "jac-links")
    if more.limit(1).count():
        comps = _components(spark, links.unionByName(more))
    named = comps.select(F.col("id").alias("c_class"), "comp")
    return meta.join(named, F.col("class") == F.col("c_class"), "left").select(
        "doc_id", "n_shingles", "class",
        F.when(F.col("n_shingles") > 0, F.coalesce("comp", "class")).alias("component"))


def _components(spark, links: DataFrame) -> DataFrame:
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    return staged(connected_components(ends, links, "id", "a", "b"), "jac-components")


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component)."""
    linked = staged(link_components(docs, id_col=id_col, text_col=text_col), "jac-documents")
    least = staged(linked.where("component is not null").groupBy(F.col("component").alias("c"))
                   .agg(F.min("doc_id").alias("least")), "jac-least")
    # a large component is many rows of one key: no shuffle where the frame is small
    return linked.join(F.broadcast(least) if _few(least) else least,
                       F.col("component") == F.col("c"), "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
        .alias("component_id"))


def representatives(docs: DataFrame, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row of ``docs`` a component, all columns unchanged, and every row
    without words. A component keeps its smallest (id, class), null ids last;
    of several rows of that pair the one of least hash of the text, then of the
    whole row. So an id keeps a row in each component where it is the smallest."""
    found = staged(link_components(docs, id_col=id_col, text_col=text_col), "jac-found")
    chosen = staged(found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("m"))
        .select("m.doc_id", "m.class"), "jac-chosen")
    # the id alone decides, unless it keeps one of several rows or is null
    ids = staged(found.select("doc_id", F.lit(1).alias("n"), (F.col("n_shingles") == 0).alias("k"))
                 .unionByName(chosen.select("doc_id", F.lit(0).alias("n"), F.lit(True).alias("k")))
                 .groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("k").alias("keeps")), "jac-ids")
    several = F.col("doc_id").isNull() | (F.col("keeps") & (F.col("n") > 1))
    key = F.col(id_col).cast("bigint")

    def side(rows: DataFrame) -> DataFrame:
        rows = staged(rows, "jac-side")
        return F.broadcast(rows) if _few(rows) else rows

    gone = side(ids.where(~F.col("keeps") & F.col("doc_id").isNotNull())
                .select(F.col("doc_id").alias("__id")))
    kept = docs.join(gone, key == F.col("__id"), "left_anti")
    again = ids.where(several).select(F.col("doc_id").alias("__id"))
    if not again.limit(1).count():
        return kept
    again = side(again)
    same = key.eqNullSafe(F.col("__id"))
    once = kept.join(again, same, "left_anti")
    rows = staged(_with_class(kept.join(again, same, "left_semi"), text_col), "jac-again")
    # a pair may hold many rows: least within a task first, then one row a task
    order = F.struct(F.xxhash64(text_col), F.xxhash64(F.to_json(F.struct(*docs.columns))))
    pairs = (rows.where("__class is not null").groupBy(key.alias("__key"), "__class")
             .agg(F.min_by(F.struct(*docs.columns), order).alias("__row")))
    wanted = side(chosen.select(F.col("doc_id").alias("__id"), F.col("class").alias("__kept")))
    first = pairs.join(wanted, F.col("__key").eqNullSafe(F.col("__id"))
                       & (F.col("__class") == F.col("__kept")), "left_semi").select("__row.*")
    wordless = rows.where("__class is null").drop("__class")
    return once.unionByName(wordless).unionByName(first)


def _with_class(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` and ``__class``, the row's class as in ``measure``; null without words."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in _slices(batches, at):
            sets = map(shingle_set, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([set_id(s) if len(s) else None for s in sets],
                                          pa.int64())], names=[*batch.schema.names, "__class"])

    return mapped(docs, run, StructType([*docs.schema.fields,
                                         StructField("__class", LongType())]), OWNER)
