"""Mixing sources by a low-discrepancy schedule, in DataFrame operations only.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating; a
target stops at ``MAX_EPOCHS`` times its source and the rest is reshared by
weight. With sources ordered by cap per weight that water level has a closed
form over running sums, so no loop is needed.

Schedule: slot ``n`` of ``SLOTS`` maps the golden-ratio point
``frac((n + 1/2) * 0.618...)`` through the cumulative targets to a source (an
equi-join on cells of the unit interval, then the interval test), and its rank
among the source's slots says which block it takes. A source's quota is its
target in blocks; slots beyond the quota are void, and the few blocks that the
sequence leaves over follow at the end.

Blocks: a source's documents in hashed order, ``MAX_EPOCHS`` times over, are a
stream of words; block ``k`` is words ``[k * B, (k + 1) * B)``, the last one
ending at the target. Positions are running sums over hash buckets of a source,
so a source with most of the rows is many tasks; rows that repeat are placed as one
row with a count and dealt out to tasks afterwards. Slots meet blocks in an
equi-join on (source, block).

Defined cases: a null or wordless text has size 0 and takes 0; the null source
is a source of its own; repeated rows are separate documents; an empty table or
one without words has an empty schedule; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastat.llm.common import staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SLOTS = 1 << 20
CELLS = 4096
BUCKETS = 256
CHUNK = 1024
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t..\\r."""
    squeezed = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.char_length(squeezed)
                      - F.char_length(F.replace(squeezed, F.lit("w"), F.lit(""))),
                      F.lit(0)).cast("bigint")


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """doc_id, source, size, the hashed order key and ``copies``: rows equal in
    these are one row, combined before the shuffle. Written once."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(text).alias("size"),
                       F.xxhash64(F.col(id_col), text).alias("h"))
    return staged(rows.groupBy("doc_id", "source", "size", "h")
                  .agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")


def spread(rows: DataFrame, copies: str = "copies", copy: str = "copy") -> DataFrame:
    """``rows``, each as often as ``copies`` says, with ``copy`` from 0. A row of
    many copies is dealt out to tasks in chunks of ``CHUNK``."""
    nth = _free("chunk", [*rows.columns, copy])
    chunks = rows.where(F.col(copies) > 0).withColumn(nth, F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.expr(f"({copies} - 1) div {CHUNK}"))))
    most = F.least(F.lit(CHUNK).cast("bigint"), F.col(copies) - F.col(nth) * CHUNK)

    def dealt(part: DataFrame) -> DataFrame:
        return (part.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("bigint"), most - 1)))
                .withColumn(copy, F.col(nth) * CHUNK + F.col(copy)).drop(nth))

    heavy = chunks.where(F.col(copies) > CHUNK)
    return dealt(chunks.where(F.col(copies) <= CHUNK)).unionByName(
        dealt(heavy.repartition(F.xxhash64(*[f"`{c}`" for c in chunks.columns]))))


def _free(name: str, others: list[str]) -> str:
    """A column name that is not among ``others``."""
    lower = {c.lower() for c in others}
    while name in lower:
        name += "_"
    return name


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: number, source, source_size, target, quota (whole words).
    The frame has one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = (rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
         .withColumn("number", F.row_number().over(order) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          F.col("number") % len(weights) + 1)
    s = (s.withColumn("weight", weight)
         .withColumn("cap", F.col("source_size").cast("double") * max_epochs))
    every = Window.partitionBy()
    earlier = (Window.orderBy(F.col("cap") / F.col("weight"), "number")
               .rowsBetween(Window.unboundedPreceding, -1))
    level = ((F.sum(F.col("source_size").cast("double")).over(every)
              - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    s = s.withColumn("level", level)
    # the first source, by cap a weight, that the level leaves under its cap
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                        F.struct(F.col("cap") / F.col("weight"), F.col("number"),
                                 F.col("level").alias("level")))).over(every)["level"]
    return (s.withColumn("fits", fits)
            .withColumn("target", F.least(F.col("cap"), F.coalesce(
                F.col("fits") * F.col("weight"), F.col("cap"))))
            .select("number", "source", "source_size", "target",
                    F.least(F.round("target").cast("bigint"),
                            F.col("source_size") * max_epochs).alias("quota")))


def schedule(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, number (source), block, block_words: which block each slot takes.

    ``slots`` bounds the schedule; a block is the total over it, rounded up.
    """
    spark = sources.sparkSession
    every = Window.partitionBy()
    upto = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = (sources.where("quota > 0")
         .withColumn("total", F.sum("quota").over(every))
         .withColumn("block_words", F.ceil(F.col("total") / F.lit(slots)).cast("bigint"))
         .withColumn("blocks", F.ceil(F.col("quota") / F.col("block_words")).cast("bigint"))
         .withColumn("hi", F.sum("target").over(upto) / F.sum("target").over(every))
         .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("number")), F.lit(0.0)))
         .withColumn("hi", F.when(F.lead("number").over(Window.orderBy("number")).isNull(),
                                  F.lit(2.0)).otherwise(F.col("hi")))
         .withColumn("all_blocks", F.sum("blocks").over(every)))
    cells = s.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS).cast("bigint"),
        F.least(F.floor(F.col("hi") * CELLS).cast("bigint"), F.lit(CELLS - 1).cast("bigint")))))
    point = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    points = (spark.range(slots).withColumn("u", point - F.floor(point))
              .withColumn("p_cell", F.floor(F.col("u") * CELLS).cast("bigint")))
    hit = (points.join(cells, F.col("p_cell") == F.col("cell"))
           .where("u >= lo and u < hi and id < all_blocks")
           .select(F.col("id").alias("slot"), "number"))
    ranked = hit.withColumn("block", F.row_number().over(
        Window.partitionBy("number").orderBy("slot")) - 1)  # at most ``slots`` rows
    full = s.select(F.col("number").alias("s_number"), "blocks", "block_words", "quota",
                    "all_blocks")
    used = (ranked.join(full, F.col("number") == F.col("s_number")).where("block < blocks")
            .select("slot", "number", F.col("block").cast("bigint").alias("block")))
    got = used.groupBy(F.col("number").alias("g_number")).agg(F.count(F.lit(1)).alias("got"))
    left = (full.join(got, F.col("s_number") == F.col("g_number"), "left")
            .withColumn("got", F.coalesce("got", F.lit(0)).cast("bigint"))
            .where("got < blocks")
            .select("all_blocks", F.col("s_number").alias("number"),
                    F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("block")))
    tail = left.select((F.col("all_blocks") + F.row_number().over(
        Window.orderBy("block", "number")) - 1).cast("bigint").alias("slot"), "number", "block")
    return (used.unionByName(tail)
            .join(full.select("s_number", "block_words"), F.col("number") == F.col("s_number"))
            .select("slot", "number", "block", "block_words"))


def positions(rows: DataFrame, sources: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row a document with words, numbered: number, start (words of the
    source's documents before it in hashed order), source_size, quota. Equal
    rows are placed as one and then follow each other."""
    dealt = (rows.where("size > 0").withColumn("words", F.col("size") * F.col("copies")).join(
        sources.select("number", F.col("source").alias("s_source"), "source_size", "quota"),
        F.col("source").eqNullSafe(F.col("s_source")))
        .withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets))))
    per = dealt.groupBy("number", "bucket").agg(F.sum("words").alias("w"))
    before = (Window.partitionBy("number").orderBy("bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select(F.col("number").alias("o_number"), F.col("bucket").alias("o_bucket"),
                         F.coalesce(F.sum("w").over(before), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("number", "bucket").orderBy("h", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (dealt.withColumn("inner", F.coalesce(F.sum("words").over(inside), F.lit(0)))
              .join(offsets, (F.col("number") == F.col("o_number"))
                    & (F.col("bucket") == F.col("o_bucket")))
              .select("doc_id", "source", "size", "h", "copies", "number", "source_size", "quota",
                      (F.col("offset") + F.col("inner")).alias("first")))
    return spread(placed).select("doc_id", "source", "size", "h", "number", "source_size", "quota",
                                 (F.col("first") + F.col("copy") * F.col("size")).alias("start"))


def pieces(placed: DataFrame, plan: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Each slot's parts of documents: slot, number, block, doc_id, start (of
    the document in its source), epoch, from_word, words."""
    width = plan.agg(F.max("block_words").alias("b")).scalar()
    at = F.col("epoch") * F.col("source_size") + F.col("start")
    end = F.least(at + F.col("size"), F.col("quota"))
    spans = (placed.withColumn("epoch", F.explode(F.array(
        *[F.lit(e).cast("bigint") for e in range(max_epochs)])))
        .withColumn("at", at).where("at < quota")
        .withColumn("until", end).withColumn("width", width))
    cut = spans.withColumn("p_block", F.explode(F.sequence(
        F.expr("at div width"), F.expr("(until - 1) div width"))))
    begin = F.greatest(F.col("at"), F.col("p_block") * F.col("width"))
    stop = F.least(F.col("until"), (F.col("p_block") + 1) * F.col("width"))
    cut = cut.select("doc_id", F.col("number").alias("p_number"), "start", "epoch", "p_block",
                     (begin - F.col("at")).alias("from_word"), (stop - begin).alias("words"))
    return cut.join(plan.select("slot", "number", "block"),
                    (F.col("p_number") == F.col("number")) & (F.col("p_block") == F.col("block"))
                    ).select("slot", "number", "block", "doc_id", "start", "epoch", "from_word",
                             "words")


def taken(docs: DataFrame, **cols) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and h, source."""
    rows = sized(docs, **cols)
    sources = staged(targets(rows), "mix-sources")
    placed = staged(positions(rows, sources), "mix-positions")
    per_doc = (pieces(placed, schedule(sources)).groupBy("number", "start")
               .agg(F.sum("words").alias("taken")))
    known = (placed.join(per_doc, ["number", "start"], "left")
             .select("doc_id", "source", "size", "h", "taken"))
    empty = spread(rows.where("size = 0")).select("doc_id", "source", "size", "h",
                                                  F.lit(0).cast("bigint").alias("taken"))
    s = sources.select(F.col("source").alias("s_source"), "source_size", "target")
    return (known.unionByName(empty)
            .join(s, F.col("source").eqNullSafe(F.col("s_source")))
            .select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"),
                    "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
                    "source", "h"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, each as often as the mix
    takes it: its words taken over its size, rounded. Only the document that a
    source's target cuts is not taken a whole number of times, so a source's
    words are within one document of its target. Rows equal in id, text and
    source follow each other in the mix; of such a group as many rows come out
    as its members are taken, the first ones once more than the others. A
    wordless row takes no words and goes."""
    names = {n: _free(f"mix_{n}", docs.columns) for n in
             ("id", "src", "h", "rows", "times", "key", "equal", "part", "block", "from", "copy")}
    c = {n: F.col(v) for n, v in names.items()}
    share = staged(
        taken(docs, id_col=id_col, text_col=text_col, source_col=source_col).where("size > 0")
        .groupBy(F.col("doc_id").alias(names["id"]), F.col("source").alias(names["src"]),
                 F.col("h").alias(names["h"]))
        .agg(F.count(F.lit(1)).alias(names["rows"]),
             F.sum(F.round(F.col("taken") / F.col("size")).cast("bigint")).alias(names["times"]))
        .where(c["times"] > 0), "mix-share")
    keyed = docs.withColumn(names["key"], F.xxhash64(F.col(id_col), F.col(text_col)))
    found = keyed.join(share, F.col(id_col).eqNullSafe(c["id"]) & (c["key"] == c["h"])
                       & F.col(source_col).cast("string").eqNullSafe(c["src"]))
    own = [F.col(f"`{x}`") for x in docs.columns]
    once = (found.where(c["rows"] == 1)
            .withColumn(names["copy"], F.explode(F.sequence(F.lit(1), c["times"].cast("int"))))
            .select(*own))
    # groups of several rows: wholly equal rows are counted, then numbered by
    # blocks of their hash, so neither copies nor a hot group meet in one task
    group = [names[n] for n in ("id", "src", "h")]
    whole = F.xxhash64(F.to_json(F.struct(*own)))
    counted = (found.where(c["rows"] > 1)
               .groupBy(*own, *group, names["rows"], names["times"])
               .agg(F.count(F.lit(1)).alias(names["equal"]))
               .withColumn(names["part"], whole)
               .withColumn(names["block"], F.pmod(c["part"], F.lit(BUCKETS))))
    per = counted.groupBy(*group, names["block"]).agg(F.sum(c["equal"]).alias(names["from"]))
    earlier = (Window.partitionBy(*group).orderBy(names["block"])
               .rowsBetween(Window.unboundedPreceding, -1))
    inside = (Window.partitionBy(*group, names["block"]).orderBy(names["part"], *own)
              .rowsBetween(Window.unboundedPreceding, -1))
    before = per.select(*[F.col(x).alias(f"o_{x}") for x in (*group, names["block"])],
                        F.coalesce(F.sum(c["from"]).over(earlier), F.lit(0)).alias("o_from"))
    same = [F.col(x).eqNullSafe(F.col(f"o_{x}")) for x in (*group, names["block"])]
    first = F.col("o_from") + F.coalesce(F.sum(c["equal"]).over(inside), F.lit(0))
    each, extra = F.expr(f"{names['times']} div {names['rows']}"), c["times"] % c["rows"]
    more = F.greatest(F.lit(0), F.least(c["equal"], extra - c["from"]))
    numbered = (counted.join(before, same[0] & same[1] & same[2] & same[3])
                .withColumn(names["from"], first)
                .withColumn(names["times"], each * c["equal"] + more))
    again = spread(numbered.select(*own, names["times"]), names["times"], names["copy"])
    return once.unionByName(again.select(*own))
