"""Chat formatting: collapse cumulative snapshots, then render.

A logged conversation that is a prefix of a longer one is a snapshot of it. Each
turn gets a code of (position, role, text); the running sum of the codes is a
rolling hash of every turn prefix (two sums of 62-bit codes, so that equal
sums mean equal prefixes). Distinct whole-conversation hashes are anti-joined
with distinct proper-prefix hashes: what stays is maximal. Of equal maximal
conversations the smallest ``conv_id`` stays. Only those are rendered.

Rows are sorted by ranges of their whole order and written; positions and sums are
taken per block of ``2**BLOCK_BITS`` rows of that order and offset, so a conversation
with most of the rows is many tasks, whatever its turn numbers; hashes are made
distinct (combined before the shuffle) before the join, so a first turn that
most conversations share is one row. Rendered text comes in segments of at most
``SEGMENT`` turns, one row each; an ordinary conversation is one segment.

Defined cases: turns are ordered by turn (null first), role, text and numbered
from 1; a null role renders as ``unknown`` and a null text as empty, and both
differ from the empty string in the hash; a row that repeats is a turn of its
own; a null conv_id is one conversation, last among equals; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastat.llm.common import staged

BLOCK_BITS = 10
TIE_CHARS = 256
SEGMENT = 1024
# The template's marks.
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"


def _code(salt: int) -> Column:
    return F.shiftright(F.xxhash64(F.lit(salt), "pos", "role", F.col("role").isNull(),
                                   "text", F.col("text").isNull()), 2).cast("decimal(38,0)")


def prefixes(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn with its position and the hash (a, b) of the prefix it ends."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.col(role_col).cast("string").alias("role"),
                        F.col(text_col).cast("string").alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    # a range key holds a text's begin; texts that it holds whole divide further by a
    # number, since their order among equals is free
    longer = F.coalesce(F.char_length("text") > TIE_CHARS, F.lit(False))
    tie = F.when(longer, F.lit(0).cast("bigint")).otherwise(F.col("tie"))
    spread = [*order, F.substring("text", 1, TIE_CHARS).asc_nulls_first(), longer, tie]
    rows = staged(
        rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*spread)
        .sortWithinPartitions(*order, F.col("text").asc_nulls_first()).drop("tie")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("block", F.shiftright("at", BLOCK_BITS)), "chat-rows")
    key = ["conv_id", "block"]
    inside = Window.partitionBy(*key).orderBy("at")
    earlier = (Window.partitionBy("conv_id").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))

    def offset(df: DataFrame, aggs: dict[str, Column], zero: Column) -> DataFrame:
        """``df`` plus, per block, the sums of all earlier blocks."""
        per = df.groupBy(*key).agg(*[c.alias(n) for n, c in aggs.items()])
        off = per.select(F.col("conv_id").alias("o_conv"), F.col("block").alias("o_block"), *[
            F.coalesce(F.sum(n).over(earlier), zero).alias(n) for n in aggs])
        return df.join(off, F.col("conv_id").eqNullSafe(F.col("o_conv"))
                       & (F.col("block") == F.col("o_block"))).drop("o_conv", "o_block")

    numbered = (offset(rows, {"before": F.count(F.lit(1))}, F.lit(0).cast("bigint"))
                .withColumn("pos", F.row_number().over(inside) + F.col("before")).drop("before"))
    coded = staged(numbered.withColumn("ca", _code(17)).withColumn("cb", _code(31)), "chat-turns")
    running = (Window.partitionBy(*key).orderBy("pos")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = offset(coded, {"oa": F.sum("ca"), "ob": F.sum("cb")},
                    F.lit(0).cast("decimal(38,0)"))
    return summed.select("conv_id", "pos", "role", "text",
                         (F.sum("ca").over(running) + F.col("oa")).cast("string").alias("a"),
                         (F.sum("cb").over(running) + F.col("ob")).cast("string").alias("b"))


def maximal(turn_prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that stay."""
    p = turn_prefixes
    whole = p.groupBy("conv_id").agg(
        F.max(F.struct("pos", "a", "b")).alias("w")).select("conv_id", "w.pos", "w.a", "w.b")
    ends = whole.groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"),
                                              F.count(F.lit(1)).alias("n_copies"))
    last = whole.select(F.col("conv_id").alias("l_conv"), F.col("pos").alias("n"))
    inner = (p.select("conv_id", "pos", "a", "b")
             .join(last, F.col("conv_id").eqNullSafe(F.col("l_conv")))
             .where("pos < n").groupBy("pos", "a", "b").agg(F.lit(1).alias("one")))
    return (ends.join(inner.drop("one"), ["pos", "a", "b"], "left_anti")
            .select("conv_id", F.col("pos").alias("n_turns"), "n_copies"))


def render(turn_prefixes: DataFrame, kept: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment, n_turns, n_copies, text of the kept conversations."""
    part = F.concat(F.lit(TURN_OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"),
                    F.coalesce("text", F.lit("")), F.lit(TURN_CLOSE))
    k = kept.select(F.col("conv_id").alias("k_conv"), "n_turns", "n_copies")
    rows = turn_prefixes.join(k, F.col("conv_id").eqNullSafe(F.col("k_conv"))).select(
        "conv_id", "n_turns", "n_copies", "pos", part.alias("part"),
        F.expr(f"(pos - 1) div {segment}").alias("segment"))
    # at most ``segment`` turns meet in a group
    return rows.groupBy("conv_id", "segment", "n_turns", "n_copies").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))),
                                 lambda x: x["part"]), "").alias("text"))


def collapse_and_render(turns: DataFrame, **cols) -> DataFrame:
    p = staged(prefixes(turns, **cols), "chat-prefixes")
    return render(p, maximal(p))
