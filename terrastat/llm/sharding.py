"""K-d tree sharding by distributed weighted cuts.

A node that must give ``k`` leaves is cut into ``k // 2`` and the rest, along
its widest metadata dimension (spread over the table's spread), at the point
that divides its weight in that ratio: the weighted median for even ``k``. All
nodes of a level are cut together. A cut is found on a 62-bit key, exact to the
row: the dimension's value in 2**20 steps, then a code of the row's group, then a code of
the row and of its number among its copies. A group that weighs at most
``GROUP_PART`` of a leaf stays whole: its rows share the metadata point of its least
row and one key, which no cut divides. Rows of a heavier group keep their own points
and are cut like others.
Each pass sums weights into ``BINS``
bins a node between the bounds left by the pass before; a node is done when the
crossing bin holds one key, or weighs less than ``TOLERANCE`` of a leaf. Only
node bounds reach the driver: at most one row a leaf.

Defined cases: null metadata counts as 0, null weights as 0; ties are cut by
group code, then id; rows that are repeated whole are numbered and cut like
others, so a row of many copies is spread over shards and slots; an empty table gives no cuts and no rows; a table lighter than the leaves leaves
some of them empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastat.llm.common import staged

BINS = 4096
TOLERANCE = 0.002
GROUP_PART = 0.02
STEPS = 1 << 20
GROUP_BITS, ID_BITS = 20, 22
SLOT_BLOCKS = 64
COPIES = 1024


def _node_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    # one row a node, so at most one a leaf
    return F.broadcast(spark.createDataFrame(rows, schema))


def _cuts(table: DataFrame, nodes: dict[int, dict], target_leaf: float) -> dict[int, int]:
    """The cut key of every node: rows with a smaller key go left."""
    spark, cuts = table.sparkSession, {}
    bounds = {n: {"lo": x["lo"], "hi": x["hi"], "need": x["need"]} for n, x in nodes.items()}
    while bounds:
        params = _node_table(spark, [
            (n, int(b["lo"]), int(b["hi"]), int(max(1, -(-(b["hi"] - b["lo"] + 1) // BINS))),
             nodes[n]["dim"], float(b["need"])) for n, b in bounds.items()],
            "p_node int, lo bigint, hi bigint, width bigint, dim int, need double")
        key = F.col("keys")[F.col("dim")]
        binned = (table.join(params, F.col("node") == F.col("p_node"))
                  .select("node", "lo", "width", "need", "weight", key.alias("key"), "hi")
                  .where("key between lo and hi")
                  .groupBy("node", F.expr("(key - lo) div width").alias("bin"), "need")
                  .agg(F.sum("weight").alias("w"), F.min("key").alias("first"),
                       F.max("key").alias("last")))
        upto = Window.partitionBy("node").orderBy("bin")  # at most BINS rows a node
        crossing = (binned.withColumn("cum", F.sum("w").over(upto))
                    .where("cum >= need or w is null")
                    .withColumn("nth", F.row_number().over(upto)).where("nth = 1").collect())
        for r in crossing:
            b = bounds[r.node]
            before = r.cum - r.w
            if r.first == r.last or r.w <= TOLERANCE * target_leaf:
                # the nearer of the two ends of the crossing bin
                cuts[r.node] = r.first if b["need"] - before < r.cum - b["need"] else r.last + 1
                del bounds[r.node]
            else:
                bounds[r.node] = {"lo": r.first, "hi": r.last, "need": b["need"] - before}
        for n in set(bounds) - {r.node for r in crossing}:  # rounding: all of it goes left
            cuts[n] = bounds.pop(n)["hi"] + 1
    return cuts


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` and ``copy``, 0-based among equal rows. Copies are counted before
    the shuffle; those of a row over ``COPIES`` are dealt out in chunks."""
    counted = staged(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "kd-copies")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n))
    few = counted.where(F.col("n") <= COPIES).select(*rows.columns, upto(F.col("n") - 1).alias("copy"))
    many = counted.where(F.col("n") > COPIES)
    if not many.limit(1).count():
        return few
    chunks = many.select("*", upto(F.expr(f"(n - 1) div {COPIES}")).alias("chunk"))
    first = F.col("chunk") * COPIES
    dealt = chunks.repartition(*rows.columns, "chunk").select(*rows.columns, upto(
        F.least(F.lit(COPIES), F.col("n") - first) - 1).alias("nth"), first.alias("first"))
    return few.unionByName(dealt.select(*rows.columns, (F.col("first") + F.col("nth")).alias("copy")))


def _gathered(table: DataFrame, limit: float) -> DataFrame:
    """``table`` with ``whole``: rows of groups that weigh at most ``limit`` get the
    metadata point of the group's least row."""
    groups = staged(table.groupBy("group").agg(
        F.sum("weight").alias("g_weight"), F.min(F.struct("id", "at")).alias("least")), "kd-groups")
    # at most total weight / limit groups are heavy: leaves / GROUP_PART
    heavy = F.broadcast(groups.where(F.col("g_weight") > limit).select("group"))
    light = (table.join(heavy, "group", "left_anti")
             .join(groups.where(F.col("g_weight") <= limit), "group")
             .withColumn("at", F.col("least.at")).withColumn("whole", F.lit(True)))
    return staged(table.join(heavy, "group", "left_semi").withColumn("whole", F.lit(False))
                  .select(*table.columns, "whole")
                  .unionByName(light.select(*table.columns, "whole")), "kd")


def kd_shards(rows: DataFrame, *, id_col: str, group: Column, weight: Column,
              dimensions: list[Column], carry: dict[str, Column] | None = None,
              n_shards: int | None = None, target_weight: float | None = None) -> DataFrame:
    """``id``, the ``carry`` columns, ``weight``, ``shard`` (0-based leaf, left
    to right) and ``slot`` (0-based in the shard). Give the number of shards, or
    the target weight of one. Rows of one ``group`` meet in one shard unless they
    weigh more than ``GROUP_PART`` of it."""
    spark, carry = rows.sparkSession, carry or {}
    table = staged(_numbered(rows.select(
        F.col(id_col).alias("id"), *[c.alias(k) for k, c in carry.items()],
        F.coalesce(weight, F.lit(0)).cast("bigint").alias("weight"),
        F.coalesce(group.cast("bigint"), F.lit(0)).alias("group"),
        F.array(*[F.coalesce(d.cast("double"), F.lit(0.0)) for d in dimensions]).alias("at"))), "kd")
    count = len(dimensions)
    total = int(table.agg(F.sum("weight").alias("w")).first()["w"] or 0)
    if n_shards is None:
        n_shards = max(1, -(-total // max(1, int(target_weight))))
    table = _gathered(table, GROUP_PART * total / n_shards)
    whole = table.agg(*[
        f(F.col("at")[i]).alias(f"{name}{i}") for i in range(count)
        for name, f in (("lo", F.min), ("hi", F.max))]).first()
    spread = [(whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0) for i in range(count)]

    def key(i: int) -> Column:
        step = (F.floor((F.col("at")[i] - F.lit(float(whole[f"lo{i}"]))) / F.lit(float(spread[i]))
                        * (STEPS - 1)).cast("bigint") if spread[i] else F.lit(0).cast("bigint"))
        tail = (F.shiftleft(F.pmod(F.col("group"), F.lit(1 << GROUP_BITS)), ID_BITS)
                + F.when(F.col("whole"), F.lit(0).cast("bigint")).otherwise(
                    F.pmod(F.xxhash64("id", "group", "at", "copy"), F.lit(1 << ID_BITS))))
        return F.shiftleft(step, GROUP_BITS + ID_BITS) + tail

    tree = {0: n_shards}  # first shard of a node: leaves below it
    table = table.select("id", *carry, "weight", "group", "copy", F.lit(0).alias("node"),
                         (F.array(*[key(i) for i in range(count)]) if total or any(spread)
                          else F.array(*[F.lit(0).cast("bigint")] * count)).alias("keys"))
    level = 0
    while any(k > 1 for k in tree.values()):
        stats = {r.node: r for r in table.groupBy("node").agg(F.sum("weight").alias("w"), *[
            f(F.col("keys")[i]).alias(f"{name}{i}") for i in range(count)
            for name, f in (("lo", F.min), ("hi", F.max))]).collect()}
        nodes = {}
        for n, k in tree.items():
            if k > 1 and n in stats:
                r = stats[n]
                dim = max(range(count), key=lambda i: ((r[f"hi{i}"] >> (GROUP_BITS + ID_BITS))
                                                       - (r[f"lo{i}"] >> (GROUP_BITS + ID_BITS)),
                                                       -i))
                nodes[n] = {"dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"],
                            "need": r.w * (k // 2) / k}
        cuts = _cuts(table, nodes, total / n_shards)
        params = _node_table(spark, [(n, nodes[n]["dim"], int(c), n + tree[n] // 2)
                                     for n, c in cuts.items()] or [(-1, 0, 0, 0)],
                             "p_node int, dim int, cut bigint, right int")
        table = staged(table.join(params, F.col("node") == F.col("p_node"), "left").select(
            "id", *carry, "weight", "group", "copy",
            F.when(F.col("keys")[F.col("dim")] >= F.col("cut"), F.col("right"))
            .otherwise(F.col("node")).alias("node"), "keys"), f"kd-{level}")
        tree = {m: k for n, total_k in tree.items() for m, k in (
            [(n, total_k)] if total_k == 1 else
            [(n, total_k // 2), (n + total_k // 2, total_k - total_k // 2)])}
        level += 1

    # slots: blocks of a shard by hash, numbered apart and offset
    numbered = table.withColumn("block", F.pmod(F.xxhash64("id", "group", "weight", "copy"),
                                                F.lit(SLOT_BLOCKS)))
    per = numbered.groupBy("node", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = (Window.partitionBy("node").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select(F.col("node").alias("o_node"), F.col("block").alias("o_block"),
                         F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("node", "block").orderBy("id", "group", "weight", "copy")
    return (numbered.withColumn("nth", F.row_number().over(inside) - 1)
            .join(F.broadcast(offsets) if n_shards * SLOT_BLOCKS <= 100_000 else offsets,
                  (F.col("node") == F.col("o_node")) & (F.col("block") == F.col("o_block")))
            .select("id", *carry, "weight", F.col("node").alias("shard"),
                    (F.col("offset") + F.col("nth")).cast("bigint").alias("slot")))


def shard_documents(docs: DataFrame, n_shards: int = 24, *, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                    ) -> DataFrame:
    """The contract's columns: shards of near-equal bytes, from a k-d tree over
    source, language, size and content code."""
    text = F.col(text_col)
    crc = F.crc32(text)
    code = lambda c: F.crc32(F.col(c).cast("string"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + F.lit(8)
    out = kd_shards(docs, id_col=id_col, group=crc, weight=size,
                    dimensions=[code(source_col), code(lang_col), F.log2(size.cast("double")),
                                crc], carry={"text_crc32": crc}, n_shards=n_shards)
    return out.select(F.col("id").alias("doc_id"), F.col("weight").alias("size"), "text_crc32",
                      F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
