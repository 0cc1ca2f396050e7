"""Conversation structure repair by generalised LR parsing.

The roles of a conversation must read ``(s?(ua)+)?``: a system turn at most, then
user and assistant in turn. A parser built from that grammar (LR items, reductions
by the symbol that may follow) runs over the turns, and each turn may be kept (cost
0), given the role user or assistant (1), deleted (2), and a turn may be inserted
before it (5). Parses live in one graph-structured stack: a stack is a shared,
interned cell (state, cell below), shifts and reductions are looked up once a cell
and role, and parses that reach equal stacks merge into the one of least (cost,
audit). The audit is the edits' initials in order; of equal costs the least string
wins, and equal costs never are prefixes of each other, so merging early is exact.

No conversation is held whole. Rows that repeat (conversation, turn, role, text)
become one row with a count, since every copy but the first must go. Rows are
sorted by ranges of the whole order and cut into segments of ``SEGMENT``. A segment
is parsed from every stack that may stand at its begin (ten for this grammar), and
gives its cheapest edits for each pair of stacks. Per conversation only these
segments' results are joined up, in order, with the edits that all parses share
cut off. So a conversation with a third of all rows is parsed by many tasks. One
thing is serial by nature: ``digest``'s hash over a conversation's repaired text,
which one task streams through without holding it.

Defined cases: a null role or text reads as one space; rows of one turn number are
ordered by role, then text; null turns come first; a null conv_id is one
conversation; roles other than those that begin with s, u or a can't be kept; a
blank row, or one whose role and text came earlier, must be deleted; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastat.llm.common import staged

# The role grammar by initials, the roles that edits give, costs.
GRAMMAR = {"C": ((), ("B",), ("s", "B")), "B": (("u", "a"), ("B", "u", "a"))}
START, END = "C", "$"
GIVEN = {"u": "user", "a": "assistant"}
RENAME, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"

SEGMENT_BITS = 12
MOST_STACKS = 64
TIE_CHARS = 64


class Cell:
    """A stack: its top state and the stack below. A parser makes each once, so
    equal stacks are one cell."""

    __slots__ = ("state", "below")

    def __init__(self, state: int, below: Cell | None):
        self.state, self.below = state, below


class Parser:
    """LR automaton of a grammar, and its graph-structured stack."""

    def __init__(self, grammar: dict = GRAMMAR, start: str = START):
        self.grammar, self.start = grammar, start
        rules = [(head, body) for head, bodies in grammar.items() for body in bodies]
        follow = self._follow(rules)
        # a state is its items: (head, body, dot)
        states = [self._closure({("", (start,), 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for k, items in enumerate(states):  # grows while it runs
            for x in sorted({b[dot] for _, b, dot in items if dot < len(b)}):
                to = self._closure({(h, b, dot + 1) for h, b, dot in items
                                    if dot < len(b) and b[dot] == x})
                if to not in states:
                    states.append(to)
                self.goto[k, x] = states.index(to)
        self.reduce = {k: sorted((h, len(b), t) for h, b, dot in items
                                 if h and dot == len(b) for t in follow[h])
                       for k, items in enumerate(states)}
        self.moves: dict[tuple[Cell, str], list[Cell]] = {}
        self.made: dict[tuple[int, Cell | None], Cell] = {}
        self.root = self._cell(0, None)
        self.terminals = sorted({x for _, b in rules for x in b if x not in grammar})
        self.cells = [self.root]  # every stack that turns can lead to
        for cell in self.cells:
            for t in self.terminals:
                self.cells += [c for c in self.shift(cell, t) if c not in self.cells]
            if len(self.cells) > MOST_STACKS:
                raise ValueError("the grammar's stacks grow without bound")
        self.number = {c: k for k, c in enumerate(self.cells)}

    def _cell(self, state: int, below: Cell | None) -> Cell:
        return self.made.setdefault((state, below), Cell(state, below))

    def _closure(self, items: set) -> frozenset:
        items = set(items)
        while True:
            more = {(b[dot], body, 0) for _, b, dot in items
                    if dot < len(b) and b[dot] in self.grammar for body in self.grammar[b[dot]]}
            if more <= items:
                return frozenset(items)
            items |= more

    def _follow(self, rules) -> dict[str, set[str]]:
        """What may come after each head; a grammar's empty rule is its start's."""
        first = {h: set() for h in self.grammar}
        follow = {h: {END} if h == self.start else set() for h in self.grammar}
        for _ in range(len(rules) + 2):
            for head, body in rules:
                if body:
                    first[head] |= first.get(body[0], {body[0]})
                for k, x in enumerate(body):
                    if x in self.grammar:
                        follow[x] |= (follow[head] if k + 1 == len(body)
                                      else first.get(body[k + 1], {body[k + 1]}))
        return follow

    def _tops(self, cell: Cell, ahead: str) -> list[Cell]:
        """The stack and all that reductions before ``ahead`` make of it."""
        out = [cell]
        for c in out:
            for head, size, t in self.reduce[c.state]:
                if t == ahead:
                    base = c
                    for _ in range(size):
                        base = base.below
                    to = self._cell(self.goto[base.state, head], base)
                    if to not in out:
                        out.append(to)
        return out

    def shift(self, cell: Cell, terminal: str) -> list[Cell]:
        key = (cell, terminal)
        if key not in self.moves:
            self.moves[key] = [self._cell(self.goto[c.state, terminal], c)
                               for c in self._tops(cell, terminal)
                               if (c.state, terminal) in self.goto]
        return self.moves[key]

    def accepts(self, cell: Cell) -> bool:
        return any(c.below == self.root and c.state == self.goto[0, self.start]
                   for c in self._tops(cell, END))


# A parse's value: cost, audit, and the role initial after each edit (- if deleted).
Value = tuple[int, str, str]


def _put(at: dict[Cell, Value], cell: Cell, value: Value) -> bool:
    if cell in at and at[cell] <= value:
        return False
    at[cell] = value
    return True


def inserted(parser: Parser, at: dict[Cell, Value]) -> dict[Cell, Value]:
    """The parses, and those with turns inserted after them."""
    at, todo = dict(at), list(at)
    while todo:
        cell = todo.pop()
        cost, audit, roles = at[cell]
        for t in GIVEN:
            for to in parser.shift(cell, t):
                if _put(at, to, (cost + INSERT, audit + "I", roles + t)):
                    todo.append(to)
    return at


def advance(parser: Parser, at: dict[Cell, Value], initial: str, must_go: bool,
            unfinished: bool, copies: int) -> dict[Cell, Value]:
    """The parses after a row; ``copies - 1`` repeats of it are deleted too."""
    out: dict[Cell, Value] = {}
    gone = DELETE * (copies - 1)
    for cell, (cost, audit, roles) in inserted(parser, at).items():
        cost += gone
        _put(out, cell, (cost + DELETE, audit + "D", roles + "-"))
        if must_go:
            continue
        cost += UNFINISHED * unfinished
        if initial in parser.terminals:
            for to in parser.shift(cell, initial):
                _put(out, to, (cost, audit + "K", roles + initial))
        for t in GIVEN:
            for to in parser.shift(cell, t):
                _put(out, to, (cost + RENAME, audit + "R", roles + t))
    return out


def damaged(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by the hash of
    ``conv_id:turn``, one in twenty each: dropped, emptied, without ends of
    sentences, repeated, or made the user's."""
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n)
          for c, n in ((role_col, "role"), (text_col, "text"))])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" "))
                             for c in ("conv_id", "turn")])
    rows = rows.withColumn("kind", F.crc32(key) % 20).where("kind != 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit(GIVEN["u"])).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("copies"))


def _nulls_first(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def ordered(turns: DataFrame) -> DataFrame:
    """The distinct rows of ``turns`` (conv_id, turn, role, text, copies) with
    their faults, numbered by ``pos`` in the order of conversations and turns."""
    rows = staged(turns.groupBy("conv_id", "turn", "role", "text")
                  .agg(F.sum("copies").alias("copies")).withColumn("key", F.sha2("text", 256)),
                  "repair-distinct")
    # the first turn of each (conversation, role, text): one row a text, and the
    # join's key holds the turn, so a text that comes again and again is no hot key
    by_turn = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn"))
    first = (rows.groupBy("conv_id", "role", "key").agg(F.min(by_turn).alias("t"))
             .select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"),
                     F.col("key").alias("f_key"), F.col("t.turn").alias("f_turn")))
    found = rows.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv"))
                      & F.col("turn").eqNullSafe(F.col("f_turn"))
                      & (F.col("role") == F.col("f_role")) & (F.col("key") == F.col("f_key")), "left")
    bare = F.rtrim("text", F.lit(SPACE))
    blank = bare == ""
    rows = found.select(
        "conv_id", "turn", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"),
        blank.alias("blank"), F.col("f_key").isNull().alias("repeats"),
        (~blank & ~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("unfinished"))
    spread = [*_nulls_first("conv_id", "turn", "role"), F.substring("text", 1, TIE_CHARS)]
    return staged(
        rows.repartitionByRange(*spread)
        .sortWithinPartitions(*_nulls_first("conv_id", "turn", "role", "text"))
        .withColumn("pos", F.monotonically_increasing_id())
        .withColumn("segment", F.shiftright("pos", SEGMENT_BITS)), "repair-rows")


PARSED = ("conv_id bigint, segment bigint, first_pos bigint, opens string, closes string, "
          "illegal bigint, entries array<int>, exits array<int>, costs array<bigint>, "
          "audits array<string>, roles array<string>")
LEGAL = ("su", "ua", "au")
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _dicts(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _table(rows, schema: str):
    """Python rows as Arrow batches of a schema given as for Spark."""
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    arrow = pa.schema([(n, pa.list_(ARROW[t[6:-1]]) if t.startswith("array<") else ARROW[t])
                       for n, t in fields])
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 512:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def segments(rows: DataFrame) -> DataFrame:
    """One row a conversation and segment: its cheapest edits from each stack
    that may stand before it to each that may follow."""

    def parse(conv, segment, run, starts, parser):
        at = {c: {c: (0, "", "")} for c in starts}
        first = last = None
        illegal = 0
        for r in run:
            first = first or r
            initial = r["initial"]
            illegal += r["copies"] - 1  # no role may follow itself
            if last is not None:
                illegal += last + initial not in LEGAL
            last = initial
            must_go = r["blank"] or r["repeats"]
            at = {c: advance(parser, f, initial, must_go, r["unfinished"], r["copies"])
                  for c, f in at.items()}
        flat = [(parser.number[c], parser.number[to], *value)
                for c, f in at.items() for to, value in f.items()]
        entries, exits, costs, audits, roles = map(list, zip(*flat))
        return {"conv_id": conv, "segment": segment, "first_pos": first["pos"],
                "opens": first["initial"], "closes": last, "illegal": illegal,
                "entries": entries, "exits": exits, "costs": costs, "audits": audits,
                "roles": roles}

    def run(batches):
        parser = Parser()

        def results():
            for segment, part in groupby(_dicts(batches), lambda r: r["segment"]):
                # only the first conversation of a segment may have begun before it
                starts = parser.cells
                for conv, same in groupby(part, lambda r: r["conv_id"]):
                    yield parse(conv, segment, same, starts, parser)
                    starts = [parser.root]

        yield from _table(results(), PARSED)

    return (rows.select("pos", "segment", "conv_id", "copies", "initial", "blank", "repeats",
                        "unfinished")
            .repartition("segment").sortWithinPartitions("segment", "pos")
            .mapInArrow(run, PARSED))


CHOSEN = ("conv_id bigint, segment bigint, first_pos bigint, entry int, exit int, closing string, "
          "cost bigint, illegal bigint")


def _joined(parser: Parser, parts):
    """The cheapest way through a conversation's segments, given in order."""
    at: dict[Cell, Value] = {parser.root: (0, "", "")}
    back, illegal, last = [], 0, None
    for p in parts:
        illegal += p["illegal"] + (last is not None and last + p["opens"] not in LEGAL)
        last = p["closes"]
        new: dict[Cell, Value] = {}
        came: dict[Cell, Cell] = {}
        for entry, exit, cost, audit in zip(p["entries"], p["exits"], p["costs"], p["audits"]):
            c, to = parser.cells[entry], parser.cells[exit]
            if c in at and _put(new, to, (at[c][0] + cost, at[c][1] + audit, "")):
                came[to] = c
        # what all parses share can't decide between them any more
        shared = len(os.path.commonprefix([v[1] for v in new.values()]))
        at = {c: (v[0], v[1][shared:], "") for c, v in new.items()}
        back.append((p["segment"], p["first_pos"], came))
    # turns inserted after the last row; the end must be accepted
    best = None
    for c, v in at.items():
        for to, w in inserted(parser, {c: v}).items():
            if parser.accepts(to) and (best is None or w[:2] < best[0][:2]):
                best = (w, c)
    (cost, _, closing), cell = best
    for segment, first_pos, came in reversed(back):
        yield {"segment": segment, "first_pos": first_pos, "entry": parser.number[came[cell]],
               "exit": parser.number[cell], "closing": closing, "cost": cost, "illegal": illegal}
        cell, closing, cost, illegal = came[cell], "", 0, 0


def chosen(parsed: DataFrame) -> DataFrame:
    """For each conversation and segment the stacks before and after it; the last
    segment's row also has the roles inserted at the end, the cost and the number
    of illegal neighbours."""

    def run(batches):
        parser = Parser()
        yield from _table(({"conv_id": conv, **r} for conv, parts in
                           groupby(_dicts(batches), lambda r: r["conv_id"])
                           for r in _joined(parser, parts)), CHOSEN)

    return (parsed.repartition("conv_id")
            .sortWithinPartitions(*_nulls_first("conv_id", "segment"))
            .mapInArrow(run, CHOSEN))


EDITED = ("pos bigint, conv_id bigint, turn bigint, role string, text string, copies bigint, "
          "before string, edit string, becomes string, after string")


def edited(rows: DataFrame, parsed: DataFrame, ways: DataFrame) -> DataFrame:
    """Every distinct row with its edit: the initials of roles inserted ``before``
    it, its own edit, the initial it ``becomes`` (- if deleted), and those
    inserted ``after`` the conversation's last row."""
    at = F.expr("filter(sequence(0, size(entries) - 1), "
                "k -> entries[k] = entry AND exits[k] = exit)[0]")
    paths = (parsed.drop("conv_id", "segment").join(ways.drop("conv_id", "segment"), "first_pos")
             .withColumn("at", at)
             .select(F.col("first_pos").alias("pos"), F.expr("audits[at]").alias("audit"),
                     F.expr("roles[at]").alias("path"), "closing"))

    def run(batches):
        audit = path = closing = ""
        k = 0
        for batch in batches:
            out = {"before": [], "edit": [], "becomes": [], "after": []}
            for a, p, c in zip(*(batch.column(n).to_pylist() for n in ("audit", "path", "closing"))):
                if a is not None:  # the first row of a conversation in a segment
                    audit, path, closing, k = a, p, c, 0
                to = k
                while audit[to] == "I":
                    to += 1
                out["before"].append(path[k:to])
                out["edit"].append(audit[to])
                out["becomes"].append(path[to])
                k = to + 1
                out["after"].append(closing if k == len(audit) else "")
            kept = ["pos", "conv_id", "turn", "role", "text", "copies"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + [pa.array(v, pa.string()) for v in out.values()],
                names=kept + list(out))

    return (rows.join(paths, "pos", "left")
            .repartition("segment").sortWithinPartitions("segment", "pos")
            .select("pos", "conv_id", "turn", "role", "text", "copies", "audit", "path", "closing")
            .mapInArrow(run, EDITED))


def _given(initials: str) -> str:
    """SQL: (role, text, edit) of the turns inserted for a string of initials."""
    return (f"transform(filter(split({initials}, ''), c -> c != ''), c -> named_struct("
            f"'role', IF(c = 'u', '{GIVEN['u']}', '{GIVEN['a']}'), 'text', '', 'edit', 'I'))")


def _turns() -> Column:
    """The repaired turns that a row stands for, in order."""
    own = (f"IF(edit = 'D', array(), array(named_struct('role', CASE WHEN edit = 'K' THEN role "
           f"WHEN becomes = 'u' THEN '{GIVEN['u']}' ELSE '{GIVEN['a']}' END, "
           "'text', text, 'edit', edit)))")
    return F.expr(f"concat({_given('before')}, {own}, {_given('after')})")


@dataclass
class Repair:
    """The steps' tables; each is written once and read by those after it."""

    damaged: DataFrame
    rows: DataFrame
    ways: DataFrame
    edits: DataFrame

    def conversations(self) -> DataFrame:
        """conv_id, pos, step, turn, role, text, edit: the repaired turns, in
        the order of (pos, step) within a conversation."""
        return self.edits.select("conv_id", "pos", "turn", F.posexplode(_turns()).alias("step", "t")
                                 ).select("conv_id", "pos", "step", "turn", "t.role", "t.text",
                                          "t.edit")


def repair(rows: DataFrame) -> Repair:
    """The cheapest repair of conversations given as conv_id, turn, role, text,
    copies (see ``damaged``)."""
    found = ordered(rows)
    parsed = staged(segments(found), "repair-segments")
    ways = staged(chosen(parsed), "repair-ways")
    return Repair(rows, found, ways, edited(found, parsed, ways))


def digest(conversations: DataFrame, done: Repair, *, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256; ``conversations`` names those that lost all their rows."""

    def run(batches):
        def results():
            for conv, rows in groupby(_dicts(batches), lambda r: r["conv_id"]):
                sha, audit, opened = hashlib.sha256(), [], False
                for r in rows:
                    audit.append(r["letters"])
                    if r["body"] is not None:
                        sha.update((b"\n" if opened else b"") + r["body"].encode())
                        opened = True
                yield {"h_conv": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        yield from _table(results(), schema)

    schema = "h_conv bigint, audit string, repaired_sha256 string"
    turns = _turns()
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])),
                         "\n")
    letters = F.concat(F.repeat(F.lit("I"), F.length("before")), F.col("edit"),
                       F.expr("repeat('D', CAST(copies - 1 AS INT))"),
                       F.repeat(F.lit("I"), F.length("after")))
    hashes = (done.edits.select("conv_id", "pos", letters.alias("letters"),
                                F.when(F.size(turns) > 0, lines).alias("body"))
              .repartition("conv_id").sortWithinPartitions(*_nulls_first("conv_id", "pos"))
              .mapInArrow(run, schema))
    total = lambda c: F.sum(c).cast("bigint")
    own = ~F.col("blank") & ~F.col("repeats")
    facts = done.rows.groupBy(F.col("conv_id").alias("f_conv")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
        .alias("gaps"),
        total(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        total(F.when(F.col("blank"), 0).otherwise(F.col("copies") - own.cast("bigint")))
        .alias("duplicate"),
        total((own & F.col("unfinished")).cast("bigint")).alias("truncated"))
    costs = done.ways.groupBy(F.col("conv_id").alias("c_conv")).agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    base = conversations.select(F.col(conv_col).cast("bigint").alias("conv_id")).distinct()
    out = base
    for part, key in ((facts, "f_conv"), (costs, "c_conv"), (hashes, "h_conv")):
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(key)), "left")
    zero = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n)
            for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
                      .alias("repaired_sha256"))
