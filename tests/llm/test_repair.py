import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from terrastat.llm import repair
from terrastat.llm.queries import QUERIES
from terrastat.llm.sql import ORACLE_SQL
from tests.conftest import SF001

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
           "repaired_sha256"]


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = role or (" " if role is None else ""), " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        kept = out.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired turns) by plain dynamic programming: the states are
    nothing read, after system, after user, after assistant."""
    order = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def put(at, state, value):
        if state not in at or value < at[state]:
            at[state] = value

    def insert(at):
        at = dict(at)
        for _ in range(4):
            for state, (cost, audit, text) in list(at.items()):
                for t in order[state]:
                    if t in names:
                        put(at, t, (cost + 5, audit + "I", (*text, names[t] + ":")))
        return at

    at = {"": (0, "", ())}
    for role, text, must, cut in turns:
        new = {}
        for state, (cost, audit, lines) in insert(at).items():
            put(new, state, (cost + 2, audit + "D", lines))
            for t in order[state] if not must else "":
                more = 5 if cut else 0
                if role[:1] == t:
                    put(new, t, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                if t in names:
                    put(new, t, (cost + more + 1, audit + "R", (*lines, f"{names[t]}:{text}")))
        at = new
    at = insert(at)
    return min(at[s] for s in ("", "a") if s in at)


def facts(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    seen, marked = set(), []
    blank = duplicate = truncated = 0
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        first = not bare, (role, text) in seen, bool(bare) and bare[-1] not in ".!?"
        seen.add((role, text))
        blank += first[0]
        duplicate += first[1] and not first[0]
        cut = first[2] and not first[0] and not first[1]
        truncated += cut
        marked.append((role, text, first[0] or first[1], cut))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, lines = cheapest(marked)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, blank, duplicate, truncated, illegal, cost, audit, sha


def brute(rows):
    return sorted(((c, *facts(t)) for c, t in damage(rows).items()), key=repr)


def made(seed, convs=60, top=9):
    rng, rows = random.Random(seed), []
    for conv in [*range(convs), None]:
        for _ in range(rng.randrange(top)):
            turn = rng.choice([None, *range(12)])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool",
                               "ulysses"])
            text = rng.choice([None, "", " \t", "Yes.", "No", "So? ", "End!\x0b", "é…", "a b", "x"])
            rows.append((conv, turn, role, text))
    return rows


def frame(spark, rows):
    return (spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
            .withColumn("pos", F.lit("clash")).withColumn("copies", F.lit(7)))


def answers(spark, rows):
    df = frame(spark, rows)
    got = repair.digest(df, repair.repair(repair.damaged(df.repartition(3))))
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = made(seed)
    assert answers(spark, rows) == brute(rows)


def test_sql_agrees_on_awkward_rows(spark):
    rows = made(3, 40)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op13_repair']})").fetchall()
    assert sorted(got, key=repr) == brute(rows)


def test_one_conversation_over_many_segments(spark, monkeypatch):
    """A third of all rows in one conversation, cut into many segments."""
    rng = random.Random(8)
    rows = [(5, k, rng.choice(["user", "assistant", "system", "x"]),
             rng.choice([f"t{k}.", f"t{k}", "again.", ""])) for k in range(700)]
    rows += [(5, None, "user", "same.")] * 300 + [(5, 900, "assistant", f"v{k % 40}") for k in range(200)]
    rows += made(9, 200)
    expect = brute(rows)
    monkeypatch.setattr(repair, "SEGMENT_BITS", 4)
    assert answers(spark, rows) == expect


def test_few_rows(spark):
    assert answers(spark, []) == []
    dropped = next(k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert answers(spark, [(dropped, 0, "user", "Hi.")]) == [
        (dropped, 0, 0, 0, 0, 0, 0, "", empty)]


def test_long_text_and_order_of_ties(spark):
    rows = [(1, 1, "user", "z" * 400_000 + "."), (1, 1, "user", "z" * 400_000 + "a."),
            (1, 2, "assistant", "ok.")]
    assert answers(spark, rows) == brute(rows)


def test_repaired_turns(spark):
    rows = made(4, 30)
    df = frame(spark, rows)
    done = repair.repair(repair.damaged(df))
    turns = {}
    for r in sorted(done.conversations().collect(), key=lambda r: (r.pos, r.step)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    shas = {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in turns.items()}
    for r in brute(rows):
        assert shas.get(r[0], hashlib.sha256(b"").hexdigest()) == r[-1]
    for t in turns.values():
        roles = "".join(x[0] for x in t)
        assert roles.removeprefix("s") == "ua" * (len(roles) // 2)


def test_parser_accepts_the_grammar():
    p = repair.Parser()
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            at = [p.root]
            for t in word:
                at = [c for cell in at for c in p.shift(cell, t)]
            w = "".join(word)
            expect = w == "" or (w.removeprefix("s") == "ua" * (len(w) // 2) and "u" in w)
            assert any(map(p.accepts, at)) == expect, w
    with pytest.raises(ValueError):
        repair.Parser({"C": ((), ("u", "C", "a"))})


def test_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in
            spark.read.parquet(f"{SF001}/conversations.parquet").collect()]
    got = QUERIES["op13_repair"](spark, SF001)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
