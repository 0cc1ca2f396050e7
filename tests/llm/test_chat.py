import random

from terrastat.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    order = lambda x: (x is not None, x if x is not None else 0)
    name = lambda x: (x is not None, x or "")
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((order(t), name(r), name(x), r, x))
    lists = {c: [(r, x) for *_, r, x in sorted(v, key=lambda z: z[:3])] for c, v in convs.items()}
    out = {}
    for c, l in lists.items():
        if any(len(o) > len(l) and o[:len(l)] == l for o in lists.values()):
            continue
        same = [d for d, o in lists.items() if o == l]
        first = min(same, key=lambda d: (d is None, d or 0))
        text = "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{x or ''}<|im_end|>\n"
                       for r, x in l)
        out[first] = (len(l), len(same), text)
    return out


def check(spark, rows):
    got = chat.collapse_and_render(spark.createDataFrame(rows, SCHEMA)).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r.conv_id or 0, r.segment)):
        n, k, text = whole.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        whole[r.conv_id] = (n, k, text + r.text)
    assert whole == brute(rows)
    return got


def test_snapshots_against_brute_force(spark):
    rng, rows = random.Random(2), []
    for c in range(120):
        turns = [(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(rng.randint(1, 4))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(500, 0, None, "x"), (501, 0, "", "x"), (502, 0, "user", None), (503, 0, "user", ""),
             (504, None, "user", "n"), (504, 0, "user", "m"), (505, 0, "user", "a"), (505, 0, "user", "a"),
             (None, 0, "user", "only here"), (506, 0, "user", "only here"), (507, 5, "z", "gap"),
             (507, 9000, "z", "far")]
    check(spark, rows)


def test_long_conversation_and_empty(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}") for t in range(1500)]
    got = check(spark, rows)
    assert sorted((r.conv_id, r.segment) for r in got) == [(1, 0), (1, 1), (1, 2)]
    assert chat.collapse_and_render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_conversations_without_turn_numbers(spark, monkeypatch):
    """Null and equal turn numbers, repeated rows and long common begins are cut
    into blocks by their whole order."""
    monkeypatch.setattr(chat, "BLOCK_BITS", 3)
    begin = "the same begin " * 30
    rows = [(1, None, "user", f"t{t % 7}") for t in range(400)]
    rows += [(2, 5, "user", begin + str(t % 50)) for t in range(200)]
    rows += [(2, 5, "user", begin[:chat.TIE_CHARS])] * 60 + [(3, 5, "user", None)] * 90
    rows += [(4, None, "user", f"t{t % 7}") for t in range(399)]
    random.Random(4).shuffle(rows)
    check(spark, rows)
