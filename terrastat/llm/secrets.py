"""Secret scans in DataFrame operations only.

Three fixed kinds are found by pattern, and a fourth, ``entropy``, by the
method: candidate strings (runs of token characters) are scored by the largest
Shannon entropy of any window of ``WINDOW`` characters within one character
class (hexadecimal, upper-case alphanumeric, base64). Counts are kept as the
window slides: the character that enters and the one that leaves change one
count each, and with them the running sum of ``c * log2(c)``. A candidate whose
best window reaches its class's threshold is a span, unless the allow-list
suppresses it (a run of letters only, dates and versions, UUIDs, lower-case
paths, and placeholder words or ordered alphabets that leave no ``WINDOW``
characters in a row without them: a secret glued to such a word stays a span,
and so does any candidate with a stretch that long beside the word). Base spans
are never suppressed.

Positions come from cutting a text behind every match: running sums of the parts'
lengths are the matches' ends, in code points. Work is linear in text and candidate
length, but for the running sums, which copy about the root of their number a part.

Defined cases: a null text is an empty text; texts of any length are scanned
whole; a candidate shorter than the window is one window; spans are ordered by
start, then kind in the order assign, access, hex, entropy; repeated rows are
answered each; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's kinds in their order, with their patterns.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a match of [0-9a-f]+ is a whole run, so length is part of it
ASSIGN_MIN, ACCESS_MIN = 8, 16
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ROUNDING = 1e-9  # of a running sum, beside a threshold
# class: (characters, least entropy in bits a character)
CLASSES = {
    "hex": ("0123456789abcdef", 3.0),
    "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.4),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
}
WORDS = ("(?:example|sample|changeme|placeholder|your[_-]|dummy|redacted|xxxx|test[_-]"
         "|abcdefghij|0123456789|qwertyuiop)")
ALLOW = (
    r"^[A-Za-z]+$",
    # no window's length free of words, from the start or from a word's end
    rf"(?i)^(?!(?:.*{WORDS})?(?:(?!{WORDS}).){{{WINDOW}}})",
    # possessive, so that a long value takes no deep recursion
    r"^[0-9]{1,4}+(?:[-_/=][0-9]{1,4}+)++$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[a-z]++(?:[-_/][a-z]++)++$",
)


SPAN = "array<struct<start:int,end:int,value:string,inner:string>>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's variable is a value,
    while an expression is computed again wherever it stands."""
    return F.transform(F.array(value), use)[0]


def _running(lengths: Column) -> Column:
    """Running sums of an array of integers. Blocks of about the root of its size are
    summed one by one and joined, so no long array is copied for each element."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)

    def summed(x):
        n = F.size(x)
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        blocks = F.when(n > 0, F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")),
            lambda k: F.slice(x, k * width + 1, width))).otherwise(F.array().cast("array<array<int>>"))
        return _let(blocks, joined)

    def joined(blocks):
        return _let(F.transform(blocks, total), lambda sums: F.flatten(F.transform(
            blocks, lambda part, k: within(part, total(F.slice(sums, F.lit(1), k))))))

    def within(part, before):
        first = F.struct(before.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, first, lambda s, v: F.struct(
            (s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"] + v)).alias("out")))["out"]

    return _let(lengths, summed)


def _found(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, value, inner>> of leftmost non-overlapping matches:
    offsets in code points, end exclusive; ``inner`` is a group of the match. The
    text is cut behind every match, so a part's first match is the one it ends with."""
    def span(x, end):
        hit = F.regexp_substr(x, F.lit(pattern))
        inner = hit if group is None else F.regexp_extract(x, pattern, group)
        return F.struct((end - F.char_length(hit)).alias("start"), end.alias("end"),
                        hit.alias("value"), inner.alias("inner"))

    def spans(parts):
        ends = _running(F.transform(parts, lambda x: F.char_length(x)))
        return F.filter(F.zip_with(parts, ends, span), lambda x: x["value"].isNotNull())

    parts = F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:{pattern}|\z)"), F.lit(0))
    # most texts have no match: the cheap test spares them the parts
    return F.when(F.rlike(text, F.lit(pattern)), _let(parts, spans).cast(SPAN)).otherwise(
        F.array().cast(SPAN))


def _best(value: Column, alphabets: list[str], window: int, finish) -> Column:
    """``finish`` of the largest entropies, one for each alphabet, of any window of
    ``value`` that lies in it.

    The value is cut into characters once. A window's sum of ``c * log2(c)`` changes
    by the count of the character that enters and of the one that leaves, both
    counted among the ``window - 1`` characters that stay; the running sum, and how
    long each alphabet has not been left, give every window's entropy.
    """
    gain = [(c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0) for c in range(window)]
    masks = [sum(1 << k for k, a in enumerate(alphabets) if chr(i) in a) for i in range(128)]
    gains, member = F.array(*map(F.lit, gain)), F.array(*map(F.lit, masks))
    n = F.char_length(value)
    codes = F.transform(F.slice(F.split(value, ""), 1, n), lambda c: F.ascii(c))
    width = F.least(n, F.lit(window))

    def change(x):
        def one(c, i):
            stay = F.slice(x, F.greatest(i - width + 2, F.lit(1)), F.least(i, width - 1))
            count = lambda y: gains[F.size(F.filter(stay, lambda z: z == y))]
            gone = F.when(i >= width, count(F.get(x, i - width))).otherwise(F.lit(0.0))
            return F.struct((count(c) - gone).alias("d"),
                            F.coalesce(F.get(member, c), F.lit(0)).alias("m"))
        return F.transform(x, one)

    steps = _let(codes, change)
    zero = F.struct(F.lit(0.0).alias("sum"), *[F.lit(0).alias(f"run{k}") for k in range(len(alphabets))],
                    *[F.lit(0.0).alias(f"best{k}") for k in range(len(alphabets))])

    def step(s, x):
        total = s["sum"] + x["d"]
        entropy = F.log2(width.cast("double")) - total / width
        runs = [F.when(x["m"].bitwiseAND(1 << k) > 0, F.least(s[f"run{k}"] + 1, width))
                .otherwise(F.lit(0)) for k in range(len(alphabets))]
        return F.struct(total.alias("sum"), *[r.alias(f"run{k}") for k, r in enumerate(runs)], *[
            F.when(r >= width, F.greatest(s[f"best{k}"], entropy)).otherwise(s[f"best{k}"])
            .alias(f"best{k}") for k, r in enumerate(runs)])

    return F.aggregate(steps, zero, step,
                       lambda s: finish([s[f"best{k}"] for k in range(len(alphabets))]))


def window_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest entropy, in bits a character, of any window of ``value`` that
    lies in ``alphabet``; 0 where there is none. A value shorter than the window
    is one window."""
    return _best(value, [alphabet], window, lambda best: best[0])


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW, window: int = WINDOW) -> Column:
    """Candidates that reach a class's threshold and no allow-list entry."""
    def reached(best):
        hot = F.lit(False)
        for b, (_, least) in zip(best, CLASSES.values()):
            hot = hot | (b >= F.lit(least - ROUNDING))
        return hot

    def secret(c):
        allowed = F.lit(False)
        for p in allow:
            allowed = allowed | F.rlike(c["value"], F.lit(p))
        return ~allowed & _best(c["value"], [a for a, _ in CLASSES.values()], window, reached)

    return F.filter(_found(text, CANDIDATE), secret)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         allow: tuple[str, ...] = ALLOW, window: int = WINDOW) -> DataFrame:
    """doc_id and one array of spans (start, end) a kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    found = {
        "assign": F.filter(_found(F.col("t"), ASSIGN, 1),
                           lambda x: F.char_length(x["inner"]) >= ASSIGN_MIN),
        "access": F.filter(_found(F.col("t"), ACCESS),
                           lambda x: F.char_length(x["value"]) >= ACCESS_MIN),
        "hex": _found(F.col("t"), HEX),
        "entropy": entropy_spans(F.col("t"), allow, window),
    }
    return rows.select("doc_id", *[F.transform(c, span).alias(k) for k, c in found.items()])


def _labelled(kind: str, nth: int) -> Column:
    return F.transform(kind, lambda x: F.struct(
        x["start"].alias("start"), F.lit(nth).alias("nth"), F.concat_ws(
            ":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")).alias("s")))


def _joined(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    every = F.concat(*[_labelled(k, n) for n, k in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(every), lambda x: x["s"]), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``."""
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(KINDS[:3]), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))
