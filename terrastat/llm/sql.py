"""DuckDB SQL for the pipeline operators' queries that SQL can express. The
others (tokens in ORC, language ID, decontamination digests, k-d shards, secret
spans, the mix, whitening, byte-pair ids) are held against brute force, libraries
or invariants in tests/llm."""

# Maximal conversations by comparing whole turn lists.
CHAT = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         role IS NULL AS no_role, text IS NULL AS no_text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations),
p AS (
  SELECT conv_id, pos, role, text,
         string_agg(md5(concat_ws('|', role, no_role, no_text, md5(text))), ',' ORDER BY pos)
           OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t),
ends AS (
  SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies
  FROM p WHERE pos = n GROUP BY prefix, n),
kept AS (
  SELECT * FROM ends e
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = e.n AND p.prefix = e.prefix))
SELECT k.conv_id, (p.pos - 1) // 1024 AS segment, k.n AS n_turns, k.n_copies,
       string_agg('<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), ''
                  ORDER BY p.pos) AS text
FROM kept k JOIN p ON p.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY ALL
"""

# All pairs that share a shingle, then the least id by repeated propagation.
JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS l
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i
        FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id
GROUP BY r.doc_id
"""

_fit = "(h = '{h}' OR ends_with(h, '.{h}')) AND starts_with(p, '{p}')"
# The contract's rules, longest first, and the registered query's parameters, written
# out here so that a change of the module's own shows.
_ranked = [("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
           ("org", "/fr/", "allow"), ("net", "/", "block")]
_suffixes = ("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp com.br com.mx "
             "com.ar co.in co.za com.cn").split()
_rule = "CASE " + " ".join(
    f"WHEN {_fit.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in _ranked) + " END"
_said = "CASE " + " ".join(
    f"WHEN {_fit.format(h=h, p=p)} THEN '{v}'" for h, p, v in _ranked) + " END"
_lo, _hi, _z, _max_bad = 1.0, 10_000.0, 1.64, 0.5
_two = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
_three = "array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')"
_last = "string_split(host, '.')[-1]"
_listed = f"{_two} IN (" + ", ".join(f"'{x}'" for x in _suffixes) + ")"


def _strength(level: str) -> str:
    """The prior strength of a level by moments, as one value."""
    return f"""(SELECT CASE WHEN m * (1 - m) > 0 AND free > 0 AND between_ > 0 THEN
      least(greatest(m * (1 - m) / between_ - 1, {_lo}), {_hi}) ELSE {_hi} END
    FROM (SELECT m, free, ((q - n * m * m) - (k - 1) * m * (1 - m)) / nullif(free, 0) AS between_
      FROM (SELECT sum(bad) / sum(n) AS m, sum(n) AS n, count(*) AS k,
                   sum(n * (bad / n) * (bad / n)) AS q,
                   sum(n) - sum(n * n) / sum(n) AS free
            FROM {level} WHERE n > 0)))"""


URLS = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
v AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS h,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p
  FROM u),
l AS (
  SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0
                          THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS bad
  FROM labels GROUP BY doc_id),
hosts AS (
  SELECT h AS host, count(l.bad)::DOUBLE AS n, coalesce(sum(l.bad), 0)::DOUBLE AS bad
  FROM v LEFT JOIN l ON l.doc_id = v.page_id GROUP BY h),
named AS (
  SELECT *, CASE WHEN {_listed} THEN {_three} ELSE {_two} END AS domain,
         CASE WHEN {_listed} THEN {_two} ELSE {_last} END AS suffix
  FROM hosts),
doms AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
sufs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
every AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS m FROM named),
x AS (SELECT suffix, (bad + {_strength('sufs')} * (SELECT m FROM every))
             / (n + {_strength('sufs')}) AS mean FROM sufs),
d AS (SELECT domain, (bad + {_strength('doms')} * x.mean) / (n + {_strength('doms')}) AS mean
      FROM doms JOIN x USING (suffix)),
r AS (SELECT host, n + {_strength('named')} AS total,
             (bad + {_strength('named')} * d.mean) / (n + {_strength('named')}) AS mean
      FROM named JOIN d USING (domain))
SELECT page_id, h AS host, p AS path, {_rule} AS rule,
       coalesce({_said}, CASE WHEN greatest(0, mean - {_z}
                * sqrt(mean * (1 - mean) / (total + 1))) >= {_max_bad}
                THEN 'block' ELSE 'allow' END) AS verdict
FROM v JOIN r ON r.host = v.h
"""

TOP_K = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))
         AS v, row_number() OVER () AS n
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.n <> q.n AND len(c.v) = len(q.v) AND q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)
            AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _add(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A parse (cost and audit as one string that sorts, repaired text) and an edit."""
    text = "" if line is None else f" || CASE WHEN {state}.r = '' THEN '' ELSE chr(10) END || {line}"
    return (f"CASE WHEN {state} IS NOT NULL THEN {{'k': lpad(CAST(CAST(left({state}.k, 9) AS BIGINT)"
            f" + {cost} AS VARCHAR), 9, '0') || substr({state}.k, 10) || '{letter}', "
            f"'r': {state}.r{text}}} END")


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _repair() -> str:
    """The cheapest repair as a recursion over turns: the best parse that has
    read nothing (e), a system turn (s), or ends in user (u) or assistant (a)."""
    # states after insertions: a user turn first, then perhaps an assistant's
    user = _least("d.u", *[_add(f"d.{x}", "5", "I", "'user:'") for x in "esa"])
    assistant = _least("h.a", _add("h.u", "5", "I", "'assistant:'"))
    own, given = "o.role || ':' || o.text", "CASE WHEN o.must THEN NULL ELSE {} END"

    def kept(state: str, initial: str) -> str:
        return given.format(f"CASE WHEN o.initial = '{initial}' THEN "
                            f"{_add(state, 'o.fine', 'K', own)} END")

    def renamed(state: str, role: str) -> str:
        return given.format(_add(state, "o.fine + 1", "R", f"'{role}:' || o.text"))

    step = {"e": _add("i.e", "2", "D"),
            "s": _least(_add("i.s", "2", "D"), kept("i.e", "s")),
            "u": _least(_add("i.u", "2", "D"), *[kept(f"i.{x}", "u") for x in "esa"],
                        *[renamed(f"i.{x}", "user") for x in "esa"]),
            "a": _least(_add("i.a", "2", "D"), kept("i.u", "a"), renamed("i.u", "assistant"))}
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
             || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 20 AS kind
  FROM conversations, crc),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
              ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12)
                                         || chr(13)) AS bare
  FROM rows_after),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS earlier FROM placed),
o AS (
  SELECT conv_id, turn, n, role, text, initial, earlier, bare = '' AS blank,
         bare <> '' AND again AS repeats,
         bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         bare = '' OR again AS must, CASE WHEN cut THEN 5 ELSE 0 END AS fine FROM seen),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (repeats) AS duplicate,
         count(*) FILTER (cut) AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au'))
           AS illegal, max(n) AS n
  FROM o GROUP BY conv_id),
d AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, {{'k': '000000000', 'r': ''}} AS e,
         CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR)) AS s,
         CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR)) AS u,
         CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR)) AS a FROM o
  UNION ALL
  SELECT o.conv_id, o.n, {step['e']}, {step['s']}, {step['u']}, {step['a']}
  FROM (SELECT h.conv_id, h.n, h.e, h.s, h.u, {assistant} AS a FROM
          (SELECT d.conv_id, d.n, d.e, d.s, {user} AS u, d.a FROM d) h) i
  JOIN o ON o.conv_id IS NOT DISTINCT FROM i.conv_id AND o.n = i.n + 1),
last AS (
  SELECT d.conv_id, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal,
         d.e, {user} AS u, d.a
  FROM d JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.n),
best AS (
  SELECT i.*, {_least('i.e', 'i.a', _add('i.u', '5', 'I', "'assistant:'"))} AS w FROM last i)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(left(w.k, 9) AS BIGINT), 0) AS cost,
       coalesce(substr(w.k, 10), '') AS audit, sha256(coalesce(w.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": CHAT,
    "op6_jaccard_join": JACCARD,
    "op8_url_filter": URLS,
    "op10_top_k": TOP_K,
    "op13_repair": _repair(),
}
