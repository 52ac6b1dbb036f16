"""DuckDB SQL for the queries that SQL can express, written from the contracts alone:
exact counts in place of sketches, running sums in place of histograms."""

from __future__ import annotations

from tidewater.llm import linespread, mixing, termaudit, urltree

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op2() -> str:
    marks = " + ".join(f"(length({{0}}) - length(replace({{0}}, {m}, ''))) // {n}" for m, n in (("'\\'", 1), ("'###'", 3), ("'</turn>'", 7)))
    role = marks.format("role") + " + (length(role) - length(replace(role, ':', '')))"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + {role} + 2 + length(text) + {marks.format('text')} + 9)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


def op5() -> str:
    line = "trim({}, ' ' || chr(9) || chr(13))"
    return f"""
WITH d AS (SELECT doc_id, text, coalesce(text, '') AS body, '=' || source AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
texts AS (SELECT body, min(coalesce(site, '')) AS site FROM d GROUP BY body),
occ AS (SELECT DISTINCT {line.format('u.line')} AS line, site FROM texts, unnest(string_split(body, chr(10))) AS u(line)),
boiler AS (SELECT list(line) AS all_lines FROM (SELECT line FROM occ WHERE line <> '' GROUP BY line HAVING count(*) >= {linespread.MIN_SITES})),
k AS (SELECT d.*, [x FOR x IN lines IF {line.format('x')} = '' OR NOT list_contains(coalesce(all_lines, []), {line.format('x')})] AS kept FROM d, boiler),
r AS (SELECT doc_id, lines, kept, array_to_string(kept, chr(10)) AS result FROM k)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_removed,
  length(result)::BIGINT AS kept_chars, sha256(result) AS kept_sha256 FROM r"""


def op6() -> str:
    w = mixing.WEIGHTS
    weight = f"[{', '.join(map(str, w))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(w)} + 1]"
    cap, slots = mixing.MAX_REPEAT, mixing.SLOTS
    sql = f"""
WITH light AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 5) AS INTEGER) AS slot FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM light GROUP BY source),
ws AS (SELECT *, {weight} AS w FROM src),
o AS (SELECT *, ({cap} * source_size)::DOUBLE / w AS ratio FROM ws),
l AS (SELECT *, ((SELECT sum(source_size) FROM src)
    - coalesce(sum({cap} * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
lv AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio > level),
t AS (SELECT source, source_size, CASE WHEN l.ratio > l.level THEN w * lv.level ELSE ({cap} * source_size)::DOUBLE END AS target FROM l LEFT JOIN lv ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {cap}) ELSE 0 END::BIGINT AS passes FROM t),
s0 AS (SELECT *, floor(target - passes * source_size)::BIGINT AS d FROM p),
d0 AS (SELECT *, false AS extra FROM light)"""
    for i in range(mixing.ROUNDS):
        sql += f""",
c{i} AS (SELECT a.source, slot, s.d, sum(sum(size)) OVER (PARTITION BY a.source ORDER BY slot) AS c
  FROM d{i} a JOIN s{i} s ON a.source IS NOT DISTINCT FROM s.source
  WHERE NOT extra AND size > 0 AND size <= s.d GROUP BY a.source, slot, s.d),
f{i} AS (SELECT source, coalesce(min(slot) FILTER (c > d), {slots}) AS cut, coalesce(max(c) FILTER (c <= d), 0)::BIGINT AS got FROM c{i} GROUP BY source),
d{i + 1} AS (SELECT a.* REPLACE (extra OR (size > 0 AND size <= s.d AND slot < coalesce(cut, 0)) AS extra)
  FROM d{i} a JOIN s{i} s ON a.source IS NOT DISTINCT FROM s.source LEFT JOIN f{i} f ON a.source IS NOT DISTINCT FROM f.source),
s{i + 1} AS (SELECT s.* REPLACE (d - coalesce(got, 0) AS d) FROM s{i} s LEFT JOIN f{i} f ON s.source IS NOT DISTINCT FROM f.source)"""
    n = mixing.ROUNDS
    return sql + f"""
SELECT doc_id, size, source_size, target, size * (passes + extra::BIGINT) AS taken
FROM d{n} a JOIN s{n} s ON a.source IS NOT DISTINCT FROM s.source"""


def op7() -> str:
    def segment(i):
        s = f"coalesce(string_split(path, '/')[{i}], '')"
        return f"CASE WHEN regexp_matches({s}, '{urltree._VARIABLE}') THEN '*' ELSE {s} END"

    def merge(src, level, parent, out):
        z = ("abs(k.bad / greatest(k.n, 1) - u.bad / greatest(u.n, 1)) / sqrt((u.bad / greatest(u.n, 1) * "
             "(1 - u.bad / greatest(u.n, 1)) + 1e-9) / greatest(k.n, 1))")
        kids = f"""(SELECT k.*, k.n > 0 AND {z} > {urltree.MERGE_Z} AS alone
  FROM (SELECT {parent}, {level}, sum(n) AS n, sum(bad) AS bad FROM {src} GROUP BY {parent}, {level}) k
  JOIN (SELECT {parent}, sum(n) AS n, sum(bad) AS bad FROM {src} GROUP BY {parent}) u USING ({parent}))"""
        return f"""(SELECT a.*, CASE WHEN k.alone THEN {level}
    WHEN k.n > 0 AND r.kids > 1 AND (r.sq - r.bad * r.bad / r.n) / nullif(r.bad / r.n * (1 - r.bad / r.n), 0) - (r.kids - 1)
      > {urltree.MERGE_Z} * sqrt(2.0 * (r.kids - 1)) THEN CASE WHEN k.bad / k.n >= r.bad / r.n THEN '~+' ELSE '~-' END
    ELSE '~' END AS {out}
  FROM {src} a JOIN {kids} k USING ({parent}, {level})
  LEFT JOIN (SELECT {parent}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*) AS kids, sum(bad * bad / n) AS sq
    FROM {kids} WHERE NOT alone AND n > 0 GROUP BY {parent}) r USING ({parent}))"""

    def share(keys, prior, parent=None):
        smooth = f"((sum(bad) OVER (PARTITION BY {keys}) + {urltree.PRIOR}::DOUBLE * {prior}) / (sum(n) OVER (PARTITION BY {keys}) + {urltree.PRIOR}::DOUBLE))"
        return smooth if parent is None else (
            f"CASE WHEN sum(n) OVER (PARTITION BY {keys}) = sum(n) OVER (PARTITION BY {parent}) THEN {prior} ELSE {smooth} END")
    fits, verdicts = [], []
    for text, decision in sorted(urltree.RULES, key=lambda r: (-len(r[0]), r[0])):
        name, _, prefix = text.partition("/")
        when = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{prefix}') THEN"
        fits.append(f"{when} '{text}'")
        verdicts.append(f"{when} '{decision}'")
    return f"""
WITH seen AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
p AS (SELECT *, {segment(2)} AS s1, CASE WHEN len(string_split(path, '/')) > 3 THEN '**' ELSE {segment(3)} END AS s2 FROM u),
leaves AS (SELECT host, s1, s2, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN seen ON page_id = doc_id GROUP BY host, s1, s2),
t2 AS {merge('leaves', 's1', 'host', 'b1')},
t4 AS {merge('t2', 's2', 'host, b1', 'b2')},
g AS (SELECT coalesce(sum(bad), 0) / greatest(coalesce(sum(n), 0), 1) AS share FROM t4),
q0 AS (SELECT t4.*, {share('host', '(SELECT share FROM g)')} AS p0 FROM t4),
q1 AS (SELECT *, {share('host, b1', 'p0', 'host')} AS p1 FROM q0),
q2 AS (SELECT *, {share('host, b1, b2', 'p1', 'host, b1')} AS purity FROM q1)
SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule,
  CASE {' '.join(verdicts)} WHEN purity >= {urltree.BLOCK_AT} THEN 'block' ELSE 'allow' END AS verdict
FROM p JOIN q2 USING (host, s1, s2)"""


def op10() -> str:
    def words(text):
        return (f"[x FOR x IN string_split_regex(translate(coalesce({text}, ''), {_AZ}), "
                "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF x <> '']")
    return f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {words('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {words('text')} AS w FROM documents),
g AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
h AS (SELECT doc_id, i, g.k, item FROM g JOIN win USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


def op12() -> str:
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    step = "list_reduce(range(8), lambda x, i: " + bit + ", xor(acc, b))"
    crc = ("xor(list_reduce([ord(ch)::BIGINT FOR ch IN string_split(conv_id::VARCHAR, '')], "
           f"lambda acc, b: {step}, 4294967295::BIGINT), 4294967295)")
    return f"""
WITH t AS (SELECT conv_id, list(md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))
      || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::VARCHAR
    ORDER BY turn NULLS FIRST, role, text) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, ({crc} % 4)::INTEGER AS h FROM t),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
n AS (SELECT array_to_string(turns[1:depth], ',') AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(CASE WHEN depth > 0 THEN array_to_string(turns[1:depth - 1], ',') END) AS parent,
    any_value(turns[1:depth]) AS turns,
    any_value(CASE WHEN depth > 0 THEN string_split(turns[depth], ':')[2]::BIGINT ELSE 0 END) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM m GROUP BY node, depth),
k AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent, n.depth),
e AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.parent AND n.depth = k.depth),
up AS (SELECT array_to_string(turns[1:d], ',') AS upper, d, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM e) GROUP BY upper, d)
SELECT e.conv_id, e.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, e.ends_sha256
FROM e JOIN up ON e.node = up.upper AND e.depth = up.d LEFT JOIN n p ON e.parent = p.node AND p.depth = e.depth - 1"""


def op13() -> str:
    p = "(1 + (1000000000::HUGEINT * (coalesce({n}, 0) + 2)) // ({total} + 2 * v))"
    score = "((({p}) - ({q})) * (({p}) - ({q}))) // (({p}) + ({q}))"
    return f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
    regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
occ AS (SELECT lang, source, i, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT i) >= {termaudit.MIN_DOCS}),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM occ JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT a.lang, a.source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = a.lang AND c.source = a.source), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN vs USING (lang)),
s AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {p.format(n='c.n', total='total')} AS p
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
l AS (SELECT lang, term, {p.format(n='n', total='total')} AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN (SELECT lang, v, sum(total) AS total FROM g GROUP BY lang, v) USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum({score.format(p='a.p', q='b.p')}) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, ({score.format(p='p', q='q')})::BIGINT AS value
  FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {termaudit.TOP}"""
