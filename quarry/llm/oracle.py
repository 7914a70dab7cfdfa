"""DuckDB SQL for the operators that SQL can express, written from their
definitions (tables hold each doc_id and page_id once)."""

from __future__ import annotations

from .bestposition import TOP
from .linededup import MIN_CHARS
from .qualityrules import METRICS, MIN_DOCS, MIN_WORDS
from .urlfilter import (DEFAULT, HREF, IS_CANONICAL, IS_REFRESH, LINK_TAG, META_TAG, OPAQUE, REFRESH_URL,
                        RULES, TRACKING, UPPER)

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SPLIT = r"[\x20\x09-\x0D]+"

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
g AS (SELECT key, min(doc_id) AS a FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, g.key IS NOT NULL AND k.doc_id <> g.a AS gone
      FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def _quality() -> str:
    per = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"),
           "repeats": ("n_repeat_words", "n_words"), "shouting": ("n_upper", "word_chars")}
    metrics = ", ".join(f"CAST(least(1000, 1000 * {a} // greatest(1, {b})) AS INT) AS {m}"
                        for m, (a, b) in per.items())
    values = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS metric, {m} AS value, {k} AS top, {g} AS guard "
        "FROM q WHERE NOT base_failed" for m, (k, g) in METRICS.items())

    def limits(name: str, by: str) -> str:
        cols = f"{by}, " if by else ""
        return f"""
{name}_r AS (SELECT {cols}metric, value, top, guard,
       row_number() OVER (PARTITION BY {cols}metric ORDER BY value) AS rn,
       count(*) OVER (PARTITION BY {cols}metric) AS n FROM v),
{name} AS (SELECT {cols}metric, any_value(n) AS docs,
       min(value) FILTER (rn * 2 >= n) AS mid, min(value) FILTER (rn * 100 >= n * top) - mid AS far,
       far + greatest(any_value(guard), far) AS spread FROM {name}_r GROUP BY {cols}metric)"""

    def ceilings(name: str, by: str) -> str:
        cols = f"{by}, " if by else ""
        return f"""
{name}_r AS (SELECT {cols}metric, spread, row_number() OVER (PARTITION BY {cols}metric ORDER BY spread) AS rn,
       count(*) OVER (PARTITION BY {cols}metric) AS n FROM s WHERE docs >= {MIN_DOCS}),
{name} AS (SELECT {cols}metric, min(spread) FILTER (rn * 2 >= n) * 3 // 2 AS cap
       FROM {name}_r GROUP BY {cols}metric)"""

    joins, cols, passed = "", "", ""
    for m in METRICS:
        joins += f"""
LEFT JOIN s AS s_{m} ON s_{m}.metric = '{m}' AND s_{m}.lang IS NOT DISTINCT FROM q.lang
      AND s_{m}.source IS NOT DISTINCT FROM q.source
LEFT JOIN l AS l_{m} ON l_{m}.metric = '{m}' AND l_{m}.lang IS NOT DISTINCT FROM q.lang
LEFT JOIN lc AS lc_{m} ON lc_{m}.metric = '{m}' AND lc_{m}.lang IS NOT DISTINCT FROM q.lang
LEFT JOIN a AS a_{m} ON a_{m}.metric = '{m}'
LEFT JOIN ac AS ac_{m} ON ac_{m}.metric = '{m}'"""
        lim = (f"CASE WHEN s_{m}.docs >= {MIN_DOCS} THEN s_{m}.mid + least(s_{m}.spread, lc_{m}.cap) "
               f"WHEN l_{m}.docs >= {MIN_DOCS} THEN l_{m}.mid + least(l_{m}.spread, lc_{m}.cap) "
               f"ELSE a_{m}.mid + least(a_{m}.spread, ac_{m}.cap) END")
        cols += f", q.{m}, CAST({lim} AS INT) AS max_{m}"
        passed += f" AND q.{m} <= coalesce({lim}, 1000)"
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '{SPLIT}'), lambda x: x <> '') AS ws FROM t),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM e
      WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words
        FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY doc_id),
b AS (SELECT t.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
      length(translate(text, {SPACES}, '')) AS word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
      length(text) - length(translate(text, '{UPPER}!', '')) AS n_upper,
      list_filter(string_split(text, chr(10)), lambda x: trim(x, {SPACES}) <> '') AS ls,
      coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM t JOIN w ON t.doc_id = w.doc_id LEFT JOIN rep ON t.doc_id = rep.doc_id),
c AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM b),
q AS (SELECT *, {metrics},
      n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS ({values}),{limits('s', 'lang, source')},{limits('l', 'lang')},{limits('a', '')},{ceilings('lc', 'lang')},{ceilings('ac', '')}
SELECT q.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed{passed} AS kept{cols}
FROM q{joins}"""


def _url() -> str:
    fits = ", ".join(
        "CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') "
        "THEN {{'len': {n}, 'allow': {a}, 'rule': '{r}'}} END".format(
            h=rule.partition("/")[0], p="/" + rule.partition("/")[2], n=len(rule),
            a=int(verdict == "allow"), r=rule) for verdict, rule in RULES)

    def rest(u: str) -> str:
        return f"CASE WHEN contains({u}, '://') THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"

    def form(u: str) -> str:
        r = rest(u)
        host = f"translate(regexp_extract({r}, '(?s)^[^/?#]*', 0), '{UPPER}', '{UPPER.lower()}')"
        path = f"regexp_extract({r}, '(?s)^[^/?#]*([^?#]*)', 1)"
        query = (f"array_to_string(list_filter(string_split(regexp_extract({r}, "
                 "'(?s)^[^?#]*\\?([^#]*)', 1), '&'), "
                 f"lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')), '&')")
        return (f"CASE WHEN {host} <> '' THEN regexp_replace({host}, '^(www|m)\\.', '') || "
                f"regexp_replace(regexp_replace({path}, '/+$', ''), '\\.html?$', '') || "
                f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END")

    quote = lambda s: s.replace("'", "''")
    links = " UNION ALL ".join(
        f"SELECT url, regexp_extract(tag, '{quote(x)}', 1) AS target FROM "
        f"(SELECT url, unnest(regexp_extract_all(html, '{quote(tag)}')) AS tag FROM u) "
        f"WHERE regexp_matches(tag, '{quote(kind)}')"
        for tag, kind, x in ((LINK_TAG, IS_CANONICAL, HREF), (META_TAG, IS_REFRESH, REFRESH_URL)))
    # segments of a path, the emptied ones ("." and what ".." takes back) dropped from the right
    folded = ("list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(parts, lambda x: [x])), "
              "lambda a, x: CASE x[1] WHEN '..' THEN a[1:len(a) - 1] WHEN '.' THEN a "
              "ELSE list_concat(a, x) END)")
    r = rest("url")
    return f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
found AS (SELECT url, target, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme,
          regexp_extract({r}, '(?s)^[^/?#]*', 0) AS base, regexp_extract({r}, '(?s)^[^/?#]*([^?#]*)', 1) AS own,
          regexp_extract(target, '(?s)^[^?#]*', 0) AS way, regexp_extract(target, '(?s)^[^?#]*(.*)$', 1) AS rest,
          regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') AS whole FROM ({links}) WHERE target <> ''),
split AS (SELECT *, string_split(substr(CASE WHEN starts_with(way, '/') THEN way ELSE
          coalesce(nullif(regexp_extract(own, '(?s)^.*/', 0), ''), '/') || way END, 2), '/') AS parts FROM found),
folded AS (SELECT *, {folded} AS stack FROM split),
links AS (SELECT {form('url')} AS a, {form('target')} AS b, target FROM (
          SELECT url, CASE WHEN whole THEN target WHEN NOT contains(url, '://') THEN NULL
          WHEN starts_with(target, '//') THEN scheme || ':' || target
          WHEN regexp_matches(target, '{OPAQUE}') THEN NULL
          WHEN way = '' THEN scheme || '://' || base || own || rest
          ELSE scheme || '://' || base || '/' || array_to_string(stack, '/') ||
               CASE WHEN parts[len(parts)] IN ('.', '..') AND len(stack) > 0 THEN '/' ELSE '' END || rest END
          AS target FROM folded) WHERE target IS NOT NULL),
sym AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM sym UNION
          SELECT reach.node, sym.b FROM reach JOIN sym ON reach.other = sym.a),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
p AS (SELECT page_id, {form('url')} AS node,
      translate(regexp_extract({r}, '(?s)^[^/?#]*', 0), '{UPPER}', '{UPPER.lower()}') AS host,
      regexp_extract({r}, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT p.*, coalesce(root, p.node) AS alias_class, list_max([{fits}]) AS own
      FROM p LEFT JOIN root ON p.node = root.node),
ends AS (SELECT b AS node, translate(regexp_extract({rest('target')}, '(?s)^[^/?#]*', 0),
         '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract({rest('target')}, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM links WHERE b IS NOT NULL),
said AS (SELECT alias_class, own.allow AS allow FROM f WHERE own IS NOT NULL UNION ALL
         SELECT coalesce(root, ends.node), list_max([{fits}]).allow FROM ends LEFT JOIN root ON ends.node = root.node),
d AS (SELECT alias_class, max(allow) AS allow FROM said WHERE alias_class IS NOT NULL GROUP BY alias_class)
SELECT page_id, host, path, own.rule AS rule,
       CASE coalesce(own.allow, d.allow, {int(DEFAULT == 'allow')})
       WHEN 1 THEN 'allow' ELSE 'block' END AS verdict, f.alias_class
FROM f LEFT JOIN d ON f.alias_class = d.alias_class"""


SEARCH = rf"""
WITH lowered AS (SELECT row_number() OVER () AS r, doc_id,
       regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT r, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM lowered WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, unnest(ts) AS term FROM d),
c AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM p
      WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM c, s GROUP BY term),
x AS (SELECT r, doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))
      AS impact FROM c JOIN w ON c.term = w.term, s),
g AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(impact) AS BIGINT) AS score
      FROM i JOIN x ON i.term = x.term GROUP BY item_id, r HAVING sum(impact) > 0),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
      AS INT) AS rank, doc_id, score FROM g)
SELECT * FROM o WHERE rank <= {TOP}"""

# Forward: the least (cost, audit) of every state after every row.  "due" is
# the role that a state asks for next: 0 nothing yet, 1 after s, 2 after u,
# 3 after a.
REPAIR = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
       lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
key AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
        FROM conversations),
crc AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''),
            lambda x: CAST(ord(x) AS BIGINT))),
            lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 AS kind FROM key, tab),
hit AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
conv AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role,
           md5(role || chr(0) || text)) AS i
           FROM hit JOIN conv ON hit.conv_id IS NOT DISTINCT FROM conv.conv_id),
solid AS (SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail,
          row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, left(role, 1) AS initial,
          lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM placed),
rows AS (SELECT *, tail = '' AS blank, tail <> '' AND again AS dup,
         tail <> '' AND NOT again AND tail NOT IN ('.', '!', '?') AS trunc FROM solid),
facts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
          count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
          count(*) FILTER (trunc) AS truncated, max(i) AS size,
          count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
          FROM rows GROUP BY c),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
        (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
        (3, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']),
        (1, 3, 4, 'II', ['user:', 'assistant:'])) AS v(a, b, cost, audit, lines)),
state AS (
  SELECT c, CAST(0 AS BIGINT) AS i, {'cost': CAST(0 AS BIGINT), 'audit': '',
         'lines': CAST([] AS VARCHAR[])} AS best, 0 AS s FROM conv
  UNION ALL
  SELECT c, i, min(best) AS best, s FROM (
    SELECT state.c, rows.i AS i, e.s AS s, {'cost': best.cost + ins.cost + e.cost,
           'audit': best.audit || ins.audit || e.audit,
           'lines': list_concat(list_concat(best.lines, ins.lines), e.lines)} AS best
    FROM state JOIN rows ON rows.c = state.c AND rows.i = state.i + 1 JOIN ins ON ins.a = state.s,
    LATERAL (SELECT unnest([
      {'s': ins.b, 'cost': 3, 'audit': 'D', 'lines': CAST([] AS VARCHAR[])},
      CASE WHEN NOT blank AND NOT dup AND initial = 's' AND ins.b = 0 THEN
        {'s': 1, 'cost': CAST(trunc AS INT), 'audit': 'K', 'lines': [role || ':' || text]}
      WHEN NOT blank AND NOT dup AND initial = CASE ins.b WHEN 2 THEN 'a' ELSE 'u' END THEN
        {'s': CASE ins.b WHEN 2 THEN 3 ELSE 2 END, 'cost': CAST(trunc AS INT), 'audit': 'K',
         'lines': [role || ':' || text]} END,
      CASE WHEN NOT blank AND NOT dup THEN
        {'s': CASE ins.b WHEN 2 THEN 3 ELSE 2 END, 'cost': 2 + CAST(trunc AS INT), 'audit': 'R',
         'lines': [CASE ins.b WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || text]} END
    ]) AS e) WHERE e IS NOT NULL) GROUP BY c, i, s),
fin AS (SELECT state.c, min({'cost': best.cost + ins.cost, 'audit': best.audit || ins.audit,
        'lines': list_concat(best.lines, ins.lines)}) AS best
        FROM state JOIN ins ON ins.a = state.s LEFT JOIN facts ON facts.c = state.c
        WHERE ins.b IN (0, 3) AND state.i = coalesce(facts.size, 0) GROUP BY state.c)
SELECT conv.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
       sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM conv LEFT JOIN facts ON facts.c = conv.c JOIN fin ON fin.c = conv.c"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _quality(), "op5_line_dedup": LINE_DEDUP, "op10_url_filters": _url(),
            "op11_conversation_repair": REPAIR, "op12_ranked_search": SEARCH}
