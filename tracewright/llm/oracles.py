"""DuckDB SQL for the text-pipeline queries that SQL can express on whole tables."""

from __future__ import annotations

from .secrets import _KEY_END, _KEY_HEAD, RULES, Rule

_KEYWORD = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + ")"


def _re2(pattern: str) -> str:
    """A rule's pattern for an engine whose case folding covers more than ASCII."""
    return pattern.replace("(?i:password|passwd|secret|token|api_?key)", _KEYWORD).replace("'", "''")


_BLANK = r"[\x20\x09-\x0D]"
_BREAK = rf"(?:{_BLANK}|\\[nrt])"
_BODY = rf"(?:{_BREAK}*(?:Proc-Type|DEK-Info|Comment|Version|X-[A-Za-z-]+):[^\r\n\\]*)*"
_LINES = rf"(?:{_BREAK}*[A-Za-z0-9+/]{{16,}}={{0,2}})+"
#: A private key without look-ahead: to its END line if that is the next line of dashes; else headers and lines of base64
#: with a short last one, whose end is told by what follows (the group, which is no part of it); else without a short one.
_KEY = rf"{_KEY_HEAD}(?:[^-]|-{{1,4}}[^-])*{_KEY_END}|{_KEY_HEAD}{_BODY}{_LINES}{_BREAK}+[A-Za-z0-9+/]{{1,15}}={{0,2}}([\x20\t]*[\\\r\n]|[\x20\t]+-----END|[\x20\t]*\z)|{_KEY_HEAD}{_BODY}(?:{_LINES})?"


def _hits(rank: int, rule: Rule) -> str:
    pattern = _KEY if rule.kind == "private_key" else _re2(rule.pattern)
    after = f"regexp_extract_all(t, '{pattern}', 1)" if rule.kind == "private_key" else "[]::VARCHAR[]"
    return f"SELECT rid, {rank} AS rank, '{rule.kind}' AS kind, '{_re2(rule.keep)}' AS keep, regexp_extract_all(t, '{pattern}') AS h, regexp_split_to_array(t, '{pattern}') AS p, {after} AS a FROM d WHERE regexp_matches(t, '{pattern}')"


_HITS = "\n  UNION ALL ".join(_hits(k, r) for k, r in enumerate(RULES))
_BASE = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({_HITS}),
flat AS (SELECT rid, rank, kind, keep, unnest(h) AS hit, unnest(p) AS pre, unnest(a) AS after, unnest(range(len(p))) AS i FROM hits),
placed AS (SELECT rid, rank, kind, keep, hit, length(coalesce(after, '')) AS cut, (sum(length(pre)) OVER w + coalesce(sum(length(hit)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM flat WINDOW w AS (PARTITION BY rid, rank ORDER BY i)),
kept AS (SELECT *, kind || ':' || s || ':' || (s + length(hit) - cut) AS span FROM placed WHERE hit IS NOT NULL AND regexp_full_match(hit, keep)),
said AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS x, string_agg(span, ',' ORDER BY s, rank) FILTER (kind IN ({_BASE})) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM kept GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN said USING (rid)
"""

CHATS = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
lists AS (SELECT conv_id, list(role || chr(1) || text ORDER BY turn) AS l FROM turns GROUP BY 1),
kinds AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies FROM lists GROUP BY l),
kept AS (SELECT conv_id, len(l) AS n_turns, copies FROM kinds a WHERE NOT EXISTS (SELECT 1 FROM kinds b WHERE b.l[1] = a.l[1] AND len(b.l) > len(a.l) AND b.l[:len(a.l)] = a.l)),
placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM turns)
SELECT conv_id, (pos - 1) // 512 AS segment, n_turns, copies, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) AS text FROM placed JOIN kept USING (conv_id) GROUP BY 1, 2, 3, 4
"""

JOIN = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(lower(t), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM d),
s AS (SELECT rid, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END)) AS g FROM w WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9 UNION SELECT a.rid, b.rid FROM d a JOIN d b ON a.t = b.t AND a.rid <> b.rid),
reach(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x AS rid, min(doc_id) AS class_id FROM reach JOIN d ON d.rid = y GROUP BY 1)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE x = d.rid) AS n_links FROM d JOIN least USING (rid)
"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p FROM n JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (t + 1)) // (total + v) AS q FROM (SELECT lang, term, sum(c) AS t FROM c GROUP BY 1, 2) JOIN (SELECT lang, sum(n) AS total FROM n GROUP BY 1) USING (lang) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN l USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

FILTERS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
least AS (SELECT t, min(doc_id) AS least FROM d GROUP BY 1),
said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
w AS (SELECT rid, doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS f FROM w JOIN least USING (t) LEFT JOIN said ON said.doc_id = w.doc_id),
m AS (SELECT part, f, string_split(f, '') AS fs, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, o[step] AS name, string_split(left(o, step - 1), '') AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
z AS (SELECT part, o, step, n, good, toxic, f, name, contains(f, name) AS fails, f <> '' AND step > 1 AND len(list_intersect(before, fs)) > 0 AS gone FROM m, s)
SELECT part, o AS filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (f = name), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(len(f), 1))) FILTER (fails), 0)::BIGINT AS shapley
FROM z GROUP BY 1, 2, 3
"""
