"""DuckDB SQL for the operators whose results plain SQL can state: archives, near duplicates, passages, personal data."""

from __future__ import annotations

SPACE = r"'[\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {SPACE}), lambda x: x <> '')"


#: Base32 of the SHA-1: 160 bits as text, five at a time.
OP2_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT *, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(CAST(encode(h) AS BLOB)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, 5 * i + j, 1) AS INT) * CAST(pow(2, 5 - j) AS INT))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM b"""

OP8_SQL = f"""WITH d AS (SELECT doc_id, {words(LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (WITH RECURSIVE r AS (SELECT a AS node, a AS seen FROM sym UNION SELECT r.node, z.b FROM r JOIN sym z ON z.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON node = d.doc_id"""

OP9_SQL = f"""WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: array_to_string(w[i:i+49], ' '))) AS k FROM d WHERE len(w) >= 50),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM v) WHERE first < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM f),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT x.doc_id, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL), '') AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _located(kind: str, pattern: str) -> str:
    """Matches with code-point positions: lengths of the pieces up to them and of the matches before."""
    return f"""SELECT t, '{kind}' AS kind, k, hits[k] AS v, CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT t, pieces, hits, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT t, regexp_split_to_array(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS hits FROM u))"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INT)) // 10 + (2 * CAST(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INT)) % 10 ELSE CAST(substr({_DIGITS}, length({_DIGITS}) - i + 1, 1) AS INT) END)) % 10 = 0"
_CLEAN = r"regexp_replace({x}, '[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*', ' ', 'g')"
_TERMS = r"list_distinct(list_transform(regexp_extract_all({x}, '\p{{L}}{{3,}}'), lambda y: lower(y)))"
_JOIN = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a)"

OP10_SQL = f"""WITH u AS (SELECT coalesce(text, '') AS t, count(*) AS c FROM documents GROUP BY 1),
raw AS ({_located("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")} UNION ALL {_located("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")}
  UNION ALL {_located("card", r"[0-9](?:[\x20-]?[0-9])+")} UNION ALL {_located("phone", r"\+[0-9][\x20().0-9-]+[0-9]")}),
base AS (SELECT t, kind, v, a, a + length(v) AS b, list_position(['email', 'ip', 'card', 'phone'], kind) AS o FROM raw WHERE CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255)) = 0
  WHEN 'card' THEN length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN} ELSE length({_DIGITS}) BETWEEN 9 AND 15 END),
ent AS (SELECT DISTINCT t, unnest([kind || ':' || v, CASE kind WHEN 'email' THEN 'domain:' || lower(string_split(v, '@')[-1]) WHEN 'ip' THEN 'net:' || array_to_string(string_split(v, '.')[1:3], '.')
  WHEN 'card' THEN 'bin:' || left({_DIGITS}, 6) ELSE 'line:' || left({_DIGITS}, length({_DIGITS}) - 4) END]) AS value FROM base),
tok AS (SELECT t, c, unnest({_TERMS.format(x=_CLEAN.format(x="t"))}) AS term FROM u),
often AS (SELECT value FROM ent GROUP BY value HAVING count(*) >= 3),
pair AS (SELECT term, max(docs) AS with_value FROM (SELECT value, term, sum(c) AS docs FROM ent JOIN often USING (value) JOIN tok USING (t) GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
bad AS (SELECT term FROM tok JOIN pair USING (term) GROUP BY term HAVING sum(c) <= 2 * any_value(with_value)),
hit AS (SELECT t, list(term) AS own FROM tok WHERE term IN (SELECT term FROM bad) GROUP BY 1),
occ AS (SELECT t, 'term' AS kind, v, a, a + length(v) AS b, 5 AS o FROM ({_located("term", r"\p{L}{3,}").replace("FROM u", "FROM (SELECT t FROM hit)")}) JOIN hit USING (t) WHERE list_contains(own, lower(v))),
every AS (SELECT * FROM base UNION ALL SELECT * FROM occ WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.t = occ.t AND base.a < occ.b AND occ.a < base.b)),
g AS (SELECT t, count(*) FILTER (WHERE o = 1) AS n_email, count(*) FILTER (WHERE o = 2) AS n_ip, count(*) FILTER (WHERE o = 3) AS n_card, count(*) FILTER (WHERE o = 4) AS n_phone, {_JOIN} FILTER (WHERE o < 5) AS s, {_JOIN} AS spans FROM every GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(s, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g ON g.t = coalesce(text, '')"""
