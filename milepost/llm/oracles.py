"""DuckDB SQL for those queries that SQL can express over whole tables."""

WORDS = r"regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

OP4 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR),'') AS item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w),10) AS n, unnest([array_to_string(w[k:k+least(len(w),10)-1],' ') FOR k IN range(1, len(w)-least(len(w),10)+2)]) AS g FROM i WHERE len(w) > 0),
dw AS (SELECT rid, s.n AS n, unnest([{{'g': array_to_string(w[k:k+s.n-1],' '), 'k': k}} FOR k IN range(1, len(w)-s.n+2)], recursive := true) FROM d, (SELECT DISTINCT n FROM iw) s WHERE len(w) >= s.n),
hit AS (SELECT DISTINCT dw.rid, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
per AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS items FROM hit GROUP BY rid),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM hit)) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit,0) AS BIGINT) AS n_hit, CAST(coalesce(n_items,0) AS BIGINT) AS n_items,
       sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0) > 0 AS contaminated
FROM d LEFT JOIN per USING (rid) LEFT JOIN cov USING (rid)"""

OP5 = r"""
WITH p AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1),'') AS path FROM pages)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict,'allow') AS verdict
FROM (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path,'/en/') THEN {'rule':'www.example.com/en/','verdict':'allow'}
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path,'/en/') THEN {'rule':'example.com/en/','verdict':'block'}
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path,'/es/') THEN {'rule':'net/es/','verdict':'block'}
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path,'/fr/') THEN {'rule':'net/fr/','verdict':'block'}
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path,'/') THEN {'rule':'com/','verdict':'allow'} END AS r FROM p)"""

OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text,''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls,1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid"""

OP12 = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, row_number() OVER () AS r FROM v),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.l = c.l AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM n a JOIN n c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT DISTINCT r, anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, positive_id, positive_score ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score) WHERE rank <= 5"""



def _best_ways() -> str:
    """Values of the four states before a row as strings (cost in 8 digits, then the audit), from those behind it: a row's edits, then two inserts."""
    none, states, after = "99999999", range(4), (2, 2, 3, 2)
    led = lambda v, cost, letter: f"CASE WHEN {v} = '{none}' THEN '{none}' ELSE lpad(CAST(CAST({v}[1:8] AS INT) + {cost} AS VARCHAR), 8, '0') || '{letter}' || {v}[9:] END"
    late = "CAST(fault = 't' AS INT)"
    ways = []
    for q in states:
        keep = " ".join(f"WHEN left(role, 1) = '{c}' THEN {led(f'v{to}', late, 'K')}" for c, to in (("s", 1), ("u", 2), ("a", 3)) if to == after[q] or (q, to) == (0, 1))
        ways.append(f"least({led(f'v{q}', 3, 'D')}, CASE WHEN fault IN ('b', 'd') THEN '{none}' ELSE least({led(f'v{after[q]}', f'2 + {late}', 'R')}, CASE {keep} ELSE '{none}' END) END) AS v{q}")
    insert = ", ".join(f"least(v{q}, {led(f'v{after[q]}', 2, 'I')}) AS v{q}" for q in states)
    return f"SELECT g, i, {insert} FROM (SELECT g, i, {insert} FROM (SELECT f.g, f.i, {', '.join(ways)} FROM r JOIN f ON f.g = r.g AND f.i = r.i - 1))"


OP13 = rf"""
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM conversations, crc),
told AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE k <> 0),
o AS (SELECT g, turn, role, text, row_number() OVER w AS i, lag(role) OVER w AS before
  FROM told JOIN ids ON told.conv_id IS NOT DISTINCT FROM ids.conv_id WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS seen FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN seen THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE '' END AS fault FROM s),
n AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows FROM f GROUP BY g),
r AS (SELECT g, n_rows + 1 AS i, '00000000' AS v0, '00000004II' AS v1, '00000002I' AS v2, '00000000' AS v3 FROM n UNION ALL {_best_ways()}),
best AS (SELECT g, CAST(v0[1:8] AS BIGINT) AS cost, v0[9:] AS audit FROM r WHERE i = 1),
walk AS (SELECT g, 0 AS p, 0 AS i, 0 AS state, CAST(NULL AS VARCHAR) AS body FROM best UNION ALL
  SELECT g, p, i, CASE letter WHEN 'D' THEN state WHEN 'K' THEN CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END AS state,
    CASE WHEN letter = 'D' THEN body ELSE coalesce(body || chr(10), '') || CASE WHEN letter = 'K' THEN role WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END END AS body
  FROM (SELECT w.g, w.p, w.i, w.state, w.body, w.letter, f.role, f.text FROM (SELECT walk.g, p + 1 AS p, audit[p + 1] AS letter, i + CASE WHEN audit[p + 1] = 'I' THEN 0 ELSE 1 END AS i, state, body FROM walk JOIN best ON walk.g = best.g WHERE p < length(audit)) w LEFT JOIN f ON f.g = w.g AND f.i = w.i)),
done AS (SELECT walk.g, sha256(coalesce(body, '')) AS sha FROM walk JOIN best ON walk.g = best.g WHERE p = length(audit))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN n USING (g) LEFT JOIN best USING (g) LEFT JOIN done USING (g)"""

ORACLES = {"op3_top_k": OP3, "op4_decontaminate": OP4, "op5_url_filter": OP5, "op9_line_dedup": OP9, "op12_hard_negatives": OP12, "op13_conversation_repair": OP13}
