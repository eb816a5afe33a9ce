"""SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from figurant.llm import quality

_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REACH = """
reach(id, other) AS (SELECT id, id FROM ids UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)"""

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM again)),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word WHERE (doc_id, p) NOT IN (SELECT doc_id, p FROM gone) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
ids AS (SELECT doc_id AS id FROM d),{_REACH}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY 1) r ON r.id = d.doc_id
"""

OP6 = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
ids AS (SELECT vec_id AS id FROM v),{_REACH}
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.component_id, v.vec_id = r.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY 1) r ON r.id = v.vec_id
"""


def _without(runs: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{runs}', '', 'g'))"


def _distance(p: str, q: str) -> str:
    share = lambda a: f"list_transform({a}, lambda x: x / nullif(list_sum({a}), 0))"
    pairs = f"list_zip({share(p)}, {share(q)})"
    part = lambda k: f"CASE WHEN z[{k}] > 0 THEN z[{k}] * log2(z[{k}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform({pairs}, lambda z: ({part(1)} + {part(2)}) / 2))))"


_LISTS = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in quality.COMMON.items())
_K = 1 + max(map(len, quality.COMMON.values()))

OP2 = rf"""
WITH d AS (SELECT doc_id, lower(lang) AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORDS}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY 1),
c AS (SELECT w.*, coalesce(rep.n, 0) AS n_rep, len(w) AS n, length(t) AS chars, length(array_to_string(w, '')) AS letters, len(regexp_extract_all(t, '[#*$%&|<>]')) AS symbols,
  len(ls) - len(list_distinct(ls)) AS dups, {_without('[0-9]+')} AS digits, {_without('[A-Z]+')} AS caps, {_without("[.,;:!?''" + '"()-]+')} AS points, {_without('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]+')} AS wide,
  CASE lang {_LISTS} END AS common, list_transform(w, lambda x: lower(x)) AS lw FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
m AS (SELECT *, (n < {quality.BASE_WORDS} OR 100 * n_rep > {quality.BASE_REPEATED} * n) AS failed,
  list_transform([letters - symbols - digits - caps - points - wide, caps, digits, points, symbols, wide, chars - letters], lambda x: CAST(x AS DOUBLE)) AS cls,
  list_transform(common, lambda k: CAST(len(list_filter(lw, lambda x: x = k)) AS DOUBLE)) AS cnt FROM c),
h AS (SELECT *, CASE WHEN common IS NOT NULL THEN list_append(cnt, n - list_sum(cnt)) END AS com,
  common IS NOT NULL AND NOT failed AND chars >= {quality.MIN_CHARS} AND n >= {quality.MIN_WORDS} AS fit FROM m),
ref AS (SELECT lang AS l, [{', '.join(f'sum(cls[{i}])' for i in range(1, 8))}] AS rc, [{', '.join(f'sum(com[{i}])' for i in range(1, _K + 1))}] AS rw FROM h
  WHERE fit GROUP BY 1),
r AS (SELECT h.*, CASE WHEN fit THEN list_transform(list_zip(rc, cls), lambda z: z[1] - z[2]) ELSE rc END AS rc, CASE WHEN fit THEN list_transform(list_zip(rw, com), lambda z: z[1] - z[2]) ELSE rw END AS rw FROM h LEFT JOIN ref ON h.lang = ref.l),
j AS (SELECT r.*, CASE WHEN chars >= {quality.MIN_CHARS} THEN {_distance('cls', 'rc')} END AS dc, CASE WHEN n >= {quality.MIN_WORDS} THEN {_distance('com', 'rw')} END AS dw FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(letters AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines, CAST(n_rep AS BIGINT) AS n_repeat_words, failed AS base_failed,
  NOT failed AND coalesce(dc, 0) <= {quality.MAX_CHAR_DISTANCE} AND coalesce(dw, 0) <= {quality.MAX_WORD_DISTANCE} AS kept, round(dc, 4) AS char_distance, round(dw, 4) AS word_distance FROM j
"""

#: SHA-1 in base32: each hexadecimal digit as four bits, then each five bits as a letter.
OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS hex,
             max(page_id) OVER (PARTITION BY body) AS best FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr(
      '0000000100100011010001010110011110001001101010111100110111101111',
      4 * (strpos('0123456789abcdef', substr(hex, CAST(i AS INTEGER), 1)) - 1) + 1, 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER)
           + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER)
           + CAST(substr(bits, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM b
"""

ORACLE_SQL = {"op2_quality": OP2, "op4_substrings": OP4, "op5_jaccard": OP5, "op6_embeddings": OP6, "op10_warc": OP10}
