"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from .bpe import op7_bpe
from .html_extract import op4_html
from .near_dedup import op9_near_dedup
from .packing import op2_packing
from .quality_model import op6_quality
from .quality_rules import op8_quality_rules
from .secrets import op3_secrets
from .substring_dedup import op10_substring_dedup
from .topk_search import op1_topk
from .warc import op5_warc

QUERIES = {
    "op1_topk": op1_topk,
    "op6_quality": op6_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op4_html": op4_html,
    "op5_warc": op5_warc,
    "op3_secrets": op3_secrets,
    "op2_packing": op2_packing,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
}

#: Words of ASCII-lower-cased texts; null texts have none.
WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

#: What DuckDB needs to give the same rows; the other operators are tested against brute force, libraries or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_topk": f"""WITH w AS (SELECT doc_id, trim(unnest({WORDS}), '.,;:!?"''()[]{{}}') AS term FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS n FROM w WHERE term <> '' GROUP BY ALL),
size AS (SELECT doc_id, sum(n) AS len FROM tf GROUP BY doc_id),
docs AS (SELECT count(*) AS n, (SELECT sum(len) FROM size) / count(*) AS mean FROM documents WHERE doc_id IS NOT NULL),
idf AS (SELECT term, ln(1 + (docs.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, docs GROUP BY term, docs.n),
part AS (SELECT term, doc_id, idf * tf.n * 2.2 / (tf.n + 1.2 * (0.25 + 0.75 * len / mean)) AS x FROM tf JOIN size USING (doc_id) JOIN idf USING (term), docs),
score AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(q.n * p.x), 6) AS score FROM tf q JOIN part p USING (term) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM score)
SELECT query_id, CAST(k AS INT) AS rank, doc_id, score FROM ranked WHERE k <= 10""",
    "op5_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS winner FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to FROM m""",
    "op9_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.doc_id WHERE r.c < e.y),
least AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id),
every AS (SELECT doc_id, min(c) AS c FROM (SELECT doc_id, c FROM least UNION ALL SELECT e.x, l.c FROM edges e JOIN least l ON l.doc_id = e.y) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(every.c, d.doc_id) AS component_id, d.doc_id = coalesce(every.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN every USING (doc_id)""",
}
