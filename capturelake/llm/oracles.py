"""SQL that states by brute force what two operators must find: every window, every pair that shares a shingle."""

from __future__ import annotations

from capturelake.llm.decontam import SIMILARITY as LEAK
from capturelake.llm.neardup import SIMILARITY as NEAR

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_SHINGLES} AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
s AS (SELECT doc_id, unnest(g) AS g, unnest(range(len(g))) AS pos FROM d),
i AS (SELECT item_id, {_SHINGLES} AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL)),
c AS (SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest(g) AS g FROM i) GROUP BY ALL),
k AS (SELECT item_id, len(g) AS size FROM i),
h AS (SELECT s.doc_id, c.item_id, k.size, s.pos FROM s JOIN c ON s.g = c.g JOIN k ON k.item_id = c.item_id),
v AS (SELECT DISTINCT doc_id, item_id, size, unnest(range(greatest(pos - size + 1, 0), pos + 1)) AS start FROM h),
w AS (SELECT v.* FROM v JOIN d ON d.doc_id = v.doc_id WHERE start + size <= len(d.g)),
x AS (SELECT w.doc_id, w.item_id, w.size, w.start, s.g, count(*) AS n FROM w JOIN s ON s.doc_id = w.doc_id AND s.pos BETWEEN w.start AND w.start + w.size - 1 GROUP BY ALL),
y AS (SELECT x.doc_id, x.item_id, x.size, x.start, CAST(sum(least(x.n, c.n)) AS BIGINT) AS common FROM x JOIN c ON c.item_id = x.item_id AND c.g = x.g GROUP BY ALL),
z AS (SELECT *, common / (2 * size - common) AS similarity FROM y)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS first_word, similarity FROM z WHERE similarity >= {LEAK}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLES} AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL)),
c AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(g) AS g FROM d) GROUP BY ALL),
t AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, CAST(sum(least(a.n, b.n)) AS BIGINT) AS common FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE common / (x.total + y.total - common) >= {NEAR}),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT u.b AS doc_id, r.root FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY ALL)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM m
"""
