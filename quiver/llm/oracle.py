"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from quiver.llm.common import LOWER, UPPER

NORMAL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP8 = """
WITH ok AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
          FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 20"""

OP9 = f"""
WITH n AS (SELECT doc_id, {NORMAL} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({NORMAL}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
hits AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM hits JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n"""

OP12 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({NORMAL}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
hits AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM hits JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n"""

OP13 = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
least AS (SELECT text, min(doc_id) AS id FROM t GROUP BY text),
marks AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
cells AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                        100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text),
                        regexp_matches(w.text, '[#$%&*|]'), w.doc_id > least.id] AS fails,
                 coalesce(q = 1, false) AS good, coalesce(x = 1, false) AS toxic, count(*) AS n
          FROM w JOIN least ON w.text = least.text LEFT JOIN marks ON marks.doc_id = w.doc_id GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
           WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders),
cases AS (SELECT cells.*, filter_order, list_transform(range(1, 6), lambda i: fails[ascii(substr(filter_order, i, 1)) - 64]) AS hit FROM cells, orders),
gone AS (SELECT *, CASE WHEN hit[1] THEN 1 WHEN hit[2] THEN 2 WHEN hit[3] THEN 3 WHEN hit[4] THEN 4 WHEN hit[5] THEN 5 ELSE 6 END AS stop FROM cases),
sums AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
                sum(CASE WHEN stop > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN stop = step THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN hit[step] AND stop < step THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN hit[step] AND len(list_filter(hit, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN stop = step AND good THEN n ELSE 0 END) AS good_lost,
                sum(CASE WHEN stop = step AND toxic THEN n ELSE 0 END) AS toxic_lost
         FROM gone JOIN steps USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM sums"""

SQL = {"op8_nearest": OP8, "op9_exact_dedup": OP9, "op10_near_dedup": OP10, "op12_ngram_join": OP12, "op13_filter_audit": OP13}
