"""DuckDB SQL for the rows of the registered queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY 1, 2),
tot AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY 1),
i2 AS (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1),
f2 AS (SELECT lang, w[i] AS x, w[i+1] AS y, count(*) AS f FROM i2 GROUP BY 1, 2, 3 HAVING count(*) >= 10),
i3 AS (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
f3 AS (SELECT lang, w[i] AS x, w[i+1] AS y, w[i+2] AS z, count(*) AS f FROM i3 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
longest AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY 1, 2, 3),
cuts AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y
    LEFT JOIN longest o ON o.lang = c.lang AND o.x = c.x AND o.y = c.y
  WHERE coalesce(100 * o.f < 50 * c.f, TRUE)
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 1, l.f, r.f
  FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, l.f, r.f
  FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 r ON r.lang = c.lang AND r.x = c.z),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM one JOIN tot USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY 1),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def llm_oracles() -> dict[str, str]:
    return {"op11_phrase_collocations": COLLOCATIONS, "op12_embedding_dedup": EMBEDDINGS}
