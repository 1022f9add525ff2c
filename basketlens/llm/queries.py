"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark import cloudpickle

import basketlens

from .align import op12_cross_tokenizer
from .exact import op11_exact_dedup
from .fingerprints import op3_fingerprints
from .html_text import op1_html_extraction
from .infill import op13_fill_in_middle
from .mixing import op2_source_mixing
from .near_join import op9_jaccard_join
from .neighbours import op4_nearest_neighbours
from .pieces import op5_sentencepiece
from .pii import op6_pii_surrogates
from .quality import op10_quality
from .secrets import op8_secret_scan
from .toxicity import op7_toxicity

# Functions that run on executors travel by value.
cloudpickle.register_pickle_by_value(basketlens)

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_source_mixing": op2_source_mixing,
    "op3_fingerprints": op3_fingerprints,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality": op10_quality,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE: dict[str, str] = {
    "op4_nearest_neighbours": r"""
WITH parts AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS dim
  FROM embeddings WHERE vec_id IS NOT NULL),
fit AS (
  SELECT vec_id, any_value(dim) AS dim FROM parts GROUP BY vec_id
  HAVING count(x) = any_value(dim) AND bool_and(isfinite(x)) AND max(abs(x)) > 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum((q.x * c.x * pow(2::DOUBLE, 100))::HUGEINT)::DOUBLE / pow(2::DOUBLE, 100) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.dim = c.dim AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0 AND q.vec_id IN (SELECT vec_id FROM fit) AND c.vec_id IN (SELECT vec_id FROM fit)
  GROUP BY q.vec_id, c.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    # Pairs of equal size classes meet on a common shingle; components by the
    # smallest reachable id.
    "op9_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
lowest AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN lowest USING (doc_id)""",
    "op11_exact_dedup": r"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op13_fill_in_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::UBIGINT % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100 THEN 'plain'
         WHEN ('0x' || h[25:32])::UBIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(list_slice(u, 1, least(x, y)::BIGINT), ''), '') AS p,
    coalesce(array_to_string(list_slice(u, least(x, y)::BIGINT + 1, greatest(x, y)::BIGINT), ''), '') AS m,
    coalesce(array_to_string(list_slice(u, greatest(x, y)::BIGINT + 1, n), ''), '') AS s
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts""",
}
