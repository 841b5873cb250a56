"""The queries of this subpackage, by name, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, merkle, topk
from .audit import op13_audit
from .bytebpe import op7_byte_bpe
from .embedding import op2_embedding
from .langid import op8_langid
from .linededup import op5_line_dedup
from .media import op10_media
from .merkle import op12_merkle
from .minhash import op1_minhash
from .mixing import op9_mixing
from .suffix import op4_suffix
from .tokenfile import op3_token_file
from .topk import op11_topk
from .toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_minhash, op2_embedding, op3_token_file, op4_suffix, op5_line_dedup, op6_toxicity, op7_byte_bpe, op8_langid, op9_mixing, op10_media, op11_topk, op12_merkle, op13_audit)
    return {f.__name__: f for f in every}


#: All pairs of vectors of a label, in double precision; paths go through a recursive closure of the links.
_OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, CAST(least(e.vec_id, coalesce(l.m, e.vec_id)) AS BIGINT) AS component_id,
       least(e.vec_id, coalesce(l.m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

#: Every pair of documents that share a shingle; words hold no blank, so joined by blanks they are told apart.
_OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS t FROM documents), s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(t[i:i + 3], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 2)) AS i FROM w WHERE len(t) >= 4)
    UNION ALL SELECT doc_id, array_to_string(t, ' ') FROM w WHERE len(t) BETWEEN 1 AND 3)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), half AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m, d.doc_id)) AS BIGINT) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

#: Classes of lines with equal sets, joined on the rarest words of either set, of which two that match share one.
_OP5 = f"""
WITH l AS (
  SELECT doc_id, i, list_sort(list_distinct({_WORDS})) AS t FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), c AS (SELECT t, min((doc_id, i)) AS f, row_number() OVER () AS id FROM l WHERE len(t) > 0 GROUP BY t),
e AS (SELECT id, len(t) AS n, unnest(t) AS word FROM c), freq AS (SELECT word, count(*) AS df FROM e GROUP BY 1),
p AS (SELECT id, word FROM e JOIN freq USING (word) QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, word) <= n - CAST(ceil(n * 80 / 100) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND a.id < b.id),
hit AS (
  SELECT CASE WHEN x.f > y.f THEN x.id ELSE y.id END AS id FROM cand JOIN c x ON x.id = a JOIN c y ON y.id = b
  WHERE 100 * least(len(x.t), len(y.t)) >= 80 * greatest(len(x.t), len(y.t))
    AND 100 * len(list_intersect(x.t, y.t)) >= 80 * (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))
), gone AS (
  SELECT doc_id, i FROM l JOIN c ON l.t = c.t WHERE (doc_id, i) <> f OR id IN (SELECT id FROM hit)
), parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL
), k AS (
  SELECT p.doc_id, string_agg(line, chr(10) ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS removed, count(*) AS n
  FROM parts p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY 1
)
SELECT d.doc_id, CAST(CASE WHEN coalesce(length(text), 0) > 0 THEN n ELSE 0 END AS BIGINT) AS n_lines, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN text IS NOT NULL THEN CAST(length(coalesce(kept, '')) AS BIGINT) END AS kept_chars, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The other queries rest on tokenizers, trained models and hashes that SQL can't run; they are tested against brute
    force in tests/llm."""
    return {"op1_minhash": _OP1, "op2_embedding": _OP2, "op5_line_dedup": _OP5, "op11_topk": topk.SQL, "op12_merkle": merkle.SQL, "op13_audit": audit.SQL}
