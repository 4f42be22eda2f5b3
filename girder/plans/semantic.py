"""Near-duplicates by direction among the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.semantic import near_duplicates
from ..registry import Tables, query


def folded(threshold: float) -> str:
    """Rows in order of id, one by one: each stays if none that stayed before is near."""
    return f"""WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings),
    near AS (SELECT a.k, list(b.k) AS js FROM u a JOIN u b ON b.k < a.k AND list_cosine_similarity(a.e, b.e) >= {threshold} GROUP BY a.k),
    f AS (SELECT 0::BIGINT AS k, true AS kept, []::BIGINT[] AS stays UNION ALL
      SELECT f.k + 1, NOT list_has_any(f.stays, coalesce(n.js, [])), CASE WHEN list_has_any(f.stays, coalesce(n.js, [])) THEN f.stays ELSE list_append(f.stays, f.k + 1) END
      FROM f LEFT JOIN near n ON n.k = f.k + 1 WHERE f.k < (SELECT count(*) FROM u))
    SELECT vec_id, kept FROM f JOIN u USING (k)"""


@query("semantic_near_duplicates", folded(0.85))
def semantic_near_duplicates(t: Tables) -> DataFrame:
    """What stays of the embeddings at a cosine of 0.85."""
    return near_duplicates(t.embeddings, 0.85)


@query("semantic_leaders", folded(0.35))
def semantic_leaders(t: Tables) -> DataFrame:
    """The same at a cosine at which unlike texts hang together, so that most rows depend on others before them."""
    return near_duplicates(t.embeddings, 0.35)
