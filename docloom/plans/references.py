"""Queries of problem 6: orphan references."""

from __future__ import annotations

from docloom.operators.references import orphan_references, orphan_report
from docloom.session import table


def _orphans(spark, d):
    return orphan_references(table(spark, d, "documents"), table(spark, d, "blocks"), table(spark, d, "chunks"))


QUERIES = {
    "p6_found": lambda s, d: _orphans(s, d).drop("month"),
    "p6_report": lambda s, d: orphan_report(_orphans(s, d)),
}

_ORPHANS = r"""
WITH b AS (SELECT upper(trim(block_id)) k, arg_min(block_id, (coalesce(ingested_at, timestamp '9999-01-01'), block_id)) record_id,
                  arg_min({'v': document_id}, (coalesce(ingested_at, timestamp '9999-01-01'), block_id)).v document_id, min(ingested_at) at_, bool_or(deleted_at IS NOT NULL) gone
           FROM blocks WHERE block_id IS NOT NULL GROUP BY 1),
c AS (SELECT upper(trim(chunk_id)) k, arg_min(chunk_id, (coalesce(ingested_at, timestamp '9999-01-01'), chunk_id)) record_id,
             arg_min({'v': document_id}, (coalesce(ingested_at, timestamp '9999-01-01'), chunk_id)).v document_id,
             arg_min({'v': block_ids}, (coalesce(ingested_at, timestamp '9999-01-01'), chunk_id)).v block_ids,
             min(ingested_at) at_, bool_or(deleted_at IS NOT NULL) gone
      FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
d AS (SELECT upper(trim(document_id)) k, min(ingested_at) at_, bool_or(deleted_at IS NOT NULL) gone FROM documents WHERE document_id IS NOT NULL GROUP BY 1),
r AS (SELECT 'blocks' table_name, record_id, 'document_id' ref_field, upper(trim(document_id)) ref_id, at_ FROM b WHERE NOT gone
      UNION ALL SELECT 'chunks', record_id, 'document_id', upper(trim(document_id)), at_ FROM c WHERE NOT gone
      UNION ALL SELECT DISTINCT 'chunks', record_id, 'block_ids', upper(trim(x)), at_ FROM (SELECT record_id, unnest(block_ids) x, at_ FROM c WHERE NOT gone)),
p AS (SELECT 'document_id' f, * FROM d UNION ALL SELECT 'block_ids', k, at_, gone FROM b),
o AS (SELECT table_name, record_id, ref_field, ref_id, r.at_ ref_at,
             CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.at_ > r.at_ THEN 'late' END ref_state
      FROM r LEFT JOIN p ON p.f = r.ref_field AND p.k = r.ref_id WHERE ref_id IS NOT NULL)
"""

ORACLE = {
    "p6_found": _ORPHANS + "SELECT table_name, record_id, ref_field, ref_id, ref_state FROM o WHERE ref_state IS NOT NULL",
    "p6_report": _ORPHANS + "SELECT table_name, ref_field, ref_state, strftime(ref_at, '%Y-%m') AS month, count(*) AS n_orphans FROM o WHERE ref_state IS NOT NULL GROUP BY ALL",
}
