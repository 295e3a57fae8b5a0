"""Queries over validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import validation as V
from docloom.session import canonical_id, table


def _failures(s, d):
    return V.failures(*(table(s, d, n) for n in ("documents", "blocks", "chunks")))


def _split(s, d):
    docs = table(s, d, "documents").select(canonical_id(F.col("document_id")).alias("k"), canonical_id(F.col("split")).alias("split"), canonical_id(F.col("content_group_id")).alias("duplicate_group"))
    inv = table(s, d, "inventory")
    given = inv.select("source_document_id", canonical_id(F.col("canonical_document_id")).alias("k")).distinct().join(docs.where("split is not null"), "k").select("source_document_id", "duplicate_group", "split")
    return V.split_failures(inv, given).distinct()


QUERIES = {
    "validation_failures": _failures,
    "validation_report": lambda s, d: V.report(_failures(s, d)),
    "split_validation": _split,
}

_U = "upper(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_FAIL = f"""
d AS (SELECT {_U.format('document_id')} dk, min(length(text)) n, arg_min(text, length(text)) t FROM documents WHERE document_id IS NOT NULL GROUP BY 1),
b AS (SELECT *, {_U.format('document_id')} dk FROM blocks), c AS (SELECT *, {_U.format('document_id')} dk FROM chunks),
bd AS (SELECT b.*, d.n, d.dk IS NULL un FROM b LEFT JOIN d USING (dk) WHERE document_id IS NOT NULL), cd AS (SELECT c.*, d.n, d.t, d.dk IS NULL un FROM c LEFT JOIN d USING (dk) WHERE document_id IS NOT NULL),
rf AS (SELECT chunk_id, dk, {_U.format('x')} bk FROM (SELECT chunk_id, dk, unnest(block_ids) x FROM c) WHERE x IS NOT NULL),
kb AS (SELECT {_U.format('block_id')} bk, min(dk) o FROM b WHERE block_id IS NOT NULL GROUP BY 1),
f AS (
  SELECT 'document.id_missing' check_name, doc_id::VARCHAR record_id FROM documents WHERE document_id IS NULL OR trim(document_id) = ''
  UNION ALL SELECT 'document.file_type', document_id FROM documents WHERE upper(trim(file_type)) NOT IN ('HWP', 'PDF')
  UNION ALL SELECT 'document.text_length', document_id FROM documents WHERE length(text) <> n_chars
  UNION ALL SELECT 'block.block_type', block_id FROM b WHERE block_type NOT IN ('HEADING', 'PARAGRAPH', 'LIST', 'TABLE', 'REQUIREMENT', 'OTHER')
  UNION ALL SELECT 'block.sealed_split', block_id FROM b WHERE {_U.format('split')} = 'FINAL_HOLDOUT'
  UNION ALL SELECT 'chunk.sealed_split', chunk_id FROM c WHERE {_U.format('split')} = 'FINAL_HOLDOUT'
  UNION ALL SELECT 'block.span_negative', block_id FROM b WHERE char_start < 0 OR char_end < char_start
  UNION ALL SELECT 'chunk.span_grid', chunk_id FROM c WHERE char_start % 1000 <> 0 OR char_start <> chunk_index * 1000 OR char_end - char_start > 1200
  UNION ALL SELECT 'chunk.text_length', chunk_id FROM c WHERE length(text) <> char_end - char_start
  UNION ALL SELECT 'chunk.no_blocks', chunk_id FROM c WHERE coalesce(len(block_ids), 0) = 0
  UNION ALL SELECT 'chunk.page_order', chunk_id FROM c WHERE page_start > page_end
  UNION ALL SELECT 'document.id_repeated', {_U.format('document_id')} FROM documents WHERE document_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'block.id_repeated', {_U.format('block_id')} FROM b WHERE block_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'chunk.id_repeated', {_U.format('chunk_id')} FROM c WHERE chunk_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'block.document_unknown', block_id FROM bd WHERE un UNION ALL SELECT 'chunk.document_unknown', chunk_id FROM cd WHERE un
  UNION ALL SELECT 'block.span_outside', block_id FROM bd WHERE char_end > n UNION ALL SELECT 'chunk.span_outside', chunk_id FROM cd WHERE char_end > n
  UNION ALL SELECT 'chunk.span_text', chunk_id FROM cd WHERE char_end <= n AND substring(t, char_start + 1, char_end - char_start) <> text
  UNION ALL SELECT 'chunk.block_unknown', chunk_id FROM rf WHERE bk NOT IN (SELECT bk FROM kb)
  UNION ALL SELECT 'chunk.block_of_other_document', chunk_id FROM rf JOIN kb USING (bk) WHERE o <> dk
  UNION ALL SELECT 'chunk.index_gap', chunk_id FROM (SELECT chunk_id, chunk_index, lag(chunk_index) OVER (PARTITION BY dk ORDER BY chunk_index NULLS FIRST, chunk_id NULLS FIRST, ingested_at NULLS FIRST) p FROM c WHERE document_id IS NOT NULL) WHERE chunk_index - coalesce(p, -1) > 1)
"""

ORACLE = {
    "validation_failures": f"WITH {_FAIL} SELECT check_name, record_id FROM f",
    "validation_report": f"WITH {_FAIL}, n AS (SELECT unnest([{', '.join(repr(c) for c in V.CHECKS)}]) check_name), k AS (SELECT check_name, count(*) n FROM f GROUP BY 1) SELECT check_name, coalesce(k.n, 0) AS n_failures, k.n IS NULL AS passed FROM n LEFT JOIN k USING (check_name)",
    "split_validation": f"""
WITH d AS (SELECT {_U.format('document_id')} k, {_U.format('split')} s, {_U.format('content_group_id')} g FROM documents WHERE split IS NOT NULL),
i AS (SELECT DISTINCT source_document_id, {_U.format('canonical_document_id')} k FROM inventory), a AS (SELECT source_document_id, g, s FROM i JOIN d USING (k))
SELECT 'split.unassigned_source' AS check_name, source_document_id AS record_id FROM (SELECT DISTINCT source_document_id FROM inventory) WHERE source_document_id NOT IN (SELECT source_document_id FROM a)
UNION SELECT 'split.two_splits', source_document_id FROM a GROUP BY 2 HAVING count(DISTINCT s) > 1
UNION SELECT 'split.not_allowed', source_document_id FROM a WHERE s NOT IN ('DEV', 'REGRESSION', 'FINAL_HOLDOUT')
UNION SELECT 'split.leaking_group', g FROM a WHERE g IS NOT NULL GROUP BY 2 HAVING count(DISTINCT s) > 1""",
}
