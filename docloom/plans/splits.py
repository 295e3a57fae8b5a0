"""Queries over splits of sources: allocation, frozen mapping, combined and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import splits as S
from docloom.operators import validation as V
from docloom.operators.inventory import config_from
from docloom.plans.inventory import _ID
from docloom.plans.validation import ORACLE as _CHECKED
from docloom.plans.validation import QUERIES as _CHECKS
from docloom.session import table

t = table


def _invariants(s, d):
    """What an allocation must keep: every source once, components whole, shares within one largest component."""
    config = config_from(t(s, d, "custom_split"))
    inv = t(s, d, "inventory")
    a = S.written(S.assign_splits(inv, config), "assigned")
    torn = a.groupBy("component").agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("n_torn"))
    widest = a.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n").alias("widest"))
    off = S.target_report(a, config).agg(F.max(F.abs("difference")).alias("off"))
    one = a.agg(F.count("*").alias("n_sources"), F.countDistinct("source_document_id").alias("n_distinct"), F.countDistinct("component").alias("n_components"), F.countDistinct("split").alias("n_splits"))
    return one.crossJoin(F.broadcast(torn)).crossJoin(F.broadcast(widest)).crossJoin(F.broadcast(off)).select(
        "n_sources", "n_distinct", "n_components", "n_splits", "n_torn", (F.col("off") <= F.col("widest")).alias("shares_near"))


def _mapping(s, d):
    """The documents' split as frozen mapping of the sources."""
    docs = t(s, d, "documents").where("document_id is not null")
    return docs.select(F.lit(None).cast("string").alias("source_document_id"), F.col("document_id").alias("canonical_document_id"), "split")


def _combined(s, d):
    return V.combined(_CHECKS["validation_failures"](s, d), _CHECKS["split_validation"](s, d))


QUERIES = {
    "core_split_invariants": _invariants,
    "core_splits": lambda s, d: S.assign_splits(t(s, d, "inventory"), config_from(t(s, d, "custom_split"))),
    "frozen_splits": lambda s, d: S.frozen_splits(t(s, d, "inventory"), _mapping(s, d)),
    "combined_validation": _combined,
    "contract_failures": lambda s, d: V.contract_failures(t(s, d, "documents"), t(s, d, "blocks"), t(s, d, "chunks")),
}

_B = "coalesce(trim({}), '') = ''"

ORACLE = {
    "core_split_invariants": f"""
WITH RECURSIVE k AS (SELECT DISTINCT source_document_id s, 'g:' || {_ID.format('duplicate_group_id')} g, 'h:' || lower(sha256) h FROM inventory WHERE source_document_id IS NOT NULL),
e AS (SELECT 's:' || s a, g b FROM k WHERE g IS NOT NULL UNION SELECT 's:' || s, h FROM k WHERE h IS NOT NULL),
ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a node, a root FROM ee UNION SELECT ee.b, r.root FROM r JOIN ee ON ee.a = r.node),
c AS (SELECT node, min(root) root FROM r GROUP BY 1), x AS (SELECT DISTINCT s, coalesce(root, 's:' || s) comp FROM k LEFT JOIN c ON node = 's:' || s)
SELECT count(*) AS n_sources, count(DISTINCT s) AS n_distinct, count(DISTINCT comp) AS n_components, (SELECT count(*) FROM (SELECT unnest(map_keys(splits)) FROM custom_split)) AS n_splits, 0 AS n_torn, true AS shares_near FROM x""",
    "frozen_splits": f"""
WITH i AS (SELECT DISTINCT source_document_id s, {_ID.format('canonical_document_id')} k FROM inventory), m AS (SELECT {_ID.format('document_id')} k, nullif(upper(trim(split)), '') split FROM documents WHERE document_id IS NOT NULL)
SELECT coalesce(s, m.k) AS source_document_id, split, CASE WHEN s IS NULL THEN 'none' ELSE 'document' END AS matched_by FROM m LEFT JOIN i ON i.k = m.k""",
    "combined_validation": f"SELECT check_name, record_id FROM ({_CHECKED['validation_failures']}) UNION ALL SELECT 'split:' || regexp_replace(check_name, '^split\\.', ''), record_id FROM ({_CHECKED['split_validation']})",
    "contract_failures": f"""
WITH d AS (SELECT DISTINCT {_ID.format('document_id')} k FROM documents WHERE document_id IS NOT NULL),
o AS (SELECT {_ID.format('block_id')} bk, min({_ID.format('document_id')}) o FROM blocks WHERE block_id IS NOT NULL GROUP BY 1),
r AS (SELECT chunk_id, {_ID.format('document_id')} dk, {_ID.format('b')} bk FROM (SELECT chunk_id, document_id, unnest(block_ids) b FROM chunks) WHERE b IS NOT NULL),
x AS (SELECT chunk_id, dk, o.bk hit, o FROM r LEFT JOIN o USING (bk))
SELECT 'documents.success' AS check_name, CAST(doc_id AS VARCHAR) AS record_id FROM documents WHERE coalesce(upper(trim(parse_status)), '') <> 'SUCCESS'
UNION ALL SELECT 'documents.empty_success', CAST(doc_id AS VARCHAR) FROM documents WHERE upper(trim(parse_status)) = 'SUCCESS' AND {_B.format('text')}
UNION ALL SELECT 'documents.hash', CAST(doc_id AS VARCHAR) FROM documents WHERE {_B.format('content_hash')}
UNION ALL SELECT 'documents.title', CAST(doc_id AS VARCHAR) FROM documents WHERE {_B.format('title')}
UNION ALL SELECT 'documents.agency', CAST(doc_id AS VARCHAR) FROM documents WHERE {_B.format('agency')}
UNION ALL SELECT 'documents.provenance', CAST(doc_id AS VARCHAR) FROM documents WHERE {_B.format('source')}
UNION ALL SELECT 'blocks.order', block_id FROM blocks WHERE block_index IS NULL
UNION ALL SELECT 'chunks.empty', chunk_id FROM chunks WHERE {_B.format('text')}
UNION ALL SELECT 'blocks.document', block_id FROM blocks LEFT JOIN d ON k = {_ID.format('document_id')} WHERE k IS NULL
UNION ALL SELECT 'chunks.document', chunk_id FROM chunks LEFT JOIN d ON k = {_ID.format('document_id')} WHERE k IS NULL
UNION ALL SELECT 'chunks.blocks', chunk_id FROM x WHERE hit IS NULL
UNION ALL SELECT 'chunks.one_document', chunk_id FROM x WHERE o <> dk
UNION ALL SELECT 'documents.unique', {_ID.format('document_id')} FROM documents WHERE document_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'blocks.unique', {_ID.format('block_id')} FROM blocks WHERE block_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'chunks.unique', {_ID.format('chunk_id')} FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1""",
}
