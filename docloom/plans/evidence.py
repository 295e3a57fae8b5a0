"""Queries over provenance, containment and self-made benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import evidence as E
from docloom.plans.activity import _ID, _STOP
from docloom.plans.retrieval import _CHUNKS, _HITS, _chunks
from docloom.session import canonical_id, table


def _trace(s, d):
    c = table(s, d, "chunks").where("deleted_at is null")
    first = c.groupBy("chunk_id").agg(F.min_by(F.struct("document_id", "block_ids"), F.struct("ingested_at", "text")).alias("x")).select("chunk_id", "x.*")
    return E.trace(first, table(s, d, "blocks"), table(s, d, "documents"))


def _containment(s, d):
    """Requirement blocks as evidence."""
    b = table(s, d, "blocks").where("block_type = 'REQUIREMENT' and document_id is not null and text_normalized is not null and deleted_at is null")
    e = b.select(F.col("block_id").alias("evidence_id"), canonical_id(F.col("document_id")).alias("scope"), F.col("text_normalized").alias("text")).distinct()
    return E.containment(e, _chunks(s, d)).distinct()


def _self_retrieval(s, d):
    x = E.self_retrieval(_chunks(s, d))
    at = lambda k: F.round(F.avg((F.coalesce("rank", F.lit(99)) <= k).cast("int")), 6).alias(f"recall_at_{k}")
    return x.agg(F.count("*").alias("n_questions"), at(1), at(5), at(10), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def _holdout_overlap(s, d):
    """Content hashes that DEV and FINAL_HOLDOUT share; there should be none."""
    docs = table(s, d, "documents").select(canonical_id(F.col("split")).alias("s"), F.regexp_extract(F.lower("content_hash"), "([0-9a-f]{64})", 1).alias("h")).where("h <> ''")
    return docs.where("s = 'DEV'").select("h").intersect(docs.where("s = 'FINAL_HOLDOUT'").select("h"))


QUERIES = {
    "provenance_trace": _trace,
    "evidence_containment": _containment,
    "self_retrieval": _self_retrieval,
    "holdout_overlap": _holdout_overlap,
    "sibling_sources": lambda s, d: E.siblings(table(s, d, "inventory")),
    "sealed_documents": lambda s, d: E.seal(table(s, d, "documents")),
    "token_cost": lambda s, d: E.token_cost(table(s, d, "history"), "content", "role", 0.5, 1.5),
}

_CH = "c AS (SELECT chunk_id, upper(trim(arg_min(document_id, (ingested_at, text)))) scope, arg_min(text, (ingested_at, text)) t FROM chunks WHERE document_id IS NOT NULL AND text IS NOT NULL AND deleted_at IS NULL GROUP BY 1)"

ORACLE = {
    "self_retrieval": rf"""
WITH {_CHUNKS}, f AS (SELECT * FROM c WHERE len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) >= 80),
w AS (SELECT chunk_id, term, i FROM (SELECT chunk_id, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]{{2,}}'), lambda x: x NOT IN ({_STOP})) x FROM f), unnest(x) WITH ORDINALITY u(term, i)),
g AS (SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, min(i)) n FROM w GROUP BY 1, 2),
q0 AS (SELECT chunk_id query_id, any_value(scope) scope, string_agg(term, ' ' ORDER BY n) question FROM g JOIN f USING (chunk_id) WHERE n <= 4 GROUP BY 1), {_HITS},
r AS (SELECT q0.query_id, "rank" FROM q0 LEFT JOIN hits h ON h.query_id = q0.query_id AND h.chunk_id = q0.query_id AND "rank" <= 10)
SELECT count(*) AS n_questions, round(avg((coalesce("rank", 99) <= 1)::INT), 6) AS recall_at_1, round(avg((coalesce("rank", 99) <= 5)::INT), 6) AS recall_at_5, round(avg((coalesce("rank", 99) <= 10)::INT), 6) AS recall_at_10,
  round(avg(coalesce(1.0 / "rank", 0)), 6) AS mrr FROM r""",
    "provenance_trace": f"""
WITH c AS (SELECT chunk_id, upper(trim(arg_min({{'v': document_id}}, (ingested_at, text)).v)) dk, arg_min({{'v': block_ids}}, (ingested_at, text)).v b FROM chunks WHERE deleted_at IS NULL GROUP BY 1),
r AS (SELECT DISTINCT chunk_id, dk, {_ID.format('x')} bk FROM (SELECT chunk_id, dk, unnest(b) x FROM c) WHERE x IS NOT NULL),
k AS (SELECT {_ID.format('block_id')} bk, min({_ID.format('document_id')}) o FROM blocks WHERE block_id IS NOT NULL GROUP BY 1),
g AS (SELECT chunk_id, count(*) n_refs, count(k.bk) n_blocks, count(*) FILTER (k.o = r.dk) n_same FROM r LEFT JOIN k USING (bk) GROUP BY 1)
SELECT chunk_id, coalesce(n_refs, 0) AS n_refs, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_same, 0) AS n_same_document, coalesce(dk IN (SELECT {_ID.format('document_id')} FROM documents WHERE document_id IS NOT NULL), false) AS document_found FROM c LEFT JOIN g USING (chunk_id)""",
    "evidence_containment": f"""
WITH {_CH}, e AS (SELECT DISTINCT block_id, {_ID.format('document_id')} scope, regexp_replace(text_normalized, '[^0-9A-Za-z가-힣]', '', 'g') ek FROM blocks WHERE block_type = 'REQUIREMENT' AND document_id IS NOT NULL AND text_normalized IS NOT NULL AND deleted_at IS NULL)
SELECT DISTINCT block_id AS evidence_id, chunk_id FROM e JOIN c USING (scope) WHERE ek <> '' AND contains(regexp_replace(t, '[^0-9A-Za-z가-힣]', '', 'g'), ek)""",
    "holdout_overlap": f"""
SELECT regexp_extract(lower(content_hash), '([0-9a-f]{{64}})', 1) AS h FROM documents WHERE {_ID.format('split')} = 'DEV' AND h <> '' INTERSECT
SELECT regexp_extract(lower(content_hash), '([0-9a-f]{{64}})', 1) AS h FROM documents WHERE {_ID.format('split')} = 'FINAL_HOLDOUT' AND h <> ''""",
    "sibling_sources": f"""
WITH r AS (SELECT DISTINCT source_document_id s, {_ID.format('canonical_document_id')} k FROM inventory WHERE canonical_document_id IS NOT NULL)
SELECT a.s AS source_document_id, count(b.s) AS n_siblings, min(b.s) AS first_sibling FROM r a LEFT JOIN r b ON a.k = b.k AND a.s <> b.s GROUP BY a.s, a.k""",
    "sealed_documents": f"SELECT {_ID.format('document_id')} AS document_key, file_type, sha256(text) AS content_digest FROM documents WHERE {_ID.format('split')} = 'FINAL_HOLDOUT'",
    "token_cost": "SELECT role, CAST(sum(ceil(length(content) / 2)) AS BIGINT) AS n_tokens, round(sum(ceil(length(content) / 2)) * CASE WHEN role = 'assistant' THEN 1.5 ELSE 0.5 END / 1e6, 6) AS cost FROM history WHERE content IS NOT NULL GROUP BY role",
}
