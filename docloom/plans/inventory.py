"""Queries over the inventory, duplicates and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import match_key
from docloom.operators import inventory as I
from docloom.session import table

t = table

QUERIES = {
    "exact_duplicates": lambda s, d: I.duplicate_stats(t(s, d, "inventory")),
    "canonical_pick": lambda s, d: I.canonical_pick(t(s, d, "inventory")),
    "duplicate_components": lambda s, d: I.duplicate_components(t(s, d, "inventory")),
    "split_counts": lambda s, d: I.split_counts(t(s, d, "documents"), t(s, d, "custom_split")),
    "split_contents": lambda s, d: I.split_contents(t(s, d, "inventory"), t(s, d, "documents")),
    "notice_crosswalk": lambda s, d: I.notice_crosswalk(t(s, d, "inventory"), t(s, d, "documents")),
    "leaking_groups": lambda s, d: I.leaking_groups(t(s, d, "documents"), "content_group_id"),
    "crosswalk": lambda s, d: I.crosswalk(t(s, d, "inventory"), t(s, d, "documents")),
    "resolved_documents": lambda s, d: I.resolve_documents(t(s, d, "inventory"), t(s, d, "documents"), match_key),
    "parse_status": lambda s, d: I.with_parse_status(t(s, d, "inventory"), t(s, d, "documents")),
    "stratified_sample": lambda s, d: I.stratified_sample(t(s, d, "documents"), "doc_id", "source", 300, "20260828"),
    "inventory_counts": lambda s, d: t(s, d, "inventory").groupBy("file_type", "parse_status").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes")),
}

_ID = "upper(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_KEY = "regexp_replace(replace(regexp_replace(regexp_replace(lower(nfc_normalize({})), '^.*/', ''), '\\.[a-z0-9]{{2,4}}$', ''), '&', 'and'), '[\\s\\[\\]()（）【】「」_·㈜-]+', '', 'g')"

ORACLE = {
    "exact_duplicates": f"SELECT lower(sha256) AS digest, count(*) AS n_sources, count(DISTINCT {_ID.format('canonical_document_id')}) AS n_documents, min(source_document_id) AS first_source FROM inventory WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "canonical_pick": f"""
SELECT k AS document_key, source_document_id, source_filename, n_sources, conflict FROM (
  SELECT {_ID.format('canonical_document_id')} k, source_document_id, source_filename, row_number() OVER (PARTITION BY k ORDER BY source_filename NULLS LAST, source_document_id) r, count(*) OVER (PARTITION BY k) n_sources,
         count(DISTINCT lower(sha256)) OVER (PARTITION BY k) > 1 conflict FROM inventory WHERE canonical_document_id IS NOT NULL) WHERE r = 1""",
    "duplicate_components": f"""
WITH RECURSIVE e AS (SELECT DISTINCT 'g:' || {_ID.format('duplicate_group_id')} a, 'h:' || lower(sha256) b FROM inventory),
ee AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT DISTINCT a node, a root FROM ee UNION SELECT ee.b, r.root FROM r JOIN ee ON ee.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY 1""",
    "split_counts": f"""
WITH c AS (SELECT {_ID.format('split')} split, count(*) n, count(DISTINCT content_group_id) g FROM documents GROUP BY 1),
t AS (SELECT unnest(map_keys(splits)) split, unnest(map_values(splits)) target FROM custom_split)
SELECT t.split, target, coalesce(n, 0) AS n_docs, coalesce(g, 0) AS n_groups, round_even(coalesce(n, 0) / (SELECT sum(n) FROM c WHERE split IS NOT NULL), 6) AS actual FROM t LEFT JOIN c USING (split)""",
    "split_contents": f"""
WITH d AS (SELECT {_ID.format('document_id')} k, {_ID.format('split')} split, {_ID.format('content_group_id')} g FROM documents WHERE document_id IS NOT NULL),
s AS (SELECT split, count(DISTINCT source_document_id) n FROM inventory JOIN d ON k = {_ID.format('canonical_document_id')} WHERE split <> '' GROUP BY 1)
SELECT d.split, coalesce(any_value(n), 0) AS n_sources, count(DISTINCT k) AS n_documents, count(DISTINCT g) AS n_groups FROM d LEFT JOIN s USING (split) WHERE d.split <> '' GROUP BY 1""",
    "notice_crosswalk": f"""
WITH k AS (SELECT regexp_extract(lower(content_hash), '([0-9a-f]{{64}})', 1) h, count(DISTINCT {_ID.format('document_id')}) n, min({_ID.format('document_id')}) k FROM documents WHERE document_id IS NOT NULL GROUP BY 1),
s AS (SELECT source_document_id, min(nullif(trim(bid_notice_no), '')) no, min({_ID.format('canonical_document_id')}) named, min(regexp_extract(lower(sha256), '([0-9a-f]{{64}})', 1)) h FROM inventory GROUP BY 1)
SELECT source_document_id, coalesce(no, named) AS notice, k AS by_digest, coalesce(k <> named, false) AS conflict FROM s LEFT JOIN k ON k.h = s.h AND k.h <> '' AND n = 1""",
    "leaking_groups": f"""
SELECT {_ID.format('content_group_id')} AS group_key, array_to_string(list_sort(list(DISTINCT {_ID.format('split')})), ',') AS splits, count(*) AS n_rows FROM documents
WHERE content_group_id IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_ID.format('split')}) > 1""",
    "crosswalk": f"""
WITH k AS (SELECT regexp_extract(lower(content_hash), '([0-9a-f]{{64}})', 1) h, count(DISTINCT {_ID.format('document_id')}) n, min({_ID.format('document_id')}) k FROM documents GROUP BY 1),
s AS (SELECT DISTINCT source_document_id, regexp_extract(lower(sha256), '([0-9a-f]{{64}})', 1) h FROM inventory)
SELECT source_document_id, CASE WHEN n = 1 THEN k END AS document_key, CASE WHEN n = 1 THEN 'EXACT' WHEN n > 1 THEN 'NEEDS_REVIEW' ELSE 'UNMATCHED' END AS status FROM s LEFT JOIN k ON k.h = s.h AND k.h <> ''""",
    "resolved_documents": f"""
WITH d AS (SELECT {_ID.format('document_id')} d, {_KEY.format('source_filename_raw')} f, doc_id FROM documents WHERE document_id IS NOT NULL),
b AS (SELECT d, f, min(doc_id) by_both FROM d GROUP BY 1, 2), o AS (SELECT d, min(doc_id) by_key FROM d GROUP BY 1 HAVING count(*) = 1),
s AS (SELECT DISTINCT source_document_id, {_ID.format('canonical_document_id')} d, {_KEY.format('source_filename')} f FROM inventory)
SELECT source_document_id, coalesce(by_both, by_key) AS doc_id, CASE WHEN by_both IS NOT NULL THEN 'key_and_file' WHEN by_key IS NOT NULL THEN 'key' ELSE 'none' END AS method
FROM s LEFT JOIN b ON b.d = s.d AND b.f = s.f LEFT JOIN o ON o.d = s.d""",
    "parse_status": f"""
WITH d AS (SELECT {_ID.format('document_id')} d, min(parse_status) st FROM documents GROUP BY 1)
SELECT source_document_id, coalesce(st, 'NOT_RUN') AS status FROM inventory LEFT JOIN d ON d = {_ID.format('canonical_document_id')}""",
    "stratified_sample": """
WITH h AS (SELECT doc_id, source stratum, sha256('20260828:' || doc_id) h, count(*) OVER (PARTITION BY source) n, count(*) OVER () total FROM documents),
r AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id) AS "rank", round_even(n * 300 / total, 0) q FROM h)
SELECT doc_id, stratum, "rank" FROM r WHERE "rank" <= q""",
    "inventory_counts": "SELECT file_type, parse_status, count(*) AS n, CAST(sum(file_size) AS BIGINT) AS bytes FROM inventory GROUP BY 1, 2",
}
