"""Queries over single texts: cleaning, labels, keys, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.session import table


def _at():
    return F.unix_micros("ingested_at").alias("at_us")


def _normalized(s, d):
    return table(s, d, "blocks").select("block_id", _at(), T.normalize(F.col("text_raw")).alias("text"))


def _audited(s, d):
    x = table(s, d, "documents").where("text_raw is not null").select("doc_id", T.audited(F.col("text_raw")).alias("a"))
    return x.select("doc_id", F.sha2("a.text", 256).alias("text_hash"), "a.removed", "a.ratio", "a.needs_review")


def _labels(s, d):
    b = table(s, d, "blocks").where("text_normalized is not null")
    t = F.col("text_normalized")
    return b.select("block_id", _at(), T.element_class(t).alias("element_class"), T.section_level(t).alias("level"), T.noise_label(t).alias("noise_label"), T.is_heading(t).alias("is_heading"), T.preview(t).alias("preview"))


def _roles(s, d):
    b = table(s, d, "blocks").where("text_normalized is not null")
    ids = F.coalesce("requirement_ids", F.array().cast("array<string>"))
    hwp = F.coalesce(F.col("parser_version").like("%hwp%"), F.lit(False))
    return b.select("block_id", _at(), T.semantic_role(F.col("text_normalized"), F.coalesce("section_path", F.array().cast("array<string>")), ids).alias("role"),
                    T.block_type(F.col("text_normalized"), ids, hwp, F.col("block_type") == "TABLE").alias("kind"))


def _requirements(s, d):
    b = table(s, d, "blocks").where("text_normalized is not null")
    return b.select("block_id", _at(), F.array_join(T.requirement_ids("text_normalized"), ",").alias("ids"))


def _keys(s, d):
    return table(s, d, "documents").select("doc_id", T.match_key(F.col("source_filename_raw")).alias("file_key"), T.stable_id("doc", F.col("document_id"), F.col("source")).alias("stable_id"),
                                           T.safe_filename(F.col("source_filename_nfc")).alias("safe_name"), F.length(T.content_key(F.col("text"))).alias("key_chars"))


def _profile(s, d):
    n = T.script_counts(F.col("text"))
    x = table(s, d, "documents").select("doc_id", *[c.alias(k) for k, c in n.items()])
    return x.withColumn("latin_dominant", F.col("n_latin") > F.col("n_hangul")).withColumn("script_clean", F.col("n_han") + F.col("n_kana") + F.col("n_cyrillic") == 0)


def _retrieval_text(s, d):
    c, docs = table(s, d, "chunks").where("document_id is not null"), table(s, d, "documents")
    key = lambda x: F.upper(F.trim(x))
    meta = docs.groupBy(key("document_id").alias("k")).agg(F.min("title").alias("title"), F.min("agency").alias("agency"))
    out = T.retrieval_text(F.col("title"), F.col("agency"), F.col("section_path"), F.col("text"))
    return c.join(meta, key(F.col("document_id")) == F.col("k"), "left").select("chunk_id", _at(), F.sha2(out, 256).alias("retrieval_hash"), F.length(out).alias("n_chars"))


def _removals(s, d):
    """What audited cleaning takes out of each document's texts, place by place."""
    fields = F.explode(F.create_map(*[x for f in ("text_raw", "title", "source_filename_raw") for x in (F.lit(f), F.col(f))])).alias("field", "value")
    docs = table(s, d, "documents").select("doc_id", fields).where("value is not null")
    return docs.select("doc_id", "field", F.explode(T.removals(F.col("value"))).alias("x")).select("doc_id", "field", F.col("x.place").cast("long").alias("place"), "x.code")


QUERIES = {
    "normalized_blocks": _normalized,
    "audited_cleaning": _audited,
    "block_labels": _labels,
    "block_roles": _roles,
    "removal_log": _removals,
    "requirement_ids": _requirements,
    "match_keys": _keys,
    "script_profile": _profile,
    "retrieval_text": _retrieval_text,
}

def _strip(x):
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _clean(x):
    lines = "array_to_string(list_transform(string_split(" + x + ", chr(10)), lambda x: " + _strip(r"regexp_replace(x, '[ \t]+', ' ', 'g')") + "), chr(10))"
    return _strip("regexp_replace(" + lines + r", '\n{3,}', E'\n\n', 'g')")


def _contains_any(needles):
    return "(" + " OR ".join(f"contains(ctx, '{n}')" for n in needles) + ")"


_HEADING = f"""((length(t) > 1 AND length(t) <= {T.HEADING_MAX_CHARS}
   OR length(t) > {T.HEADING_MAX_CHARS} AND length(t) <= 100 AND contains(t, chr(10)) AND len(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '{T.NUMBERED_LINE}'))) = 0)
  AND NOT regexp_matches(t, '{T.DATE_OR_SIGNATURE}') AND NOT regexp_matches(t, '^[IVX][.]\\n')
  AND (regexp_matches(t, '{T.HEADING_MARKER}') OR NOT contains(t, chr(10)) AND regexp_matches(trim(t), '{T.HEADING_KEYWORD}')))"""

ORACLE = {
    "normalized_blocks": r"""
SELECT block_id, epoch_us(ingested_at) AS at_us, nfc_normalize(array_to_string(list_filter(list_transform(
  regexp_split_to_array(regexp_replace(regexp_replace(text_raw, '[\x{10000}-\x{10FFFF}\x{3000}]', ' ', 'g'), '\x{200B}', '', 'g'), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
  lambda x: """ + _strip(r"regexp_replace(x, '[ \t\x{a0}]+', ' ', 'g')") + r"""), lambda x: x <> ''), chr(10))) AS text FROM blocks""",
    "audited_cleaning": r"""
WITH a AS (SELECT doc_id, text_raw r, regexp_replace(text_raw, '[\x00-\x08\x0b-\x1f\x7f-\x{9f}\p{Cf}\p{Co}]', '', 'g') k FROM documents WHERE text_raw IS NOT NULL),
b AS (SELECT *, length(r) - length(k) + len(regexp_extract_all(k, '\x{FFFD}+|(?:.\x{0203})+')) removed,
      """ + _clean(r"nfc_normalize(regexp_replace(regexp_replace(k, '\x{FFFD}+|(?:.\x{0203})+', ' ', 'g'), '(?m)[.·ㆍ…]{4,}\s*\d{1,4}\s*$', '', 'g'))") + r""" t FROM a),
c AS (SELECT *, round_even(greatest(0, (length(r) - length(t)) / greatest(1, length(r))), 6) ratio FROM b)
SELECT doc_id, sha256(t) AS text_hash, removed, ratio, ratio > 0.05 OR removed > 10 AS needs_review FROM c""",
    "removal_log": r"""
WITH v AS (SELECT doc_id, unnest(['text_raw', 'title', 'source_filename_raw']) field, unnest([text_raw, title, source_filename_raw]) v FROM documents),
c AS (SELECT doc_id, field, unnest(regexp_extract_all(v, '(?s).')) c, generate_subscripts(regexp_extract_all(v, '(?s).'), 1) - 1 place FROM v WHERE v IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY place) n FROM c WHERE regexp_matches(c, '[\x00-\x08\x0b-\x1f\x7f-\x{9f}\p{Cf}\p{Co}]'))
SELECT doc_id, field, place, 'U+' || printf('%04X', unicode(c)) AS code FROM g WHERE n <= 100""",
    # Every sign and Korean letter is doubled, so that a match may use up one of two as its bound.
    "requirement_ids": r"""
WITH b AS (SELECT block_id, epoch_us(ingested_at) AS at_us, regexp_replace(text_normalized, '([^A-Za-z0-9])', '\1\1', 'g') t FROM blocks WHERE text_normalized IS NOT NULL),
m AS (SELECT block_id, at_us, list_transform(list_zip(regexp_extract_all(t, re, 1), regexp_extract_all(t, re, 2)), lambda x: upper(x[1]) || '-' || lpad(CAST(CAST(x[2] AS INT) AS VARCHAR), CAST(greatest(3, length(CAST(CAST(x[2] AS INT) AS VARCHAR))) AS INT), '0')) l
      FROM b, (SELECT '(?i)(?:^|[^A-Z0-9])([A-Z]{2,5})\s*[-–—]{2}\s*(?:(?:[가-힣A-Za-z]+)\s*[-–—]{2}\s*)?(\d{1,4})(?:\D|$)' re))
SELECT block_id, at_us, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS ids FROM m""",
    "block_labels": r"""
WITH b AS (SELECT block_id, epoch_us(ingested_at) AS at_us, text_normalized t, """ + _strip("text_normalized") + rf""" s FROM blocks WHERE text_normalized IS NOT NULL)
SELECT block_id, at_us,
  CASE WHEN length(s) <= 120 AND regexp_matches(s, '{T.ELEMENT_HEADING}') THEN 'heading' WHEN regexp_matches(s, '{T.ELEMENT_LIST}') THEN 'list_item' ELSE 'paragraph' END AS element_class,
  CASE WHEN regexp_matches(s, '^(?:제?\s*[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|제?\s*\d+\s*장)') THEN 1 WHEN regexp_matches(s, '^\d') THEN least(4, length(regexp_replace(regexp_extract(s, '^(\d+(?:\.\d+)*)', 1), '[^.]', '', 'g')) + 2) ELSE 2 END AS level,
  CASE WHEN t = '' THEN 'empty_after_cleaning' WHEN regexp_matches(t, '{T.PAGE_NUMBER}') THEN 'page_number' END AS noise_label,
  {_HEADING} AS is_heading, CASE WHEN length(t) > 80 THEN substring(t, 1, 80) || '...' ELSE t END AS preview
FROM b""",
    "block_roles": rf"""
WITH b AS (SELECT block_id, epoch_us(ingested_at) AS at_us, text_normalized t, lower(concat_ws(' ', nullif(array_to_string(section_path, ' '), ''), text_normalized)) ctx, len(coalesce(requirement_ids, [])) n, coalesce(parser_version LIKE '%hwp%', false) hwp, block_type FROM blocks WHERE text_normalized IS NOT NULL)
SELECT block_id, at_us, CASE {" ".join(f"WHEN {_contains_any(v)}{' OR n > 0' if k == 'REQUIREMENT' else ''} THEN '{k}'" for k, v in T.ROLES.items())} ELSE 'OTHER' END AS role,
  CASE WHEN n > 0 AND (NOT hwp OR contains(t, '요구') OR length(t) - length(replace(t, chr(10), '')) >= 2) THEN 'REQUIREMENT' WHEN block_type = 'TABLE' THEN 'TABLE'
       WHEN {_HEADING} THEN 'HEADING' WHEN hwp AND regexp_matches(t, '{T.LIST_MARKER}') THEN 'LIST' ELSE 'PARAGRAPH' END AS kind FROM b""",
    "script_profile": r"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[가-힣]')) n_hangul, len(regexp_extract_all(text, '[A-Za-z]')) n_latin, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) n_han,
  len(regexp_extract_all(text, '[\x{3040}-\x{30FF}]')) n_kana, len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')) n_cyrillic FROM documents)
SELECT *, n_latin > n_hangul AS latin_dominant, n_han + n_kana + n_cyrillic = 0 AS script_clean FROM n""",
    "match_keys": r"""
SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(lower(nfc_normalize(source_filename_raw)), '^.*/', ''), '\.[a-z0-9]{2,4}$', ''), '&', 'and'), '[\s\[\]()（）【】「」_·㈜-]+', '', 'g') AS file_key,
  'doc_' || substring(sha256(concat_ws('||', document_id, source)), 1, 20) AS stable_id,
  substring(""" + _strip(r"""regexp_replace(source_filename_nfc, '[\\/:*?"<>|\x00-\x1f]', '_', 'g')""") + r""", 1, 150) AS safe_name,
  length(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g')) AS key_chars FROM documents""",
    "retrieval_text": r"""
WITH m AS (SELECT upper(trim(document_id)) k, min(title) title, min(agency) agency FROM documents GROUP BY 1),
x AS (SELECT chunk_id, epoch_us(ingested_at) AS at_us, array_to_string(list_filter([title, agency, array_to_string(section_path, ' > '), text], lambda x: x IS NOT NULL AND x <> ''), chr(10)) t
      FROM chunks LEFT JOIN m ON k = upper(trim(document_id)) WHERE document_id IS NOT NULL)
SELECT chunk_id, at_us, sha256(t) AS retrieval_hash, length(t) AS n_chars FROM x""",
}
