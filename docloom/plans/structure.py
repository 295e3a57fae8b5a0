"""Queries over blocks and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import structure as S
from docloom.plans.text import _HEADING
from docloom.session import table


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def _windows(s, d):
    return S.chunk_windows(_docs(s, d)).select("doc_id", "chunk_index", "char_start", "char_end", F.sha2("text", 256).alias("text_hash"))


def _paragraphs(s, d):
    return S.with_sections(S.paragraphs(_docs(s, d))).select("doc_id", "block_index", "char_start", "char_end", "section")


def _provenance(s, d):
    """Blocks per chunk with the first six sections in order."""
    b = S.with_sections(S.paragraphs(_docs(s, d)))
    pairs = S.chunk_blocks(S.chunk_windows(_docs(s, d)), b)
    full = pairs.join(b.select("doc_id", "block_index", "section"), ["doc_id", "block_index"])
    listed = F.array_sort(F.collect_list(F.struct("block_index", "section")))
    x = full.groupBy("doc_id", "chunk_index").agg(listed.alias("x"))
    sections = F.slice(F.array_distinct(F.filter(F.transform("x", lambda e: e["section"]), lambda e: e.isNotNull())), 1, 6)
    return x.select("doc_id", "chunk_index", F.size("x").alias("n_blocks"), F.array_min("x")["block_index"].alias("first_block"), F.array_max("x")["block_index"].alias("last_block"), F.array_join(sections, " > ").alias("sections"))


def _reconstruct(s, d):
    docs = _docs(s, d)
    back = S.reconstructed(S.paragraphs(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id", "left").select("doc_id", (F.col("text") == F.coalesce("back", F.lit(""))).alias("same"))


def _stack(s, d):
    return S.heading_stack(S.paragraphs(_docs(s, d))).select("doc_id", "block_index", F.array_join("path", " > ").alias("path"))


def _elements(s, d):
    return S.raw_elements(_docs(s, d), "doc_id").groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def _cells(s, d):
    return S.table_cells(S.raw_elements(_docs(s, d), "doc_id"), "doc_id").select("doc_id", "order_index", "row", "col", "cell")


def _pieces(s, d):
    words = _docs(s, d).select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("tokens"))
    return S.token_pieces(words, "doc_id", 200, 15).select("doc_id", "piece", "start", F.size("tokens").alias("n_tokens"), F.element_at("tokens", 1).alias("first_token"))


def _packed(s, d):
    e = S.raw_elements(_docs(s, d), "doc_id")
    sized = e.select("doc_id", "order_index", F.when(F.col("kind") == "text", F.when(T.element_class(F.col("text")) == "heading", "heading").otherwise("text")).otherwise(F.col("kind")).alias("kind"),
                     F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("n_tokens"))
    packed = S.pack_elements(sized, "doc_id")
    return packed.join(sized.drop("kind"), ["doc_id", "order_index"]).groupBy("doc_id", "chunk").agg(F.count("*").alias("n_elements"), F.sum("n_tokens").alias("n_tokens"), F.min("order_index").alias("first"), F.max("order_index").alias("last"))


def _segments(s, d):
    return S.page_segments(table(s, d, "documents").where("text_raw is not null").select("doc_id", F.col("text_raw").alias("text")), "doc_id").select("doc_id", "segment", F.length("text").alias("n_chars"))


def _neighbours(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("document_id").orderBy("block_index", "block_id", "ingested_at")
    b = table(s, d, "blocks").where("document_id is not null")
    return b.withColumn("prev_id", F.lag("block_id").over(w)).withColumn("next_id", F.lead("block_id").over(w)).where("block_type = 'TABLE'").select("block_id", F.unix_micros("ingested_at").alias("at_us"), "prev_id", "next_id")


QUERIES = {
    "chunk_windows": _windows,
    "paragraph_blocks": _paragraphs,
    "chunk_provenance": _provenance,
    "reconstruction": _reconstruct,
    "heading_stack": _stack,
    "raw_elements": _elements,
    "table_cells": _cells,
    "token_pieces": _pieces,
    "packed_elements": _packed,
    "page_segments": _segments,
    "table_neighbours": _neighbours,
}

_P = rf"""
p AS (SELECT doc_id, i - 1 block_index, t FROM (SELECT doc_id, string_split(text, E'\n\n') x FROM documents WHERE length(text) > 0), unnest(x) WITH ORDINALITY u(t, i)),
o AS (SELECT *, CAST(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY block_index) AS BIGINT) - 2 char_end FROM p),
h AS (SELECT *, char_end - length(t) char_start, CASE WHEN {_HEADING} THEN t END heading FROM o),
b AS (SELECT *, coalesce(heading, last_value(regexp_replace(heading, '\s+', ' ', 'g') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) section FROM h)
"""
_C = """
c AS (SELECT doc_id, CAST(st / 1000 AS INT) chunk_index, st char_start, least(st + 1200, n) char_end, substring(text, st + 1, 1200) t
      FROM (SELECT doc_id, text, length(text) n, unnest(generate_series(0, length(text) - 1, 1000)) st FROM documents WHERE length(text) > 0) WHERE st = 0 OR st + 200 < n)
"""

ORACLE = {
    "chunk_windows": f"WITH {_C} SELECT doc_id, chunk_index, char_start, char_end, sha256(t) AS text_hash FROM c",
    "paragraph_blocks": f"WITH {_P} SELECT doc_id, block_index, char_start, char_end, section FROM b",
    "chunk_provenance": f"""
WITH {_P}, {_C},
j AS (SELECT c.doc_id, c.chunk_index, b.block_index, b.section FROM c JOIN b ON b.doc_id = c.doc_id AND b.char_start < c.char_end AND b.char_end > c.char_start),
f AS (SELECT doc_id, chunk_index, section, min(block_index) m, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY min(block_index)) r FROM j WHERE section IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT doc_id, chunk_index, string_agg(section, ' > ' ORDER BY r) sections FROM f WHERE r <= 6 GROUP BY 1, 2),
a AS (SELECT doc_id, chunk_index, count(*) n_blocks, min(block_index) first_block, max(block_index) last_block FROM j GROUP BY 1, 2)
SELECT a.*, coalesce(sections, '') AS sections FROM a LEFT JOIN s USING (doc_id, chunk_index)""",
    "reconstruction": "SELECT doc_id, true AS same FROM documents",
    "raw_elements": r"""
WITH p AS (SELECT unnest(string_split(text, E'\n\n')) t FROM documents WHERE length(text) > 0),
k AS (SELECT t, CASE WHEN len(list_filter(string_split(t, chr(10)), lambda x: NOT contains(x, '|'))) = 0 THEN 'table' WHEN regexp_matches(t, '^!\[.*\]\(.*\)$') THEN 'image' ELSE 'text' END kind FROM p WHERE trim(t) <> '')
SELECT kind, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM k GROUP BY 1""",
    "table_cells": r"""
WITH p AS (SELECT doc_id, i - 1 order_index, t FROM (SELECT doc_id, string_split(text, E'\n\n') x FROM documents WHERE length(text) > 0), unnest(x) WITH ORDINALITY u(t, i)),
r AS (SELECT doc_id, order_index, j - 1 AS "row", line FROM (SELECT doc_id, order_index, list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^[\s|:-]+$')) l FROM p
      WHERE trim(t) <> '' AND len(list_filter(string_split(t, chr(10)), lambda x: NOT contains(x, '|'))) = 0), unnest(l) WITH ORDINALITY u(line, j))
SELECT doc_id, order_index, "row", k - 1 AS col, trim(cell) AS cell FROM r, unnest(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|')) WITH ORDINALITY u(cell, k)""",
    "heading_stack": rf"""
WITH {_P}, s AS (SELECT doc_id, block_index, t, regexp_replace(t, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') x FROM b),
ll AS (SELECT *, CASE WHEN length(x) <= 120 AND regexp_matches(x, '{T.ELEMENT_HEADING}') THEN CASE WHEN regexp_matches(x, '^(?:제?\s*[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|제?\s*\d+\s*장)') THEN 1
      WHEN regexp_matches(x, '^\d') THEN least(4, length(regexp_replace(regexp_extract(x, '^(\d+(?:\.\d+)*)', 1), '[^.]', '', 'g')) + 2) ELSE 2 END END v FROM s),
oo AS (SELECT doc_id, block_index, {", ".join(f"last_value(CASE WHEN v = {n} THEN t END IGNORE NULLS) OVER w t{n}, max(CASE WHEN v = {n} THEN block_index END) OVER w i{n}, coalesce(max(CASE WHEN v < {n} THEN block_index END) OVER w, -1) c{n}" for n in range(1, 5))}
      FROM ll WINDOW w AS (PARTITION BY doc_id ORDER BY block_index ROWS UNBOUNDED PRECEDING))
SELECT doc_id, block_index, array_to_string(list_filter([{", ".join(f"CASE WHEN i{n} > c{n} THEN t{n} END" for n in range(1, 5))}], lambda x: x IS NOT NULL), ' > ') AS path FROM oo""",
    "token_pieces": r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') k FROM documents),
s AS (SELECT doc_id, k, unnest(generate_series(0, len(k) - 1, 185)) st FROM t WHERE len(k) > 0)
SELECT doc_id, CAST(st / 185 AS INT) AS piece, st AS start, least(200, len(k) - st) AS n_tokens, k[st + 1] AS first_token FROM s WHERE st = 0 OR st + 15 < len(k)""",
    "page_segments": r"""
WITH l AS (SELECT doc_id, i line_no, line FROM (SELECT doc_id, string_split(text_raw, chr(10)) x FROM documents WHERE length(text_raw) > 0), unnest(x) WITH ORDINALITY u(line, i) WHERE trim(line) <> ''),
f AS (SELECT *, coalesce(suffix(trim(lag(line) OVER w), '.') AND (regexp_matches(trim(line), '^-\s*\d+\s*-$') OR length(line) >= 75 AND (length(line) - length(regexp_replace(line, '\s', '', 'g'))) / length(line) < 0.20), false)::INT s FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
g AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) segment FROM f)
SELECT doc_id, segment, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS n_chars FROM g GROUP BY 1, 2""",
    "table_neighbours": """
SELECT block_id, at_us, prev_id, next_id FROM (SELECT block_id, epoch_us(ingested_at) at_us, block_type, lag(block_id) OVER w prev_id, lead(block_id) OVER w next_id
  FROM blocks WHERE document_id IS NOT NULL WINDOW w AS (PARTITION BY document_id ORDER BY block_index NULLS FIRST, block_id NULLS FIRST, ingested_at NULLS FIRST)) WHERE block_type = 'TABLE'""",
}
