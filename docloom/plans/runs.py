"""Queries over evaluation runs, collected files and slices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.functions import text as T
from docloom.operators import chat as C
from docloom.operators import evidence as E
from docloom.operators import quality as Q
from docloom.operators import retrieval as R
from docloom.plans.retrieval import _CHUNKS, _EVIDENCE, _HITS, _chunks, _evidence
from docloom.session import canonical_id, table

t = table


def _scored(s, d):
    """(query_id, hit, ndcg, rr) of requirement texts that some chunk holds."""
    q, gold = _evidence(s, d)
    return R.ranking_metrics(R.top(R.bm25(q, _chunks(s, d)), 5), gold)


def _roles(s, d):
    b = t(s, d, "blocks").where("block_id is not null")
    return b.groupBy(F.col("block_id").alias("query_id")).agg(F.min(F.coalesce("semantic_role", F.lit("(none)"))).alias("role"))


def _by_role(s, d):
    """Hits by the kind of question, with a total."""
    rows = _scored(s, d).join(_roles(s, d), "query_id")
    per = rows.rollup("role").agg(F.count("*").alias("n_questions"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit"), F.round(F.avg("rr"), 6).alias("mrr"))
    return per.select(F.coalesce("role", F.lit("(all)")).alias("role"), "n_questions", "hit", "mrr")


def _attached(s, d):
    """Each question with its hit and the number of chunks that hold it, null where it wasn't scored."""
    q, gold = _evidence(s, d)
    held = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    scored = R.ranking_metrics(R.top(R.bm25(q, _chunks(s, d)), 5), gold).select("query_id", "hit", F.round("rr", 6).alias("rr"))
    return q.select("query_id").join(scored, "query_id", "left").join(held, "query_id", "left")


def _summary(s, d):
    """One row that sums up the run: questions, hits, conversations, cost."""
    m = _scored(s, d).agg(F.count("*").alias("n_scored"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_at_5"), F.round(F.avg("rr"), 6).alias("mrr"))
    who = C.spoken_by(F.col("role"))
    h = t(s, d, "history").agg(
        F.count("*").alias("n_messages"), F.countDistinct("conv_id").alias("n_conversations"), F.sum((who == "user").cast("int")).alias("n_user"), F.sum((who == "assistant").cast("int")).alias("n_assistant"),
        F.sum(F.ceil(F.length("content") / 2.0)).cast("long").alias("n_tokens"))
    c = _chunks(s, d).agg(F.count("*").alias("n_chunks"), F.countDistinct("scope").alias("n_documents"))
    return m.crossJoin(F.broadcast(h)).crossJoin(F.broadcast(c))


def _paired(s, d):
    """Mean length of a source's documents as HWP and as PDF, for sources that have both."""
    docs = t(s, d, "documents").select("source", F.upper(F.trim("file_type")).alias("kind"), "n_chars")
    x = docs.groupBy("source").pivot("kind", ["HWP", "PDF"]).agg(F.round(F.avg("n_chars"), 6)).where("HWP is not null and PDF is not null")
    return x.select("source", F.col("HWP").alias("hwp_chars"), F.col("PDF").alias("pdf_chars"), F.round(F.col("HWP") - F.col("PDF"), 6).alias("difference"))


def _files(s, d):
    """Sources against documents by file name: the first document of that name, with its status."""
    known = t(s, d, "documents").where("source_filename_raw is not null").groupBy(T.nfc(F.col("source_filename_raw")).alias("name")).agg(
        F.min(F.struct("doc_id", F.coalesce("parse_status", F.lit("UNKNOWN")).alias("status"))).alias("x"))
    files = t(s, d, "inventory").select("source_document_id", T.nfc(F.col("source_filename")).alias("name")).distinct()
    return files.join(known, "name", "left").select("source_document_id", "name", "x.doc_id", F.coalesce("x.status", F.lit("MISSING")).alias("status"))


def _unsuccessful(s, d):
    """Documents of the inventory of which no source was parsed."""
    key = canonical_id(F.col("canonical_document_id")).alias("document_key")
    inv = t(s, d, "inventory").where("canonical_document_id is not null")
    return inv.select(key).subtract(inv.where("upper(trim(parse_status)) = 'SUCCESS'").select(key))


def _slices(s, d):
    """Elements of the processed splits in one table, each marked with its slice."""
    b = t(s, d, "blocks").where("deleted_at is null")
    part = lambda name: b.where(canonical_id(F.col("split")) == name).select(F.lit(name).alias("slice"), "block_id", F.unix_micros("ingested_at").alias("at_us"), "block_type")
    return part("DEV").unionByName(part("REGRESSION"))


def _analysed(s, d):
    """Blocks per type that are kept for analysis, those with a noise label left out."""
    b = t(s, d, "blocks").where("text_normalized is not null")
    label = T.noise_label(F.col("text_normalized"))
    return b.groupBy("block_type").agg(F.count("*").alias("n_blocks"), F.sum(label.isNull().cast("int")).alias("n_kept"))


def _benchmark(s, d):
    return E.capped_benchmark(E.benchmark(_chunks(s, d), 40)).select("query_id", "scope", "question", "turn")


def _wiring(s, d):
    """Of each document's prompt context: does it name every chunk and hold every text that it was made of?"""
    from docloom.plans.activity import _context_hits

    hits = _context_hits(s, d)
    text = C.context_block(F.col("hits"))
    ok = lambda field: F.forall("hits", lambda h: F.contains(text, h[field]))
    return hits.select("scope", F.size("hits").alias("n_hits"), ok("chunk_id").alias("ids_in"), ok("text").alias("texts_in"))


def _sources(s, d):
    """Hits of requirement texts: ranked ones by the question's id, else the chunks that hold the text by the text itself."""
    q, gold = _evidence(s, d)
    listed = lambda rows, key: rows.groupBy(key).agg(F.sort_array(F.collect_set("chunk_id")).alias("hits"))
    top = R.normalised_hits(R.bm25(q, _chunks(s, d)), 3).where("score > 20")
    text = gold.join(q.select("query_id", "question"), "query_id").groupBy("question", "chunk_id").agg(F.count("*")).withColumn("r", F.row_number().over(W.partitionBy("question").orderBy("chunk_id"))).where("r <= 3")
    return R.hits_from(q, listed(top, "query_id"), listed(text, "question")).select("query_id", "origin", F.array_join("hits", ",").alias("hits"))


def _compared(s, d):
    per = t(s, d, "documents").groupBy("source").agg(F.round(F.avg(F.when(F.col("lang") == "en", F.col("n_chars"))), 6).alias("mean_chars"))
    return Q.compared_runs(per, "source", "mean_chars")


QUERIES = {
    "hit_sources": _sources,
    "compared_sources": _compared,
    "question_rollup": _by_role,
    "attached_scores": _attached,
    "run_summary": _summary,
    "paired_sources": _paired,
    "file_matches": _files,
    "zero_success": _unsuccessful,
    "split_slices": _slices,
    "analysed_blocks": _analysed,
    "capped_benchmark": _benchmark,
    "prompt_wiring": _wiring,
    "chunk_pages": lambda s, d: E.chunk_pages(t(s, d, "chunks").where("deleted_at is null").groupBy("chunk_id").agg(F.min_by("block_ids", F.struct("ingested_at", "text")).alias("block_ids")), t(s, d, "blocks")),
    "block_histogram": lambda s, d: Q.block_histogram(t(s, d, "blocks")),
    "chat_pages": lambda s, d: C.pages(t(s, d, "chat_local")),
}

_ID = "upper(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_TS = "try_strptime(regexp_replace(chatdate, '[^0-9]', '', 'g')[:14], '%Y%m%d%H%M%S')"
_SCORED = f"""{_CHUNKS}, {_EVIDENCE}, {_HITS}, h AS (SELECT * FROM hits WHERE "rank" <= 5),
m AS (SELECT g.query_id, count(*) n_gold, max(("rank" IS NOT NULL)::INT) hit, coalesce(1.0 / min("rank"), 0) rr FROM gold g LEFT JOIN h USING (query_id, chunk_id) GROUP BY 1)"""

ORACLE = {
    "hit_sources": f"""
WITH {_CHUNKS}, {_EVIDENCE}, {_HITS}, a AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY chunk_id) h FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) n FROM b WHERE score > 0) WHERE n <= 3 AND score > 20 GROUP BY 1),
g AS (SELECT question, chunk_id, row_number() OVER (PARTITION BY question ORDER BY chunk_id) n FROM (SELECT DISTINCT question, chunk_id FROM gold JOIN q0 USING (query_id))),
x AS (SELECT question, string_agg(chunk_id, ',' ORDER BY chunk_id) h FROM g WHERE n <= 3 GROUP BY 1)
SELECT query_id, CASE WHEN a.h IS NOT NULL THEN 'id' WHEN x.h IS NOT NULL THEN 'text' ELSE 'none' END AS origin, coalesce(a.h, x.h, '') AS hits FROM q0 LEFT JOIN a USING (query_id) LEFT JOIN x USING (question)""",
    "compared_sources": """
WITH p AS (SELECT source, round(avg(n_chars) FILTER (lang = 'en'), 6) m FROM documents GROUP BY 1)
SELECT source, m AS mean_chars, row_number() OVER (ORDER BY m DESC NULLS LAST, source) AS place FROM p""",
    "question_rollup": f"""
WITH {_SCORED}, r AS (SELECT block_id query_id, min(coalesce(semantic_role, '(none)')) AS role FROM blocks WHERE block_id IS NOT NULL GROUP BY 1)
SELECT coalesce(role, '(all)') AS role, count(*) AS n_questions, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS mrr FROM m JOIN r USING (query_id) GROUP BY ROLLUP (role)""",
    "attached_scores": f"WITH {_SCORED} SELECT query_id, hit = 1 AS hit, round(rr, 6) AS rr, n_gold FROM q0 LEFT JOIN m USING (query_id)",
    "run_summary": f"""
WITH {_SCORED}, w AS (SELECT conv_id, content, lower(regexp_replace(role, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) r FROM history)
SELECT (SELECT count(*) FROM m) AS n_scored, (SELECT round(avg(hit), 6) FROM m) AS hit_at_5, (SELECT round(avg(rr), 6) FROM m) AS mrr, count(*) AS n_messages, count(DISTINCT conv_id) AS n_conversations,
  count(*) FILTER (r IN ('user', 'human', '사용자')) AS n_user, count(*) FILTER (r IN ('assistant', 'ai', 'bot', '어시스턴트')) AS n_assistant, CAST(sum(ceil(length(content) / 2)) AS BIGINT) AS n_tokens,
  (SELECT count(*) FROM c) AS n_chunks, (SELECT count(DISTINCT scope) FROM c) AS n_documents FROM w""",
    "paired_sources": """
WITH a AS (SELECT source, round(avg(n_chars) FILTER (upper(trim(file_type)) = 'HWP'), 6) h, round(avg(n_chars) FILTER (upper(trim(file_type)) = 'PDF'), 6) p FROM documents GROUP BY 1)
SELECT source, h AS hwp_chars, p AS pdf_chars, round(h - p, 6) AS difference FROM a WHERE h IS NOT NULL AND p IS NOT NULL""",
    "file_matches": """
WITH k AS (SELECT nfc_normalize(source_filename_raw) "name", arg_min((doc_id, coalesce(parse_status, 'UNKNOWN')), doc_id) x FROM documents WHERE source_filename_raw IS NOT NULL GROUP BY 1),
f AS (SELECT DISTINCT source_document_id, nfc_normalize(source_filename) "name" FROM inventory)
SELECT source_document_id, "name", x[1] AS doc_id, coalesce(x[2], 'MISSING') AS status FROM f LEFT JOIN k USING ("name")""",
    "zero_success": f"SELECT DISTINCT {_ID.format('canonical_document_id')} AS document_key FROM inventory WHERE canonical_document_id IS NOT NULL EXCEPT SELECT {_ID.format('canonical_document_id')} FROM inventory WHERE upper(trim(parse_status)) = 'SUCCESS'",
    "split_slices": f"SELECT {_ID.format('split')} AS slice, block_id, epoch_us(ingested_at) AS at_us, block_type FROM blocks WHERE deleted_at IS NULL AND {_ID.format('split')} IN ('DEV', 'REGRESSION')",
    "analysed_blocks": f"SELECT block_type, count(*) AS n_blocks, count(*) FILTER (NOT (text_normalized = '' OR regexp_matches(text_normalized, '{T.PAGE_NUMBER}'))) AS n_kept FROM blocks WHERE text_normalized IS NOT NULL GROUP BY 1",
    "capped_benchmark": rf"""
WITH {_CHUNKS}, f AS (SELECT * FROM c WHERE len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) >= 40),
w AS (SELECT chunk_id, term, i FROM (SELECT chunk_id, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]{{2,}}'), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in Q.STOPWORDS)})) x FROM f), unnest(x) WITH ORDINALITY u(term, i)),
g AS (SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, min(i)) n FROM w GROUP BY 1, 2),
a AS (SELECT chunk_id, string_agg(term, ' ' ORDER BY n) question FROM g WHERE n <= 4 GROUP BY 1),
r AS (SELECT chunk_id query_id, scope, question, row_number() OVER (PARTITION BY scope ORDER BY chunk_id) turn FROM a JOIN f USING (chunk_id)),
z AS (SELECT * FROM r WHERE turn <= greatest(1, (SELECT 1000 // greatest(1, count(DISTINCT scope)) FROM r)) ORDER BY turn, scope LIMIT 1000)
SELECT query_id, scope, question, turn FROM z""",
    "prompt_wiring": f"WITH {_CHUNKS} SELECT scope, least(3, count(*)) AS n_hits, true AS ids_in, true AS texts_in FROM c GROUP BY 1",
    "chunk_pages": f"""
WITH c AS (SELECT chunk_id, arg_min({{'v': block_ids}}, (ingested_at, text)).v b FROM chunks WHERE deleted_at IS NULL GROUP BY 1), r AS (SELECT chunk_id, {_ID.format('x')} bk FROM (SELECT chunk_id, unnest(b) x FROM c)),
p AS (SELECT {_ID.format('block_id')} bk, min(source_page) lo, max(source_page) hi FROM blocks WHERE block_id IS NOT NULL GROUP BY 1), g AS (SELECT chunk_id, min(lo) lo, max(hi) hi FROM r LEFT JOIN p USING (bk) GROUP BY 1)
SELECT chunk_id, lo AS page_from, hi AS page_to FROM c LEFT JOIN g USING (chunk_id)""",
    "block_histogram": f"SELECT block_type, count(*) AS n_blocks, count(DISTINCT {_ID.format('document_id')}) AS n_documents, quantile_cont(length(text_normalized), 0.5) AS median_chars FROM blocks GROUP BY 1",
    "chat_pages": f"""
WITH r AS (SELECT {_ID.format('documentid')} k, id, row_number() OVER (PARTITION BY k ORDER BY {_TS} DESC NULLS LAST, id DESC) - 1 n FROM chat_local WHERE documentid IS NOT NULL)
SELECT k, n // 30 AS page, n % 30 AS place, id FROM r""",
}
