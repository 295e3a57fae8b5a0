"""Queries over conversations, quality, collection and TPC-H-like activity tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import iso_week
from docloom.operators import chat as C
from docloom.operators import collect as L
from docloom.operators import quality as Q
from docloom.session import canonical_id, table

t = table


def _window(s, d):
    h = t(s, d, "history").select("conv_id", F.col("chat_id").alias("pos"), C.spoken_by(F.col("role")).alias("role"), "content")
    return C.history_window(h).select("conv_id", "pos", "role", F.length("content").alias("n_chars"))


def _context_hits(s, d):
    """(scope, hits): the first three chunks of each document in order; three are kept per salt before a document's meet."""
    from pyspark.sql import Window as W

    from docloom.plans.retrieval import _chunks

    c = _chunks(s, d).join(t(s, d, "chunks").where("deleted_at is null").groupBy("chunk_id").agg(F.min("section_path").alias("section_path"), F.min("requirement_ids").alias("requirement_ids")), "chunk_id")
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(16))
    near = c.withColumn("r", F.row_number().over(W.partitionBy("scope", salt).orderBy("chunk_id"))).where("r <= 3")
    first = near.withColumn("r", F.row_number().over(W.partitionBy("scope").orderBy("chunk_id"))).where("r <= 3")
    hit = F.struct("chunk_id", "section_path", "requirement_ids", "text")
    return first.groupBy("scope").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def _context(s, d):
    """The first chunks of each document as one prompt context."""
    text = C.context_block(F.col("hits"))
    return _context_hits(s, d).select("scope", F.size("hits").alias("n_hits"), F.sha2(text, 256).alias("context_hash"))


def _answers(s, d):
    """History rows of the assistant, however its role is spelled."""
    return t(s, d, "history").where((C.spoken_by(F.col("role")) == "assistant") & F.col("content").isNotNull())


def _frames(s, d):
    return C.token_frames(_answers(s, d), "history_id", "content").groupBy("kind").agg(F.count("*").alias("n"), F.max("seq").alias("max_seq"))


def _fold(s, d):
    return C.fold_frames(C.token_frames(_answers(s, d), "history_id", "content"), "history_id")


def _prompts(s, d):
    """Each conversation's window as history of a prompt."""
    h = C.history_window(t(s, d, "history").select("conv_id", F.col("chat_id").alias("pos"), C.spoken_by(F.col("role")).alias("role"), "content"))
    per = h.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("h"))  # six at most
    m = C.prompt_messages(F.lit("Answer from the selected document only."), F.col("h"), F.lit("?"))
    return per.select("conv_id", F.size(m).alias("n_messages"), F.element_at(m, -1)["role"].alias("last_role"), F.sha2(F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["role"], x["content"])), "\n"), 256).alias("hash"))


def _chat_page(s, d):
    """The second page of every document's chat."""
    return C.pages(t(s, d, "chat_local")).where("page = 1").select("k", "place", "id")


def _repeated(s, d):
    b = t(s, d, "blocks").where("deleted_at is null").withColumn("k", canonical_id(F.col("document_id")))
    return Q.repeated_short(b, "k", "text_normalized")


def _corpus(s, d):
    from docloom.plans.retrieval import _chunks

    return _chunks(s, d)


def _mix(s, d):
    b = t(s, d, "blocks")
    return b.groupBy("block_type").pivot("split", ["DEV", "REGRESSION"]).agg(F.count(F.lit(1))).select("block_type", F.coalesce("DEV", F.lit(0)).alias("n_dev"), F.coalesce("REGRESSION", F.lit(0)).alias("n_regression"))


def _runs(s, d):
    """Sources of documents as runs, compared by their parse settings and measures."""
    docs = t(s, d, "documents")
    return docs.groupBy("source").agg(F.min("parser_version").alias("parser"), F.max("file_type").alias("file_type"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.avg((F.col("parse_status") == "SUCCESS").cast("double")), 6).alias("success"), F.countDistinct("agency").alias("agencies"))


def _pieces(s, d):
    o = t(s, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.min(F.col("o_orderdate").cast("timestamp")).alias("start"), F.max(F.col("o_orderdate").cast("timestamp")).alias("end"))
    return L.period_pieces(o).select("key", "piece", F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"))


def _latest(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return L.latest_version(o, "o_custkey", "o_orderpriority", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderpriority")


def _robin(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return L.weekly_round_robin(o, "day", ["o_orderpriority", "day", "o_orderkey"], 500).select("o_orderkey", "week", "turn")


def _unseen(s, d):
    inv = t(s, d, "inventory").select(canonical_id(F.col("canonical_document_id")).alias("k"))
    return L.unseen(inv.where("k is not null"), t(s, d, "chat_local").select(canonical_id(F.col("documentid")).alias("k")).where("k is not null"), ["k"])


def _gaps(s, d):
    return L.gaps(t(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts").select("user_id", "island", "n", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


def _weeks(s, d):
    return t(s, d, "documents").groupBy(iso_week(F.date_format("ingested_at", "yyyy-MM-dd")).alias("week")).agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"))


QUERIES = {
    "history_window": _window,
    "prompt_context": _context,
    "prompt_messages": _prompts,
    "token_frames": _frames,
    "folded_answers": _fold,
    "chat_last_turn": lambda s, d: C.last_chat(t(s, d, "documents"), t(s, d, "chat_local")).withColumns({c: F.col(c).cast("string") for c in ("last_at", "last_id")}),
    "chat_page": _chat_page,
    "chat_days": lambda s, d: C.day_separators(t(s, d, "chat_local")).withColumn("day", F.col("day").cast("string")),
    "repeated_blocks": _repeated,
    "dictionary_terms": lambda s, d: Q.dictionary(_corpus(s, d)),
    "top4_keywords": lambda s, d: Q.keywords(_corpus(s, d)),
    "quality_report": lambda s, d: Q.quality_report(t(s, d, "documents")),
    "latency_stats": lambda s, d: Q.latency(t(s, d, "events"), "event_type", "value"),
    "block_mix": _mix,
    "differing_settings": lambda s, d: Q.differing_settings(_runs(s, d), ["parser", "file_type", "agencies"]),
    "best_runs": lambda s, d: Q.best_runs(_runs(s, d), "source", {"mean_chars": True, "success": False, "agencies": False}),
    "period_pieces": _pieces,
    "latest_version": _latest,
    "weekly_round_robin": _robin,
    "unseen_documents": _unseen,
    "event_gaps": _gaps,
    "weekly_documents": _weeks,
}

_ID = "upper(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_TS = "try_strptime(regexp_replace(chatdate, '[^0-9]', '', 'g')[:14], '%Y%m%d%H%M%S')"
_CH = f"c AS (SELECT chunk_id, upper(trim(arg_min(document_id, (ingested_at, text)))) scope, arg_min(text, (ingested_at, text)) t FROM chunks WHERE document_id IS NOT NULL AND text IS NOT NULL AND deleted_at IS NULL GROUP BY 1)"
_STOP = ", ".join(f"'{w}'" for w in Q.STOPWORDS)
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_NAME = _STRIP.format("role")
_ROLE = f"CASE WHEN lower({_NAME}) IN ('user', 'human', '사용자') THEN 'user' WHEN lower({_NAME}) IN ('assistant', 'ai', 'bot', '어시스턴트') THEN 'assistant' WHEN lower({_NAME}) IN ('system', '시스템') THEN 'system' END"
_WINDOW = f"""
m AS (SELECT conv_id, chat_id pos, {_ROLE} AS role, {_STRIP.format('content')} ct FROM history WHERE conv_id IS NOT NULL),
w AS (SELECT *, row_number() OVER b rn, sum(length(ct)) OVER (b ROWS UNBOUNDED PRECEDING) chars FROM m WHERE role IN ('user', 'assistant') AND ct <> '' WINDOW b AS (PARTITION BY conv_id ORDER BY pos DESC, role DESC, ct DESC)),
k AS (SELECT *, min(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY conv_id) f FROM w WHERE rn <= 6 AND chars <= 400)
"""
_RUNS = """
r AS (SELECT source, min(parser_version) parser, max(file_type) file_type, round(avg(n_chars), 6) mean_chars, round(avg((parse_status = 'SUCCESS')::DOUBLE), 6) success, count(DISTINCT agency) agencies FROM documents GROUP BY 1)
"""

ORACLE = {
    "history_window": f"""
WITH {_WINDOW} SELECT conv_id, pos, role, length(ct) AS n_chars FROM k WHERE pos >= f""",
    "prompt_context": f"""
WITH {_CH}, e AS (SELECT chunk_id, min(section_path) sp, min(requirement_ids) ri FROM chunks WHERE deleted_at IS NULL GROUP BY 1),
h AS (SELECT scope, chunk_id, '[chunk_id: ' || chunk_id || '] (section: ' || coalesce(nullif(array_to_string(sp, ' > '), ''), '-') || ' / requirement: ' || coalesce(nullif(array_to_string(ri, ', '), ''), '-') || ')' || chr(10) || t x,
      row_number() OVER (PARTITION BY scope ORDER BY chunk_id) n FROM c JOIN e USING (chunk_id))
SELECT scope, count(*) AS n_hits, sha256(string_agg(x, E'\\n\\n' ORDER BY n)) AS context_hash FROM h WHERE n <= 3 GROUP BY 1""",
    "prompt_messages": f"""
WITH {_WINDOW}, h AS (SELECT conv_id, count(*) n, string_agg(role || ':' || ct, chr(10) ORDER BY pos, role, ct) x FROM k WHERE pos >= f GROUP BY 1)
SELECT conv_id, n + 2 AS n_messages, 'user' AS last_role, sha256('system:Answer from the selected document only.' || chr(10) || x || chr(10) || 'user:?') AS hash FROM h""",
    "token_frames": f"""
WITH h AS (SELECT len(list_filter(string_split(content, ' '), lambda w: w <> '')) n FROM history WHERE {_ROLE} = 'assistant' AND content IS NOT NULL)
SELECT 'SOS' AS kind, count(*) AS n, 0 AS max_seq FROM h UNION ALL SELECT 'TOKEN', CAST(sum(n) AS BIGINT), max(n) FROM h UNION ALL SELECT 'EOS', count(*), max(n) + 1 FROM h""",
    "folded_answers": f"SELECT history_id, array_to_string(list_filter(string_split(content, ' '), lambda w: w <> ''), ' ') AS text FROM history WHERE {_ROLE} = 'assistant' AND content IS NOT NULL",
    "chat_last_turn": f"""
WITH p AS (SELECT {_ID.format('documentid')} k, count(*) n, max({_TS}) l, arg_max(id, (coalesce({_TS}, timestamp '0001-01-01'), id)) i FROM chat_local GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_messages, CAST(CAST(epoch(l) AS BIGINT) AS VARCHAR) AS last_at, CAST(i AS VARCHAR) AS last_id FROM documents LEFT JOIN p ON k = {_ID.format('document_id')}""",
    "chat_page": f"""
WITH r AS (SELECT {_ID.format('documentid')} k, id, row_number() OVER (PARTITION BY k ORDER BY {_TS} DESC NULLS LAST, id DESC) - 1 n FROM chat_local WHERE documentid IS NOT NULL)
SELECT k, n % 30 AS place, id FROM r WHERE n // 30 = 1""",
    "chat_days": f"""
SELECT {_ID.format('documentid')} AS k, CAST(CAST({_TS} AS DATE) AS VARCHAR) AS day, count(*) AS n_messages, arg_min(id, ({_TS}, id)) AS first_id FROM chat_local WHERE documentid IS NOT NULL AND {_TS} IS NOT NULL GROUP BY 1, 2""",
    "repeated_blocks": f"SELECT {_ID.format('document_id')} AS k, text_normalized, count(*) AS n FROM blocks WHERE deleted_at IS NULL AND document_id IS NOT NULL AND length(text_normalized) BETWEEN 3 AND 100 GROUP BY 1, 2 HAVING count(*) >= 3",
    "dictionary_terms": rf"""
WITH {_CH}, w AS (SELECT chunk_id, scope, 'noun' kind, unnest(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]{{2,}}'), lambda x: x NOT IN ({_STOP}))) term FROM c
  UNION ALL SELECT chunk_id, scope, 'acronym', unnest(list_filter(regexp_split_to_array(t, '[^\p{{L}}\p{{N}}_-]+'), lambda x: regexp_full_match(x, '[A-Z][A-Z0-9-]{{1,15}}'))) FROM c)
SELECT term, kind, count(*) AS frequency, count(DISTINCT scope) AS document_frequency, min(chunk_id) AS example FROM w WHERE length(term) <= 40 GROUP BY 1, 2 HAVING count(*) >= 3""",
    "top4_keywords": rf"""
WITH {_CH}, w AS (SELECT chunk_id, term, i FROM (SELECT chunk_id, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]{{2,}}'), lambda x: x NOT IN ({_STOP})) x FROM c), unnest(x) WITH ORDINALITY u(term, i)),
g AS (SELECT chunk_id, term, count(*) tf, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, min(i)) AS "rank" FROM w GROUP BY 1, 2)
SELECT chunk_id, term, tf, "rank" FROM g WHERE "rank" <= 4""",
    "quality_report": """
SELECT count(*) AS n_documents, count(DISTINCT doc_id) AS n_ids, min(length(text)) AS min_chars, quantile_cont(length(text), 0.5) AS median_chars, max(length(text)) AS max_chars, count(*) FILTER (split IS NULL) AS null_splits,
  count(*) FILTER (content_hash IS NULL) AS null_hashes, bool_and(length(text) = n_chars) AS lengths_agree, bool_and(text <> '') AS no_empty_text FROM documents""",
    "latency_stats": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY 1",
    "block_mix": "SELECT block_type, count(*) FILTER (split = 'DEV') AS n_dev, count(*) FILTER (split = 'REGRESSION') AS n_regression FROM blocks GROUP BY 1",
    "differing_settings": f"""
WITH {_RUNS}, l AS (SELECT unnest(['parser', 'file_type', 'agencies']) setting, unnest([coalesce(parser, '(none)'), coalesce(file_type, '(none)'), agencies::VARCHAR]) v FROM r)
SELECT setting, count(DISTINCT v) AS n_values, array_to_string(list_sort(list(DISTINCT v)), ',') AS "values" FROM l GROUP BY 1 HAVING count(DISTINCT v) > 1""",
    "best_runs": f"""
WITH {_RUNS}, l AS (SELECT source, unnest(['mean_chars', 'success', 'agencies']) metric, unnest([mean_chars, success, agencies::DOUBLE]) v FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'mean_chars' THEN v ELSE -v END, source) n FROM l WHERE v IS NOT NULL)
SELECT metric, source AS best_run, v AS value FROM g WHERE n = 1""",
    "period_pieces": """
WITH o AS (SELECT o_custkey AS key, min(CAST(o_orderdate AS TIMESTAMP)) a, max(CAST(o_orderdate AS TIMESTAMP)) b FROM orders GROUP BY 1),
p AS (SELECT key, b, unnest(generate_series(0, CAST(floor(date_diff('second', a, b) / (30 * 86400 + 60)) AS BIGINT))) piece, a FROM o)
SELECT key, piece, CAST(epoch(a) + piece * (30 * 86400 + 60) AS BIGINT) AS start_s, CAST(least(epoch(a) + piece * (30 * 86400 + 60) + 30 * 86400, epoch(b)) AS BIGINT) AS end_s FROM p""",
    "latest_version": """
SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(nullif(o_orderpriority, ''), '0') DESC, o_orderkey DESC) n FROM orders) WHERE n = 1""",
    "weekly_round_robin": """
WITH w AS (SELECT o_orderkey, printf('%d-W%02d', isoyear(CAST(o_orderdate AS DATE)), weekofyear(CAST(o_orderdate AS DATE))) AS week, row_number() OVER (PARTITION BY week ORDER BY o_orderpriority, CAST(o_orderdate AS DATE), o_orderkey) turn FROM orders)
SELECT o_orderkey, week, turn FROM w ORDER BY turn, week LIMIT 500""",
    "unseen_documents": f"SELECT DISTINCT {_ID.format('canonical_document_id')} AS k FROM inventory WHERE canonical_document_id IS NOT NULL AND {_ID.format('canonical_document_id')} NOT IN (SELECT {_ID.format('documentid')} FROM chat_local WHERE documentid IS NOT NULL)",
    "event_gaps": """
WITH e AS (SELECT user_id, ts, coalesce((floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) > 1800)::INT, 0) n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
i AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) island FROM e)
SELECT user_id, island, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM i GROUP BY 1, 2""",
    "weekly_documents": "SELECT printf('%d-W%02d', isoyear(ingested_at), weekofyear(ingested_at)) AS week, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1",
}
