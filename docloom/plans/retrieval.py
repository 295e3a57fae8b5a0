"""Queries over retrieval: chunks of documents as corpus, users' chat messages as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.operators.chat import spoken_by
from docloom.operators.evidence import containment
from docloom.session import canonical_id, table, written


def _chunks(s, d):
    c = table(s, d, "chunks").where("document_id is not null and text is not null and deleted_at is null")
    first = c.groupBy("chunk_id").agg(F.min_by(F.struct("document_id", "text"), F.struct("ingested_at", "text")).alias("x"))
    return first.select("chunk_id", canonical_id(F.col("x.document_id")).alias("scope"), F.col("x.text").alias("text"))


def _questions(s, d):
    """What users ask in the chat about a document, each message whole."""
    c = table(s, d, "chat_local").where((spoken_by(F.col("sender")) == "user") & F.col("documentid").isNotNull() & F.col("msg").isNotNull())
    return c.select(F.col("id").alias("query_id"), canonical_id(F.col("documentid")).alias("scope"), F.col("msg").alias("question"))


def _evidence(s, d):
    """Requirement blocks as questions; the chunks of their document that hold them whole are their gold."""
    b = table(s, d, "blocks").where("block_type = 'REQUIREMENT' and document_id is not null and text_normalized is not null and deleted_at is null")
    first = b.groupBy("block_id").agg(F.min(F.struct("ingested_at", "document_id", "text_normalized")).alias("x"))
    q = written(first.select(F.col("block_id").alias("query_id"), canonical_id(F.col("x.document_id")).alias("scope"), F.col("x.text_normalized").alias("question")), "evidence")
    gold = containment(q.select(F.col("query_id").alias("evidence_id"), "scope", F.col("question").alias("text")), _chunks(s, d))
    return q, written(gold.select(F.col("evidence_id").alias("query_id"), "chunk_id", F.lit("ANY").alias("logic")), "gold")


def _bm25(s, d):
    hits = R.top(R.bm25(_questions(s, d), _chunks(s, d)), 5)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("scope"), F.col("embedding").alias("vector"))


def _queries(s, d):
    return _vectors(s, d).where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")


def _dense(s, d):
    return R.block_topk(_queries(s, d), _vectors(s, d), 10).select("query_id", F.col("item_id").alias("chunk_id"), F.round("cosine", 6).alias("cosine"), "rank")


def _fused(s, d):
    """Keyword and dense hits of each question, 40 of both, fused to 5."""
    return R.retrieve(_questions(s, d), _chunks(s, d), 5).select("query_id", "chunk_id", F.round("fused", 9).alias("fused"), "rank")


def _blend(s, d):
    """All chunks of the document by both scores, scaled and blended; a chunk without a shared term has a keyword score of 0."""
    q, c = _questions(s, d), _chunks(s, d)
    corpus = R.Corpus(c)
    near = R.dense(*R.hashed_vectors(corpus, q)).withColumnsRenamed({"item_id": "chunk_id", "cosine": "dense"})
    both = near.join(R.bm25(q, c, corpus=corpus).select("query_id", "chunk_id", F.col("score").alias("sparse")), ["query_id", "chunk_id"], "left").fillna(0.0, ["sparse"])
    return R.top(R.blend(both.withColumn("dense", F.round("dense", 9)).withColumn("sparse", F.round("sparse", 9))), 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _metrics(s, d):
    """Hits of requirement texts against the chunks that hold them; questions without gold can't be answered and are left out."""
    q, gold = _evidence(s, d)
    c = _chunks(s, d)
    hits = written(R.top(R.bm25(q, c), 5), "hits")
    m = R.ranking_metrics(hits, gold)
    one = m.agg(F.count("*").alias("n_questions"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_at_5"), F.round(F.avg("ndcg"), 6).alias("ndcg_at_5"), F.round(F.avg("rr"), 6).alias("mrr"))
    return one.crossJoin(F.broadcast(R.scope_violations(hits, q, c).agg(F.count("*").alias("scope_violations")))).crossJoin(
        F.broadcast(q.join(gold.select("query_id").distinct(), "query_id", "left_anti").agg(F.count("*").alias("n_unanswerable"))))


def _exported(s, d):
    """Hits of requirement texts per question; one that no chunk holds is unanswerable and exports none."""
    q, gold = _evidence(s, d)
    q = q.join(gold.select("query_id", F.lit(True).alias("answerable")).distinct(), "query_id", "left").fillna(False, ["answerable"])
    hits = R.top(R.bm25(q.where("answerable"), _chunks(s, d)), 5)
    x = R.exported_hits(q, hits)
    return x.select("question_id", "selected_document_id", F.sha2("question", 256).alias("question_hash"), F.array_join("hits", ",").alias("hits"))


def _self(s, d):
    return R.self_query(_vectors(s, d), _queries(s, d))


def _ann(s, d):
    """Recall at 1, 3 and 5 of the approximate index against exact search over all vectors."""
    one = F.lit(0).alias("scope")
    v, q = _vectors(s, d).select("item_id", one, "vector"), _queries(s, d).select("query_id", one, "vector")
    exact = R.block_topk(q, v, 5)
    near = R.CentroidIndex(v).tune(q, v).search(q, v, 5)
    got = exact.join(near.select("query_id", "item_id", F.lit(1).alias("ok")), ["query_id", "item_id"], "left")
    return got.agg(*[F.round(F.avg(F.when(F.col("rank") <= k, F.coalesce("ok", F.lit(0)))), 4).alias(f"recall_at_{k}") for k in (1, 3, 5)])


def _stats(s, d):
    return R.Corpus(_chunks(s, d)).idf.select("term", F.round("idf", 9).alias("idf"))


QUERIES = {
    "bm25_search": _bm25,
    "bm25_terms": _stats,
    "dense_topk": _dense,
    "rrf_fusion": _fused,
    "hybrid_minmax": _blend,
    "retrieval_metrics": _metrics,
    "exported_hits": _exported,
    "vector_self_query": _self,
    "ann_recall": _ann,
}

_CHUNKS = r"""
c AS (SELECT chunk_id, upper(trim(arg_min(document_id, (ingested_at, text)))) scope, arg_min(text, (ingested_at, text)) t FROM chunks WHERE document_id IS NOT NULL AND text IS NOT NULL AND deleted_at IS NULL GROUP BY 1),
k AS (SELECT chunk_id, scope, regexp_extract_all(lower(t), '[\p{L}\p{N}]{2,}') w FROM c),
p AS (SELECT scope, chunk_id, len(w) l, unnest(w) term FROM k), tf AS (SELECT scope, chunk_id, l, term, count(*) tf FROM p GROUP BY ALL),
s AS (SELECT count(*) n, avg(len(w)) a FROM k), i AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) idf FROM tf, s GROUP BY 1)
"""
_ASKED = r"""
q0 AS (SELECT id query_id, upper(regexp_replace(documentid, '^\s+|\s+$', '', 'g')) scope, msg question FROM chat_local WHERE lower(trim(sender)) IN ('user', 'human', '사용자') AND documentid IS NOT NULL AND msg IS NOT NULL)
"""
_EVIDENCE = r"""
e0 AS (SELECT block_id query_id, arg_min((document_id, text_normalized), (ingested_at, document_id, text_normalized)) x FROM blocks WHERE block_type = 'REQUIREMENT' AND document_id IS NOT NULL AND text_normalized IS NOT NULL AND deleted_at IS NULL GROUP BY 1),
q0 AS (SELECT query_id, upper(regexp_replace(x[1], '^\s+|\s+$', '', 'g')) scope, x[2] question FROM e0),
gold AS (SELECT DISTINCT query_id, chunk_id FROM q0 JOIN c USING (scope) WHERE regexp_replace(question, '[^0-9A-Za-z가-힣]', '', 'g') <> '' AND contains(regexp_replace(t, '[^0-9A-Za-z가-힣]', '', 'g'), regexp_replace(question, '[^0-9A-Za-z가-힣]', '', 'g')))
"""
_HITS = r"""
q1 AS (SELECT query_id, scope, unnest(regexp_extract_all(lower(question), '[\p{L}\p{N}]{2,}')) term FROM q0), q AS (SELECT query_id, scope, term, count(*) n FROM q1 GROUP BY ALL),
b AS (SELECT query_id, chunk_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) score FROM q JOIN tf USING (scope, term) JOIN i USING (term), s GROUP BY 1, 2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS "rank" FROM b WHERE score > 0)
"""
_FOLDED = r"""
qc AS (SELECT query_id, scope, CAST('0x' || substring(md5(term), 1, 6) AS INT) % 64 cell, sum(n * idf) w FROM q JOIN i USING (term) GROUP BY ALL),
vc AS (SELECT chunk_id, scope, CAST('0x' || substring(md5(term), 1, 6) AS INT) % 64 cell, sum(tf * idf) w FROM tf JOIN i USING (term) GROUP BY ALL),
qn AS (SELECT query_id, scope, sqrt(sum(w * w)) z FROM qc GROUP BY ALL), vn AS (SELECT chunk_id, scope, sqrt(sum(w * w)) z FROM vc GROUP BY ALL),
dt AS (SELECT query_id, chunk_id, sum(qc.w * vc.w) dot FROM qc JOIN vc USING (scope, cell) GROUP BY ALL),
cs AS (SELECT query_id, chunk_id, round(coalesce(dot, 0) / (qn.z * vn.z), 9) x FROM qn JOIN vn USING (scope) LEFT JOIN dt USING (query_id, chunk_id))
"""


def _cos(alias, n, name):
    return f"""{alias} AS (SELECT q.vec_id query_id, v.vec_id chunk_id, list_cosine_similarity(q.embedding[1:{n}]::DOUBLE[], v.embedding[1:{n}]::DOUBLE[]) {name} FROM embeddings q JOIN embeddings v USING (label) WHERE q.vec_id % 20 = 0)"""


ORACLE = {
    "bm25_search": f'WITH {_CHUNKS}, {_ASKED}, {_HITS} SELECT query_id, chunk_id, round(score, 6) AS score, "rank" FROM hits WHERE "rank" <= 5',
    "bm25_terms": f"WITH {_CHUNKS} SELECT term, round(idf, 9) AS idf FROM i",
    "dense_topk": f"""WITH {_cos('a', 64, 'x')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id) r FROM a)
SELECT query_id, chunk_id, round(x, 6) AS cosine, r AS "rank" FROM r WHERE r <= 10""",
    "rrf_fusion": f"""
WITH {_CHUNKS}, {_ASKED}, {_HITS}, {_FOLDED}, ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, chunk_id) r FROM cs),
f AS (SELECT query_id, chunk_id, a.r ra, h."rank" rb, coalesce(1.0 / (60 + a.r), 0) + coalesce(0.3 / (60 + h."rank"), 0) fused
  FROM (SELECT * FROM ra WHERE r <= 40) a FULL JOIN (SELECT * FROM hits WHERE "rank" <= 40) h USING (query_id, chunk_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, ra NULLS LAST, rb NULLS FIRST) AS "rank" FROM f)
SELECT query_id, chunk_id, round(fused, 9) AS fused, "rank" FROM g WHERE "rank" <= 5""",
    "hybrid_minmax": f"""
WITH {_CHUNKS}, {_ASKED}, {_HITS}, {_FOLDED}, y AS (SELECT query_id, chunk_id, x, round(coalesce(score, 0), 9) y FROM cs LEFT JOIN hits USING (query_id, chunk_id)),
m AS (SELECT query_id, chunk_id, 0.55 * coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0) + 0.45 * coalesce((y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0), 0) score FROM y WINDOW w AS (PARTITION BY query_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS "rank" FROM m)
SELECT query_id, chunk_id, round(score, 6) AS score, "rank" FROM g WHERE "rank" <= 5""",
    "retrieval_metrics": f"""
WITH {_CHUNKS}, {_EVIDENCE}, {_HITS}, h AS (SELECT * FROM hits WHERE "rank" <= 5),
m AS (SELECT g.query_id, coalesce(max(("rank" IS NOT NULL)::INT), 0) hit, coalesce(sum(1 / log2("rank" + 1)), 0) dcg, count("rank") k, min("rank") f FROM gold g LEFT JOIN h USING (query_id, chunk_id) GROUP BY 1),
n AS (SELECT *, CASE WHEN k > 0 THEN dcg / list_sum(list_transform(generate_series(1, k), lambda i: 1 / log2(i + 1))) ELSE 0 END ndcg FROM m)
SELECT count(*) AS n_questions, round(avg(hit), 6) AS hit_at_5, round(avg(ndcg), 6) AS ndcg_at_5, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr,
  (SELECT count(*) FROM h JOIN q0 USING (query_id) JOIN c USING (chunk_id) WHERE q0.scope <> c.scope) AS scope_violations, (SELECT count(*) FROM q0 WHERE query_id NOT IN (SELECT query_id FROM gold)) AS n_unanswerable FROM n""",
    "exported_hits": f"""
WITH {_CHUNKS}, {_EVIDENCE}, {_HITS}, h AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY "rank") x FROM hits WHERE "rank" <= 5 GROUP BY 1)
SELECT query_id AS question_id, scope AS selected_document_id, sha256(question) AS question_hash, CASE WHEN query_id IN (SELECT query_id FROM gold) THEN coalesce(x, '') ELSE '' END AS hits FROM q0 LEFT JOIN h USING (query_id)""",
    "vector_self_query": f"""
WITH {_cos('a', 64, 'x')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, chunk_id <> query_id, chunk_id) n FROM a)
SELECT query_id, chunk_id AS top_id, round(x, 6) AS cosine, CASE WHEN chunk_id = query_id THEN 'self' WHEN 1 - round(x, 9) < 1e-4 THEN 'same' ELSE 'other' END AS state FROM r WHERE n = 1""",
}
