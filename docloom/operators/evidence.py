"""Provenance, containment and self-made benchmarks over documents, blocks and chunks.

Results by case: null ids trace to nothing; blank evidence is contained nowhere; ties go
to the smaller id; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.functions.text import content_key
from docloom.operators.quality import keywords
from docloom.operators.retrieval import bm25, top
from docloom.session import canonical_id

SALTS = 16


def trace(chunks: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, n_refs, n_blocks, n_same_document, document_found): how far each chunk can be traced back."""
    refs = chunks.select("chunk_id", canonical_id(F.col("document_id")).alias("dk"), F.explode_outer(F.array_distinct(F.transform("block_ids", lambda x: canonical_id(x)))).alias("bk"))
    known = blocks.where("block_id is not null").groupBy(canonical_id(F.col("block_id")).alias("bk")).agg(F.min(canonical_id(F.col("document_id"))).alias("owner"))
    docs = documents.where("document_id is not null").select(canonical_id(F.col("document_id")).alias("dk")).distinct().withColumn("there", F.lit(True))
    rows = refs.join(known.withColumn("hit", F.lit(1)), "bk", "left")
    per = rows.groupBy("chunk_id").agg(F.count("bk").alias("n_refs"), F.count("hit").alias("n_blocks"), F.sum(F.coalesce((F.col("owner") == F.col("dk")).cast("int"), F.lit(0))).alias("n_same_document"), F.min("dk").alias("dk"))
    return per.join(docs, "dk", "left").select("chunk_id", "n_refs", "n_blocks", "n_same_document", F.coalesce("there", F.lit(False)).alias("document_found"))


def containment(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence(evidence_id, scope, text), chunks(chunk_id, scope, text) -> (evidence_id, chunk_id): evidence whose letters and digits lie in a chunk of its document."""
    e = evidence.select("evidence_id", "scope", content_key(F.col("text")).alias("ek")).where("ek <> ''")
    c = chunks.select("chunk_id", "scope", content_key(F.col("text")).alias("ck"))
    return e.join(c, "scope").where(F.contains("ck", "ek")).select("evidence_id", "chunk_id")


def overlap_kept(inner: DataFrame, outer: DataFrame, share: float = 0.5) -> DataFrame:
    """inner(page, id, x0, y0, x1, y1) without the boxes of which more than `share` lies in an outer box of the page."""
    o = outer.select(F.col("page").alias("_p"), *[F.col(c).alias("_" + c) for c in ("x0", "y0", "x1", "y1")])
    width = F.least("x1", "_x1") - F.greatest("x0", "_x0")
    height = F.least("y1", "_y1") - F.greatest("y0", "_y0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return inner.join(o, (F.col("page") == F.col("_p")) & (width > 0) & (height > 0) & (width * height > share * area), "left_anti")


def benchmark(chunks: DataFrame, least: int = 80) -> DataFrame:
    """(query_id, scope, question): of every chunk with `least` words or more its four most frequent terms as a question."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    fit = chunks.where(words >= least)
    q = keywords(fit).groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("question"))
    return q.join(fit.select("chunk_id", "scope"), "chunk_id").select(F.col("chunk_id").alias("query_id"), "scope", "question")


def self_retrieval(chunks: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank): the place of each chunk among the hits of its own question, null beyond k."""
    asked = benchmark(chunks)
    hits = top(bm25(asked, chunks), k).where("chunk_id = query_id").select("query_id", "rank")
    return asked.select("query_id").join(hits, "query_id", "left")


def siblings(inventory: DataFrame) -> DataFrame:
    """(source_document_id, n_siblings, first_sibling): the other sources of the same document."""
    rows = inventory.where("canonical_document_id is not null").select("source_document_id", canonical_id(F.col("canonical_document_id")).alias("k")).distinct()
    # The two smallest per salt, then per document: no group holds all sources of a document.
    salt = F.pmod(F.xxhash64("source_document_id"), F.lit(SALTS))
    near = rows.withColumn("r", F.row_number().over(W.partitionBy("k", salt).orderBy("source_document_id"))).where("r <= 2")
    two = near.groupBy("k").agg(F.slice(F.array_sort(F.collect_list("source_document_id")), 1, 2).alias("two"))  # at most 2 x SALTS
    per = rows.groupBy("k").agg(F.count("*").alias("n")).join(two, "k")
    x = rows.join(per, "k")
    return x.select("source_document_id", (F.col("n") - 1).alias("n_siblings"), F.when(F.element_at("two", 1) != F.col("source_document_id"), F.element_at("two", 1)).otherwise(F.try_element_at("two", F.lit(2))).alias("first_sibling"))


def capped_benchmark(asked: DataFrame, total: int = 1000) -> DataFrame:
    """asked(query_id, scope, ...) -> at most total // documents questions of each document (one at least), total in all.

    A sampling operator: the first by id are kept, documents take turns.
    """
    n = asked.agg(F.countDistinct("scope").alias("n_scopes"))
    cap = F.greatest(F.lit(1), F.floor(F.lit(total) / F.greatest(F.lit(1), F.col("n_scopes"))))
    turn = asked.withColumn("turn", F.row_number().over(W.partitionBy("scope").orderBy("query_id")))
    return turn.crossJoin(F.broadcast(n)).where(F.col("turn") <= cap).orderBy("turn", "scope").limit(total).drop("n_scopes")


def chunk_pages(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chunk_id, page_from, page_to): first and last page of each chunk's blocks, null where none has a page."""
    refs = chunks.select("chunk_id", F.explode_outer(F.array_distinct(F.transform("block_ids", lambda x: canonical_id(x)))).alias("bk"))
    pages = blocks.where("block_id is not null").groupBy(canonical_id(F.col("block_id")).alias("bk")).agg(F.min("source_page").alias("lo"), F.max("source_page").alias("hi"))
    return refs.join(pages, "bk", "left").groupBy("chunk_id").agg(F.min("lo").alias("page_from"), F.max("hi").alias("page_to"))


def seal(documents: DataFrame, split: str = "FINAL_HOLDOUT") -> DataFrame:
    """(document_key, file_type, content_digest) of a split that is kept apart, without its texts."""
    rows = documents.where(canonical_id(F.col("split")) == split)
    return rows.select(canonical_id(F.col("document_id")).alias("document_key"), "file_type", F.sha2("text", 256).alias("content_digest"))


def token_cost(rows: DataFrame, text: str, role: str, price_in: float, price_out: float) -> DataFrame:
    """Estimated cost per role: two characters a token, prices per million tokens."""
    tokens = F.ceil(F.length(text) / 2.0)
    per = rows.where(F.col(text).isNotNull()).groupBy(F.col(role).alias("role")).agg(F.sum(tokens).alias("n_tokens"))
    return per.select("role", "n_tokens", F.round(F.col("n_tokens") * F.when(F.col("role") == "assistant", price_out).otherwise(price_in) / 1e6, 6).alias("cost"))
