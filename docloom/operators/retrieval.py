"""Keyword, dense and fused retrieval, each query scoped to one document, and its metrics.

A query's scope is an equality in every join, so it filters before anything is scored.
Results by case: a query without terms or with an unknown scope has no hits; a chunk
without terms scores nothing; ties go to the smaller chunk id; null vectors and vectors
of length zero are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, DoubleType

from docloom.session import written

K1, B = 1.5, 0.75
RRF_K = 60
#: Statistics of one row are joined by broadcast; term statistics only by size.
WORD = r"[\p{L}\p{N}]{2,}"


def terms(col):
    """Search terms of a text in order; a morphological analyser can take this place."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


class Corpus:
    """Postings and statistics of chunks(chunk_id, scope, text), tokenised once and written."""

    def __init__(self, chunks: DataFrame, tokens=None):
        self.tokens = tokens or terms
        counted = written(chunks.select("scope", "chunk_id", self.tokens(F.col("text")).alias("t")), "tokens")
        self.lengths = counted.select("scope", "chunk_id", F.size("t").alias("len"))
        exploded = counted.select("scope", "chunk_id", F.size("t").alias("len"), F.explode("t").alias("term"))
        #: (scope, chunk_id, len, term, tf)
        self.postings = written(exploded.groupBy("scope", "chunk_id", "len", "term").agg(F.count("*").alias("tf")), "postings")
        #: One row: chunks, and their mean length.
        self.size = self.lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
        df = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        #: (term, idf)
        self.idf = written(df.crossJoin(F.broadcast(self.size)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "idf")

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, scope, term, tf) of questions; those blank or without scope ask nothing."""
        rows = queries.where("scope is not null and question is not null").select("query_id", "scope", F.explode(self.tokens(F.col("question"))).alias("term"))
        return rows.groupBy("query_id", "scope", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, chunks: DataFrame, tokens=None, corpus: Corpus | None = None) -> DataFrame:
    """queries(query_id, scope, question) -> (query_id, scope, chunk_id, score): scores above zero in the query's scope.

    Rarity is that of the whole corpus; the chunks scored are only the scope's.
    """
    corpus = corpus or Corpus(chunks, tokens)
    met = corpus.asked(queries).drop("tf").join(corpus.postings, ["scope", "term"]).join(corpus.idf, "term").crossJoin(F.broadcast(corpus.size.select("avg_len")))
    norm = F.when(F.col("avg_len") > 0, K1 * (1 - B + B * F.col("len") / F.col("avg_len"))).otherwise(K1)
    return met.groupBy("query_id", "scope", "chunk_id").agg(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("score")).where("score > 0")


@F.pandas_udf(ArrayType(DoubleType()))
def _dense_row(cells: pd.Series, weights: pd.Series, dimensions: pd.Series) -> pd.Series:
    return pd.Series([np.bincount(c, w, n) for c, w, n in zip(cells, weights, dimensions)])


def _folded(terms_of: DataFrame, keys: list[str], corpus: Corpus, dimensions: int) -> DataFrame:
    """rows(keys, term, tf) -> (keys, vector): tf x idf summed over hashed dimensions, in the order of the terms."""
    cell = F.pmod(F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("int"), F.lit(dimensions))
    weights = corpus.idf.select("term", "idf", cell.alias("cell"))
    listed = F.array_sort(F.collect_list(F.struct("term", "cell", (F.col("tf") * F.col("idf")).alias("w")))).alias("t")  # the terms of one text
    rows = terms_of.join(weights, "term").groupBy(*keys).agg(listed)
    return rows.select(*keys, _dense_row(F.col("t.cell"), F.col("t.w"), F.lit(dimensions)).alias("vector"))


def hashed_vectors(corpus: Corpus, queries: DataFrame, dimensions: int = 64) -> tuple[DataFrame, DataFrame]:
    """(queries(query_id, scope, vector), chunks(item_id, scope, vector)): vectors for retrieval where no embedding model is at hand.

    Terms of a question that the corpus lacks have no weight.
    """
    chunks = _folded(corpus.postings.select("scope", "chunk_id", "term", "tf"), ["scope", "chunk_id"], corpus, dimensions).withColumnRenamed("chunk_id", "item_id")
    return _folded(corpus.asked(queries), ["query_id", "scope"], corpus, dimensions), chunks


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 5, mode: str = "hybrid", fan_out: int = 8, vectors=None, tokens=None) -> DataFrame:
    """queries(query_id, scope, question), chunks(chunk_id, scope, text) -> (query_id, chunk_id, fused, rank, rank_a, rank_b), the k best in the scope.

    mode: dense, sparse, or hybrid, which takes the k x fan_out best of both and fuses
    their ranks, dense first.  vectors is (queries, chunks) with vectors, by default hashed
    term vectors.
    """
    corpus = Corpus(chunks, tokens)
    none = written(queries.limit(0).select("query_id", F.lit("").alias("chunk_id"), F.lit(0).alias("rank")), "none")
    n = k * fan_out if mode == "hybrid" else k
    near = sparse = none
    if mode in ("dense", "hybrid"):
        near = block_topk(*(vectors or hashed_vectors(corpus, queries)), n).withColumnRenamed("item_id", "chunk_id")
    if mode in ("sparse", "hybrid"):
        sparse = top(bm25(queries, chunks, corpus=corpus), n)
    return fuse(near, sparse).where(F.col("rank") <= k)


def top(hits: DataFrame, k: int, by: str = "score", query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The k best rows of each query with their rank."""
    w = W.partitionBy(query).orderBy(F.desc(F.round(by, 9)), item)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cosines(batches):
    for pdf in batches:
        a, b = np.stack(pdf["va"].to_numpy()).astype(np.float64), np.stack(pdf["vb"].to_numpy()).astype(np.float64)
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        yield pdf.drop(columns=["va", "vb"]).assign(cosine=np.einsum("ij,ij->i", a, b) / np.where(na * nb > 0, na * nb, 1))


def dense(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """queries(query_id, scope, vector), vectors(item_id, scope, vector) -> (query_id, item_id, cosine) within the scope."""
    a = queries.where("vector is not null").select("query_id", "scope", F.col("vector").alias("va"))
    b = vectors.where("vector is not null").select("item_id", "scope", F.col("vector").alias("vb"))
    kinds = dict(a.dtypes) | dict(b.dtypes)
    return a.join(b, "scope").select("query_id", "item_id", "va", "vb").mapInPandas(_cosines, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, cosine double")


#: Vectors in a block; two blocks are multiplied at a time.
BLOCK_ROWS = 2_000


def _blocks(rows: DataFrame, id_col: str) -> DataFrame:
    """(scope, block, n_blocks, ids, values): the vectors of a scope in blocks of about BLOCK_ROWS, their components in one array."""
    rows = rows.where("vector is not null and scope is not null").select("scope", id_col, F.col("vector").cast("array<double>").alias("vector"))
    sizes = rows.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_blocks"))
    placed = rows.join(sizes, "scope").withColumn("block", F.pmod(F.xxhash64(id_col), F.col("n_blocks")).cast("int"))
    rows = placed.groupBy("scope", "block", "n_blocks").agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "vector")).alias("rows"))
    return rows.select("scope", "block", "n_blocks", F.col("rows.id").alias("ids"), F.flatten("rows.vector").alias("values"))


def _block_products(k):
    def run(batches):
        for pdf in batches:
            asked, found, cosines = [], [], []
            for q_ids, q_values, ids, values in zip(pdf["q_ids"], pdf["q_values"], pdf["v_ids"], pdf["v_values"]):
                a, b = (np.asarray(x, dtype=np.float64).reshape(len(i), -1) for x, i in ((q_values, q_ids), (values, ids)))
                a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
                by_id = np.argsort(ids, kind="stable")
                cos = np.round(a @ b.T, 9)[:, by_id]
                first = np.argsort(-cos, axis=1, kind="stable")[:, :k]  # ties to the smaller id
                asked.append(np.repeat(np.asarray(q_ids), first.shape[1]))
                found.append(np.asarray(ids)[by_id][first].ravel())
                cosines.append(np.take_along_axis(cos, first, axis=1).ravel())
            if asked:
                yield pd.DataFrame({"query_id": np.concatenate(asked), "item_id": np.concatenate(found), "cosine": np.concatenate(cosines)})

    return run


def block_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries(query_id, scope, vector), vectors(item_id, scope, vector) -> (query_id, item_id, cosine, rank): exact k nearest in the scope.

    Blocks of queries meet blocks of vectors as matrices, each pair by itself, so a scope
    that holds any share of the rows is spread over (scope, block); only k rows of a query
    leave a pair.
    """
    v = _blocks(vectors, "item_id")
    counts = v.select("scope", "n_blocks").distinct()
    q = _blocks(queries, "query_id").select("scope", F.col("ids").alias("q_ids"), F.col("values").alias("q_values")).join(counts, "scope").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks")
    pairs = q.join(v.select("scope", "block", F.col("ids").alias("v_ids"), F.col("values").alias("v_values")), ["scope", "block"]).select("q_ids", "q_values", "v_ids", "v_values")
    kinds = dict(queries.dtypes) | dict(vectors.dtypes)
    return top(pairs.mapInPandas(_block_products(k), f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, cosine double"), k, "cosine", item="item_id")


def fuse(first: DataFrame, second: DataFrame, weights=(1.0, 0.3), k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of two rankings (query_id, chunk_id, rank from 1); ties go to the first ranking's order."""
    a = first.select("query_id", "chunk_id", F.col("rank").alias("rank_a"))
    b = second.select("query_id", "chunk_id", F.col("rank").alias("rank_b"))
    both = a.join(b, ["query_id", "chunk_id"], "full")
    score = F.coalesce(weights[0] / (k + F.col("rank_a")), F.lit(0.0)) + F.coalesce(weights[1] / (k + F.col("rank_b")), F.lit(0.0))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), F.asc_nulls_last("rank_a"), "rank_b")
    return both.withColumn("fused", score).withColumn("rank", F.row_number().over(w))


def blend(scores: DataFrame, alpha: float = 0.55) -> DataFrame:
    """scores(query_id, chunk_id, dense, sparse) -> alpha x minmax(dense) + (1 - alpha) x minmax(sparse) per query; a zero span gives 0."""
    span = scores.groupBy("query_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("dense", "sparse") for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c):
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.when(width > 0, (F.col(c) - F.col(f"lo_{c}")) / width).otherwise(0.0)

    return scores.join(span, "query_id").select("query_id", "chunk_id", (alpha * scaled("dense") + (1 - alpha) * scaled("sparse")).alias("score"))


def scope_violations(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of hits outside the document that the question was asked about."""
    asked, known = queries.select("query_id", F.col("scope").alias("_asked")), chunks.select("chunk_id", F.col("scope").alias("_of"))
    return hits.select("query_id", "chunk_id").join(asked, "query_id").join(known, "chunk_id").where("_asked <> _of").select("query_id", "chunk_id")


def normalised_hits(hits: DataFrame, k: int = 5) -> DataFrame:
    """hits(query_id, chunk_id, ...) in any layout as contract rows of at most k per query: rank by the given rank, else by score, then
    by chunk id; a missing score is 0, a missing section path empty; rows without chunk id are dropped."""
    has = set(hits.columns)
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in has else F.lit(0.0)
    given = F.col("rank").cast("int") if "rank" in has else F.lit(None).cast("int")
    path = F.coalesce("section_path", F.array().cast("array<string>")) if "section_path" in has else F.array().cast("array<string>")
    rows = hits.where("chunk_id is not null and trim(chunk_id) <> ''").select("query_id", "chunk_id", score.alias("score"), given.alias("_given"), path.alias("section_path"))
    w = W.partitionBy("query_id").orderBy(F.asc_nulls_last("_given"), F.desc("score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_given")


def hits_from(queries: DataFrame, by_id: DataFrame, by_text: DataFrame) -> DataFrame:
    """queries(query_id, question), by_id(query_id, hits), by_text(question, hits) -> (query_id, origin, hits).

    Hits kept for the question's id go before hits kept for its text; a question with neither has none.
    """
    a, b = by_id.select("query_id", F.col("hits").alias("_a")), by_text.select("question", F.col("hits").alias("_b"))
    rows = queries.select("query_id", "question").join(a, "query_id", "left").join(b, "question", "left")
    origin = F.when(F.col("_a").isNotNull(), "id").when(F.col("_b").isNotNull(), "text").otherwise("none")
    return rows.select("query_id", origin.alias("origin"), F.coalesce("_a", "_b", F.array().cast("array<string>")).alias("hits"))


def exported_hits(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, selected_document_id, question, hits): each question with its hits in order; an unanswerable one has none."""
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("hits"))  # at most k each
    none = F.array().cast("array<string>")
    return queries.join(found, "query_id", "left").select(
        F.col("query_id").alias("question_id"), F.col("scope").alias("selected_document_id"), "question", F.when(F.col("answerable"), F.coalesce("hits", none)).otherwise(none).alias("hits"))


def ranking_metrics(hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """hits(query_id, chunk_id, rank), gold(query_id, chunk_id, logic) -> per query hit, ndcg and rr at k.

    ALL needs every gold chunk among the hits, else one is enough.  The ideal gain counts
    the relevant chunks retrieved, not all gold.
    """
    rel = hits.where(F.col("rank") <= k).join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.count("*").alias("found"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"))
    asked = gold.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_gold"), F.first("logic").alias("logic"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("found").cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1.0))
    x = asked.join(rel, "query_id", "left")
    hit = F.when(F.col("logic") == "ALL", F.coalesce("found", F.lit(0)) == F.col("n_gold")).otherwise(F.coalesce("found", F.lit(0)) > 0)
    return x.select("query_id", hit.alias("hit"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def self_query(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Does each query vector find itself first in its scope?  (query_id, top_id, cosine, state)

    state: self, same (another item at distance below 1e-4) or other.
    """
    own = queries.withColumnRenamed("query_id", "item_id").join(vectors.select("item_id", F.col("vector").alias("_v")), "item_id").select(F.col("item_id").alias("query_id"), "item_id", F.col("vector").alias("va"), F.col("_v").alias("vb"))
    itself = own.mapInPandas(_cosines, f"query_id {dict(queries.dtypes)['query_id']}, item_id {dict(vectors.dtypes)['item_id']}, cosine double")
    near = block_topk(queries, vectors, 1).select("query_id", "item_id", "cosine").unionByName(itself)
    best = near.groupBy("query_id").agg(F.max(F.struct(F.round("cosine", 9).alias("c"), (F.col("item_id") == F.col("query_id")).alias("me"), (-F.col("item_id")).alias("i"))).alias("t"))
    state = F.when(-F.col("t.i") == F.col("query_id"), "self").when(1 - F.col("t.c") < 1e-4, "same").otherwise("other")
    return best.select("query_id", (-F.col("t.i")).alias("top_id"), F.round("t.c", 6).alias("cosine"), state.alias("state"))


class CentroidIndex:
    """Approximate neighbours by inverted lists around k-means centres.

    The centres, as many as the square root of the vectors (MOST_LISTS at most), are fitted
    on a seeded sample of at most SAMPLE vectors; every vector is put into the list of its
    nearest centre, and a query looks into its `probes` nearest lists.  `tune` sets probes
    to the fewest that reach a recall for a sample of queries.
    """

    SAMPLE, MOST_LISTS, TUNE = 50_000, 2_500, 200

    def __init__(self, vectors: DataFrame, lists: int | None = None, probes: int = 8, seed: int = 7):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        known = vectors.where("vector is not null").select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
        n = known.count()
        some = known.sample(min(1.0, self.SAMPLE / max(1, n)), seed).limit(self.SAMPLE)
        self.centres = np.array(KMeans(k=lists or max(1, min(self.MOST_LISTS, round(n**0.5))), seed=seed, maxIter=15).fit(some).clusterCenters())
        self.probes = min(probes, len(self.centres))

    def lists(self, vectors: DataFrame, id_col: str, nearest: int) -> DataFrame:
        """(id, scope: list, vector, place): the vector in each of its nearest lists."""
        centres = self.centres

        def keys(batches):
            for pdf in batches:
                v = np.stack(pdf["vector"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, centres.shape[1]))
                far = (centres**2).sum(axis=1)[None] - 2 * v @ centres.T
                order = np.argsort(far, axis=1, kind="stable")[:, :nearest]
                again = np.repeat(np.arange(len(pdf)), order.shape[1])
                yield pd.DataFrame({id_col: pdf[id_col].to_numpy()[again], "scope": order.ravel(), "vector": pdf["vector"].to_numpy()[again], "place": np.tile(np.arange(order.shape[1]), len(pdf))})

        kind = dict(vectors.dtypes)
        return vectors.where("vector is not null").select(id_col, F.col("vector").cast("array<double>").alias("vector")).mapInPandas(keys, f"{id_col} {kind[id_col]}, scope long, vector array<double>, place int")

    def search(self, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
        """(query_id, item_id, cosine, rank): exact cosines over the items of the probed lists, block by block."""
        met = block_topk(self.lists(queries, "query_id", self.probes), self.lists(vectors, "item_id", 1), k)
        return top(met.drop("rank"), k, "cosine", item="item_id")

    def tune(self, queries: DataFrame, vectors: DataFrame, k: int = 5, recall: float = 0.93) -> CentroidIndex:
        """Fewest probes at which at least `recall` of the k nearest of at most TUNE queries lie in the probed lists."""
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(self.TUNE)
        one = F.lit(0).alias("scope")
        exact = block_topk(some.select("query_id", one, "vector"), vectors.select("item_id", one, "vector"), k).select("query_id", "item_id")
        of_item = self.lists(vectors, "item_id", 1).select("item_id", "scope")
        places = self.lists(some, "query_id", len(self.centres)).select("query_id", "scope", "place")
        needed = exact.join(of_item, "item_id").join(places, ["query_id", "scope"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").toPandas()  # a row per list
        if len(needed):
            share = needed["n"].cumsum() / needed["n"].sum()
            self.probes = int(needed["place"][share >= recall].iloc[0]) + 1
        return self
