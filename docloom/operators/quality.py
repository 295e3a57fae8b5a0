"""Corpus quality: repeated texts, term dictionary, keywords, distributions, run comparisons.

Results by case: nulls count where a column says so and nowhere else; ties are broken by
the term; empty tables give empty results or zero counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.operators.retrieval import terms
from docloom.session import canonical_id

# Fixed value: words too common in this domain to be terms.
STOPWORDS = ("사업", "시스템", "제안", "요청", "관련", "내용", "경우", "기관", "업무", "통해", "위해", "대한", "따라", "등", "및", "수", "함")


def repeated_short(blocks: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(key, text, n): texts of 3 to 100 characters that occur `least` times or more under one key."""
    rows = blocks.where(F.length(text).between(3, 100) & F.col(key).isNotNull())
    return rows.groupBy(key, text).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def dictionary(chunks: DataFrame, least: int = 3) -> DataFrame:
    """chunks(chunk_id, scope, text) -> (term, frequency, document_frequency, kind, example): terms used `least` times or more."""
    acronyms = F.filter(F.split("text", r"[^\p{L}\p{N}_-]+"), lambda t: t.rlike("^[A-Z][A-Z0-9-]{1,15}$"))
    words = F.filter(terms(F.col("text")), lambda t: ~t.isin(*STOPWORDS))
    rows = chunks.select("chunk_id", "scope", F.explode(F.concat(F.transform(words, lambda t: F.struct(t.alias("term"), F.lit("noun").alias("kind"))), F.transform(acronyms, lambda t: F.struct(t.alias("term"), F.lit("acronym").alias("kind"))))).alias("t"))
    per = rows.where(F.length("t.term") <= 40).groupBy(F.col("t.term").alias("term"), F.col("t.kind").alias("kind"), "scope").agg(F.count("*").alias("n"), F.min("chunk_id").alias("example"))
    return per.groupBy("term", "kind").agg(F.sum("n").alias("frequency"), F.count("scope").alias("document_frequency"), F.min("example").alias("example")).where(F.col("frequency") >= least)


def keywords(chunks: DataFrame, k: int = 4) -> DataFrame:
    """(chunk_id, term, tf, rank): the k most frequent terms of each chunk, ties by first place."""
    rows = chunks.select("chunk_id", F.posexplode(F.filter(terms(F.col("text")), lambda t: ~t.isin(*STOPWORDS))).alias("pos", "term"))
    per = rows.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("pos"))
    return per.withColumn("rank", F.row_number().over(W.partitionBy("chunk_id").orderBy(F.desc("tf"), "pos"))).where(F.col("rank") <= k).select("chunk_id", "term", "tf", "rank")


def medians(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group..., n, median): exact, from counts per value and their running totals, so no group's values are gathered."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    keys = [F.col(c) for c in group] or [F.lit(0)]
    upto = F.sum("_k").over(W.partitionBy(*keys).orderBy("_v"))
    placed = counts.select(*group, "_v", upto.alias("_upto"), (upto - F.col("_k")).alias("_from"), F.sum("_k").over(W.partitionBy(*keys)).alias("_n"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    at = lambda i: F.max(F.when((F.col("_from") <= i) & (i < F.col("_upto")), F.col("_v")))
    return placed.groupBy(*group).agg(F.max("_n").alias("n"), ((at(low) + at(high)) / 2.0).alias("median"))


def quality_report(documents: DataFrame) -> DataFrame:
    """One row: counts, length statistics and checks of the documents."""
    n = F.length("text")
    middle = medians(documents.select(n.alias("n_text")), [], "n_text").select(F.col("median").alias("median_chars"))
    return documents.agg(
        F.count("*").alias("n_documents"), F.countDistinct("doc_id").alias("n_ids"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"),
        F.sum(F.col("split").isNull().cast("int")).alias("null_splits"), F.sum(F.col("content_hash").isNull().cast("int")).alias("null_hashes"),
        F.bool_and(n == F.col("n_chars")).alias("lengths_agree"), F.bool_and(F.col("text") != "").alias("no_empty_text")).join(F.broadcast(middle), F.lit(True), "left")


def block_histogram(blocks: DataFrame) -> DataFrame:
    """(block_type, n_blocks, n_documents, median_chars) over all blocks."""
    rows = blocks.select("block_type", canonical_id(F.col("document_id")).alias("k"), F.length("text_normalized").alias("chars"))
    per = rows.groupBy("block_type").agg(F.count("*").alias("n_blocks"), F.countDistinct("k").alias("n_documents"))
    middle = medians(rows, ["block_type"], "chars").select(F.col("block_type").alias("_t"), F.col("median").alias("median_chars"))
    return per.join(middle, F.col("block_type").eqNullSafe(F.col("_t")), "left").drop("_t")


def latency(events: DataFrame, group: str, value: str) -> DataFrame:
    per = events.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"))
    middle = medians(events, [group], value).select(F.col(group).alias("_g"), F.round("median", 6).alias("median"))
    return per.join(middle, F.col(group).eqNullSafe(F.col("_g"))).select(group, "n", "mean", "median", "max")


def differing_settings(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(setting, n_values, values) of the settings in which runs differ."""
    long = runs.select(F.explode(F.create_map(*[x for k in keys for x in (F.lit(k), F.coalesce(F.col(k).cast("string"), F.lit("(none)")))])).alias("setting", "value"))
    return long.groupBy("setting").agg(F.countDistinct("value").alias("n_values"), F.array_join(F.sort_array(F.collect_set("value")), ",").alias("values")).where("n_values > 1")


def best_runs(runs: DataFrame, run: str, metrics: dict[str, bool]) -> DataFrame:
    """(metric, best_run, value): the best run of each metric; the flag says whether less is better.  Ties: the smaller run."""
    long = runs.select(run, F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value")).where("value is not null")
    less = F.create_map(*[x for m, down in metrics.items() for x in (F.lit(m), F.lit(down))])
    order = F.struct(F.when(F.element_at(less, F.col("metric")), F.col("value")).otherwise(-F.col("value")).alias("v"), F.col(run))
    return long.groupBy("metric").agg(F.min_by(run, order).alias("best_run"), F.min_by("value", order).alias("value"))


def compared_runs(runs: DataFrame, run: str, metric: str) -> DataFrame:
    """(run, metric, place): runs from the greatest value on, those without one last, ties by name."""
    w = W.orderBy(F.desc_nulls_last(metric), run)
    return runs.select(run, metric).withColumn("place", F.row_number().over(w))  # a row per run


def answer_scores(rows: DataFrame) -> DataFrame:
    """rows(question_id, logic, answerable, abstained, facts, facts_ok, conditions, conditions_ok, cited, gold, shown) -> per question
    logic_pass, partial, citation share, abstention result and cause.

    ALL needs every fact and condition, ANY one of them, NONE an abstention; cited, gold and
    shown are arrays of chunk ids.  No citations give a null share.
    """
    all_ok = (F.col("facts") > 0) & (F.col("facts_ok") == F.col("facts")) & (F.col("conditions_ok") == F.col("conditions"))
    any_ok = (F.col("facts_ok") > 0) | (F.col("conditions_ok") > 0)
    passed = F.when(F.col("logic") == "NONE", F.col("abstained")).when(F.col("logic") == "ALL", all_ok).when(F.col("logic") == "ANY", any_ok).otherwise((F.col("facts") > 0) & (F.col("facts_ok") == F.col("facts")))
    cited = F.array_distinct("cited")
    refused = F.col("abstained") & F.col("answerable") & (F.coalesce("logic", F.lit("")) != "NONE")
    return rows.select(
        "question_id", passed.alias("logic_pass"), ((F.col("logic") == "ALL") & ~passed & any_ok).alias("partial"),
        F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, "gold")) / F.size(cited)).alias("citation_share"), refused.alias("over_abstained"),
        F.when(refused, F.when(F.arrays_overlap("gold", "shown"), "GENERATION_ERROR").otherwise("RETRIEVAL_ERROR")).alias("cause"))


def claims(answers: DataFrame, least: int = 6) -> DataFrame:
    """(question_id, claim_no, claim): the sentences of an answer with `least` characters or more."""
    parts = F.filter(F.transform(F.split("answer", r"(?<=[.!?。])\s+|\n+"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    return answers.where("answer is not null").select("question_id", F.posexplode(parts).alias("claim_no", "claim"))
