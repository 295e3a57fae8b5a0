"""Dataset validation as failure rows: one query per check, one table of results.

Every check yields (check_name, record_id) for each record that breaks it; a check
without rows has passed.  Empty tables pass; a null id breaks its id check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.session import canonical_id

# Labels that the contract allows.
FILE_TYPES = ("HWP", "PDF")
BLOCK_TYPES = ("HEADING", "PARAGRAPH", "LIST", "TABLE", "REQUIREMENT", "OTHER")
PROCESSED = ("DEV", "REGRESSION")
SEALED = "FINAL_HOLDOUT"


def _fail(df: DataFrame, name: str, record, condition) -> DataFrame:
    return df.where(condition).select(F.lit(name).alias("check_name"), record.cast("string").alias("record_id"))


def _each(df: DataFrame, record, checks: dict) -> DataFrame:
    """All checks of one kind of row in one pass."""
    names = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in checks.items()]))
    return df.select(F.explode(names).alias("check_name"), record.cast("string").alias("record_id"))


def failures(documents: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """All broken checks of the three tables: ids, labels, duplicates, order, references, spans, coverage, sealed split.

    Each table is passed once for the checks of its rows and once for those against the
    documents; only chunks, whose spans are compared, meet the documents' texts.
    """
    doc, block, chunk = F.col("document_id"), F.col("block_id"), F.col("chunk_id")
    keyed = documents.where("document_id is not null").select(canonical_id(doc).alias("dk"), F.length("text").alias("n_text"), F.col("text").alias("doc_text"))
    texts = keyed.groupBy("dk").agg(F.min("n_text").alias("n_text"), F.min_by("doc_text", "n_text").alias("doc_text"))
    sizes = keyed.groupBy("dk").agg(F.min("n_text").alias("n_text"), F.lit(True).alias("known"))
    width = F.col("char_end") - F.col("char_start")
    out = [
        _each(documents, F.coalesce(doc, F.col("doc_id").cast("string")), {
            "document.id_missing": doc.isNull() | (F.trim(doc) == ""), "document.file_type": ~F.upper(F.trim("file_type")).isin(*FILE_TYPES), "document.text_length": F.length("text") != F.col("n_chars")}),
        _each(blocks, block, {
            "block.block_type": ~F.col("block_type").isin(*BLOCK_TYPES), "block.sealed_split": canonical_id(F.col("split")) == SEALED, "block.span_negative": (F.col("char_start") < 0) | (width < 0)}),
        _each(chunks, chunk, {
            "chunk.sealed_split": canonical_id(F.col("split")) == SEALED, "chunk.span_grid": (F.col("char_start") % 1000 != 0) | (F.col("char_start") != F.col("chunk_index") * 1000) | (width > 1200),
            "chunk.text_length": F.length("text") != width, "chunk.no_blocks": F.coalesce(F.size("block_ids"), F.lit(0)) <= 0, "chunk.page_order": F.col("page_start") > F.col("page_end")}),
        _each(blocks.where(doc.isNotNull()).withColumn("dk", canonical_id(doc)).join(sizes, "dk", "left"), block, {
            "block.document_unknown": F.col("known").isNull(), "block.span_outside": F.col("char_end") > F.col("n_text")}),
        _each(chunks.where(doc.isNotNull()).withColumn("dk", canonical_id(doc)).join(texts.withColumn("known", F.lit(True)), "dk", "left"), chunk, {
            "chunk.document_unknown": F.col("known").isNull(), "chunk.span_outside": F.col("char_end") > F.col("n_text"),
            "chunk.span_text": (F.col("char_end") <= F.col("n_text")) & (F.col("doc_text").substr(F.col("char_start") + 1, width) != F.col("text"))}),
    ]
    for df, name, key in ((documents, "document", doc), (blocks, "block", block), (chunks, "chunk", chunk)):
        twice = df.where(key.isNotNull()).groupBy(canonical_id(key).alias("k")).agg(F.count("*").alias("n"))
        out.append(_fail(twice, f"{name}.id_repeated", F.col("k"), F.col("n") > 1))
    refs = chunks.select("chunk_id", canonical_id(doc).alias("dk"), F.explode("block_ids").alias("b")).where("b is not null").withColumn("bk", canonical_id(F.col("b")))
    owners = blocks.where("block_id is not null").groupBy(canonical_id(block).alias("bk")).agg(F.min(canonical_id(doc)).alias("owner"), F.lit(True).alias("known"))
    out.append(_each(refs.join(owners, "bk", "left"), chunk, {"chunk.block_unknown": F.col("known").isNull(), "chunk.block_of_other_document": F.col("owner") != F.col("dk")}))
    w = W.partitionBy("dk").orderBy("chunk_index", "chunk_id", "ingested_at")
    ordered = chunks.where(doc.isNotNull()).withColumn("dk", canonical_id(doc)).withColumn("previous", F.lag("chunk_index").over(w))
    out.append(_fail(ordered, "chunk.index_gap", chunk, F.col("chunk_index") - F.coalesce("previous", F.lit(-1)) > 1))
    return reduce(DataFrame.unionByName, out)


CHECKS = (
    "document.id_missing", "document.file_type", "document.text_length", "block.block_type", "block.sealed_split", "chunk.sealed_split", "block.span_negative", "chunk.span_grid",
    "chunk.text_length", "chunk.no_blocks", "chunk.page_order", "document.id_repeated", "block.id_repeated", "chunk.id_repeated", "block.document_unknown", "chunk.document_unknown",
    "block.span_outside", "chunk.span_outside", "chunk.span_text", "chunk.block_unknown", "chunk.block_of_other_document", "chunk.index_gap",
)


def report(broken: DataFrame) -> DataFrame:
    """(check_name, n_failures, passed) of every check."""
    spark = broken.sparkSession
    return spark.createDataFrame([(c,) for c in CHECKS], "check_name string").join(broken.groupBy("check_name").agg(F.count("*").alias("n")), "check_name", "left").select(
        "check_name", F.coalesce("n", F.lit(0)).alias("n_failures"), F.col("n").isNull().alias("passed"))


def split_failures(inventory: DataFrame, assigned: DataFrame, allowed: tuple[str, ...] = (*PROCESSED, SEALED)) -> DataFrame:
    """Failures of assignments(source_document_id, duplicate_group, split): unknown, unassigned, repeated, disallowed, leaking."""
    src = F.col("source_document_id")
    sources = inventory.select("source_document_id").distinct()
    given = assigned.select("source_document_id").distinct()
    twice = assigned.groupBy("source_document_id").agg(F.countDistinct("split").alias("n"))
    leak = assigned.where("duplicate_group is not null").groupBy("duplicate_group").agg(F.countDistinct("split").alias("n"))
    out = [
        _fail(given.join(sources, "source_document_id", "left_anti"), "split.unknown_source", src, F.lit(True)),
        _fail(sources.join(given, "source_document_id", "left_anti"), "split.unassigned_source", src, F.lit(True)),
        _fail(twice, "split.two_splits", src, F.col("n") > 1),
        _fail(assigned, "split.not_allowed", src, ~F.col("split").isin(*allowed)),
        _fail(leak, "split.leaking_group", F.col("duplicate_group"), F.col("n") > 1),
    ]
    return reduce(DataFrame.unionByName, out)


def require(broken: DataFrame) -> None:
    """Raise with some of the failures if there are any."""
    some = broken.limit(5).collect()
    if some:
        raise ValueError("validation failed: " + "; ".join(f"{r['check_name']} {r['record_id']}" for r in some))


def combined(dataset: DataFrame, splits: DataFrame) -> DataFrame:
    """Failures of the dataset and of its splits in one table, the latter's checks named split:..."""
    return dataset.unionByName(splits.withColumn("check_name", F.concat(F.lit("split:"), F.regexp_replace("check_name", r"^split\.", ""))))


def contract_failures(documents: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(check_name, record_id) of records that break the contract between parser output and search: unique keys, texts, references."""
    doc, block, chunk = F.col("document_id"), F.col("block_id"), F.col("chunk_id")
    docs = documents.where("document_id is not null").select(canonical_id(doc).alias("dk"), F.lit(True).alias("known")).distinct()
    owners = blocks.where("block_id is not null").groupBy(canonical_id(block).alias("bk")).agg(F.min(canonical_id(doc)).alias("owner"), F.lit(True).alias("there"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    refs = chunks.select("chunk_id", canonical_id(doc).alias("dk"), F.explode("block_ids").alias("b")).where("b is not null").withColumn("bk", canonical_id(F.col("b"))).join(owners, "bk", "left")
    out = [
        _each(documents, F.col("doc_id"), {
            "documents.success": F.coalesce(F.upper(F.trim("parse_status")), F.lit("")) != "SUCCESS", "documents.empty_success": (F.upper(F.trim("parse_status")) == "SUCCESS") & blank(F.col("text")),
            "documents.hash": blank(F.col("content_hash")), "documents.title": blank(F.col("title")), "documents.agency": blank(F.col("agency")), "documents.provenance": blank(F.col("source"))}),
        _each(blocks, block, {"blocks.order": F.col("block_index").isNull()}),
        _each(chunks, chunk, {"chunks.empty": blank(F.col("text"))}),
        _each(blocks.withColumn("dk", canonical_id(doc)).join(docs, "dk", "left"), block, {"blocks.document": F.col("known").isNull()}),
        _each(chunks.withColumn("dk", canonical_id(doc)).join(docs, "dk", "left"), chunk, {"chunks.document": F.col("known").isNull()}),
        _each(refs, chunk, {"chunks.blocks": F.col("there").isNull(), "chunks.one_document": F.col("owner") != F.col("dk")}),
    ]
    for df, name, key in ((documents, "documents", doc), (blocks, "blocks", block), (chunks, "chunks", chunk)):
        twice = df.where(key.isNotNull()).groupBy(canonical_id(key).alias("k")).agg(F.count("*").alias("n"))
        out.append(_fail(twice, f"{name}.unique", F.col("k"), F.col("n") > 1))
    return reduce(DataFrame.unionByName, out)
