"""Source inventory, exact duplicates, crosswalks and split assignments.

Results by case: null keys group nothing and match nothing; ties are broken by the
source id; repeated rows count as often as they occur unless a function says otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.operators.graph import components
from docloom.session import canonical_id


@dataclass(frozen=True)
class SplitConfig:
    """Shares per split (summing to 1), the seed and the grouping column."""

    shares: dict[str, float]
    seed: int
    group_by: str = "duplicate_group"
    names: tuple[str, ...] = ("DEV", "REGRESSION", "FINAL_HOLDOUT")

    def __post_init__(self):
        if set(self.shares) != set(self.names):
            raise ValueError(f"splits must be exactly {', '.join(self.names)}")
        if abs(sum(self.shares.values()) - 1) > 1e-9:
            raise ValueError("shares must sum to 1.0")
        if isinstance(self.seed, bool) or not isinstance(self.seed, int):
            raise ValueError("seed must be an integer")


def config_from(table: DataFrame) -> SplitConfig:
    row = table.first()
    return SplitConfig(dict(row["splits"]), row["seed"], row["group_by"])


def duplicate_stats(inventory: DataFrame, digest: str = "sha256") -> DataFrame:
    """Groups of equal digests with more than one row: digest, n_sources, n_documents, first source."""
    return inventory.where(F.col(digest).isNotNull()).groupBy(F.lower(digest).alias("digest")).agg(
        F.count("*").alias("n_sources"), F.countDistinct(canonical_id(F.col("canonical_document_id"))).alias("n_documents"), F.min("source_document_id").alias("first_source")).where("n_sources > 1")


def canonical_pick(inventory: DataFrame) -> DataFrame:
    """One source per document, the first by file name, and whether its sources disagree on the digest."""
    rows = inventory.where("canonical_document_id is not null").withColumn("document_key", canonical_id(F.col("canonical_document_id")))
    first = F.min(F.struct(F.col("source_filename").isNull().alias("unnamed"), "source_filename", "source_document_id")).alias("f")
    return rows.groupBy("document_key").agg(first, F.count("*").alias("n_sources"), (F.countDistinct(F.lower("sha256")) > 1).alias("conflict")).select(
        "document_key", F.col("f.source_document_id").alias("source_document_id"), F.col("f.source_filename").alias("source_filename"), "n_sources", "conflict")


def duplicate_components(inventory: DataFrame) -> DataFrame:
    """(node, root) over digests and duplicate groups: sources that share either, directly or through others."""
    g, h = F.concat(F.lit("g:"), canonical_id(F.col("duplicate_group_id"))), F.concat(F.lit("h:"), F.lower("sha256"))
    return components(inventory.select(g.alias("a"), h.alias("b")).where("a is not null and b is not null").distinct())


def split_counts(assigned: DataFrame, targets: DataFrame, split: str = "split") -> DataFrame:
    """Documents per split against the target share."""
    counts = assigned.groupBy(canonical_id(F.col(split)).alias("split")).agg(F.count("*").alias("n_docs"), F.countDistinct("content_group_id").alias("n_groups"))
    total = counts.where("split is not null").agg(F.sum("n_docs").alias("total"))
    goal = targets.select(F.explode("splits").alias("split", "target"))
    return goal.join(counts, "split", "left").crossJoin(F.broadcast(total)).select("split", "target", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.bround(F.coalesce("n_docs", F.lit(0)) / F.col("total"), 6).alias("actual"))


def split_contents(inventory: DataFrame, documents: DataFrame) -> DataFrame:
    """(split, n_sources, n_documents, n_groups): different sources, documents and content groups per split; sources follow their document."""
    docs = documents.where("document_id is not null").select(canonical_id(F.col("document_id")).alias("k"), canonical_id(F.col("split")).alias("split"), canonical_id(F.col("content_group_id")).alias("g")).where("split <> ''")
    src = inventory.select(canonical_id(F.col("canonical_document_id")).alias("k"), "source_document_id").distinct().join(docs.select("k", "split"), "k").groupBy("split").agg(F.countDistinct("source_document_id").alias("n_sources"))
    return docs.groupBy("split").agg(F.countDistinct("k").alias("n_documents"), F.countDistinct("g").alias("n_groups")).join(src, "split", "left").select(
        "split", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "n_documents", "n_groups")


def notice_crosswalk(inventory: DataFrame, documents: DataFrame) -> DataFrame:
    """(source_document_id, notice, by_digest, conflict): each source's notice number, else the document it names; conflict where
    the digest leads to another document than the source names."""
    by_hash = documents.select(F.regexp_extract(F.lower("content_hash"), "([0-9a-f]{64})", 1).alias("h"), canonical_id(F.col("document_id")).alias("k")).where("h <> '' and k is not null")
    known = by_hash.groupBy("h").agg(F.countDistinct("k").alias("n"), F.min("k").alias("by_digest")).where("n = 1")
    rows = inventory.groupBy("source_document_id").agg(F.min(F.when(F.trim("bid_notice_no") != "", F.trim("bid_notice_no"))).alias("no"), F.min(canonical_id(F.col("canonical_document_id"))).alias("named"), F.min(F.regexp_extract(F.lower("sha256"), "([0-9a-f]{64})", 1)).alias("h"))
    return rows.join(known, "h", "left").select("source_document_id", F.coalesce("no", "named").alias("notice"), "by_digest", F.coalesce(F.col("by_digest") != F.col("named"), F.lit(False)).alias("conflict"))


def leaking_groups(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Values of key that lie in more than one split, with the sorted splits and the number of rows."""
    names = rows.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(canonical_id(F.col(key)).alias("group_key"), canonical_id(F.col(split)).alias("s")).agg(F.count("*").alias("n"))
    return names.groupBy("group_key").agg(F.array_join(F.sort_array(F.collect_set("s")), ",").alias("splits"), F.sum("n").alias("n_rows"), F.count("*").alias("k")).where("k > 1").drop("k")


def crosswalk(inventory: DataFrame, documents: DataFrame) -> DataFrame:
    """Each source's documents by digest: EXACT for one, NEEDS_REVIEW for several, UNMATCHED for none."""
    by_hash = documents.select(F.regexp_extract(F.lower("content_hash"), "([0-9a-f]{64})", 1).alias("h"), canonical_id(F.col("document_id")).alias("k")).where("h <> ''")
    known = by_hash.groupBy("h").agg(F.countDistinct("k").alias("n"), F.min("k").alias("k"))
    sources = inventory.select("source_document_id", F.regexp_extract(F.lower("sha256"), "([0-9a-f]{64})", 1).alias("h")).distinct()
    return sources.join(known, "h", "left").select("source_document_id", F.when(F.col("n") == 1, F.col("k")).alias("document_key"), F.when(F.col("n") == 1, "EXACT").when(F.col("n") > 1, "NEEDS_REVIEW").otherwise("UNMATCHED").alias("status"))


def resolve_documents(inventory: DataFrame, documents: DataFrame, key_of) -> DataFrame:
    """Documents by (document key, file key), else by document key alone where it names one document; with the method used."""
    docs = documents.select(canonical_id(F.col("document_id")).alias("d"), key_of(F.col("source_filename_raw")).alias("f"), "doc_id").where("d is not null")
    both = docs.groupBy("d", "f").agg(F.min("doc_id").alias("by_both"))
    single = docs.groupBy("d").agg(F.count("*").alias("n"), F.min("doc_id").alias("by_key")).where("n = 1").drop("n")
    rows = inventory.select("source_document_id", canonical_id(F.col("canonical_document_id")).alias("d"), key_of(F.col("source_filename")).alias("f")).distinct()
    found = rows.join(both, ["d", "f"], "left").join(single, "d", "left")
    return found.select("source_document_id", F.coalesce("by_both", "by_key").alias("doc_id"), F.when(F.col("by_both").isNotNull(), "key_and_file").when(F.col("by_key").isNotNull(), "key").otherwise("none").alias("method"))


def with_parse_status(inventory: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources with the parse status of their document, NOT_RUN where there is none."""
    status = documents.groupBy(canonical_id(F.col("document_id")).alias("d")).agg(F.min("parse_status").alias("status"))
    return inventory.join(status, canonical_id(F.col("canonical_document_id")) == F.col("d"), "left").select("source_document_id", F.coalesce("status", F.lit("NOT_RUN")).alias("status"))


def stratified_sample(rows: DataFrame, id_col: str, stratum: str, size: int, seed: str) -> DataFrame:
    """A seeded sample of about `size` rows, each stratum by its share (half to even), in hash order.

    The order comes from hashes instead of a random generator, so any engine repeats it.
    """
    hashed = rows.select(id_col, F.col(stratum).alias("stratum"), F.sha2(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string")), 256).alias("h"))
    sizes = hashed.groupBy("stratum").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    quota = sizes.crossJoin(F.broadcast(total)).select("stratum", F.bround(F.col("n") * size / F.col("total")).cast("int").alias("quota"), "n").withColumnRenamed("stratum", "_s")
    # Only hashes below a generous multiple of the quota can be drawn; the window then sorts few rows.
    bound = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4294967296.0
    near = hashed.join(F.broadcast(quota), F.col("stratum").eqNullSafe(F.col("_s"))).select(id_col, "stratum", "h", "quota", "n").where(bound <= (F.col("quota") + 12 * F.sqrt(F.col("quota") + 9.0)) / F.col("n"))
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("stratum").orderBy("h", id_col)))
    return ranked.where("rank <= quota").select(id_col, "stratum", "rank")
