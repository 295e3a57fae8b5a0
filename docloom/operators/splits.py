"""Leakage-safe splits of sources, from a frozen mapping or by allocation.

Results by case: sources without digest and group are components of their own; repeated
inventory rows are one source; a mapping row that names no known source is passed
through; blank split names are null; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.operators.graph import components
from docloom.operators.inventory import SplitConfig
from docloom.session import canonical_id, written

BUCKETS = 4096


def allocation_groups(inventory: DataFrame) -> DataFrame:
    """(source_document_id, component): sources that share a digest or a duplicate group, directly or through others.

    The graph's vertices are digests and groups, so a group that holds any share of the
    sources is one vertex.
    """
    keys = inventory.where("source_document_id is not null").select(
        "source_document_id", F.concat(F.lit("g:"), canonical_id(F.col("duplicate_group_id"))).alias("g"), F.concat(F.lit("h:"), F.lower("sha256")).alias("h"))
    edges = keys.where("g is not null and h is not null").select(F.col("g").alias("a"), F.col("h").alias("b")).distinct()
    # A source delivered more than once with other keys ties them together too.
    own = keys.groupBy("source_document_id").agg(F.min("g").alias("g1"), F.max("g").alias("g2"), F.min("h").alias("h1"), F.max("h").alias("h2"))
    ties = own.where("g1 < g2").select(F.col("g1").alias("a"), F.col("g2").alias("b")).unionByName(own.where("h1 < h2").select(F.col("h1").alias("a"), F.col("h2").alias("b")))
    roots = components(edges.unionByName(ties))
    one = own.select("source_document_id", F.coalesce("g1", "h1").alias("key"))
    return one.join(roots, F.col("key") == F.col("node"), "left").select("source_document_id", F.coalesce("root", "key", F.concat(F.lit("s:"), F.col("source_document_id"))).alias("component"))


def plan_by_size(sizes: dict[int, int], shares: dict[str, float]) -> dict[int, list[int]]:
    """How many components of each size every split gets: largest sizes first, each by what the splits still lack.

    sizes has a row per different size, at most the square root of twice the sources.
    """
    total = sum(s * k for s, k in sizes.items())
    lack = [total * share for share in shares.values()]
    plan = {}
    for size in sorted(sizes, reverse=True):
        k, room = sizes[size], [max(0.0, x) for x in lack]
        part = k * size / max(sum(room), 1e-12)
        give = [int(min(1.0, part) * x // size) for x in room]
        for _ in range(k - sum(give)):  # what rounding leaves: a few per size
            i = max(range(len(lack)), key=lambda i: (lack[i] - give[i] * size, -i))
            give[i] += 1
        plan[size] = give
        lack = [x - g * size for x, g in zip(lack, give)]
    return plan


def assign_splits(inventory: DataFrame, config: SplitConfig) -> DataFrame:
    """(source_document_id, component, split): whole components, shares as near as sizes allow, seeded hash order within a size."""
    spark = inventory.sparkSession
    groups = written(allocation_groups(inventory), "groups")
    sized = groups.groupBy("component").agg(F.count("*").alias("size"), F.min("source_document_id").alias("first"))
    order = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.col("first")), 256)
    sized = written(sized.select("component", "size", order.alias("h")).withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2**32 * BUCKETS)), "sized")
    plan = plan_by_size({r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}, config.shares)
    names = list(config.shares)
    counts = sized.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(W.partitionBy("size", "bucket").orderBy("h", "component"))
    ranked = sized.withColumn("inner", rank).join(counts.select("size", "bucket", before.alias("before")), ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("inner"))
    bounds = spark.createDataFrame([(s, sum(give[:1]), sum(give[:2])) for s, give in plan.items()], "size long, first long, second long")
    placed = ranked.join(bounds, "size").select("component", F.when(F.col("rank") <= F.col("first"), names[0]).when(F.col("rank") <= F.col("second"), names[1]).otherwise(names[2]).alias("split"))
    salt = F.pmod(F.xxhash64("source_document_id"), F.lit(8)).cast("int")
    return groups.withColumn("salt", salt).join(placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7)))), ["component", "salt"]).select("source_document_id", "component", "split")


def frozen_splits(inventory: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping(source_document_id, canonical_document_id, split) -> (source_document_id, split, matched_by).

    A mapping row goes to the source that it names, else to every source of the document
    that it names; one that names neither is passed through with what it names.
    """
    key = canonical_id(F.col("canonical_document_id"))
    rows = inventory.select("source_document_id", key.alias("k")).distinct()
    given = mapping.select(F.col("source_document_id").alias("_s"), key.alias("_k"), F.upper(F.trim("split")).alias("split"))
    given = given.withColumn("split", F.when(F.col("split") != "", F.col("split")))
    known = rows.select(F.col("source_document_id").alias("_s"), F.lit(True).alias("by_source")).distinct()
    marked = given.join(known, "_s", "left")
    direct = marked.where("by_source").select(F.col("_s").alias("source_document_id"), "split", F.lit("source").alias("matched_by"))
    rest = marked.where("by_source is null").join(rows.withColumnRenamed("k", "_k"), "_k", "left")
    return direct.unionByName(rest.select(F.coalesce("source_document_id", "_s", "_k").alias("source_document_id"), "split", F.when(F.col("source_document_id").isNotNull(), "document").otherwise("none").alias("matched_by")))


def target_report(assigned: DataFrame, config: SplitConfig) -> DataFrame:
    """(split, target_count, actual_count, difference) of every configured split."""
    spark = assigned.sparkSession
    goal = spark.createDataFrame(list(config.shares.items()), "split string, share double")
    counts = assigned.groupBy("split").agg(F.count("*").alias("n"))
    total = assigned.agg(F.count("*").alias("total"))
    x = goal.join(counts, "split", "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))
    target = F.col("total") * F.col("share")
    return x.select("split", F.bround(target, 6).alias("target_count"), F.col("n").alias("actual_count"), F.bround(F.col("n") - target, 6).alias("difference"))
