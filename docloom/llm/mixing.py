"""Mixing sources to target weights.

Method: hierarchical budgeting.  Leaves are (file type, language, source); a source's
weight goes to its leaves in proportion to their tokens and adds up along the tree
domain, language, source.  A leaf without enough tokens, even repeated up to its cap,
hands its shortage to its siblings first, then to the siblings of its ancestors, each
by weight.  A leaf's budget is whole epochs plus a prefix of one more, in an order
seeded per epoch; the prefix ends where its total is nearest to the budget.

Going down the tree, a node's budget is spread over its children by weight, none above
what its leaves can give: budget = min(cap, level * weight) with one level for all
children, which is what passing shortages on to siblings until nothing moves comes to.
So a shortage leaves a node only when all below it is full.  Nodes and leaves are tables;
nothing of the tree comes to the driver but the total.

Unless given, the total is the largest at which every source that has tokens can meet
its share; the share of sources without documents goes to the others.

Results by case: null or token-less texts are not chosen; sources outside the targets
are left out; a null language or file type is a branch of its own; a null max_repeat
is 1; repeated rows are separate documents; empty tables give empty results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.llm.tokens import VOCABULARY, encoding
from docloom.session import written

BUCKETS = 2048


def with_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """documents(doc_id, ..., text) -> the same without text, with n_tokens."""
    keep = [f for f in documents.schema.fields if f.name != "text"]

    def count(batches):
        enc = encoding(path)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(n_tokens=n)

    return documents.where("text is not null").mapInPandas(count, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in keep] + ["n_tokens long"]))


def _spread(children: DataFrame, parent: list[str]) -> DataFrame:
    """children(parent..., weight, cap, above) -> with budget: above is the parent's budget, spread by weight up to the caps."""
    ratio = F.col("cap") / F.col("weight")
    order = W.partitionBy(*(parent or [F.lit(0)])).orderBy(F.col("_ratio").asc_nulls_last(), "_node")
    rows = children.withColumn("_ratio", F.when(F.col("weight") > 0, ratio)).withColumn("_node", F.hash(*children.columns))
    full = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    # With all nodes of a smaller ratio full, the level of the rest; it rises until the first node that has room at it.
    rows = rows.withColumn("_level", F.when(F.col("weight") > 0, (F.col("above") - full) / open_weight))
    level = F.max("_level").over(W.partitionBy(*(parent or [F.lit(0)])))
    return rows.withColumn("budget", F.when(F.col("weight") > 0, F.greatest(F.lit(0.0), F.least("cap", level * F.col("weight")))).otherwise(0.0)).drop("_ratio", "_node", "_level")


def _nodes(leaves: DataFrame, levels: list[str], depth: int) -> DataFrame:
    return leaves.groupBy(*levels[:depth]).agg(F.sum("weight").alias("weight"), F.sum("cap").cast("double").alias("cap"))


def fair_total(leaves: DataFrame, levels: list[str]) -> float:
    """The largest total at which every leaf with tokens meets its weight; leaves without hand theirs to their nearest relatives."""
    share = leaves.limit(1).select(F.lit(1.0).alias("_above"))
    for depth in range(1, len(levels) + 1):
        parent = levels[: depth - 1]
        some = _nodes(leaves, levels, depth).where("cap > 0 and weight > 0")
        some = some.join(share, parent) if parent else some.crossJoin(F.broadcast(share))
        part = F.col("weight") / F.sum("weight").over(W.partitionBy(*(parent or [F.lit(0)])))
        share = some.select(*levels[:depth], "cap", (F.col("_above") * part).alias("_above"))
        if depth < len(levels):
            share = share.drop("cap")
    return share.agg(F.min(F.col("cap") / F.col("_above"))).first()[0] or 0.0


def leaf_budgets(leaves: DataFrame, levels: list[str], total: float | None = None) -> DataFrame:
    """leaves(levels..., weight, cap, ...), one row per leaf -> with budget; weights sum to 1, cap is the most tokens a leaf can give."""
    total = fair_total(leaves, levels) if total is None else total
    above = leaves.limit(1).select(F.lit(float(total)).alias("above"))
    for depth in range(1, len(levels) + 1):
        parent = levels[: depth - 1]
        nodes = _nodes(leaves, levels, depth)
        nodes = _spread(nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above)), parent)
        above = nodes.select(*levels[:depth], F.col("budget").alias("above"))
    return leaves.join(above.withColumnRenamed("above", "budget"), levels)


def budgets(leaves: pd.DataFrame, levels: list[str], total: float | None = None) -> pd.DataFrame:
    """leaf_budgets of a small table in memory, in its order."""
    rows = SparkSession.active().createDataFrame(leaves.reset_index(drop=True).assign(_row=range(len(leaves))))
    return leaf_budgets(rows, levels, total).orderBy("_row").drop("_row").toPandas()


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the chosen documents."""
    name = F.lower(F.trim("source"))
    goal = targets.groupBy(name.alias("source")).agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat"))
    levels = ["file_type", "lang", "source"]
    rows = documents.select("doc_id", "text", F.upper(F.trim(F.coalesce("file_type", F.lit("?")))).alias("file_type"), F.lower(F.trim(F.coalesce("lang", F.lit("?")))).alias("lang"), name.alias("source"))
    counted = written(with_tokens(rows.join(goal.select("source"), "source", "left_semi"), path).where("n_tokens > 0"), "tokens")
    leaf = F.xxhash64(*levels)
    sizes = counted.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    of_source = W.partitionBy("source")
    leaves = goal.join(sizes, "source", "left").select(
        *[F.coalesce(name, F.lit("?")).alias(name) for name in levels], "share", "max_repeat", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.sum("tokens").over(of_source).alias("all"))
    leaves = written(leaves.select(
        *levels, "max_repeat", "tokens", F.when(F.col("all") > 0, F.col("share") * F.col("tokens") / F.col("all")).otherwise(F.col("share")).alias("weight"), (F.col("tokens") * F.col("max_repeat")).cast("double").alias("cap")), "leaves")
    plan = leaf_budgets(leaves, levels, total).where("tokens > 0").withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("tokens")), F.col("max_repeat")).cast("int"))
    parts = plan.select(*levels, "epochs", F.when(F.col("epochs") < F.col("max_repeat"), F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0.0).alias("rest"))
    # Order of the partial epoch: seeded hash; running totals by bucket first, then within the bucket.
    seeded = counted.join(written(parts, "plan"), levels).withColumn("leaf", leaf).withColumn("key", F.xxhash64(F.lit(seed), "epochs", "doc_id"))
    seeded = seeded.withColumn("bucket", F.pmod(F.shiftright("key", 40), F.lit(BUCKETS)))
    sums = seeded.groupBy("leaf", "bucket").agg(F.sum("n_tokens").alias("t"))
    sums = sums.select("leaf", "bucket", (F.sum("t").over(W.partitionBy("leaf").orderBy("bucket")) - F.col("t")).alias("before"))
    inner = F.sum("n_tokens").over(W.partitionBy("leaf", "bucket").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = seeded.withColumn("inner", inner).join(sums, ["leaf", "bucket"])
    start = F.col("before") + F.col("inner") - F.col("n_tokens")
    repeats = F.col("epochs") + F.when(start + F.col("n_tokens") / 2.0 <= F.col("rest"), 1).otherwise(0)
    return placed.select("doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Target and actual share of tokens per source of the targets."""
    got = mix(documents, targets, **options).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    got = written(got, "mixed")
    total = got.agg(F.sum("n_tokens").alias("total"))
    return targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeat").join(got, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeat", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("n_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
