"""Splits that keep related records together.

Method: components by parallel hooking and shortcutting over a parent table that is
joined with its edges, until no parent changes; then subset-sum bitsets over the
multiplicities of component sizes choose how many components of each size every
evaluation split gets, so that the totals come closest to the target shares, exactly and
at any number of records.

Records are related through content_group_id and content_hash.  The graph is built on
the keys, not the records: keys are vertices, and a record with both keys is an edge,
so a key that a third of all rows share is one vertex, its records are reduced before
the shuffle.  Hash keys seen with one group only take that group's component without
iterating.

Results by case: a null or blank key relates nothing; a record without keys is a
component of its own; a null split is no split; repeated rows are separate records of
one component; empty tables give empty results.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.llm.common import SPLITS, group_key, hash_key, split_name
from docloom.operators.graph import components
from docloom.session import written

BUCKETS = 4096


def related(documents: DataFrame) -> DataFrame:
    """(doc_id, split, component): component is a key of the component, or null for a record of its own."""
    keyed = written(
        documents.select("doc_id", split_name(F.col("split")).alias("split"), group_key(F.col("content_group_id")).alias("g"), hash_key(F.col("content_hash")).alias("h")), "keys")
    links = keyed.where("g is not null and h is not null").groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high"))
    inner = F.col("low") < F.col("high")
    links = written(links, "links")
    # Hashes that span several groups: their (group, group) edges, from the hash's smallest group to each other group.
    spanning = keyed.where("g is not null").join(links.where(inner).select("h", "low"), "h").select(F.col("low").alias("a"), F.col("g").alias("b")).where("a <> b").distinct()
    roots = components(spanning)
    by_group = keyed.join(roots, keyed["g"] == roots["node"], "left").select("doc_id", "split", "h", F.coalesce("root", "g").alias("root"))
    with_group = by_group.where("root is not null")
    # Records without a group follow the group that their hash is seen with, else the hash itself.
    of_hash = links.join(roots, links["low"] == roots["node"], "left").select(F.col("h").alias("k"), F.coalesce("root", "low").alias("of"))
    rest = by_group.where("root is null")
    rest = rest.join(of_hash, rest["h"] == of_hash["k"], "left").select("doc_id", "split", F.coalesce(F.concat(F.lit("g:"), "of"), F.concat(F.lit("h:"), "h")).alias("component"))
    return with_group.select("doc_id", "split", F.concat(F.lit("g:"), "root").alias("component")).unionByName(rest)


def torn(records: DataFrame) -> DataFrame:
    """doc_id of every record whose component lies in more than one split."""
    wide = records.where("component is not null").groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo < hi").select("component")
    salts = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt")
    return records.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int")).join(wide.select("component", salts), ["component", "salt"]).select("doc_id")


def _advance(bits: int, blocks: list[tuple[int, int]], unit: int, bound: int) -> int:
    for size, take in blocks:
        bits |= (bits << (size * take // unit)) & bound
    return bits


def _read_back(bits: int, blocks: list[tuple[int, int]], at: int, unit: int, bound: int, chosen: dict[int, int]) -> int:
    """Which blocks make up the reachable total `at`; halves are read back in turn, so only log2(blocks) bitsets are held."""
    if len(blocks) == 1:
        (size, take), = blocks
        if (bits >> at) & 1:
            return at
        chosen[size] = chosen.get(size, 0) + take
        return at - size * take // unit
    half = len(blocks) // 2
    at = _read_back(_advance(bits, blocks[:half], unit, bound), blocks[half:], at, unit, bound, chosen)
    return _read_back(bits, blocks[:half], at, unit, bound, chosen)


def _down(sizes: dict[int, int], goal: int) -> tuple[dict[int, int], int]:
    """Largest sizes first, as many as fit: (taken, what is left of the goal)."""
    taken = {}
    for size in sorted(sizes, reverse=True):
        k = min(sizes[size], goal // size)
        if k:
            taken[size], goal = k, goal - k * size
    return taken, goal


def closest(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many components of each size give the total closest to the target, the smaller total if two are.

    Sizes from the smallest on, as long as none exceeds the sum of those before by more
    than 1, reach every total up to their sum C.  So only totals of the other sizes are
    searched: any that lies at most C below the target is exact.  Largest first finds one
    mostly; else a subset-sum bitset over their multiplicities, in units of the sizes'
    common divisor, finds the closest.  It is exact at any size and holds
    log2(blocks) + 2 bitsets of about target / divisor bits.
    """
    small, reach, large = {}, 0, {}
    for size in sorted(sizes):
        if not large and size <= reach + 1:
            small[size], reach = sizes[size], reach + size * sizes[size]
        else:
            large[size] = sizes[size]
    taken, short = _down(large, target)
    if short > reach and large:
        best = short - reach  # the gap of that choice: totals farther above need no bit
        unit = gcd(*large)
        blocks = []
        for size in sorted(large, reverse=True):
            k, step = min(large[size], (target + best) // size), 1
            while k > 0:
                take = min(step, k)
                blocks.append((size, take))
                k -= take
                step *= 2
        if blocks:
            bound = (1 << ((target + best) // unit + 1)) - 1
            bits, goal = _advance(1, blocks, unit, bound), target // unit
            below = (bits & ((1 << (goal + 1)) - 1)).bit_length() - 1
            over = bits >> (goal + 1)
            above = goal + (over & -over).bit_length() if over else None
            gap = max(0, target - below * unit - reach)
            at = below if above is None or gap <= above * unit - target else above
            taken = {}
            _read_back(1, blocks, at, unit, bound, taken)
            short = max(0, target - at * unit)
    rest, _ = _down(small, min(short, reach))
    return taken | rest


def choose(sizes: dict[int, int], shares: dict[str, float]) -> dict[str, dict[int, int]]:
    """For each split but the first, how many components of each size it takes.

    sizes: component size -> number of such components; the number of different sizes
    is below the square root of twice the records, whatever their number.
    """
    total, left, out = sum(s * k for s, k in sizes.items()), dict(sizes), {}
    for name in list(shares)[1:]:
        out[name] = chosen = closest(left, round(total * shares[name]))
        left = {s: k - chosen.get(s, 0) for s, k in left.items() if k > chosen.get(s, 0)}
    return out


def assign(documents: DataFrame, config: DataFrame) -> DataFrame:
    """(doc_id, component, new_split) with all of a component in one split near the configured shares."""
    spark = documents.sparkSession
    row = config.first()
    shares = {name: row["splits"][name] for name in SPLITS}
    seed = str(row["seed"])
    records = written(related(documents).select("doc_id", F.coalesce("component", F.concat(F.lit("d:"), F.col("doc_id").cast("string"))).alias("component")), "related")
    sized = written(records.groupBy("component").agg(F.count("*").alias("size")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(BUCKETS))), "sized")
    plan = choose({r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}, shares)
    # Within a size, components are taken in seeded hash order: rank = those of earlier buckets + place in the bucket.
    per_bucket = sized.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = per_bucket.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("size", "bucket").orderBy("component"))
    ranked = sized.withColumn("place", place).join(before.select("size", "bucket", "before"), ["size", "bucket"]).withColumn("rank", F.col("before") + F.col("place"))
    names = list(plan)
    bounds = spark.createDataFrame(
        [(s, plan[names[0]].get(s, 0), plan[names[0]].get(s, 0) + plan[names[1]].get(s, 0)) for s in set(plan[names[0]]) | set(plan[names[1]])], "size long, first long, second long")
    placed = ranked.join(bounds, "size", "left").select(
        "component", F.when(F.col("rank") <= F.col("first"), names[0]).when(F.col("rank") <= F.col("second"), names[1]).otherwise(SPLITS[0]).alias("new_split"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt")
    return records.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int")).join(placed.select("component", "new_split", salts), ["component", "salt"]).select("doc_id", "component", "new_split")


def shares_report(assigned: DataFrame, config: DataFrame) -> DataFrame:
    """Target and actual share of documents per split."""
    targets = config.select(F.explode("splits").alias("new_split", "target_share"))
    counts = assigned.groupBy("new_split").agg(F.count("*").alias("n_docs"), F.countDistinct("component").alias("n_components"))
    total = counts.agg(F.sum("n_docs").alias("total"))
    return targets.join(counts, "new_split", "left").crossJoin(F.broadcast(total)).select(
        "new_split", "target_share", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_components", F.lit(0)).alias("n_components"),
        (F.coalesce("n_docs", F.lit(0)) / F.col("total")).alias("actual_share"))
