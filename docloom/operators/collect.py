"""Incremental collection: period pieces, latest versions, weekly round robin, unseen keys.

Results by case: unknown dates form the last week; ties are broken by the key; repeated
rows of one key count once where a key is said to be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.functions.text import iso_week


def period_pieces(periods: DataFrame, days: int = 30) -> DataFrame:
    """periods(key, start, end) -> (key, piece, start, end): pieces of at most `days`, each a minute after the one before."""
    stride = F.expr(f"interval {days} days 1 minute")
    at = F.filter(F.sequence("start", "end", stride), lambda x: x <= F.col("end"))
    return periods.where(F.col("start") <= F.col("end")).select("key", "end", F.posexplode(at).alias("piece", "from")).select(
        "key", "piece", F.col("from").alias("start"), F.least(F.col("from") + F.expr(f"interval {days} days"), "end").alias("end"))


def latest_version(rows: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """The row of each key with the greatest version compared as text; a blank version is 0, the later row wins ties."""
    order = F.struct(F.coalesce(F.when(F.col(version) != "", F.col(version)), F.lit("0")).alias("v"), F.col(tie))
    best = F.max_by(F.struct(*rows.columns), order).alias("r")
    return rows.groupBy(F.col(key).alias("_k")).agg(best).select("r.*")


def weekly_round_robin(rows: DataFrame, date: str, priority: list[str], size: int) -> DataFrame:
    """The first `size` rows when weeks take turns, each week giving its best row by priority; unknown weeks come last.

    A week's place `turn` is at most `size`, so later rows of a week are dropped before the
    global order is made.
    """
    weeks = rows.withColumn("week", iso_week(F.col(date)))
    turned = weeks.withColumn("turn", F.row_number().over(W.partitionBy("week").orderBy(*priority))).where(F.col("turn") <= size)
    chosen = turned.orderBy("turn", F.col("week") == "unknown", "week").limit(size)
    return chosen


def unseen(new: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys were not seen before, one per key."""
    return new.join(seen.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def gaps(events: DataFrame, key: str, at: str, minutes: int = 30) -> DataFrame:
    """(key, island, n, first_at, last_at): runs of events less than `minutes` apart."""
    w = W.partitionBy(key).orderBy(at)
    new = F.coalesce((F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(w)) > minutes * 60).cast("int"), F.lit(0))
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("new", new)
    rows = rows.withColumn("island", F.sum("new").over(w.rangeBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy(key, "island").agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def paired_names(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, fields map) -> (key, url, name): each url field with the name field of the same number whose stem is most alike."""
    long = rows.select(key, F.explode("fields").alias("field", "value")).where("value is not null and value <> ''")
    long = long.withColumn("number", F.regexp_extract("field", r"(\d*)$", 1)).withColumn("stem", F.regexp_replace(F.lower("field"), r"(?:url|name|nm)?\d*$", ""))
    urls = long.where(F.lower("field").rlike(r"url\d*$")).select(key, "number", F.col("field").alias("url_field"), F.col("value").alias("url"), F.col("stem").alias("us"))
    names = long.where(F.lower("field").rlike(r"(?:name|nm)\d*$")).select(key, "number", F.col("value").alias("name"), F.col("stem").alias("ns"))
    common = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("us"), F.length("ns")))), F.lit(0), lambda acc, i: F.when(F.substring("us", 1, i) == F.substring("ns", 1, i), i).otherwise(acc))
    best = urls.join(names, [key, "number"], "left").withColumn("common", F.when(F.col("ns").isNotNull(), common).otherwise(-1))
    return best.groupBy(key, "url_field", "url").agg(F.max_by("name", F.struct("common", "name")).alias("name"))
