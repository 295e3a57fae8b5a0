"""Writers: deterministic JSON lines, gated datasets, manifests, checked indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.validation import require


def write_jsonl(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """Rows as JSON with sorted keys, range-sorted by `order` over the files, so the same rows give the same bytes."""
    rows = df.select(F.struct(*order).alias("_o"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    parts = rows.repartitionByRange(files, "_o") if files else rows.repartitionByRange("_o")
    parts.sortWithinPartitions("_o", "value").select("value").write.mode("overwrite").option("lineSep", "\n").text(path)


def write_dataset(tables: dict[str, DataFrame], broken: DataFrame, folder: str, order: dict[str, list[str]]) -> None:
    """Write the tables unless a check has failed."""
    require(broken)
    for name, df in tables.items():
        write_jsonl(df, f"{folder}/{name}", order[name])


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, digest) per table; the digest doesn't depend on the order of rows."""
    out = None
    for name, df in tables.items():
        line = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        # The sum of hash parts is the same in any order and counts repeated rows.
        part = lambda i: F.sum(F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
        one = df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("-", *[part(i).cast("string") for i in range(4)]), 256).alias("digest")).select(F.lit(name).alias("name"), "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def dataset_manifest(tables: dict[str, DataFrame], versions: dict[str, str], split: str = "split") -> DataFrame:
    """manifest() with the versions that made the tables and, where a table has splits, its rows per split."""
    rows = manifest(tables).withColumn("versions", F.create_map(*[F.lit(x) for pair in sorted(versions.items()) for x in pair]))
    counts = None
    for name, df in tables.items():
        if split in df.columns:
            per = df.groupBy(F.coalesce(F.upper(F.trim(split)), F.lit("(none)")).alias("s")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("splits"))
            per = per.select(F.lit(name).alias("name"), "splits")
            counts = per if counts is None else counts.unionByName(per)
    return rows if counts is None else rows.join(counts, "name", "left")


def write_formats(tables: dict[str, DataFrame], folder: str, order: dict[str, list[str]]) -> None:
    """Every table as JSON lines, and as CSV with arrays and maps written as JSON."""
    for name, df in tables.items():
        write_jsonl(df, f"{folder}/{name}.jsonl", order[name])
        flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def write_index(vectors: DataFrame, path: str, scope: str, buckets: int = 64, rows_per_task: int = 250_000) -> int:
    """Vectors in folders by scope bucket, so a scoped search reads one folder; raises unless every row is there again.

    Every bucket is written by as many tasks as its rows need, so a scope may hold any share.
    """
    placed = vectors.withColumn("scope_bucket", F.pmod(F.xxhash64(scope), F.lit(buckets)).cast("int"))
    tasks = placed.groupBy("scope_bucket").agg(F.ceil(F.count("*") / rows_per_task).alias("_tasks"))  # a row per bucket
    parts = max(buckets, tasks.agg(F.sum("_tasks")).first()[0] or 0)
    spread = placed.join(F.broadcast(tasks), "scope_bucket").withColumn("_part", F.pmod(F.xxhash64(*vectors.columns), F.col("_tasks")))
    spread.repartition(parts, "scope_bucket", "_part").drop("_tasks", "_part").write.mode("errorifexists").partitionBy("scope_bucket").parquet(path)
    there, here = vectors.sparkSession.read.parquet(path).count(), vectors.count()
    if there != here:
        raise ValueError(f"index incomplete: {there} of {here} rows")
    return there


def read_index(spark, path: str, scope: str, value, buckets: int = 64) -> DataFrame:
    """The rows of one scope; only its folder is read."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets)).cast("int")).first()[0]
    return spark.read.parquet(path).where((F.col("scope_bucket") == bucket) & (F.col(scope) == value))


def write_split(assigned: DataFrame, report: DataFrame, folder: str) -> None:
    """split.csv with a header, one row per source in order, and split.json with the target report."""
    assigned.orderBy("source_document_id").write.mode("overwrite").option("header", True).csv(f"{folder}/split.csv")
    write_jsonl(report, f"{folder}/split.json", ["split"], 1)


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys aren't in the table yet; returns what was appended."""
    spark = df.sparkSession
    try:
        seen = spark.read.parquet(path).select(*keys).distinct()
        fresh = df.dropDuplicates(keys).join(seen, keys, "left_anti")
    except Exception as e:  # the first append
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df.dropDuplicates(keys)
    fresh = fresh.persist()
    fresh.write.mode("append").parquet(path)
    return fresh
