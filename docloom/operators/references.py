"""Orphan references: blocks and chunks that point to records missing, deleted or late.

Method: keys are range-partitioned; each range holds its parents as one sorted
array, and the reference keys of the range are probed batch by batch with binary
search.  References are reduced to one row per key before that shuffle (with the
earliest referring time), so a key that a third of all rows share costs one row
per task.  Only keys that fail go back to the references, over a salted join.

Results by case: null keys are no reference; an empty key (blanks only) is a
reference to the empty id, which is missing; empty tables give empty results; rows
with null record ids are kept as records of their own; a record delivered several
times counts once, at its earliest ingested_at (ties: smallest remaining values).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import canonical_id, written

SALTS = 8
KEYS_PER_RANGE = 1_000_000


def first_delivery(df: DataFrame, id_col: str, refs: list[str]) -> DataFrame:
    """One row per id: the earliest delivery's references; deleted if any delivery was.

    Columns: key, record_id, refs..., at (may be null), gone.
    """
    rows = df.select(
        canonical_id(F.col(id_col)).alias("key"),
        F.struct(F.col("ingested_at").isNull().alias("n"), F.col("ingested_at").alias("at"), F.col(id_col).alias("record_id"),
                 *[F.col(c) for c in refs]).alias("first"),
        F.col("deleted_at").isNotNull().alias("gone"),
    )
    known = rows.where("key is not null").groupBy("key").agg(F.min("first").alias("first"), F.max("gone").alias("gone"))
    return known.unionByName(rows.where("key is null")).select("key", "first.record_id", *[f"first.{c}" for c in refs], "first.at", "gone")


def _probe(batches):
    """Within one key range, sorted by (kind of row, key): parents first, then reference keys."""
    keys, at, gone, built = [], [], [], None
    for pdf in batches:
        parents = pdf[pdf["is_parent"]]
        if len(parents):
            keys.append(parents["key"].str.encode("utf-8").to_numpy())
            at.append(parents["at"].to_numpy(dtype="float64"))
            gone.append(parents["gone"].to_numpy(dtype=bool))
            built = None
        refs = pdf[~pdf["is_parent"]]
        if not len(refs):
            continue
        if built is None:
            built = (np.concatenate(keys), np.concatenate(at), np.concatenate(gone)) if keys else (np.array([], object), np.array([]), np.array([], bool))
        k, t, g = built
        probe = refs["key"].str.encode("utf-8").to_numpy()
        if len(k):
            pos = np.minimum(np.searchsorted(k, probe), len(k) - 1)
            hit = k[pos] == probe
            dead, when = g[pos], t[pos]
        else:
            hit = dead = np.zeros(len(probe), bool)
            when = np.full(len(probe), np.nan)
        late = hit & ~dead & (when > refs["at"].to_numpy(dtype="float64"))
        bad = ~hit | dead | late
        state = np.where(~hit, "missing", np.where(dead, "deleted", "late"))
        yield pd.DataFrame({"key": refs["key"].to_numpy()[bad], "parent_at": np.where(late, when, np.nan)[bad], "state": state[bad]})


def orphan_references(documents: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """table_name, record_id, ref_field, ref_id, ref_state, month of the referring record."""
    b = written(first_delivery(blocks, "block_id", ["document_id"]), "first-blocks")
    c = written(first_delivery(chunks, "chunk_id", ["document_id", "block_ids"]), "first-chunks")
    micros = F.unix_micros("at").cast("double")

    def refs(df, name, field, ids):
        return df.where("not gone").select(F.lit(name).alias("table_name"), "record_id", F.lit(field).alias("ref_field"), ids.alias("ref_id"), "at").where("ref_id is not null")

    one = canonical_id(F.col("document_id"))
    many = F.explode(F.array_distinct(F.transform("block_ids", lambda x: canonical_id(x))))
    all_refs = (
        refs(b, "blocks", "document_id", one)
        .unionByName(refs(c, "chunks", "document_id", one))
        .unionByName(refs(c, "chunks", "block_ids", many))
        .withColumn("key", F.concat(F.when(F.col("ref_field") == "document_id", F.lit("d:")).otherwise(F.lit("b:")), "ref_id"))
    )
    parents = documents.where("document_id is not null").groupBy(F.concat(F.lit("d:"), canonical_id(F.col("document_id"))).alias("key")).agg(
        F.unix_micros(F.min("ingested_at")).cast("double").alias("at"), F.max(F.col("deleted_at").isNotNull()).alias("gone"))
    parents = parents.unionByName(b.where("key is not null").select(F.concat(F.lit("b:"), "key").alias("key"), micros.alias("at"), "gone"))
    asked = all_refs.groupBy("key").agg(F.min(micros).alias("at"))
    keys = written(
        parents.withColumn("is_parent", F.lit(True)).unionByName(asked.withColumn("gone", F.lit(False)).withColumn("is_parent", F.lit(False))), "reference-keys")
    n = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // KEYS_PER_RANGE))
    failed = (
        keys.repartitionByRange(n, "key").sortWithinPartitions(F.desc("is_parent"), "key")
        .mapInPandas(_probe, "key string, parent_at double, state string")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = all_refs.withColumn("salt", F.pmod(F.xxhash64("record_id", "table_name", "ref_field"), F.lit(SALTS)).cast("int"))
    return (
        salted.join(failed, ["key", "salt"])
        .where((F.col("state") != "late") | (F.col("parent_at") > micros))
        .select("table_name", "record_id", "ref_field", "ref_id", F.col("state").alias("ref_state"), F.date_format("at", "yyyy-MM").alias("month"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field, state and month of ingested_at."""
    return orphans.groupBy("table_name", "ref_field", "ref_state", "month").agg(F.count("*").alias("n_orphans"))
