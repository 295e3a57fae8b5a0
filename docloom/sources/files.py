"""Readers: source files, metadata tables, JSON lines.

Results by case: an empty folder raises; blank JSON lines are skipped; a metadata row
without any alias or an alias claimed by two rows raises in checked_metadata.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.text import nfc

# Suffixes read, names a metadata row may be found by, first bytes of file kinds.
SUFFIXES = ("hwp", "pdf")
ALIASES = ("source_document_id", "canonical_document_id", "document_id", "original_name", "short_name")
MAGIC = {"HWP": "D0CF11E0A1B11AE1", "ZIP": "504B0304", "PDF": "25504446"}


def source_files(spark: SparkSession, folder: str, suffixes=SUFFIXES) -> DataFrame:
    """(name, path, size, suffix, sha256, source_document_id, content) of the files with the suffixes, any letter case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = files.where(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$"))
    name = nfc(F.regexp_extract("path", r"([^/]+)$", 1))
    digest = F.sha2("content", 256)
    return rows.select(name.alias("name"), "path", F.col("length").alias("size"), F.upper(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("suffix"), digest.alias("sha256"),
                       F.concat(F.lit("SRC_"), F.sha2(F.concat(name, F.lit("\x00"), digest), 256)).alias("source_document_id"), "content")


def unzipped(files: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """(archive, name, content) of the members of zip files; broken archives give a row with null name."""

    def members(batches):
        for pdf in batches:
            rows = []
            for archive, content in zip(pdf["name"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows.extend((archive, n, z.read(n)) for n in z.namelist() if n.lower().rsplit(".", 1)[-1] in suffixes)
                except (zipfile.BadZipFile, RuntimeError):
                    rows.append((archive, None, None))
            yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    return files.select("name", "content").mapInPandas(members, "archive string, name string, content binary")


def file_kind(content):
    """HWP, ZIP, PDF or HTML by a file's first bytes, else OTHER."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.when(F.lower(F.decode(F.substring(content, 1, 64), "ISO-8859-1")).rlike(r"^\s*<(?:!doctype html|html)"), "HTML")
    for kind, magic in MAGIC.items():
        out = out.when(head.startswith(magic), kind)
    return out.otherwise("OTHER")


def aliases(metadata: DataFrame, row_id: str) -> DataFrame:
    """(alias, row_id): every name a metadata row may be found by, composed."""
    names = [c for c in ALIASES if c in metadata.columns]
    found = F.array_distinct(F.filter(F.array(*[nfc(F.trim(F.col(c))) for c in names]), lambda x: x.isNotNull() & (x != "")))
    return metadata.select(F.col(row_id).alias("row_id"), F.explode_outer(found).alias("alias"))


def checked_metadata(metadata: DataFrame, row_id: str) -> DataFrame:
    """aliases(), after making sure that each row has one and no two rows share one."""
    found = aliases(metadata, row_id)
    if found.where("alias is null").limit(1).count():
        raise ValueError("a metadata row has no alias")
    twice = found.groupBy("alias").agg(F.countDistinct("row_id").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError("aliases used twice: " + ", ".join(r["alias"] for r in twice))
    return found


def read_metadata(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV with header; a byte order mark and quoted line breaks are allowed."""
    return spark.read.option("header", "true").option("multiLine", "true").option("encoding", "UTF-8").schema(schema).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def contract_chunks(chunks: DataFrame) -> DataFrame:
    """Nested chunks in either known layout as contract rows; the document id is looked for in three places."""
    has = set(chunks.columns)
    meta = {f.name for f in chunks.schema["metadata"].dataType.fields} if "metadata" in has else set()
    pick = lambda *names: F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names if n in has or (n.startswith("metadata.") and n[9:] in meta)], F.lit(None).cast("string"))
    path = F.col("metadata.section_path") if "section_path" in meta else F.col("section_path") if "section_path" in has else F.array().cast("array<string>")
    return chunks.select("chunk_id", pick("document_id", "metadata.document_id", "metadata.canonical_doc_id").alias("document_id"), F.coalesce(pick("split", "metadata.semantic_role"), F.lit("LIVE_DEV")).alias("split"), "text",
                         F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != "")).alias("section_path"))


def contract_documents(documents: DataFrame) -> DataFrame:
    """Documents in the collector's layout as contract rows: the id in two places, Korean names of title, agency and amount, NaN as null."""
    has = set(documents.columns)
    col = lambda name: F.col(f"`{name}`") if name in has else F.lit(None).cast("string")
    text = lambda name: F.when(F.trim(col(name)) != "", F.trim(col(name)))
    amount = F.lit(None).cast("double")
    if "사업금액" in has:
        number = col("사업금액").try_cast("double")
        amount = F.when(~F.isnan(number), number)
    return documents.select(
        F.coalesce(text("document_id"), text("canonical_doc_id")).alias("document_id"), text("사업명").alias("title"), text("발주기관").alias("agency"), amount.alias("budget_amount"),
        F.coalesce(text("budget_status"), F.lit("")).alias("budget_status"), F.coalesce(text("split"), F.lit("LIVE_DEV")).alias("split"))
