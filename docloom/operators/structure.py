"""Documents into blocks and chunks with exact character provenance.

Results by case: null or empty texts have no blocks and no chunks; repeated rows give
repeated results; texts of any length are processed whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.functions import text as T

CHUNK_CHARS, CHUNK_STEP = 1200, 1000


def paragraphs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_index, text, char_start, char_end): the parts between empty lines, with their places in the text."""
    parts = documents.where(F.length(text) > 0).select(key, F.posexplode(F.split(text, "\n\n")).alias("block_index", "text"))
    w = W.partitionBy(key).orderBy("block_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.length("text") + 2).over(w) - 2
    return parts.withColumn("char_end", end).withColumn("char_start", F.col("char_end") - F.length("text"))


def with_sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds heading, section (the last heading above, a heading's own text on its own row)."""
    heading = F.when(T.is_heading(F.col("text")), F.col("text"))
    above = F.last(F.regexp_replace("heading", r"\s+", " "), True).over(W.partitionBy(key).orderBy("block_index").rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("heading", heading).withColumn("section", F.coalesce("heading", above))


def heading_stack(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds path: at every row the headings of levels 1 to 4 still open above it (or on it), deepest last.

    A heading closes all headings of its level and deeper.
    """
    level = F.when(T.element_class(F.col("text")) == "heading", T.section_level(F.col("text")))
    rows = blocks.withColumn("level", level)
    upto = W.partitionBy(key).orderBy("block_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    for n in range(1, 5):
        at = F.when(F.col("level") == n, F.struct("block_index", "text"))
        rows = rows.withColumn(f"open_{n}", F.last(at, True).over(upto)).withColumn(f"last_{n}", F.max(F.when(F.col("level") < n, F.col("block_index"))).over(upto))
    kept = [F.when(F.col(f"open_{n}.block_index") > F.coalesce(f"last_{n}", F.lit(-1)), F.col(f"open_{n}.text")) for n in range(1, 5)]
    return rows.withColumn("path", F.array_compact(F.array(*kept))).drop(*[f"{p}_{n}" for p in ("open", "last") for n in range(1, 5)])


def reconstructed(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): blocks put together again in order."""
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def chunk_windows(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, char_start, char_end, text): windows of 1,200 characters every 1,000, the last one ending the text."""
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(CHUNK_STEP)), lambda x: (x == 0) | (x + (CHUNK_CHARS - CHUNK_STEP) < n))
    rows = documents.where(n > 0).select(key, text, n.alias("n"), F.posexplode(starts).alias("chunk_index", "char_start"))
    return rows.select(key, "chunk_index", "char_start", F.least(F.col("char_start") + CHUNK_CHARS, "n").alias("char_end"), F.substring(F.col(text), F.col("char_start") + 1, F.lit(CHUNK_CHARS)).alias("text"))


def chunk_blocks(chunks: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, block_index): blocks that overlap a chunk.

    A range join on top of the key; a block is offered only to the chunks whose windows
    it can touch, so long documents don't pair all blocks with all chunks.
    """
    first = F.greatest(F.lit(0), F.floor((F.col("b.char_start") - CHUNK_CHARS) / CHUNK_STEP) + 1)
    b = blocks.alias("b").select(F.col(key), "b.block_index", "b.char_start", "b.char_end", F.explode(F.sequence(first, F.greatest(first, F.floor((F.col("b.char_end") - 1) / CHUNK_STEP)))).alias("chunk_index"))
    c = chunks.select(key, "chunk_index", F.col("char_start").alias("c_start"), F.col("char_end").alias("c_end"))
    return b.join(c, [key, "chunk_index"]).where("char_start < c_end and char_end > c_start").select(key, "chunk_index", "block_index")


def token_pieces(tokens: DataFrame, key: str, size: int = 800, overlap: int = 60) -> DataFrame:
    """tokens(key, tokens array) -> sliding pieces of `size` tokens that share `overlap` with the one before."""
    n = F.size("tokens")
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)), lambda x: (x == 0) | (x + overlap < n))
    return tokens.where(n > 0).select(key, "tokens", F.posexplode(starts).alias("piece", "start")).select(key, "piece", "start", F.slice("tokens", F.col("start") + 1, F.lit(size)).alias("tokens"))


def pack_elements(elements: DataFrame, key: str, least: int = 300, target: int = 600, most: int = 800) -> DataFrame:
    """elements(key, order_index, kind, n_tokens) -> (key, chunk, order_index, kind): greedy packing in reading order.

    A chunk closes before an element that would pass `most`, after reaching `target`, and
    at a heading once it has `least`; tables and images stand alone.  Order decides every
    cut, so each document's elements (ids and sizes only) are folded in one group.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, size, out = 0, 0, []
        used = False
        for kind, n in pdf.sort_values("order_index")[["kind", "n_tokens"]].itertuples(index=False):
            alone = kind in ("table", "image")
            if used and (alone or size + n > most or (kind == "heading" and size >= least)):
                chunk, size, used = chunk + 1, 0, False
            out.append(chunk)
            size, used = size + n, True
            if alone or size >= target:
                chunk, size, used = chunk + 1, 0, False
        return pdf.sort_values("order_index")[[key, "order_index", "kind"]].assign(chunk=out)

    kind_of = dict(elements.dtypes)
    return elements.select(key, "order_index", "kind", "n_tokens").groupBy(key).applyInPandas(fold, f"{key} {kind_of[key]}, order_index {kind_of['order_index']}, kind string, chunk int")


def page_segments(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, segment, text): a page's lines grouped into segments.

    A segment ends after a line that ends with a full stop when the line after it is a
    page mark or is long and dense.
    """
    lines = pages.where(F.length(text) > 0).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    w = W.partitionBy(key).orderBy("line_no")
    blanks = F.length("line") - F.length(F.regexp_replace("line", r"\s", ""))
    starts = F.trim(F.lag("line").over(w)).endswith(".") & (F.trim("line").rlike(r"^-\s*\d+\s*-$") | ((F.length("line") >= 75) & (blanks / F.length("line") < 0.20)))
    rows = lines.withColumn("starts", F.coalesce(starts, F.lit(False)).cast("int"))
    rows = rows.withColumn("segment", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.groupBy(key, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def raw_elements(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, order_index, kind, text): paragraphs told apart as table (markdown rows), image mark or text."""
    parts = documents.where(F.length(text) > 0).select(key, F.posexplode(F.split(text, "\n\n")).alias("order_index", "text"))
    lines = F.split("text", "\n")
    kind = F.when(F.forall(lines, lambda x: F.contains(x, F.lit("|"))), "table").when(F.col("text").rlike(r"^!\[.*\]\(.*\)$"), "image").otherwise("text")
    return parts.where(F.trim("text") != "").withColumn("kind", kind)


def table_cells(elements: DataFrame, key: str) -> DataFrame:
    """(key, order_index, row, col, cell) of table elements; separator rows are dropped."""
    tables = elements.where("kind = 'table'")
    rows = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^[\s|:-]+$"))
    cells = tables.select(key, "order_index", F.posexplode(rows).alias("row", "line"))
    trimmed = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    return cells.select(key, "order_index", "row", F.posexplode(F.transform(F.split(trimmed, r"\|"), lambda x: F.trim(x))).alias("col", "cell"))


def rows_to_markdown(rows):
    """An array of rows as markdown lines; bars in cells are escaped."""
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))), "\n")
