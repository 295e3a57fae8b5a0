"""Conversation windows, paging, prompt parts and model output parsing.

Results by case: rows with a null conversation are left out; blank or non-dialogue rows
are dropped from windows; ties in time go to the smaller id; very long messages are kept
or dropped whole.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from docloom.functions.text import strip
from docloom.session import canonical_id

ANSWER = StructType([StructField("answer", StringType()), StructField("abstained", BooleanType()), StructField("sources", StringType()), StructField("parse_ok", BooleanType())])

# Spellings of the speakers in roles and senders.
SPEAKERS = {"user": ("user", "human", "사용자"), "assistant": ("assistant", "ai", "bot", "어시스턴트"), "system": ("system", "시스템")}


def spoken_by(col):
    """The speaker that a role or sender names in any spelling, else null."""
    name = F.lower(F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    out = F.lit(None).cast("string")
    for who, spellings in SPEAKERS.items():
        out = F.when(name.isin(*spellings), who).otherwise(out)
    return out


def chat_time(col):
    """Any of the stored date formats as a timestamp; null for others."""
    return F.try_to_timestamp(F.substring(F.regexp_replace(col, r"[^0-9]", ""), 1, 14), F.lit("yyyyMMddHHmmss"))


def history_window(messages: DataFrame, max_turns: int = 3, max_chars: int = 400) -> DataFrame:
    """messages(conv_id, pos, role, content) -> the window a model is given.

    Keeps user and assistant messages with content, of those the last 2 x max_turns, drops
    the oldest while their characters exceed max_chars, then leading assistant messages.
    """
    rows = messages.where("conv_id is not null").select("conv_id", "pos", F.lower(strip(F.col("role"))).alias("role"), strip(F.col("content")).alias("content"))
    rows = rows.where(F.col("role").isin("user", "assistant") & (F.col("content") != ""))
    back = W.partitionBy("conv_id").orderBy(F.desc("pos"), F.desc("role"), F.desc("content"))
    rows = rows.withColumn("rn", F.row_number().over(back)).withColumn("chars", F.sum(F.length("content")).over(back.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.where((F.col("rn") <= 2 * max_turns) & (F.col("chars") <= max_chars))
    first_user = F.min(F.when(F.col("role") == "user", F.col("pos"))).over(W.partitionBy("conv_id"))
    return rows.withColumn("from", first_user).where("pos >= `from`").select("conv_id", "pos", "role", "content")


def last_chat(documents: DataFrame, chat: DataFrame) -> DataFrame:
    """Documents with their number of messages and the time of the last one."""
    per = chat.groupBy(canonical_id(F.col("documentid")).alias("k")).agg(F.count("*").alias("n_messages"), F.max(chat_time(F.col("chatdate"))).alias("last_at"), F.max_by("id", F.struct(chat_time(F.col("chatdate")), "id")).alias("last_id"))
    return documents.select("doc_id", canonical_id(F.col("document_id")).alias("k")).join(per, "k", "left").select("doc_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), F.unix_timestamp("last_at").alias("last_at"), "last_id")


def pages(chat: DataFrame, size: int = 30) -> DataFrame:
    """(k, page, place, id): every document's messages on numbered pages, newest first.

    Messages are numbered within the days of a document and days by running counts, so no
    document's messages are sorted in one task.
    """
    at = chat_time(F.col("chatdate"))
    rows = chat.where("documentid is not null").select(canonical_id(F.col("documentid")).alias("k"), at.alias("at"), "id")
    rows = rows.withColumn("part", F.struct(F.col("at").isNull().alias("late"), F.coalesce(-F.unix_date(F.to_date("at")), F.floor(-F.col("id") / 8192).cast("int")).alias("day")))
    counts = rows.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(W.partitionBy("k", "part").orderBy(F.desc_nulls_last("at"), F.desc("id")))
    placed = rows.withColumn("inner", inner).join(counts.select("k", "part", before.alias("before")), ["k", "part"]).withColumn("place", F.col("before") + F.col("inner") - 1)
    return placed.select("k", F.floor(F.col("place") / size).alias("page"), (F.col("place") % size).alias("place"), "id")


def page(chat: DataFrame, document: str, number: int, size: int = 30) -> DataFrame:
    """One page of a document's messages, newest first."""
    rows = chat.where(canonical_id(F.col("documentid")) == document.strip().upper())
    return rows.orderBy(F.desc_nulls_last(chat_time(F.col("chatdate"))), F.desc("id")).offset(number * size).limit(size)


def day_separators(chat: DataFrame) -> DataFrame:
    """(k, day, n_messages, first_id): a separator row for each day of a document's messages."""
    rows = chat.where("documentid is not null").select(canonical_id(F.col("documentid")).alias("k"), F.to_date(chat_time(F.col("chatdate"))).alias("day"), "id", chat_time(F.col("chatdate")).alias("at"))
    return rows.where("day is not null").groupBy("k", "day").agg(F.count("*").alias("n_messages"), F.min_by("id", F.struct("at", "id")).alias("first_id"))


def context_block(hits):
    """An array of hits(chunk_id, section_path, requirement_ids, text) as prompt text."""
    def joined(x, sep):
        text = F.array_join(F.coalesce(x, F.array().cast("array<string>")), sep)
        return F.when(text == "", "-").otherwise(text)

    part = lambda h: F.concat(F.lit("[chunk_id: "), h["chunk_id"], F.lit("] (section: "), joined(h["section_path"], " > "), F.lit(" / requirement: "), joined(h["requirement_ids"], ", "), F.lit(")\n"), F.coalesce(h["text"], F.lit("")))
    return F.when(F.size(hits) > 0, F.array_join(F.transform(hits, part), "\n\n")).otherwise("NO_HIT")


def prompt_messages(system, history, question):
    """System message, history and question as one array of (role, content)."""
    one = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    return F.concat(one("system", system), history, one("user", question))


def without_thinking(col):
    """Output without the model's thinking, whether its tags are closed, only closed, or never closed."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), r"(?s)<think>.*?</think>", "")
    text = F.regexp_replace(text, r"(?s)^(?:(?!<think>).)*?</think>", "")
    return strip(F.regexp_replace(text, r"(?s)<think>.*$", ""))


@F.pandas_udf(ANSWER)
def parse_answer(texts: pd.Series) -> pd.DataFrame:
    """The answer object of a model's output: the whole text as JSON, else its last complete object, else the text itself."""
    decoder, rows = json.JSONDecoder(), []
    for text in texts:
        body = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip())
        obj = None
        for at in [0, *sorted((m.start() for m in re.finditer(r"\{", body)), reverse=True)]:
            try:
                found, end = decoder.raw_decode(body, at)
            except ValueError:
                continue
            if isinstance(found, dict) and (at or not body[end:].strip()):
                obj = found
                break
        if obj is None:
            rows.append((body, False, "[]", False))
        else:
            answer = obj.get("answer", "")
            rows.append((answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False), bool(obj.get("abstained", False)), json.dumps(obj.get("sources", []), ensure_ascii=False), True))
    return pd.DataFrame(rows, columns=["answer", "abstained", "sources", "parse_ok"])


def token_frames(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, kind, token): SOS, one TOKEN per word, EOS, as an answer is streamed."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    frames = F.concat(F.array(F.struct(F.lit("SOS").alias("kind"), F.lit(None).cast("string").alias("token"))), F.transform(words, lambda w: F.struct(F.lit("TOKEN").alias("kind"), w.alias("token"))),
                      F.array(F.struct(F.lit("EOS").alias("kind"), F.lit(None).cast("string").alias("token"))))
    return answers.where(F.col(text).isNotNull()).select(key, F.posexplode(frames).alias("seq", "frame")).select(key, "seq", "frame.kind", "frame.token")


def fold_frames(frames: DataFrame, key: str) -> DataFrame:
    """Frames back to (key, text), for streams that reached EOS."""
    x = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "token"))).alias("f")).where(F.exists("f", lambda e: e["kind"] == "EOS"))
    return x.select(key, F.array_join(F.transform(F.filter("f", lambda e: e["kind"] == "TOKEN"), lambda e: e["token"]), " ").alias("text"))
