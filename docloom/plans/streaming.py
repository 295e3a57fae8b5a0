"""Streaming queries: each reads its table as a stream and runs it over all that is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.operators.chat import spoken_by, token_frames
from docloom.plans.activity import ORACLE as _ACTIVITY
from docloom.session import shared_dir, table
from docloom.streaming import streams as T


def _stream(s, d, name):
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parq*t")


def _done(stream, s):
    """Write what the stream gives to the shared folder and read it."""
    at = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    T.append_available(stream, f"{at}/out", f"{at}/state")
    return s.read.schema(stream.schema).parquet(f"{at}/out")


def _windows(s, d):
    e = _stream(s, d, "events").select("ts", "event_type", "value")
    return _done(T.windowed_counts(e, "ts", "event_type"), s).select(F.unix_timestamp("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


def _first(s, d):
    b = _stream(s, d, "blocks").where("block_id is not null and ingested_at is not null").select(F.upper(F.trim("block_id")).alias("k"), "ingested_at")
    return _done(T.first_deliveries(b, ["k"], "ingested_at", "3650 days"), s).select("k")


def _sessions(s, d):
    e = _stream(s, d, "events").where("user_id is not null").select("ts", "user_id")
    return _done(T.sessions(e, "ts", "user_id"), s).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def _folded(s, d):
    """Answers of the history sent as frames and folded again with state per answer."""
    h = table(s, d, "history").where((spoken_by(F.col("role")) == "assistant") & F.col("content").isNotNull())
    frames = token_frames(h, "history_id", "content").select(F.col("history_id").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "kind", "token")
    at = f"{shared_dir(s)}/frames-{uuid.uuid4().hex}"
    frames.write.parquet(at)
    stream = s.readStream.schema(frames.schema).parquet(at)
    return _done(T.fold_tokens(stream), s).select(F.col("key").cast("long").alias("history_id"), "text")


QUERIES = {"stream_windows": _windows, "stream_first_deliveries": _first, "stream_sessions": _sessions, "stream_folded_answers": _folded}

ORACLE = {
    "stream_folded_answers": _ACTIVITY["folded_answers"],
    # Sessions past the watermark only, as with windows.
    "stream_sessions": """
WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) ts, coalesce((CAST(ts AS TIMESTAMP) - lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT, 1) new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) k FROM e), g AS (SELECT user_id, min(ts) a, max(ts) b, count(*) n FROM i GROUP BY user_id, k)
SELECT user_id, epoch_us(a) AS start_us, epoch_us(b + INTERVAL 30 MINUTE) AS end_us, n FROM g WHERE b + INTERVAL 30 MINUTE <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL 2 DAY""",
    "stream_first_deliveries": "SELECT DISTINCT upper(trim(block_id)) AS k FROM blocks WHERE block_id IS NOT NULL AND ingested_at IS NOT NULL",
    # Windows past the watermark, which trails the last event by two days, are still open.
    "stream_windows": """
SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2""",
}
