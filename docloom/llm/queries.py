"""Queries and oracle SQL of the numbered problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.llm import group_split, lookalike, mixing, overlap, packing, scans, threads, truncation
from docloom.session import table, written


def _assign_checks(s, d):
    """Documents per split, and components that lie in more than one, which must be none."""
    a = written(group_split.assign(table(s, d, "documents"), table(s, d, "custom_split")), "assigned")
    torn = a.groupBy("component").agg(F.countDistinct("new_split").alias("n")).where("n > 1").agg(F.count("*").alias("n_torn"))
    return a.groupBy("new_split").agg(F.count("*").alias("n_docs"), F.countDistinct("doc_id").alias("n_distinct")).crossJoin(F.broadcast(torn))


def _pack_checks(s, d):
    """Per kind: documents packed; containers over capacity, texts divided though they fit, and texts with a piece missing, which must be none."""
    kinds = table(s, d, "pack_containers")
    p = written(packing.pack(table(s, d, "documents"), kinds), "packed").join(F.broadcast(kinds), "container_kind")
    over = p.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"), F.max("capacity_tokens").alias("c"))
    docs = p.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max("capacity_tokens").alias("c"), F.count("*").alias("pieces"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    flag = lambda condition, name: F.sum(F.when(condition, 1).otherwise(0)).alias(name)
    x = docs.groupBy("container_kind").agg(F.count("*").alias("n_docs"), flag((F.col("n") <= F.col("c")) & (F.col("pieces") > 1), "n_divided"), flag(F.col("end") != F.col("n"), "n_gaps"))
    return x.join(over.groupBy("container_kind").agg(flag(F.col("n") > F.col("c"), "n_over")), "container_kind")


def _mix_checks(s, d):
    """Per source: documents repeated too often, which must be none, and whether its share is met (within 0.02 of what it gets when sources without documents hand theirs on)."""
    docs, targets = table(s, d, "documents"), table(s, d, "mix_targets")
    chosen = written(mixing.mix(docs, targets), "mixed")
    goal = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeat").join(docs.select(F.lower(F.trim("source")).alias("source")).distinct().withColumn("there", F.lit(True)), "source", "left")
    met = goal.where("there").agg(F.sum("target_share").alias("there_share"))
    per = chosen.join(F.broadcast(goal), "source").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n"), F.sum((F.col("repeats") > F.col("max_repeat")).cast("int")).alias("n_over_repeat"))
    total = per.agg(F.sum("n").alias("total"))
    wanted = F.when(F.col("there"), F.col("target_share") / F.col("there_share")).otherwise(0.0)
    return goal.join(per, "source", "left").crossJoin(F.broadcast(met)).crossJoin(F.broadcast(total)).select(
        "source", F.coalesce("n_over_repeat", F.lit(0)).alias("n_over_repeat"), (F.abs(F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)) - wanted) <= 0.02).alias("met"))


QUERIES = {
    "p1_found": lambda s, d: lookalike.alike_pairs(table(s, d, "documents")),
    "p1_forms": lambda s, d: lookalike.consistent(table(s, d, "documents")),
    "p1_report": lambda s, d: lookalike.spelling_report(table(s, d, "documents")),
    "p2_found": lambda s, d: overlap.found(table(s, d, "documents")),
    "p2_report": lambda s, d: overlap.report(table(s, d, "documents")),
    "p7_pack": lambda s, d: packing.pack(table(s, d, "documents"), table(s, d, "pack_containers")),
    "p7_report": lambda s, d: packing.fill_report(table(s, d, "documents"), table(s, d, "pack_containers")),
    "p8_mix": lambda s, d: mixing.mix(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p3_found": lambda s, d: scans.noise(table(s, d, "documents"), table(s, d, "blocks")),
    "p3_repaired": lambda s, d: scans.repaired_records(table(s, d, "documents"), table(s, d, "blocks")),
    "p3_report": lambda s, d: scans.noise_report(table(s, d, "documents"), table(s, d, "blocks")),
    "p3_links": lambda s, d: scans.links(table(s, d, "documents")),
    "p4_found": lambda s, d: threads.broken(table(s, d, "history"), table(s, d, "chat_local")),
    "p4_conversations": lambda s, d: threads.conversations(table(s, d, "history"), table(s, d, "chat_local")),
    "p9_found": lambda s, d: truncation.found(table(s, d, "documents")),
    "p9_rates": lambda s, d: truncation.rates(table(s, d, "documents")),
    "p9_judged": lambda s, d: truncation.judged(table(s, d, "documents")),
    "p4_channel_threads": lambda s, d: threads.channel_threads(table(s, d, "chat_local")),
    "p5_checks": _assign_checks,
    "p7_checks": _pack_checks,
    "p8_checks": _mix_checks,
    "p5_found": lambda s, d: group_split.torn(group_split.related(table(s, d, "documents"))),
    "p5_assign": lambda s, d: group_split.assign(table(s, d, "documents"), table(s, d, "custom_split")),
    "p5_shares": lambda s, d: group_split.shares_report(group_split.assign(table(s, d, "documents"), table(s, d, "custom_split")), table(s, d, "custom_split")),
}

_SPEAKER = """CASE WHEN lower(trim({0})) IN ('user', 'human', '사용자') THEN 'user' WHEN lower(trim({0})) IN ('assistant', 'ai', 'bot', '어시스턴트') THEN 'assistant'
  WHEN lower(trim({0})) IN ('system', '시스템') THEN 'system' END"""



def _form_sql() -> str:
    """A value's form: kinds of blank as one, ignorable characters out, look-alikes by table, composed."""
    pairs = {chr(code): to for code, to in lookalike.TABLE.items()}
    quoted = ["".join(x).replace("'", "''") for x in (pairs, pairs.values())]
    fillers = "".join(f"\\x{{{c:04X}}}" for c in sorted(lookalike.FILLERS))
    bare = rf"regexp_replace(regexp_replace(v, '[\s\x{{0085}}\p{{Z}}]', ' ', 'g'), '[\p{{Cf}}\p{{Cc}}{fillers}]', '', 'g')"
    return f"nfc_normalize(translate(nfc_normalize(translate({bare}, '{quoted[0]}', '{quoted[1]}')), '{quoted[0]}', '{quoted[1]}'))"


_FORMS = f"""
v AS (SELECT doc_id, unnest(['title', 'source_filename_raw', 'source_filename_nfc']) field_name, unnest([title, source_filename_raw, source_filename_nfc]) v FROM documents),
f AS (SELECT doc_id, field_name, v, {_form_sql()} form FROM v WHERE v IS NOT NULL)
"""

ORACLE = {
    "p1_found": f"WITH {_FORMS} SELECT a.field_name, a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b USING (field_name, form) WHERE a.doc_id < b.doc_id AND a.v <> b.v",
    "p4_conversations": r"""
WITH m AS (SELECT conv_id, chat_id, c.id, nullif(upper(trim(documentid)), '') doc, content, try_strptime(regexp_replace(chatdate, '[^0-9]', '', 'g')[:14], '%Y%m%d%H%M%S') ts,
                  coalesce(""" + _SPEAKER.format("role") + ", " + _SPEAKER.format("sender") + r""") who
           FROM history LEFT JOIN chat_local c ON c.id = chat_id WHERE conv_id IS NOT NULL),
r AS (SELECT conv_id, who, content, ts, min(chat_id) chat_id, min(doc) doc FROM m WHERE regexp_replace(content, '[\s\p{Z}\p{Cc}\p{Cf}]', '', 'g') <> '' GROUP BY conv_id, who, content, ts),
u AS (SELECT *, lead(who) OVER w nxt, row_number() OVER w n FROM r WHERE who IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY ts NULLS FIRST, chat_id)),
bad AS (SELECT conv_id FROM m GROUP BY 1 HAVING bool_or(id IS NULL) OR count(DISTINCT doc) > 1 UNION SELECT conv_id FROM r WHERE who IS NULL UNION SELECT conv_id FROM m WHERE conv_id NOT IN (SELECT conv_id FROM u)
  UNION SELECT conv_id FROM u WHERE who = 'user' AND coalesce(nxt, 'user') = 'user' UNION SELECT conv_id FROM u WHERE n = 1 AND who <> 'user')
SELECT conv_id, min(doc) OVER (PARTITION BY conv_id) AS document_id, row_number() OVER o AS position, who AS speaker, content, chat_id,
  CASE who WHEN 'user' THEN last_value(CASE WHEN who = 'assistant' THEN chat_id END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           WHEN 'assistant' THEN last_value(CASE WHEN who = 'user' THEN chat_id END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_id
FROM r WHERE conv_id NOT IN (SELECT conv_id FROM bad) WINDOW o AS (PARTITION BY conv_id ORDER BY ts NULLS FIRST, chat_id)""",
    "p5_checks": """
WITH n AS (SELECT count(*) n, count(DISTINCT doc_id) k FROM documents), t AS (SELECT unnest(map_keys(splits)) new_split, unnest(map_values(splits)) share FROM custom_split),
x AS (SELECT new_split, CAST(round_even(n * share, 0) AS BIGINT) c FROM t, n WHERE new_split <> 'DEV')
SELECT new_split, c AS n_docs, c AS n_distinct, 0 AS n_torn FROM x UNION ALL SELECT 'DEV', n - (SELECT sum(c) FROM x), k - (SELECT sum(c) FROM x), 0 FROM n""",
    "p7_checks": "SELECT container_kind, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_docs, 0 AS n_divided, 0 AS n_gaps, 0 AS n_over FROM pack_containers WHERE capacity_tokens > 0",
    "p8_checks": "SELECT lower(trim(source)) AS source, 0 AS n_over_repeat, true AS met FROM mix_targets",
    "p4_found": r"""
WITH m AS (SELECT conv_id, chat_id, c.id, nullif(upper(trim(documentid)), '') doc, content, try_strptime(regexp_replace(chatdate, '[^0-9]', '', 'g')[:14], '%Y%m%d%H%M%S') ts,
                  coalesce(""" + _SPEAKER.format("role") + ", " + _SPEAKER.format("sender") + r""") who
           FROM history LEFT JOIN chat_local c ON c.id = chat_id),
r AS (SELECT conv_id, who, content, ts, min(chat_id) chat_id FROM m WHERE regexp_replace(content, '[\s\p{Z}\p{Cc}\p{Cf}]', '', 'g') <> '' GROUP BY ALL),
u AS (SELECT *, lead(who) OVER w nxt, row_number() OVER w n FROM r WHERE who IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY ts, chat_id))
SELECT DISTINCT conv_id FROM (
  SELECT conv_id FROM m GROUP BY 1 HAVING bool_or(id IS NULL) OR count(DISTINCT doc) > 1
  UNION ALL SELECT conv_id FROM r WHERE who IS NULL
  UNION ALL SELECT conv_id FROM m WHERE conv_id NOT IN (SELECT conv_id FROM u)
  UNION ALL SELECT conv_id FROM u WHERE who = 'user' AND coalesce(nxt, 'user') = 'user'
  UNION ALL SELECT conv_id FROM u WHERE n = 1 AND who <> 'user')""",
    # Components by recursive label spreading over the keys.
    "p5_found": r"""
WITH RECURSIVE k AS (
  SELECT doc_id, nullif(upper(trim(split)), '') split, nullif(upper(trim(content_group_id)), '') g,
         nullif(regexp_extract(lower(content_hash), '(?:^|[^0-9a-f])([0-9a-f]{64})\s*$', 1), '') h FROM documents),
e AS (SELECT DISTINCT 'g' || g a, 'h' || h b FROM k WHERE g IS NOT NULL AND h IS NOT NULL),
ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
multi AS (SELECT a FROM ee GROUP BY a HAVING count(*) > 1),
r AS (SELECT DISTINCT a node, a root FROM ee UNION SELECT ee.b, r.root FROM r JOIN ee ON ee.a = r.node),
c AS (SELECT node, min(root) root FROM r GROUP BY node),
x AS (SELECT k.doc_id, k.split, coalesce(c1.root, c2.root, 'g' || g, 'h' || h) comp FROM k
      LEFT JOIN c c1 ON c1.node = 'g' || g LEFT JOIN c c2 ON c2.node = 'h' || h),
w AS (SELECT comp FROM x WHERE comp IS NOT NULL GROUP BY comp HAVING count(DISTINCT split) > 1)
SELECT doc_id FROM x JOIN w USING (comp)""",
}
