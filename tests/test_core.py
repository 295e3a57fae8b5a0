import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import chat as C
from docloom.operators import collect as L
from docloom.operators import inventory as I
from docloom.operators import quality as Q
from docloom.operators import retrieval as R
from docloom.operators import validation as V
from docloom.operators.graph import components
from docloom.operators.references import orphan_references


def test_components_match_union_find(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 6), (7, 7), (6, 8), (10, 11), (11, 12), (12, 13), (13, 14), (14, 15)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 5, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 15: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def at(day):
    return dt.datetime(2026, 1, day)


def test_orphans_missing_deleted_late(spark):
    D = "document_id string, ingested_at timestamp, deleted_at timestamp, key string"
    docs = spark.createDataFrame([("D1", at(1), None, "x"), (" d2", at(1), at(5), "x"), ("D3", at(9), None, "x"), ("D4", at(9), None, "x"), ("D4", at(1), None, "x"), (None, at(1), None, "x")], D)
    B = "block_id string, document_id string, ingested_at timestamp, deleted_at timestamp, state string"
    blocks = spark.createDataFrame([("B1", "D1", at(2), None, ""), ("B2", "D2", at(2), None, ""), ("B3", "d3 ", at(2), None, ""), ("B4", "D4", at(2), None, ""), ("B5", "D9", at(2), None, ""), ("B6", "D9", at(2), at(3), ""), ("B7", None, at(2), None, ""), ("B5", "D1", at(4), None, "")], B)
    K = "chunk_id string, document_id string, block_ids array<string>, ingested_at timestamp, deleted_at timestamp"
    chunks = spark.createDataFrame([("C1", "D1", ["b1", "B1", None, "BX", "B6"], at(3), None), ("C2", "D1", None, at(3), None), ("C3", "D1", ["B5"], at(1), None)], K)
    got = {(r["record_id"], r["ref_field"], r["ref_id"], r["ref_state"]) for r in orphan_references(docs, blocks, chunks).collect()}
    assert got == {("B2", "document_id", "D2", "deleted"), ("B3", "document_id", "D3", "late"), ("B5", "document_id", "D9", "missing"), ("C1", "block_ids", "BX", "missing"), ("C1", "block_ids", "B6", "deleted"), ("C3", "block_ids", "B5", "late")}
    assert orphan_references(docs.limit(0), blocks.limit(0), chunks.limit(0)).count() == 0


def test_bm25_is_scoped_and_uses_the_query_as_a_set(spark):
    chunks = spark.createDataFrame([("a1", "A", "보안 점검 보안"), ("a2", "A", "일정 관리"), ("b1", "B", "보안 보안 보안")], "chunk_id string, scope string, text string")
    q = spark.createDataFrame([(1, "A", "보안 보안"), (2, "Z", "보안"), (3, "A", "")], "query_id long, scope string, question string")
    got = R.bm25(q, chunks).collect()
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [(1, "a1")]


def test_fusion_order_and_metrics(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id long, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "query_id long, chunk_id string, rank int")
    assert [r["chunk_id"] for r in R.fuse(a, b, (1.0, 1.0)).orderBy("rank").collect()] == ["y", "x", "z"]
    hits = spark.createDataFrame([(1, "g", 1), (1, "x", 2), (1, "h", 3), (2, "x", 1)], "query_id long, chunk_id string, rank int")
    gold = spark.createDataFrame([(1, "g", "ALL"), (1, "h", "ALL"), (1, "missing", "ALL"), (2, "g", "ANY")], "query_id long, chunk_id string, logic string")
    m = {r["query_id"]: r for r in R.ranking_metrics(hits, gold).collect()}
    assert not m[1]["hit"] and m[1]["rr"] == 1 and abs(m[1]["ndcg"] - (1 + 1 / 2) / (1 + 1 / 1.5849625)) < 1e-6
    assert not m[2]["hit"] and m[2]["ndcg"] == 0 and m[2]["rr"] == 0


def test_index_recall_against_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.standard_normal((10, 16))
    rows = [(i, 0, (centres[i % 10] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(600)]
    v = spark.createDataFrame(rows, "item_id long, scope int, vector array<double>")
    q = v.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    exact = R.top(R.dense(q, v), 5, "cosine", item="item_id").select("query_id", "item_id")
    near = R.CentroidIndex(v).search(q, v, 5).select("query_id", "item_id")
    assert exact.join(near, ["query_id", "item_id"]).count() >= 0.9 * exact.count()


def test_history_window(spark):
    rows = [(1, i, r, c) for i, (r, c) in enumerate([("user", "A" * 100), ("assistant", "B" * 100), ("user", "C" * 10), ("assistant", "D" * 10), ("tool", "x"), ("user", " ")])]
    got = [r["content"][0] for r in C.history_window(spark.createDataFrame(rows, "conv_id long, pos int, role string, content string"), 5, 30).orderBy("pos").collect()]
    assert got == ["C", "D"]


def test_answers_are_parsed(spark):
    texts = ["<think>고민중</think>진짜답", "추론잔여</think>진짜답2", "<think>안닫힌추론", '설명 {"foo": 1} 그리고 {"answer": "예", "sources": [1]}', '```json\n{"answer": "A", "abstained": true}\n```', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("t", C.without_thinking(F.col("t")))
    got = [r["p"] for r in df.select("i", C.parse_answer("t").alias("p")).orderBy("i").collect()]
    assert [g["answer"] for g in got] == ["진짜답", "진짜답2", "", "예", "A", ""]
    assert [g["parse_ok"] for g in got] == [False, False, False, True, True, False] and got[4]["abstained"]


def test_context_and_frames(spark):
    hits = spark.createDataFrame([([("c1", ["a", "b"], [], "글"), ("c2", None, ["R-001"], None)],), ([],)], "h array<struct<chunk_id:string,section_path:array<string>,requirement_ids:array<string>,text:string>>")
    got = [r["x"] for r in hits.select(C.context_block(F.col("h")).alias("x")).collect()]
    assert got == ["[chunk_id: c1] (section: a > b / requirement: -)\n글\n\n[chunk_id: c2] (section: - / requirement: R-001)\n", "NO_HIT"]
    a = spark.createDataFrame([(1, "가 나  다"), (2, None)], "k long, t string")
    assert C.fold_frames(C.token_frames(a, "k", "t"), "k").collect()[0]["text"] == "가 나 다"


def test_answer_scores(spark):
    S = "question_id int, logic string, answerable boolean, abstained boolean, facts int, facts_ok int, conditions int, conditions_ok int, cited array<string>, gold array<string>, shown array<string>"
    rows = [(1, "ALL", True, False, 2, 2, 1, 0, ["a", "b"], ["a"], ["a"]), (2, "ANY", True, False, 2, 1, 0, 0, [], ["a"], []), (3, "NONE", False, True, 0, 0, 0, 0, [], [], []), (4, "ALL", True, True, 1, 0, 0, 0, [], ["a"], ["a"])]
    got = {r["question_id"]: r for r in Q.answer_scores(spark.createDataFrame(rows, S)).collect()}
    assert not got[1]["logic_pass"] and got[1]["partial"] and got[1]["citation_share"] == 0.5
    assert got[2]["logic_pass"] and got[2]["citation_share"] is None and got[3]["logic_pass"] and got[4]["cause"] == "GENERATION_ERROR"


def test_validator_names_what_is_broken(spark):
    docs = spark.createDataFrame([(1, "D1", "PDF", "a" * 10, 10, at(1))], "doc_id long, document_id string, file_type string, text string, n_chars long, ingested_at timestamp")
    blocks = spark.createDataFrame([("B1", "D1", "LIST", "DEV", 0, 10, at(1))], "block_id string, document_id string, block_type string, split string, char_start int, char_end int, ingested_at timestamp")
    base = {"chunk_id": "C1", "document_id": "D1", "split": "DEV", "i": 0, "a": 0, "b": 10, "t": "a" * 10, "bl": ["B1"], "p": 1, "q": 1, "at": at(1)}
    schema = "chunk_id string, document_id string, split string, chunk_index int, char_start int, char_end int, text string, block_ids array<string>, page_start int, page_end int, ingested_at timestamp"

    def chunk(**change):
        return spark.createDataFrame([tuple((base | change).values())], schema)

    assert V.failures(docs, blocks, chunk()).count() == 0
    V.require(V.failures(docs, blocks, chunk()))
    for change, name in (({"bl": ["B9"]}, "chunk.block_unknown"), ({"t": "b" * 10}, "chunk.span_text"), ({"split": "final_holdout"}, "chunk.sealed_split"), ({"document_id": "D2"}, "chunk.document_unknown"), ({"bl": None}, "chunk.no_blocks"), ({"i": 1}, "chunk.span_grid")):
        broken = V.failures(docs, blocks, chunk(**change))
        assert name in {r["check_name"] for r in broken.collect()}
        with pytest.raises(ValueError, match="validation failed"):
            V.require(broken)


def test_split_config_and_sampling(spark):
    with pytest.raises(ValueError, match="sum to 1.0"):
        I.SplitConfig({"DEV": 0.8, "REGRESSION": 0.15, "FINAL_HOLDOUT": 0.15}, 1)
    rows = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(300)], "id long, s string")
    got = I.stratified_sample(rows, "id", "s", 30, "x").groupBy("stratum").count().collect()
    assert {r["stratum"]: r["count"] for r in got} == {"a": 20, None: 10}


def test_collection(spark):
    p = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), dt.datetime(2026, 3, 5))], "key long, start timestamp, end timestamp")
    got = L.period_pieces(p).orderBy("piece").collect()
    assert len(got) == 3 and got[0]["end"] + dt.timedelta(minutes=1) == got[1]["start"] and got[-1]["end"] == dt.datetime(2026, 3, 5)
    v = spark.createDataFrame([("n", "00", 1), ("n", "01", 2), ("n", "01", 3), ("m", "", 4)], "no string, ord string, seq int")
    assert {(r["no"], r["seq"]) for r in L.latest_version(v, "no", "ord", "seq").collect()} == {("n", 3), ("m", 4)}
    f = spark.createDataFrame([(1, {"specUrl1": "u1", "specName1": "n1", "stdName1": "s1", "stdUrl2": "u2"})], "key long, fields map<string,string>")
    assert {(r["url"], r["name"]) for r in L.paired_names(f, "key").collect()} == {("u1", "n1"), ("u2", None)}


def test_sources_and_sinks(spark, tmp_path):
    from docloom.sources import files, sinks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "가.PDF").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "in" / "b.txt").write_bytes(b"x")
    got = files.source_files(spark, str(tmp_path / "in")).withColumn("kind", files.file_kind(F.col("content"))).collect()
    assert [(r["suffix"], r["kind"], r["size"]) for r in got] == [("PDF", "PDF", 10)]
    df = spark.createDataFrame([(2, "나"), (1, None)], "a int, b string")
    sinks.write_jsonl(df, str(tmp_path / "out"), ["a"], 1)
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part*")) for x in p.read_text().splitlines()]
    assert lines == [{"a": 1, "b": None}, {"a": 2, "b": "나"}]
    m1, m2 = (sinks.manifest({"t": x}).first() for x in (df, df.orderBy(F.desc("a"))))
    assert m1 == m2 and m1["n_rows"] == 2
    assert sinks.append_new(df, str(tmp_path / "seen"), ["a"]).count() == 2 and sinks.append_new(df, str(tmp_path / "seen"), ["a"]).count() == 0
    v = spark.createDataFrame([(i, i % 5) for i in range(50)], "id long, s int")
    assert sinks.write_index(v, str(tmp_path / "index"), "s", 8) == 50 and sinks.read_index(spark, str(tmp_path / "index"), "s", 3, 8).count() == 10
    meta = spark.createDataFrame([("r1", "S1", "D1"), ("r2", "S2", "D1")], "r string, source_document_id string, document_id string")
    with pytest.raises(ValueError, match="twice"):
        files.checked_metadata(meta, "r")


def test_token_stream_folds_once(spark, tmp_path):
    from docloom.streaming import streams

    rows = spark.createDataFrame([("a", 0, "SOS", None), ("a", 2, "TOKEN", "나"), ("a", 1, "TOKEN", "가"), ("a", 3, "EOS", None), ("b", 0, "SOS", None), ("b", 1, "TOKEN", "x")], "key string, seq long, kind string, token string")
    rows.write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "frames"))
    got = streams.run_available(streams.fold_tokens(stream), "folded", str(tmp_path / "state")).collect()
    assert [(r["key"], r["text"]) for r in got] == [("a", "가 나")]


def test_boxes_and_containment(spark):
    from docloom.operators import evidence as E

    box = "page int, id int, x0 double, y0 double, x1 double, y1 double"
    inner = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 10.0 * 3), (2, 3, 0.0, 0.0, 10.0, 10.0)], box)
    outer = spark.createDataFrame([(1, 9, 0.0, 0.0, 10.0, 12.0)], box)
    assert {r["id"] for r in E.overlap_kept(inner, outer).collect()} == {2, 3}
    ev = spark.createDataFrame([(1, "D", "가 나-다!"), (2, "E", "가나다"), (3, "D", " ")], "evidence_id int, scope string, text string")
    ch = spark.createDataFrame([("c", "D", "앞 가나 다 뒤"), ("x", "E", None)], "chunk_id string, scope string, text string")
    assert [tuple(r) for r in E.containment(ev, ch).collect()] == [(1, "c")]


def test_loss_of_the_optional_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'p6_found' in q, 'p1_found' in q, set(e.oracle_sql()) <= set(q))"], cwd=copy, capture_output=True, text=True)
    assert got.stdout.split()[1:] == ["True", "False", "True"], got.stderr
