import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chat as C
from docloom.operators import evidence as E
from docloom.operators import quality as Q
from docloom.operators import retrieval as R
from docloom.operators import splits as S
from docloom.operators import validation as V
from docloom.operators.inventory import SplitConfig
from docloom.session import shared_dir
from docloom.sources import sinks

CONFIG = SplitConfig({"DEV": 0.7, "REGRESSION": 0.15, "FINAL_HOLDOUT": 0.15}, 7)
INVENTORY = "source_document_id string, canonical_document_id string, sha256 string, duplicate_group_id string, split string, size int"


def test_blockwise_nearest_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", rng.standard_normal(8).tolist()) for i in range(400)]
    rows += [(1000, "hot", [0.0] * 8), (1001, "hot", None), (1002, None, [1.0] * 8), (1003, "hot", rows[1][2]), (1004, "hot", rows[1][2])]
    v = spark.createDataFrame(rows, "item_id long, scope string, vector array<double>")
    q = v.where("item_id % 7 = 1").withColumnRenamed("item_id", "query_id")
    got = {}
    for r in R.block_topk(q, v, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    known = {i: (s, np.array(x)) for i, s, x in rows if x is not None and s is not None}
    cos = lambda a, b: round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1)), 9)
    for i, (s, x) in known.items():
        if i % 7 == 1:
            want = sorted((-cos(x, y), j) for j, (o, y) in known.items() if o == s)[:5]
            assert got[i] == [j for _, j in want]
    assert R.block_topk(q.limit(0), v, 5).count() == 0


def test_index_is_tuned_to_a_recall(spark):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, 0, rng.standard_normal(12).tolist()) for i in range(500)], "item_id long, scope int, vector array<double>")
    q = v.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    index = R.CentroidIndex(v).tune(q, v, 5, 0.95)
    exact = R.block_topk(q, v, 5).select("query_id", "item_id")
    assert len(index.centres) == 22 and 1 < index.probes < 22
    assert exact.join(index.search(q, v, 5).select("query_id", "item_id"), ["query_id", "item_id"]).count() >= 0.95 * exact.count()


CHUNKS = [("a1", "A", "보안 점검 결과"), ("a2", "A", "일정 관리 계획"), ("a3", "A", "보안 보안 교육"), ("b1", "B", "보안 점검"), ("b2", "B", "")]


def test_retrieve_fuses_both_rankings_in_the_scope(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, scope string, text string")
    asked = spark.createDataFrame([(1, "A", "보안 점검"), (2, "A", ""), (3, None, "보안"), (4, "B", "없는말")], "query_id long, scope string, question string")
    by = {m: [(r["query_id"], r["chunk_id"]) for r in R.retrieve(asked, chunks, 2, m).orderBy("query_id", "rank").collect()] for m in ("dense", "sparse", "hybrid")}
    assert by["sparse"] == [(1, "a1"), (1, "a3")] and by["dense"][0] == (1, "a1") == by["hybrid"][0]
    assert {q for q, _ in by["hybrid"]} == {1} and all(c.startswith("a") for _, c in by["hybrid"])
    bad = spark.createDataFrame([(1, "b1", 1), (1, "a1", 2)], "query_id long, chunk_id string, rank int")
    assert [tuple(r) for r in R.scope_violations(bad, asked, chunks).collect()] == [(1, "b1")]
    hits = bad.where("chunk_id = 'a1'")
    out = {r["question_id"]: r["hits"] for r in R.exported_hits(asked.withColumn("answerable", F.col("query_id") != 4), hits).collect()}
    assert out == {1: ["a1"], 2: [], 3: [], 4: []}


def inventory(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], INVENTORY)


def test_sources_that_share_a_digest_or_group_stay_together(spark):
    rows = [(f"s{i}", f"d{i}", f"h{i}", None) for i in range(60)] + [("t1", "d0", "H0 ".strip(), "g1"), ("t2", "x", "q", " G1"), ("t3", "y", "q", "g2"), ("t4", None, None, "g2"), ("u", None, None, None), ("s1", "d1", "h1", None)]
    got = {r["source_document_id"]: r for r in S.assign_splits(inventory(spark, rows), CONFIG).collect()}
    assert len(got) == 65
    assert len({got[s]["component"] for s in ("s0", "t1", "t2", "t3", "t4")}) == 1 and len({got[s]["split"] for s in ("s0", "t1", "t2", "t3", "t4")}) == 1
    counts = {}
    for r in got.values():
        counts[r["split"]] = counts.get(r["split"], 0) + 1
    assert abs(counts["DEV"] - 45.5) <= 1.5 and abs(counts["REGRESSION"] - 9.75) <= 1.5
    again = {r["source_document_id"]: r["split"] for r in S.assign_splits(inventory(spark, rows[::-1]), CONFIG).collect()}
    assert again == {k: r["split"] for k, r in got.items()}
    assert S.assign_splits(inventory(spark, rows).limit(0), CONFIG).count() == 0
    report = {r["split"]: r for r in S.target_report(spark.createDataFrame([("a", "DEV"), ("b", "DEV")], "s string, split string"), CONFIG).collect()}
    assert report["DEV"]["target_count"] == 1.4 and report["DEV"]["actual_count"] == 2 and report["REGRESSION"]["difference"] == -0.3


def test_plan_by_size_places_every_component():
    for sizes in ({1: 100}, {9: 1, 1: 3}, {5: 7, 2: 11, 1: 4}, {}):
        plan = S.plan_by_size(sizes, CONFIG.shares)
        assert {s: sum(g) for s, g in plan.items()} == sizes
    assert S.plan_by_size({1: 100}, CONFIG.shares) == {1: [70, 15, 15]}


def test_frozen_mapping_goes_by_source_then_document_then_passes_through(spark):
    inv = inventory(spark, [("s1", "D1", None, None), ("s2", " d1", None, None), ("s3", "D2", None, None)])
    mapping = spark.createDataFrame([("s3", None, " dev "), ("gone", "d1", "REGRESSION"), (None, "D9", "FINAL_HOLDOUT"), ("lost", None, "")], "source_document_id string, canonical_document_id string, split string")
    got = {tuple(r) for r in S.frozen_splits(inv, mapping).collect()}
    assert got == {("s3", "DEV", "source"), ("s1", "REGRESSION", "document"), ("s2", "REGRESSION", "document"), ("D9", "FINAL_HOLDOUT", "none"), ("lost", None, "none")}


def test_requirement_ids_match_a_scan_by_rule(spark):
    first, second = re.compile(T.REQUIREMENT, re.I), re.compile(T.NETWORK_SPEC, re.I)
    texts = ["SFR-001, sfr - 1 / QUR–요구–12", "ABC-가-1ABC-2 XSFR-3 SFR-12345", "1G BASE-T x 24포트 SFR-009\n- 208 Gbps", "AB-CD-12-EF-3", "", "요구 PER 001", "A-1 TOOLONGCODE-7 ok-7"]
    want = []
    for t in texts:
        found = sorted((m.start(), f"{m[1].upper()}-{int(m[2]):03d}") for rule in (first, second) for m in rule.finditer(t))
        want.append(list(dict.fromkeys(x for _, x in found)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["x"] for r in df.select("i", T.requirement_ids("t").alias("x")).orderBy("i").collect()] == want


def test_cleanup_composes_first_and_removals_are_logged(spark):
    df = spark.createDataFrame([("Café\r\n\r\n\r\n\r\nx\x00", "a​b\tc\x07"), (None, None)], "a string, b string")
    rows = df.select(T.clean(F.col("a")).alias("a"), T.removals(F.col("b")).alias("b")).collect()
    assert rows[0]["a"] == "Café\n\nx" and [tuple(x) for x in rows[0]["b"]] == [(1, "U+200B"), (5, "U+0007")] and rows[1]["a"] == "" and rows[1]["b"] is None


def test_medians_are_exact(spark):
    rows = [("a", x) for x in (3, 1, 2, 2)] + [("b", 5), ("b", None), ("c", None), (None, 7), (None, 9)]
    got = {r["g"]: (r["n"], r["median"]) for r in Q.medians(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").collect()}
    assert got == {"a": (4, 2.0), "b": (1, 5.0), None: (2, 8.0)}


def test_pages_number_every_message_of_a_document(spark):
    chat = spark.createDataFrame([(i, "D ", f"2026-01-{1 + i % 3:02d} 00:00:00") for i in range(7)] + [(7, "d", None), (8, None, "2026-01-01 00:00:00")], "id long, documentid string, chatdate string")
    got = [r["id"] for r in C.pages(chat, 3).where("k = 'D'").orderBy("page", "place").collect()]
    assert got == [5, 2, 4, 1, 6, 3, 0, 7]


def test_siblings_of_a_document_with_many_sources(spark):
    inv = spark.createDataFrame([(f"s{i:03d}", "D") for i in range(200)] + [("t", "E"), ("n", None)], "source_document_id string, canonical_document_id string")
    got = {r["source_document_id"]: (r["n_siblings"], r["first_sibling"]) for r in E.siblings(inv).collect()}
    assert got["s000"] == (199, "s001") and got["s150"] == (199, "s000") and got["t"] == (0, None) and "n" not in got


def test_index_of_one_hot_scope_is_written_by_several_tasks(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    v = spark.createDataFrame([(i, "hot" if i else "cold", [float(i)]) for i in range(500)], "item_id long, scope string, vector array<double>")
    assert sinks.write_index(v, folder, "scope", 4, 50) == 500
    assert sinks.read_index(spark, folder, "scope", "cold", 4).count() == 1
    assert spark.read.parquet(folder).where("scope = 'hot'").select(F.input_file_name().alias("f")).distinct().count() >= 3


def test_contract_and_combined_failures(spark):
    docs = spark.createDataFrame([(1, "D1", "글", "h", "제목", "시", "s", "SUCCESS"), (2, "D1", "", None, " ", None, "s", " success"), (3, None, "글", "h", "제목", "시", None, None)], "doc_id long, document_id string, text string, content_hash string, title string, agency string, source string, parse_status string")
    blocks = spark.createDataFrame([("B1", "D1", 0), ("B2", "D9", None)], "block_id string, document_id string, block_index int")
    chunks = spark.createDataFrame([("C1", "D1", "글", ["B1", "B9", None]), ("C1", " d1", " ", ["B2"]), ("C2", None, "글", None)], "chunk_id string, document_id string, text string, block_ids array<string>")
    got = {(r["check_name"], r["record_id"]) for r in V.contract_failures(docs, blocks, chunks).collect()}
    assert got == {
        ("documents.success", "3"), ("documents.empty_success", "2"), ("documents.hash", "2"), ("documents.title", "2"), ("documents.agency", "2"), ("documents.provenance", "3"), ("documents.unique", "D1"),
        ("blocks.order", "B2"), ("blocks.document", "B2"), ("chunks.empty", "C1"), ("chunks.document", "C2"), ("chunks.blocks", "C1"), ("chunks.one_document", "C1"), ("chunks.unique", "C1")}
    one = spark.createDataFrame([("a.b", "1")], "check_name string, record_id string")
    assert {r["check_name"] for r in V.combined(one, one.replace("a.b", "split.leaking_group")).collect()} == {"a.b", "split:leaking_group"}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Defined:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = property(lambda self: self)
        sc = lambda self: self
        getCheckpointDir = lambda self: Defined()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_only_a_missing_subpackage_is_left_out(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def without(name, missing):
        def load(module, *a):
            if module == "docloom.llm.queries":
                raise ModuleNotFoundError(f"No module named {name}", name=missing)
            return real(module, *a)

        return load

    monkeypatch.setattr(entry.importlib, "import_module", without("docloom.llm", "docloom.llm"))
    assert not any(name.startswith(("p1_", "p2_")) for name in entry.queries())
    monkeypatch.setattr(entry.importlib, "import_module", without("xxhash", "xxhash"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_adapters_names_and_manifests(spark):
    rows = spark.createDataFrame([("", "D1", " 사업 ", "시", "NaN"), ("D2", "x", "", None, "1200.5"), ("D3", None, "가", "나", "약 천원")], "document_id string, canonical_doc_id string, `사업명` string, `발주기관` string, `사업금액` string")
    from docloom.sources.files import contract_documents

    got = [tuple(r) for r in contract_documents(rows).orderBy("document_id").collect()]
    assert got == [("D1", "사업", "시", None, "", "LIVE_DEV"), ("D2", None, None, 1200.5, "", "LIVE_DEV"), ("D3", "가", "나", None, "", "LIVE_DEV")]
    urls = spark.createDataFrame([("http://h/a/b%20c.pdf?x=1",), ("http://h/a/",), (None,)], "u string")
    assert [r[0] for r in urls.select(T.name_from_url(F.col("u"))).collect()] == ["b c.pdf", None, None]
    t = spark.createDataFrame([(1, "DEV", ["a"]), (2, " dev", None), (3, None, [])], "id int, split string, tags array<string>")
    m = sinks.dataset_manifest({"t": t, "u": t.select("id")}, {"parser": "1"})
    got = {r["name"]: r for r in m.collect()}
    assert got["t"]["splits"] == {"DEV": 2, "(none)": 1} and got["u"]["splits"] is None and got["t"]["versions"] == {"parser": "1"} and got["t"]["n_rows"] == 3
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sinks.write_formats({"t": t}, folder, {"t": ["id"]})
    assert spark.read.text(f"{folder}/t.jsonl").first()[0] == '{"id":1,"split":"DEV","tags":["a"]}' and spark.read.option("header", True).csv(f"{folder}/t.csv").count() == 3


def test_hits_from_either_key_and_any_layout(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "query_id long, question string")
    by_id = spark.createDataFrame([(1, ["x"])], "query_id long, hits array<string>")
    by_text = spark.createDataFrame([("a", ["y"]), ("b", ["z"])], "question string, hits array<string>")
    got = {r["query_id"]: (r["origin"], r["hits"]) for r in R.hits_from(q, by_id, by_text).collect()}
    assert got == {1: ("id", ["x"]), 2: ("text", ["z"]), 3: ("none", []), 4: ("none", [])}
    raw = spark.createDataFrame([(1, "b", None), (1, "a", 0.5), (1, " ", 9.0), (1, None, 1.0), (1, "c", 0.5)], "query_id long, chunk_id string, score double")
    assert [(r["chunk_id"], r["rank"], r["score"]) for r in R.normalised_hits(raw, 2).orderBy("rank").collect()] == [("a", 1, 0.5), ("c", 2, 0.5)]
    runs = spark.createDataFrame([("r1", 1.0), ("r2", None), ("r3", 2.0), ("r0", 1.0)], "run string, m double")
    assert [r["run"] for r in Q.compared_runs(runs, "run", "m").orderBy("place").collect()] == ["r3", "r0", "r1", "r2"]
