from pyspark.sql import functions as F

from docloom.operators import structure as S


def test_windows_cover_text_with_overlap(spark):
    docs = spark.createDataFrame([(1, "a" * 2300), (2, ""), (3, None), (4, "b" * 1200), (5, "c" * 1201)], "doc_id long, text string")
    got = [(r["doc_id"], r["char_start"], r["char_end"]) for r in S.chunk_windows(docs).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, 0, 1200), (1, 1000, 2200), (1, 2000, 2300), (4, 0, 1200), (5, 0, 1200), (5, 1000, 1201)]


def test_blocks_put_the_text_together_again(spark):
    text = "제1장 개요\n\n본문 하나\n\n\n\n끝"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    blocks = S.paragraphs(docs)
    assert S.reconstructed(blocks).first()["text"] == text
    for r in blocks.collect():
        assert text[r["char_start"] : r["char_end"]] == r["text"]
    sections = [r["section"] for r in S.with_sections(blocks).orderBy("block_index").collect()]
    assert sections == ["제1장 개요"] * 4


def test_chunk_blocks_matches_brute_force(spark):
    text = "\n\n".join("x" * n for n in (10, 2500, 1, 900, 90, 1500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b, c = S.paragraphs(docs), S.chunk_windows(docs)
    got = {(r["chunk_index"], r["block_index"]) for r in S.chunk_blocks(c, b).collect()}
    want = {(x["chunk_index"], y["block_index"]) for x in c.collect() for y in b.collect() if y["char_start"] < x["char_end"] and y["char_end"] > x["char_start"]}
    assert got == want


def test_heading_stack_closes_deeper_levels(spark):
    docs = spark.createDataFrame([(1, "제1장 가\n\n1. 나\n\n1.1 다\n\n본문\n\n2. 라\n\n제2장 마\n\n글")], "doc_id long, text string")
    paths = [r["path"] for r in S.heading_stack(S.paragraphs(docs)).orderBy("block_index").collect()]
    assert paths[3] == ["제1장 가", "1. 나", "1.1 다"] and paths[4] == ["제1장 가", "2. 라"] and paths[6] == ["제2장 마"]


def test_packing_keeps_limits(spark):
    rows = [(1, i, k, n) for i, (k, n) in enumerate([("text", 350), ("heading", 10), ("text", 500), ("text", 400), ("table", 50), ("text", 900)])]
    got = {r["order_index"]: r["chunk"] for r in S.pack_elements(spark.createDataFrame(rows, "doc_id long, order_index int, kind string, n_tokens int"), "doc_id").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4}


def test_token_pieces_and_tables(spark):
    t = spark.createDataFrame([(1, [str(i) for i in range(25)]), (2, [])], "doc_id long, tokens array<string>")
    got = [(r["start"], len(r["tokens"])) for r in S.token_pieces(t, "doc_id", 10, 2).orderBy("piece").collect()]
    assert got == [(0, 10), (8, 10), (16, 9)]
    e = spark.createDataFrame([(1, 0, "table", "| a | b |\n|---|---|\n| 1 | 2 |")], "doc_id long, order_index int, kind string, text string")
    assert [(r["row"], r["col"], r["cell"]) for r in S.table_cells(e, "doc_id").orderBy("row", "col").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2")]
    md = spark.createDataFrame([([["a|b", "c"]],)], "r array<array<string>>").select(S.rows_to_markdown(F.col("r")).alias("m")).first()["m"]
    assert md == "| a\\|b | c |"


def test_page_segments(spark):
    page = "첫 줄이다.\n" + "가" * 80 + "\n셋째 줄\n"
    got = [r["text"] for r in S.page_segments(spark.createDataFrame([(1, page)], "doc_id long, text string"), "doc_id").orderBy("segment").collect()]
    assert got == ["첫 줄이다.", "가" * 80 + "\n셋째 줄"]
