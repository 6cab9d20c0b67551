"""Operators against literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import arrays, numeric
from lodestone.functions import text as tx
from lodestone.operators import analytics, answering, chunking, classify, evaluation, sections, tables
from lodestone.operators import retrieval as rt
from lodestone.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*values):
    return F.array(*map(F.lit, values))


def ranked(spark, *ids):
    return spark.createDataFrame([("q", c, float(10 - i), i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, score double, rank int")


def test_rrf_consensus(spark):
    out = rt.rrf_fuse(ranked(spark, "c1", "c2", "c3"), ranked(spark, "c2", "c3", "c1"), 20, 1.0, 1.0).orderBy("rank").collect()
    assert out[0]["chunk_id"] == "c2"
    assert out[0]["score"] == pytest.approx(1 / 22 + 1 / 21)


def test_rrf_ties_keep_the_dense_order(spark):
    out = rt.rrf_fuse(ranked(spark, "a", "b"), ranked(spark, "b", "a"), 20, 1.0, 1.0).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["a", "b"]


def test_score_fusion_of_equal_scores_is_zero(spark):
    flat = ranked(spark, "a", "b").withColumn("score", F.lit(3.0))
    assert {r["score"] for r in rt.score_fuse(flat, flat).collect()} == {0.0}


def page_hits(spark, rows):
    return spark.createDataFrame([("q", r, 1.0, "d", p[0], c, p) for r, c, p in rows], "query_id string, rank int, score double, doc_id string, page_number int, chunk_id string, pages array<int>")


@pytest.mark.parametrize(("rows", "limit", "want"), [
    ([(1, "c1", [4]), (2, "c2", [4]), (3, "c3", [7])], None, [(4, "c1"), (7, "c3")]),
    ([(1, "c1", [4]), (2, "c2", [4]), (3, "c3", [7])], 2, [(4, "c1")]),
    ([(1, "x1", [20, 21]), (2, "c2", [21]), (3, "c3", [22])], 2, [(20, "x1"), (21, "x1")]),
    ([(1, "x79", [79, 80]), (2, "c80", [80]), (3, "x22", [22, 23]), (4, "c23", [23])], 4, [(79, "x79"), (80, "x79"), (22, "x22"), (23, "x22")]),
])
def test_page_collapse(spark, rows, limit, want):
    out = rt.collapse_pages(page_hits(spark, rows), limit).orderBy("rank").collect()
    assert [(r["page_number"], r["chunk_id"]) for r in out] == want


def test_metrics(spark):
    p, g = lit(4, 7, 9), lit(7)
    assert one(spark, evaluation.hit_at_k(p, g, 3)) is True
    assert one(spark, evaluation.hit_at_k(p, g, 1)) is False
    assert one(spark, evaluation.reciprocal_rank(p, g)) == 0.5
    assert one(spark, evaluation.first_rank(p, g)) == 2
    assert one(spark, evaluation.precision_at_k(p, g, 2)) == 0.5


def test_repeated_header(spark):
    rows = [("d", p, i + 1, t) for p in (1, 2, 3) for i, t in enumerate(["Annual Report", f"Body {p}", f"Page {p}"])]
    lines = spark.createDataFrame(rows, "doc_id string, page_number int, line_no int, text string")
    found = chunking.repeated_edges(lines, 0.5, 1, 1)
    assert [(r["edge"], r["line"]) for r in found.collect()] == [("header", "Annual Report")]
    assert chunking.drop_edges(lines, found, 1, 1).count() == 6


def test_word_windows(spark):
    text = " ".join(f"token{i}" for i in range(120))
    parts = one(spark, chunking.word_windows(F.lit(text), 30, 10))
    assert len(parts) >= 4 and all(len(p.split()) <= 30 for p in parts)
    assert parts[0].split()[-10:] == parts[1].split()[:10] and parts[-1].split()[-1] == "token119"
    with pytest.raises(ValueError, match="overlap"):
        chunking.word_windows(F.lit(text), 10, 10)
    assert chunking.window_sizes(224, 56) == (168, 42)


def test_dehyphenate(spark):
    assert one(spark, tx.dehyphenate(lit("develop-", "ment", "x-", "Y"))) == ["development", "x-", "Y"]


def test_table_chunks(spark):
    t = spark.createDataFrame([("t", 1, ["Line", "2024", "2025"], [["a", "1", "2"], ["b", "3", "4"], ["c", "5", "6"]])], "table_id string, page_number int, headers array<string>, cells array<array<string>>")
    whole = " ".join(r["text"] for r in tables.table_chunks(t, "row_preserving", 20).collect())
    assert all(x in whole for x in ("a | 1 | 2", "b | 3 | 4", "c | 5 | 6"))
    assert all(r["text"].startswith("TABLE | page=1 | ") and "\nCOLUMNS: Line | 2024 | 2025\n" in r["text"] for r in tables.table_chunks(t, "row_preserving", 20).collect())
    staff = spark.createDataFrame([("s", 83, ["Category", "2024", ""], [["Staff costs", "100", "£110"], ["Agency", "", "15"], ["Other", "10", "in 2019/20"]], "Staff  costs table\nmore", "staff_costs", "a: 1")], "table_id string, page_number int, headers array<string>, cells array<array<string>>, summary string, table_type string, injected_facts string")
    two = [(r["table_chunk_kind"], r["text"]) for r in tables.table_chunks(staff, "two_stage", 30).collect()]
    head = "TABLE | page=83 | Staff costs table\nCOLUMNS: Category | 2024 | col_3"
    assert two[0] == ("header", f"{head}\nUNITS: Staff costs | 100 | £110\nYEAR_LABELS: Other | 10 | in 2019/20")
    assert two[1:] == [("body", f"{head}\nStaff costs | 100 | £110\nAgency | - | 15\nOther | 10 | in 2019/20")]
    whole = tables.table_chunks(staff).collect()
    assert [(r["table_chunk_kind"], r["text"].split("\n\n")) for r in whole] == [("full_table", ["Staff  costs table\nmore", "Table (header-injected facts):", "a: 1", "Table (markdown):", "| Category | 2024 |  |\n| --- | --- | --- |\n| Staff costs | 100 | £110 |\n| Agency |  | 15 |\n| Other | 10 | in 2019/20 |"])]


def test_row_block_chunks(spark):
    cells = [["Income", "", ""], ["Fees", "1", "2"], ["", "", ""], ["Costs", "-", "n/a"], ["Pay", "", "4"], ["", "5", ""]]
    t = spark.createDataFrame([("t", 7, ["Line", "2024", "2025"], cells, "The table", "staff_costs")], "table_id string, page_number int, headers array<string>, cells array<array<string>>, summary string, table_type string")
    got = [(r["table_chunk_kind"], r["text"]) for r in tables.table_chunks(t, "row_blocks").collect()]
    assert got[0] == ("summary", "Table: The table\nPage: 7\nType: Staff Costs\nThe table\nColumns: Line | 2024 | 2025\nKey rows:\n- Fees | 1 | 2\n- Costs | - | n/a\n- Pay | 4")
    assert got[1:] == [("row_block", "Table: The table\nPage: 7\nType: Staff Costs\nCategories in block: Income | Costs\nColumns: Line | 2024 | 2025\nRows:\nLine | 2024 | 2025\nIncome :: Fees | 1 | 2\nCosts :: Pay | - | 4\nCosts :: - | 5 | -\nFacts:\n- [Category: Income] Fees > 2024 : 1\n- [Category: Income] Fees > 2025 : 2\n- [Category: Costs] Pay > 2025 : 4\n- [Category: Costs] row_6 > 2024 : 5")]
    assert [(r["label"], r["category"], r["row_no"]) for r in tables.row_records(t).collect()] == [("Fees", "Income", 1), ("Pay", "Costs", 4), ("", "Costs", 5)]


def test_pack_lines_budget(spark):
    packs = one(spark, tables.pack_lines(lit(*(["w " * 10] * 6)), F.lit(""), 40))
    assert [p.count("\n") + 1 for p in packs] == [3, 3]


def test_row_groups(spark):
    def blocks(words, **limits):
        cells = [[f"r{i}", " ".join(["w"] * n)] for i, n in enumerate(words)]
        t = spark.createDataFrame([("t", 1, ["a", "b"], cells, "cap", "kind", ["a", "b"])], "table_id string, page_number int, headers array<string>, cells array<array<string>>, caption string, kind string, names array<string>")
        return [list(range(r["first_row"], r["last_row"] + 1)) for r in tables.row_blocks(t, **limits).orderBy("block_no").collect()]

    # a row of n words counts twice: as a row and as a fact
    assert blocks([40] * 6) == [[0, 1, 2], [3, 4, 5]]
    assert blocks([40, 40, 300, 40, 40]) == [[0, 1], [2], [3, 4]]
    assert blocks([1] * 12) == [list(range(10)), [10, 11]]
    assert blocks([40] * 3, target=400, hard=200) == [[0], [1], [2]]


def test_constrained_extraction(spark):
    assert one(spark, arrays.parse_extraction(F.lit('x {"answer": "7", "evidence_span": "is \\"7\\" }"} y'))).asDict() == {"answer": "7", "evidence_span": 'is "7" }', "ok": True}
    assert one(spark, answering.validate_span(F.lit("7"), F.lit("not there"), F.lit("text"))).asDict() == {"answer": None, "evidence_span": None}


def test_coerce_number_of_brackets_and_percent(spark):
    assert one(spark, numeric.coerce_number(F.lit("(5)%"))).asDict() == {"value": 5.0, "is_percent": True}
    assert one(spark, numeric.coerce_number(F.lit("(5%)")))["value"] is None


def test_mcnemar():
    exact, chi = evaluation.mcnemar_p(1, 6)
    assert exact == pytest.approx(2 * sum(math.comb(7, i) for i in range(2)) / 2**7)
    assert 0 < chi < 1 and evaluation.mcnemar_p(0, 0) == (1.0, 1.0)


def test_bootstrap_holds_the_mean(spark):
    a = spark.range(500).select(F.col("id").alias("query_id"), (F.col("id") % 4 / 4.0).alias("value"))
    row = evaluation.paired_bootstrap(a, a.withColumn("value", F.lit(0.0)), 200).first()
    assert row["low"] < row["delta"] < row["high"] and row["delta"] == pytest.approx(0.375)


def test_number_answer(spark):
    rows = [("q", "What was the budget deficit?", 1, "c", "The variance shows a deficit of £2.5 million against budget in 2021.", False)]
    results = spark.createDataFrame(rows, "query_id string, question string, rank int, chunk_id string, text string, is_table boolean")
    assert answering.best_number(results).first()["answer"] == "£2,500,000"
    assert answering.predict_answer(results).first()["answer"] == "£2,500,000"


def test_first_sentence_with_most_words(spark):
    rows = [("q", "Who chairs the audit group?", 1, "c", "Nothing here. The audit group is the body that meets. Others chairs.", False)]
    results = spark.createDataFrame(rows, "query_id string, question string, rank int, chunk_id string, text string, is_table boolean")
    assert answering.sentence_answer(results).first()["answer"] == "The audit group is the body that meets."


def test_small_financial_table(spark):
    table = "Consolidated Net Assets (£000's)\nItem 2024/25 2023/24\nTotal assets 1,559,285 1,512,300\nTotal liabilities (64,947) (60,100)\nNet assets 1,494,338 1,452,200\n"
    prose = "This report includes a single reference to £000 in the notes. The narrative\nexplains performance but does not present tabular figures or columns.\n"
    wide = "Header  2024  2023  2022\nLine A  1,000  2,000  3,000\nLine B  4,000  5,000  6,000\nLine C  7,000  8,000  9,000\n"
    assert [one(spark, classify.is_table_like(F.lit(t))) for t in (table, prose, wide)] == [True, False, True]


def test_graphics_tables(spark):
    shape = "array<struct<op:string,x0:double,y0:double,x1:double,y1:double,filled:boolean>>"
    grid = [("l", 0.0, float(i), 100.0, float(i), False) for i in range(10)] + [("l", float(i), 0.0, float(i), 100.0, False) for i in range(5)]
    plot = [("c", 0.0, 0.0, 1.0, 1.0, False)] * 50 + [("re", 0.0, 0.0, 40.0, 40.0, True)] * 9
    df = spark.createDataFrame([(grid,), (plot,), ([],)], f"d {shape}")
    assert [r["g"] for r in df.select(classify.is_graphics_table(F.col("d")).alias("g")).collect()] == [True, False, False]


def test_heading_pairs(spark):
    lines = spark.createDataFrame([("d", 1, i, t, 12.0, 10.0) for i, t in enumerate(["A", "Management Report", "Part A", "Financial Highlights", "some prose here."])], "doc_id string, page_number int, line_no int, text string, max_size double, p95 double")
    assert [r["heading"] for r in classify.heading_candidates(lines).orderBy("line_no").collect()] == ["A Management Report", "Financial Highlights"]


def test_page_wise_sections(spark):
    rows = [("d", p, "P", "S", "U", "t") for p in (1, 2, 3)] + [("d", p, "P", "S2", "U", "t") for p in (4, 5)]
    labels = spark.createDataFrame(rows, "doc_id string, page_number int, part string, section_title string, subsection_title string, text string")
    assert [(r["page_start"], r["page_end"]) for r in sections.section_spans(labels).orderBy("section_no").collect()] == [(1, 3), (4, 5)]
    assert sections.section_spans(labels, page_wise=True).count() == 3


def test_title_matches(spark):
    wanted = spark.createDataFrame([("d", "Financial overview"), ("d", "Governance statment")], "doc_id string, wanted string")
    titles = spark.createDataFrame([("d", 1, "Overview (financial)"), ("d", 2, "Governance Statement")], "doc_id string, position int, title string")
    assert {r["wanted"]: r["position"] for r in sections.title_matches(wanted, titles).collect()} == {"Financial overview": 1, "Governance statment": 2}


def test_duplicate_keys_fail(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "chunk_id int, text string")
    with pytest.raises(ValueError, match="not unique"):
        analytics.require_unique(df, "chunk_id")
    with pytest.raises(ValueError, match="no vector"):
        io.save_index(df.limit(1), df.where("false").select("chunk_id", F.array(F.lit(1.0)).alias("embedding")), str(tmp_path))


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    plan = rt.apply_filters(df.withColumnRenamed("source", "trust_id"), doc_id=3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,3)" in plan


def test_broadcast_only_what_is_small(spark):
    df = spark.range(1000)
    assert rt.small(df, 1) is df and rt.small(df) is not df


def test_hits_csv_and_manifest(spark, tmp_path):
    hits = page_hits(spark, [(1, "c1", [4, 5])])
    io.write_hits_csv(hits, f"{tmp_path}/h")
    assert io.read_hits_csv(spark, f"{tmp_path}/h", "query_id string, rank int, score double, doc_id string, page_number int, chunk_id string, pages string").first()["pages"] == [4, 5]
    io.write_manifest(f"{tmp_path}/m.json", run="x")
