"""What larger and odd inputs asked for: work done once, tables that are folders, lists that stay short."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import best_chunks, chunking, sections, tables
from lodestone.operators import retrieval as rt
from lodestone.plans import registry
from lodestone.plans.document_queries import item_tables
from lodestone.sources import io
from lodestone.streaming import events


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_markdown_is_parsed_once(spark, sf):
    parsed = spark.createDataFrame([("x",)], "m string").select(tables.parse_markdown(F.col("m")).alias("t"))
    assert plan(parsed).count("split(") == 2  # the text at line breaks, a line at bars
    assert plan(registry.QUERIES["markdown_round_trip"](spark, sf)).count("split(") == 2


@pytest.mark.parametrize(("text", "want"), [
    ("x\n| a | b |\n|---|:-:|\n| 1 |\n| 2 | 3 | 4 |\n| -- | - |\n|5|", (["a", "b", ""], [["1", "", ""], ["2", "3", "4"], ["5", "", ""]])),
    ("| a |\n| b |\nno rule", None),
    ("|---|\n| a |", None),
    ("| a |\n|---|", None),
    ("plain", None),
    (None, None),
])
def test_parse_markdown_cases(spark, text, want):
    got = spark.createDataFrame([(text,)], "m string").select(tables.parse_markdown(F.col("m")).alias("t")).first()["t"]
    assert (got and (got["headers"], got["cells"])) == want


@pytest.fixture
def folders(spark, sf, tmp_path):
    """The tables as folders of several files."""
    for name in ("labels", "benchmark", "conversations", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["files", "stream_routes", "stream_windows", "stream_distinct"])
def test_tables_may_be_folders(spark, sf, folders, name):
    rows = lambda d: sorted(map(str, registry.QUERIES[name](spark, d).collect()))
    assert rows(folders) == rows(sf) != []


def test_discover(spark, tmp_path):
    for path, n in (("a.pdf", 1), ("sub/b.x.pdf", 2), ("sub/c.pdf/p0", 3), ("sub/c.pdf/deep/p1.pdf", 4), ("d.txt", 5), ("pdf", 6)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * n)
    got = {(r["doc_id"], r["path"].removeprefix(f"file:{tmp_path}/"), r["size"]) for r in io.discover(spark, str(tmp_path)).collect()}
    assert got == {("a", "a.pdf", 1), ("b.x", "sub/b.x.pdf", 2), ("c", "sub/c.pdf", 7)}


def test_stream_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], events.SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    assert registry.QUERIES["stream_distinct"](spark, str(tmp_path)).first()["n"] == 0


def words(rng, n):
    return " ".join(rng.choice(["a1", "bb", "cc-d", "ee", "ff", "gg", "hh"]) for _ in range(n))


@pytest.mark.parametrize(("k", "digits", "kind", "bound"), [(1, 6, "long", 1), (3, None, "string", 1 << 18), (5, 2, "string", 1), (500, 9, "long", 1 << 18)])
def test_best_chunks_are_those_of_all_pairs(spark, monkeypatch, k, digits, kind, bound):
    for name in ("PRODUCTS", "CELLS", "WAITING"):
        monkeypatch.setattr(best_chunks, name, bound)
    rng = random.Random(k)
    texts = [words(rng, rng.randrange(12)) for _ in range(150)]
    texts = [*texts, *texts[:60], None, "", "zz only"]  # copies tie; some have no term
    rng.shuffle(texts)
    chunks = spark.createDataFrame([(i if kind == "long" else f"é{i}", t) for i, t in enumerate(texts)], f"chunk_id {kind}, text string")
    asked = spark.createDataFrame([("q1", "bb cc-d bb"), ("q2", "ee"), ("q3", "a1 bb ee ff gg hh"), ("q4", "nowhere"), ("q5", None)], "query_id string, text string")
    index = rt.bm25_index(chunks)
    for best, scores in ((rt.bm25_top_k, rt.bm25_scores), (rt.okapi_top_k, rt.okapi_scores)):
        rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
        # sums of equal terms in another order may differ in their last bits
        want = rt.top_k(scores(asked, index).withColumn("score", F.round("score", 12)), k, "chunk_id", digits=digits)
        got = best(asked, index, k, 12 if digits is None else digits)
        assert rows(got) == rows(want) != []


def test_best_chunks_of_no_terms(spark):
    asked = spark.createDataFrame([(1, "nowhere")], "query_id long, text string")
    index = rt.bm25_index(spark.createDataFrame([(1, "here")], "chunk_id long, text string"))
    assert rt.bm25_top_k(asked, index, 3).collect() == rt.okapi_top_k(asked, index, 3).collect() == []


def test_rounded_as_spark_rounds(spark):
    rng = random.Random(2)
    values = [0.0, 0.5, 2.5, 1.0000005, 2.0000015, -0.1234565, 12.3456785, 1e15, *(rng.uniform(-50, 50) for _ in range(200)), *(round(rng.uniform(0, 9), 6) + 5e-7 for _ in range(200))]
    want = [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 6).alias("x")).collect()]
    assert best_chunks.rounded(np.array(values), 6).tolist() == want


@pytest.mark.parametrize("name", ["bm25_topk", "multi_variant_merge", "hit_fusion", "page_collapse", "number_answers"])
def test_ranked_lists_are_read_not_joined(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert "terms#" not in plan(df) and any("/sparse-" in f for f in df.inputFiles())


def edged(rng, i):
    """A document of pages with lines that repeat at their edges, headings between, and odd lines."""
    kinds = ["Running  head", "foot 7", "", "  ", "PERFORMANCE REPORT", "A. Staff matters", "B) Other things", "Part A", "part b text", "Docusign envelope ID: GOVERNANCE STATEMENT", words(rng, 30)]
    return i, "\n".join(rng.choice(kinds) for _ in range(rng.randrange(45))) if i % 7 else None


def test_ingest_is_that_of_lines(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([edged(rng, i) for i in range(60)], "doc_id long, text string")
    lines = chunking.page_lines(docs)
    clean = chunking.drop_edges(lines, chunking.repeated_edges(lines))
    grouped = clean.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    want = {(r["doc_id"], r["page_number"]): [x["text"] for x in r["l"]] for r in grouped.collect()}
    pages = chunking.clean_pages(docs)
    got = {(r["doc_id"], p["page_number"]): p["lines"] for r in pages.collect() for p in r["pages"]}
    assert got == want and clean.count() < lines.count()
    old = {tuple(r) for r in sections.carry_labels(sections.labels_from_lines(clean)).collect()}
    mine = sections.carried(F.transform("pages", lambda p: sections.labels_of_lines(p["lines"])))
    new = {(r["doc_id"], p["page_number"], *x) for r in pages.select("doc_id", "pages", mine.alias("labels")).collect() for p, x in zip(r["pages"], r["labels"], strict=True)}
    assert new == old and len({x[3] for x in old}) > 1 and len({x[4] for x in old}) > 1


def test_search_shuffles_no_texts(spark, sf):
    physical = lambda name: registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in physical("ingest")
    assert "Exchange hashpartitioning" not in physical("search")


def block_words(text):
    return len(text.split())


def test_row_blocks_of_many_shapes(spark):
    """Groups against plain Python: the words of each candidate group's text are counted anew."""
    rng = random.Random(8)
    pick = lambda: rng.choice(["", "-", "7", "1 2 3", "some words here", "x" * 9, "Income line", "general", "n/a"])
    made = [(f"t{i}", i, ["Line", "", "2025"], [[pick() for _ in range(rng.randrange(4))] for _ in range(rng.randrange(30))], "cap tion", rng.choice([None, "kind of"]), ["Line", "col_2", "2025"]) for i in range(40)]
    t = spark.createDataFrame(made, "table_id string, page_number int, headers array<string>, cells array<array<string>>, caption string, kind string, names array<string>")
    records = {}
    for r in tables.row_records(t).collect():
        records.setdefault(r["table_id"], []).append(r)

    def text(rows, page, kind):
        own = list(dict.fromkeys(r["category"] for r in rows if r["category"].lower() not in ("", "general")))
        facts = [f for r in rows for f in r["fact_lines"]][:24]
        mark = lambda r: f"{r['category']} :: " if len(own) > 1 and r["category"].lower() != "general" else ""
        told = "Line | col_2 | 2025"
        named = [f"Categories in block: {' | '.join(own[:4])}"] if len(own) > 1 else [f"Active category: {own[0]}"] if own else []
        return "\n".join(["Table: cap tion", f"Page: {page}", *([f"Type: {kind}"] if kind else []), *named, f"Columns: {told}", "Rows:", told, *(mark(r) + r["line"] for r in rows), *(["Facts:"] if facts else []), *facts])

    for target, hard, most in ((320, 450, 10), (60, 80, 4), (90, 50, 3), (40, 400, 100)):
        want = {}
        for name, page, _, _, _, kind, _ in made:
            groups = []
            for r in sorted(records.get(name, []), key=lambda r: r["row_no"]):
                if groups and len(groups[-1]) < most and block_words(text([*groups[-1], r], page, kind)) <= target:
                    groups[-1].append(r)
                else:
                    groups.append([r])
            split = [x for g in groups for x in ([[r] for r in g] if len(g) > 1 and block_words(text(g, page, kind)) > hard else [g])]
            for i, g in enumerate(split):
                whole = text(g, page, kind)
                want[name, i] = (g[0]["row_no"], g[-1]["row_no"], " ".join(whole.split()[:hard]) if block_words(whole) > hard else whole.strip(" "))
        got = {(r["table_id"], r["block_no"]): (r["first_row"], r["last_row"], r["text"]) for r in tables.row_blocks(t, target, hard, most).collect()}
        assert got == want


def test_tables_are_read_once_for_all_chunks(spark, sf):
    df = registry.QUERIES["table_chunks"](spark, sf)
    assert plan(df).count("Relation [") == 1 and "Join" not in plan(df)
    one_by_one = sorted(tuple(r) for s in ("baseline", "row_blocks", "two_stage") for r in tables.table_chunks(item_tables(spark, sf), s, 60).collect())
    assert one_by_one == sorted(tuple(r)[:5] for r in df.where("strategy != 'row_preserving'").collect())


def test_chunks_of_tables_without_cells(spark):
    t = spark.createDataFrame([("a", 1, ["h"], []), ("b", 1, ["h"], None)], "table_id string, page_number int, headers array<string>, cells array<array<string>>")
    kinds = lambda s: sorted((r["table_id"], r["table_chunk_kind"]) for r in tables.table_chunks(t, s).collect())
    assert kinds("row_blocks") == kinds("row_preserving") == []
    assert kinds("baseline") == [("a", "full_table"), ("b", "full_table")]
    assert kinds("two_stage") == [("a", "header"), ("b", "header")]
