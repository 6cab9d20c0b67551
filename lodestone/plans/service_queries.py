"""Registered queries: whole flows, markdown, and what is left of scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, evaluation, markdown, tables
from ..operators import retrieval as rt
from ..sources import io
from . import service
from .analysis_queries import _folder, labelled_vectors, systems
from .document_queries import QUESTIONS, item_tables, rows_sql
from .retrieval_queries import asked, table, vector_sides

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def indexed(spark, sf_dir):
    """Chunks written once, as a search reads them several times."""
    io.write_table(service.ingest(table(spark, sf_dir, "documents")), path := _folder(spark, "chunks"))
    return io.read_table(spark, path)


@register("ingest")
def ingest(spark, sf_dir):
    """Documents to chunks: S8, G3, F10, W19, E1."""
    return service.ingest(table(spark, sf_dir, "documents"))


@register("search")
def search(spark, sf_dir):
    """Questions to chunks of pages, reranked: §3.2."""
    return service.search(asked(spark, sf_dir), indexed(spark, sf_dir)).drop("text")


@register("search_hybrid")
def search_hybrid(spark, sf_dir):
    """Both rankings fused, over documents."""
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(1).alias("page_number"), F.array(F.lit(1)).alias("pages"), "text")
    return service.search(asked(spark, sf_dir), c, service.SearchConfig(fusion="score_fusion"), *vector_sides(spark, sf_dir)).drop("text")


@register("search_answers")
def search_answers(spark, sf_dir):
    """Search, then answers."""
    chunks, q = indexed(spark, sf_dir), asked(spark, sf_dir)
    io.write_table(service.search(q, chunks), path := _folder(spark, "found"))
    return service.answer(io.read_table(spark, path), q)


@register("page_markdown", """SELECT doc_id, '# Part A' || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || '#### Page ' || (doc_id % 9) || chr(10) || chr(10) || 'body ' || doc_id || chr(10) || chr(10) || '> Table summary: s' || chr(10) || chr(10) || '> Table facts:' || chr(10) || '> f' || doc_id || chr(10) || chr(10) || '| m |' AS page FROM documents""")
def page_markdown(spark, sf_dir):
    """P19."""
    i = F.col("doc_id").cast("string")
    t = F.array(F.struct(F.lit("s ").alias("summary"), F.concat(F.lit("f"), i).alias("facts"), F.lit("| m |").alias("markdown")))
    page = markdown.page_markdown(F.col("doc_id") % 9, F.concat(F.lit("body "), i), F.lit("Part A"), F.col("lang"), F.lit("Unknown"), t)
    return table(spark, sf_dir, "documents").select("doc_id", page.alias("page"))


@register("row_maps", """WITH i AS (SELECT l_orderkey, l_linenumber, format('{:,.2f}', l_extendedprice) AS p, format('{:.1f}', l_discount * 100) || '%' AS d, CASE WHEN l_tax > 0.04 THEN '(' || l_quantity::INT || ')' END AS q FROM lineitem)
SELECT l_orderkey::VARCHAR AS table_id, string_agg('- Line ' || l_linenumber || ' -> col_1=' || p || ' ; col_2=' || d || coalesce(' ; col_3=' || q, ''), chr(10) ORDER BY l_linenumber, p, d, coalesce(q, '-')) AS lines FROM i GROUP BY l_orderkey""")
def row_maps(spark, sf_dir):
    """E10, T5."""
    return item_tables(spark, sf_dir).select("table_id", F.array_join(markdown.row_map(F.col("headers"), F.col("cells")), "\n").alias("lines"))


@register("merged_headers", "SELECT " + "'Salary 2024,Total remuneration'" + " AS headers, 'Row label,Total remuneration' AS names")
def merged_headers(spark, sf_dir):
    """Two header rows."""
    rows = F.array(F.array(F.lit("Salary"), F.lit("Total ")), F.array(F.lit("2024"), F.lit("remuneration")), F.array(F.lit(""), F.lit("remuneration")))
    h = markdown.merge_headers(rows, F.lit(2))
    return spark.range(1).select(F.array_join(h, ",").alias("headers"), F.array_join(markdown.aliases(h), ",").alias("names"))


@register("clean_tables", "SELECT l_orderkey::VARCHAR AS table_id, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def clean_tables(spark, sf_dir):
    """A first row of words becomes the header of a table without one."""
    words = F.array(*map(F.lit, ("Item", "Price", "Discount", "Quantity")))
    t = item_tables(spark, sf_dir).select("table_id", tables.clean_table(F.array(*map(F.lit, ("0", "1", "2", "3"))), F.concat(F.array(words), F.col("cells"), F.array(F.array_repeat(F.lit(" "), 4)))).alias("c"))
    return t.where(F.col("c.headers") == words).select("table_id", F.size("c.cells").alias("n"))


@register("merge_split_rows", "SELECT o_custkey::VARCHAR AS table_id, 0 AS row_no, 'Staff' AS label, min(o_orderkey)::VARCHAR AS value FROM orders GROUP BY o_custkey")
def merge_split_rows(spark, sf_dir):
    """A label above its values."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("table_id")).agg(F.min("o_orderkey").cast("string").alias("v"))
    top = o.select("table_id", F.lit(0).alias("row_no"), F.lit("Staff").alias("label"), F.array(F.lit("")).alias("values"))
    low = o.select("table_id", F.lit(1).alias("row_no"), F.lit("").alias("label"), F.array("v").alias("values"))
    return tables.merge_split_rows(top.unionByName(low)).select("table_id", "row_no", "label", F.get("values", F.lit(0)).alias("value"))


@register("milestone_boosts", "SELECT id, boost::DOUBLE AS boost FROM " + rows_sql([(1, 0.12), (2, 0.2), (3, 0.13), (4, 0.15), (5, 0.0), (6, 0.0), (7, 0.0), (8, 0.0), (9, 0.0), (10, 0.0), (11, 0.08), (12, 0.0)], "id, boost"))
def milestone_boosts(spark, sf_dir):
    """W12."""
    text = F.lit("Milestones on track and complete in Q3; remuneration and total pension; target emissions and percentage change of carbon")
    q = spark.createDataFrame(QUESTIONS, "id int, question string")
    return q.select("id", F.round(rt.milestone_boost(F.col("question"), text), 6).alias("boost"))


ANSWERS = [(1, "£1,000", "it was £1,005", "number", "correct"), (2, "100", "104", "number", "partial"), (3, "12%", "12", "number", "correct"), (4, "the audit committee", "The Audit Committee met", "text", "correct"), (5, "audit committee", "a committee", "text", "partial"), (6, None, "x", "text", "not_scored"), (7, "north", "south", "text", "incorrect"), (8, "7", "none", "number", "incorrect")]


@register("answer_scores", f"SELECT id, status FROM {rows_sql(ANSWERS, 'id, expected, found, kind, status')}")
def answer_scores(spark, sf_dir):
    """V8, V9, V10, G7."""
    d = spark.createDataFrame([a[:4] for a in ANSWERS], "id int, expected string, found string, kind string")
    return d.select("id", evaluation.answer_match(F.col("expected"), F.col("found"), F.col("kind")).alias("status"))


@register("expected_in_documents", "SELECT doc_id, regexp_matches(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[\\s,]+', ' ', 'g'), '[^a-z0-9% ]+', ' ', 'g'), ' +', ' ', 'g')), 'of the') AS there FROM documents")
def expected_in_documents(spark, sf_dir):
    """V8."""
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.expected_in_context(F.lit("Of, the"), F.col("text"), F.lit("text")).alias("there"))


@register("wilcoxon")
def wilcoxon(spark, sf_dir):
    """G16."""
    w, p = evaluation.wilcoxon(*systems(spark, sf_dir))
    return spark.createDataFrame([(w, round(p, 9))], "statistic double, p double")


@register("pca_radius")
def pca_radius(spark, sf_dir):
    """G21."""
    return analytics.pca_radius(labelled_vectors(spark, sf_dir), "label").withColumn("radius", F.round("radius", 4))


@register("text_lookup", "SELECT c.vec_id AS chunk_id, coalesce(a.text, b.text) AS text FROM embeddings c LEFT JOIN documents a ON a.doc_id = c.vec_id AND a.doc_id % 2 = 0 LEFT JOIN documents b ON b.doc_id = c.vec_id")
def text_lookup(spark, sf_dir):
    """Global ids first."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    c = d.select(F.when(i % 2 == 0, i).alias("chunk_id_global"), i.alias("chunk_id"), "text", i.alias("chunk_ord"))
    return rt.text_lookup(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")), c)
