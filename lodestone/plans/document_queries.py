"""Registered queries: text, classification, sections, tables and answers, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, numeric
from ..functions import text as tx
from ..operators import answering, chunking, classify, evaluation, sections, tables
from ..sources import io
from .retrieval_queries import BM25, asked, sparse_list, table

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rows_sql(rows: list[tuple], columns: str) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns}))"


@register("normalize_line", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS digest FROM documents")
def normalize_line(spark, sf_dir):
    """These documents have no other white space and no typographic characters."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(tx.normalize_page_text(F.col("text"))).alias("digest"))


@register("page_titles", r"""SELECT page_id, trim(regexp_replace(regexp_replace(lower(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&', ' and ')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS title,
trim(regexp_replace(lower(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&', ' and ')), '[^a-z0-9]+', '_', 'g'), '_') AS key FROM pages""")
def page_titles(spark, sf_dir):
    """P10, P12."""
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", tx.normalize_title(t).alias("title"), tx.normalize_key(t).alias("key"))


YEARS = [("Report-2022-2023.pdf", "for 2022-23 only"), ("a_2019", "In 2019 to 2020, period ended 31 March 2020."), ("none", "period  ended 30 February 2021"), ("x1999y2001z2003", "from 2021/22; 2023-2024"), ("2024", "the years 2018 – 2019")]


@register("report_years", f"""SELECT name, CASE WHEN len(y) >= 2 THEN y[1] || '-' || y[2] WHEN len(y) = 1 THEN y[1] END AS from_name,
CASE name WHEN 'Report-2022-2023.pdf' THEN '2022-23' WHEN 'a_2019' THEN '2019-2020' WHEN 'x1999y2001z2003' THEN '2021-22' WHEN '2024' THEN '2018-2019' END AS from_text, CASE name WHEN 'a_2019' THEN '2020-03-31' END AS period_end
FROM (SELECT name, regexp_extract_all(name, '(?:19|20)[0-9][0-9]') AS y FROM {rows_sql(YEARS, "name, text")})""")
def report_years(spark, sf_dir):
    """P4, P5."""
    d = spark.createDataFrame(YEARS, "name string, text string")
    return d.select("name", tx.year_from_name(F.col("name")).alias("from_name"), tx.year_range_from_text(F.col("text")).alias("from_text"), tx.period_end_date(F.col("text")).alias("period_end"))


@register("snippets", "SELECT doc_id, CASE WHEN length(text) > 280 THEN rtrim(left(text, 280), ' ') || ' ...' ELSE text END AS snippet FROM documents")
def snippets(spark, sf_dir):
    """P20."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@register("embedding_text", """SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN lang <> 'en' THEN lang END, CASE WHEN doc_id % 2 = 1 THEN source END, text)) AS digest FROM documents""")
def embedding_text(spark, sf_dir):
    """Language as section ('unknown' for English), source as subsection, even documents as tables."""
    i = F.col("doc_id")
    section = F.when(F.col("lang") == "en", "Unknown").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.embedding_text(section, F.col("source"), F.col("text"), i % 2 == 0)).alias("digest"))


@register("text_artifacts", r"SELECT count(*) AS n, sum(len(regexp_extract_all(text, '\x{AD}'))) AS soft_hyphen, sum(len(regexp_extract_all(text, '[\x{FB00}-\x{FB04}]'))) AS ligature FROM documents")
def text_artifacts(spark, sf_dir):
    """P16."""
    a = tx.find_text_artifacts(F.col("text"))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.sum(a["soft_hyphen"]).alias("soft_hyphen"), F.sum(a["ligature"]).alias("ligature"))


@register("owner_names", "SELECT doc_id, CASE WHEN source IN ('src1', 'src10', 'src11', 'src12', 'src13', 'src14', 'src15', 'src16', 'src17', 'src18', 'src19') THEN 'First Trust' ELSE 'NHS Src' END AS owner FROM documents")
def owner_names(spark, sf_dir):
    """P14."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.trust_of(F.col("source"), {"src1": "First Trust"}).alias("owner"))


QUESTIONS = [
    (1, "What was the total spend on staff costs in Q2?"), (2, "Which emissions target was met; what percentage change in fleet carbon?"), (3, "How many indicators are on track?"),
    (4, "What proportion were complete in Q3?"), (5, "Did the Board Committee review the strategic risk register?"), (6, "Did they endorse the risk appetite and the strategic risk profile?"),
    (7, "What is the core revenue resource limit?"), (8, "What was the deficit of the IJB?"), (9, "waiting time performance rate"), (10, "Who wrote this?"), (11, "Is there a significant delay in q1?"), (12, "What did the accountable officer say of the significant issue?"),
]


@register("route_questions", f"""SELECT id, CASE WHEN q LIKE '%significant%' AND q LIKE '%delay%' THEN 'table_metric_significant_delay' WHEN q LIKE '%on track%' THEN 'table_metric_on_track' WHEN q LIKE '%proportion%' AND q LIKE '%complete%' THEN 'table_metric_complete_ratio'
WHEN regexp_matches(q, 'staff cost|employee benefit|remuneration|pension cost') THEN 'table_metric_staff_costs' WHEN regexp_matches(q, 'emission|greenhouse gas|co2|carbon') THEN 'table_metric_emissions' WHEN regexp_matches(q, 'resource limit|core revenue') THEN 'table_metric_financial_targets'
WHEN regexp_matches(q, 'income|expenditure|surplus|deficit') THEN 'table_metric_financial_statements' WHEN q LIKE '%waiting time%' THEN 'table_metric_performance' WHEN q LIKE '%board committee%' THEN 'governance_board_committee' WHEN q LIKE '%endorse%' THEN 'governance_endorsements'
WHEN q LIKE '%significant issue%' THEN 'governance_significant_issue' ELSE 'unknown' END AS intent, CASE WHEN q LIKE '%q1%' THEN 'q1' WHEN q LIKE '%q2%' THEN 'q2' WHEN q LIKE '%q3%' THEN 'q3' END AS quarter FROM (SELECT id, lower(question) AS q FROM {rows_sql(QUESTIONS, "id, question")})""")
def route_questions(spark, sf_dir):
    """F16, P13, F15."""
    r = tx.route(F.col("question"))
    return spark.createDataFrame(QUESTIONS, "id int, question string").select("id", r["intent"].alias("intent"), r["quarter"].alias("quarter"))


@register("query_rewrites")
def query_rewrites(spark, sf_dir):
    """A question and its variants, without repeats."""
    q = spark.createDataFrame(QUESTIONS, "id int, question string")
    return q.select("id", F.posexplode(tx.distinct_variants(F.concat(F.array("question"), tx.rewrites(F.col("question"))))).alias("variant", "text"))


@register("query_entities", "SELECT id, entities FROM " + rows_sql([(1, "spend,staff,cost,q2"), (3, "many,indicator,track"), (8, "deficit,ijb"), (10, "wrote,thi")], "id, entities"))
def query_entities(spark, sf_dir):
    """P6, P9."""
    q = spark.createDataFrame(QUESTIONS, "id int, question string").where("id in (1, 3, 8, 10)")
    return q.select("id", F.array_join(tx.query_entities(F.col("question")), ",").alias("entities"))


@register("title_overlap", """WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(left(text, 60)), '&', ' and '), '[^a-z0-9 \\t\\n]', ' ', 'g'), '[ \\t\\n]+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 9) AS ratio FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def title_overlap(spark, sf_dir):
    """P22 by words: beginnings of neighbouring documents as titles."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(60)).alias("a"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(b, "doc_id").select("doc_id", F.round(tx.token_set_ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


CELLS = ["1,234", "(1,234)", "12.5%", "(5)%", "(5%)", "-", "n/a", "", "abc", "-7", "1.5", "£3", "(2", "12,34"]


@register("coerce_numbers", f"""SELECT cell, CASE WHEN ok THEN CASE WHEN cell LIKE '(%)' THEN -v ELSE v END END AS value, ok AND cell LIKE '%\\%' ESCAPE '\\' AS is_percent
FROM (SELECT cell, regexp_matches(cell, '^\\(?-?[0-9][0-9,]*(\\.[0-9]+)?\\)?%?$') AS ok, TRY_CAST(regexp_replace(cell, '[(),%]', '', 'g') AS DOUBLE) AS v FROM {rows_sql([(c,) for c in CELLS], "cell")})""")
def coerce_numbers(spark, sf_dir):
    """M3."""
    n = numeric.coerce_number(F.col("cell"))
    return spark.createDataFrame([(c,) for c in CELLS], "cell string").select("cell", n["value"].alias("value"), n["is_percent"].alias("is_percent"))


AMOUNTS = [("£1,234", "£1,234", 1234.0, "currency"), ("£2.5m", "£2,500,000", 2.5e6, "currency"), ("(1,000)", "-1,000", -1000.0, "count"), ("12.50%", "12.5%", 12.5, "percent"), ("3 thousand", "3,000", 3000.0, "count"), ("£3 (000)", "-£3,000", -3000.0, "currency"), ("1.2 bn", "1,200,000,000", 1.2e9, "count"), ("none", None, None, None), ("usd 7.25", "£7.25", 7.25, "currency")]


@register("normalize_amounts", f"SELECT raw, canonical, value::DOUBLE AS value, kind FROM {rows_sql(AMOUNTS, 'raw, canonical, value, kind')}")
def normalize_amounts(spark, sf_dir):
    """M4."""
    n = numeric.normalize_value(F.col("raw"))
    return spark.createDataFrame([(a[0],) for a in AMOUNTS], "raw string").select("raw", numeric.canonical_text(F.col("raw")).alias("canonical"), n["value"].alias("value"), n["dimension"].alias("kind"))


@register("standalone_numbers", "SELECT * FROM " + rows_sql([("£1.5m", 1), ("12 percent of", 0), ("7", 1), ("about 7", 0), ("", 0), ("x" * 65, 0)], "raw, ok"))
def standalone_numbers(spark, sf_dir):
    """M4: texts that are a number and nothing else."""
    raws = [("£1.5m",), ("12 percent of",), ("7",), ("about 7",), ("",), ("x" * 65,)]
    return spark.createDataFrame(raws, "raw string").select("raw", numeric.is_standalone_number(F.col("raw")).cast("int").alias("ok"))


@register("numbers_match", """SELECT o_orderkey, CASE WHEN abs(a - b) <= greatest(1, 0.01 * abs(a)) THEN 'full' WHEN abs(a - b) <= greatest(5, 0.05 * abs(a)) THEN 'partial' ELSE 'none' END AS match
FROM (SELECT o_orderkey, o_totalprice AS a, o_totalprice * (1 + (o_orderkey % 9) / 100.0) AS b FROM orders)""")
def numbers_match(spark, sf_dir):
    """M7, V9."""
    a = F.col("o_totalprice")
    b = a * (1 + (F.col("o_orderkey") % 9) / F.lit(100.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", evaluation.numbers_match(a, b, F.lit(False), F.lit(False)).alias("match"))


@register("text_ratios", r"""SELECT doc_id, round(len(regexp_extract_all(text, '[0-9]')) / greatest(length(regexp_replace(text, '[ \t\n\r]', '', 'g')), 1), 9) AS digits, round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1), 9) AS letters,
length(trim(text)) < 50 OR (length(regexp_replace(trim(text), '[^\p{L}]', '', 'g')) / greatest(length(trim(text)), 1) < 0.3 AND length(regexp_replace(trim(text), '[^\p{Nd}]', '', 'g')) / greatest(length(trim(text)), 1) < 0.6) AS needs_ocr FROM documents""")
def text_ratios(spark, sf_dir):
    """M6, F4, F10."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(numeric.digit_ratio(t), 9).alias("digits"), F.round(numeric.alpha_ratio(t), 9).alias("letters"), classify.page_needs_ocr(t).alias("needs_ocr"))


@register("ocr_quality", r"""WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]+') AS tok, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines, regexp_replace(text, '[ \t\n\r]', '', 'g') AS dense FROM documents),
m AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(tok) AS t FROM d) WHERE length(t) <= 4 GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, length(text) < 200 OR len(tok) < 30 AS low_text_density, n_lines < 4 AS low_line_count, length(regexp_replace(dense, '[\p{L}\p{N}£%.,()/\-:''’+&]', '', 'g')) / greatest(length(dense), 1) > 0.35 AS high_symbol_ratio, coalesce(most, 0) > 20 AS often FROM d LEFT JOIN m USING (doc_id)""")
def ocr_quality(spark, sf_dir):
    """the run of equal words next to each other is left out here, as the SQL can't say it."""
    q = classify.ocr_quality(F.col("text"))
    d = table(spark, sf_dir, "documents").withColumn("q", q)
    tokens = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), lambda t: F.length(t) <= 4)
    o = F.array_sort(tokens)
    often = F.exists(F.zip_with(o, F.slice(o, 21, 1_000_000), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    return d.select("doc_id", "q.low_text_density", "q.low_line_count", "q.high_symbol_ratio", often.alias("often"))


@register("table_pages")
def table_pages(spark, sf_dir):
    """Orders as pages of text."""
    lines = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.concat_ws("  ", F.lit("Total assets"), F.col("o_orderkey").cast("string"), F.format_number("o_totalprice", 0)))).alias("lines"))
    page = F.concat_ws("\n", F.lit("Balance sheet £000"), F.array_join("lines", "\n"))
    return lines.select("o_custkey", classify.classify_page(page).alias("c"), classify.is_table_like_raw(F.col("lines")).alias("raw"), classify.accept_ocr_table(page).alias("ocr")).select("o_custkey", "c.*", "raw", F.col("ocr.accepted").alias("ocr_accepted"))


@register("table_types", """SELECT p_partkey, CASE WHEN k = 'none' THEN 'unknown' ELSE k END AS kind FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'staff_costs' WHEN 2 THEN 'cash_flow' ELSE 'none' END AS k FROM part)""")
def table_types(spark, sf_dir):
    """the most keywords, the first listed of equals."""
    s = F.col("p_size") % 4
    text = F.when(s == 0, "Balance  sheet: total assets, cash flow").when(s == 1, "Remuneration and pension costs; provisions").when(s == 2, "cash flow, PPE").otherwise("nothing")
    return table(spark, sf_dir, "part").select("p_partkey", classify.table_type(text).alias("kind"))


HEADINGS = [(1, "PERFORMANCE REPORT"), (2, "NHS BOARD REPORT"), (3, "1.2 Financial Review"), (4, "A Management Report"), (5, "this is a sentence."), (6, "Part B of it"), (7, "Contents"), (8, "Digitally signed by X"), (9, "GOVERNANCE STATEMENT 2020"), (10, "See page 3 of Report")]


@register("headings", "SELECT * FROM " + rows_sql([(1, None, 1, 0, 1, 0), (2, None, 1, 0, 0, 1), (3, None, 0, 0, 0, 0), (4, None, 1, 1, 0, 0), (5, None, 0, 0, 0, 0), (6, "Part B", 1, 0, 0, 0), (7, None, 0, 0, 0, 0), (8, None, 1, 0, 0, 0), (9, None, 1, 0, 0, 0), (10, None, 0, 0, 0, 0)], "id, part, heading, lettered, anchor, global"))
def headings(spark, sf_dir):
    """F11, F18."""
    x = F.col("line")
    d = spark.createDataFrame(HEADINGS, "id int, line string")
    return d.select("id", classify.part_label(x).alias("part"), *(f.cast("int").alias(n) for n, f in (("heading", classify.is_heading_text(x)), ("lettered", classify.is_lettered_subsection(x)), ("anchor", classify.is_section_anchor(x)), ("global", classify.is_global_heading(x)))))


def layout(spark, sf_dir) -> DataFrame:
    """Line items as positioned lines: an order is a page."""
    d = table(spark, sf_dir, "lineitem")
    y = F.col("l_linenumber") * F.when(F.col("l_linenumber") > 3, 40.0).otherwise(14.0)
    x = (F.col("l_partkey") % 6) * 90.0
    return d.select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("line_no"), F.concat_ws(" ", "l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("text"), x.alias("x0"), (x + 80).alias("x1"), y.alias("y0"), (y + 12).alias("y1"), F.lit(600.0).alias("page_width"), F.lit(300.0).alias("page_height"), (F.col("l_orderkey") % 4 * 90).alias("rotation"))


@register("strip_margins", """SELECT page_number, count(*) AS kept FROM (SELECT l_orderkey AS page_number, (l_partkey % 6) * 90.0 + 40 AS x, l_linenumber * (CASE WHEN l_linenumber > 3 THEN 40.0 ELSE 14.0 END) + 6 AS y FROM lineitem)
WHERE x >= 12 AND x <= 588 GROUP BY page_number""")
def strip_margins(spark, sf_dir):
    """the pages are wide, so their sides are cut."""
    return classify.strip_margins(layout(spark, sf_dir)).groupBy("page_number").agg(F.count("*").alias("kept"))


@register("word_lines", """WITH w AS (SELECT l_orderkey AS page_number, l_linenumber // 2 AS g, (l_linenumber * 50)::DOUBLE AS x0, (l_linenumber // 2) * 14 + (l_partkey % 3) AS top, l_returnflag || l_quantity::INT AS text FROM lineitem),
l AS (SELECT page_number, g, string_agg(text, ' ' ORDER BY x0, top, text) AS text, min(x0) AS x0, max(x0) + 40 AS x1, min(top)::DOUBLE AS y0, max(top)::DOUBLE + 10 AS y1 FROM w GROUP BY ALL)
SELECT page_number, row_number() OVER (PARTITION BY page_number ORDER BY y0, x0) AS line_no, text, x0, x1, y0, y1 FROM l""")
def word_lines(spark, sf_dir):
    """S3: items of an order as positioned words of a page."""
    n = F.col("l_linenumber")
    top = (F.floor(n / 2) * 14 + F.col("l_partkey") % 3).cast("double")
    words = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_number"), F.concat("l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("text"), (n * 50.0).alias("x0"), (n * 50.0 + 40).alias("x1"), top.alias("top"), (top + 10).alias("bottom"))
    return classify.lines_of_words(words).drop("doc_id")


@register("table_export", """SELECT l_orderkey::VARCHAR AS table_id, row_no, line FROM (SELECT l_orderkey, 0 AS row_no, l_orderkey || ',0,"","Price Q1","Discount & more Q2","Qty Q3"' AS line FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, format('{:,.2f}', l_extendedprice), format('{:.1f}', l_discount * 100), CASE WHEN l_tax > 0.04 THEN '(' || l_quantity::INT || ')' ELSE '-' END), l_orderkey || ',' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, format('{:,.2f}', l_extendedprice), format('{:.1f}', l_discount * 100), CASE WHEN l_tax > 0.04 THEN '(' || l_quantity::INT || ')' ELSE '-' END) || ',"Line ' || l_linenumber || '","' || format('{:,.2f}', l_extendedprice) || '","' || format('{:.1f}', l_discount * 100) || '%","' || CASE WHEN l_tax > 0.04 THEN '(' || l_quantity::INT || ')' ELSE '-' END || '"' FROM lineitem)""")
def table_export(spark, sf_dir):
    """Tables as CSV lines, written and read."""
    io.write_tables(item_tables(spark, sf_dir), path := f"{io.shared_folder(spark)}/tables-{uuid.uuid4().hex}")
    part = F.split("value", ",", 3)
    return spark.read.text(path).select(part[0].alias("table_id"), part[1].cast("int").alias("row_no"), F.col("value").alias("line"))


@register("dehyphenated", "SELECT * FROM " + rows_sql([(1, "development|of"), (2, "x-|Y"), (3, "one|two"), (4, "abcd-|Ef"), (5, "")], "id, lines"))
def dehyphenated(spark, sf_dir):
    """P3."""
    rows = [(1, ["develop-", "ment", "of"]), (2, ["x-", "Y"]), (3, ["one", "two"]), (4, ["ab-", "cd-", "Ef"]), (5, [])]
    return spark.createDataFrame(rows, "id int, lines array<string>").select("id", F.array_join(tx.dehyphenate(F.col("lines")), "|").alias("lines"))


@register("page_regions")
def page_regions(spark, sf_dir):
    """W23."""
    return classify.regions(layout(spark, sf_dir))


@register("column_alignment", """WITH l AS (SELECT l_suppkey AS page_number, (l_partkey % 6) * 90.0 AS x0 FROM lineitem), b AS (SELECT page_number, round_even(x0 / 12, 0) * 12 AS b, count(*) AS n FROM l GROUP BY ALL)
SELECT page_number, sum(n) >= 12 AND count(*) FILTER (n >= 6) >= 5 AS aligned FROM b GROUP BY page_number""")
def column_alignment(spark, sf_dir):
    """F9 by columns: a supplier's items as a page."""
    d = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_suppkey").alias("page_number"), ((F.col("l_partkey") % 6) * 90.0).alias("x0"), F.lit("7").alias("text"))
    return classify.column_aligned_pages(d).select("page_number", "aligned")


@register("heading_candidates")
def heading_candidates(spark, sf_dir):
    """F12."""
    lines = chunking.page_lines(table(spark, sf_dir, "documents")).withColumn("max_size", F.lit(10.0)).withColumn("p95", F.lit(11.0))
    return classify.heading_candidates(lines)


@register("extraction_choice", """SELECT l_orderkey AS page_number, l_linenumber AS table_no FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY m, r * c DESC, c DESC, a DESC, l_linenumber) AS n FROM (
SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS m, l_quantity::INT AS r, (l_partkey % 5) AS c, (l_suppkey % 40 + 60) AS a, l_partkey % 60 AS ws FROM lineitem) WHERE (m = 0 AND a >= 85 AND ws <= 40) OR (m = 1 AND a >= 80 AND ws <= 45) OR m = 2) WHERE n = 1""")
def extraction_choice(spark, sf_dir):
    """Gates by pass, then the largest."""
    m = F.col("l_linenumber") % 3
    d = table(spark, sf_dir, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("table_no"), F.when(m == 0, "lattice").when(m == 1, "hybrid").otherwise("stream").alias("method"), (F.col("l_suppkey") % 40 + 60).alias("accuracy"), (F.col("l_partkey") % 60).alias("whitespace"), F.col("l_quantity").cast("int").alias("n_rows"), (F.col("l_partkey") % 5).alias("n_cols"))
    return classify.choose_extraction(d).select("page_number", "table_no")


# sections: events of a user as pages with labels where the type changes


LABELS = """lab AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS page_number, CASE WHEN event_type = 'purchase' THEN 'S' || (event_id % 3) END AS s, CASE WHEN event_type IN ('purchase', 'click') AND event_id % 2 = 0 THEN 'U' || (event_id % 4) END AS u FROM events),
g AS (SELECT *, count(s) OVER (PARTITION BY doc_id ORDER BY page_number) AS grp FROM lab),
c AS (SELECT doc_id, page_number, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number ROWS UNBOUNDED PRECEDING), 'Unknown') AS section_title,
coalesce(last_value(u IGNORE NULLS) OVER (PARTITION BY doc_id, grp ORDER BY page_number ROWS UNBOUNDED PRECEDING), 'Unknown') AS subsection_title FROM g)"""


def labelled(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    e = F.col("event_id")
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), page.alias("page_number"), F.lit(None).cast("string").alias("part"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("S"), (e % 3).cast("string"))).alias("section_title"), F.when(F.col("event_type").isin("purchase", "click") & (e % 2 == 0), F.concat(F.lit("U"), (e % 4).cast("string"))).alias("subsection_title"))


@register("carry_labels", f"WITH {LABELS} SELECT doc_id, page_number, section_title, subsection_title FROM c")
def carry_labels(spark, sf_dir):
    """W19."""
    return sections.carry_labels(labelled(spark, sf_dir)).drop("part")


SPANS = f"""{LABELS}, n AS (SELECT *, CASE WHEN lag(section_title) OVER w = section_title AND lag(subsection_title) OVER w = subsection_title THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY page_number)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS run FROM n),
sp AS (SELECT doc_id, run AS section_no, any_value(section_title) AS section_title, any_value(subsection_title) AS subsection_title, min(page_number) AS page_start, max(page_number) AS page_end FROM r GROUP BY doc_id, run)"""


def spans(spark, sf_dir) -> DataFrame:
    return sections.section_spans(sections.carry_labels(labelled(spark, sf_dir)).withColumn("text", F.lit("some words")))


@register("section_spans", f"WITH {SPANS} SELECT doc_id, section_no, section_title, subsection_title, page_start, page_end, 2 * (page_end - page_start + 1) AS word_count FROM sp")
def section_spans(spark, sf_dir):
    """Islands."""
    return spans(spark, sf_dir).select("doc_id", "section_no", "section_title", "subsection_title", "page_start", "page_end", "word_count")


@register("section_join", f"""WITH {SPANS}, p AS (SELECT user_id AS doc_id, (event_id % 200)::INT AS page_number, event_id FROM events), m AS (SELECT p.event_id, section_title, row_number() OVER (PARTITION BY event_id ORDER BY section_no DESC) AS n FROM p JOIN sp ON sp.doc_id = p.doc_id AND p.page_number BETWEEN page_start AND page_end)
SELECT p.event_id, coalesce(section_title, 'Unknown') AS section_title FROM p LEFT JOIN m ON m.event_id = p.event_id AND n = 1""")
def section_join(spark, sf_dir):
    """Interval join, the last match wins."""
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 200).cast("int").alias("page_number"), "event_id")
    return sections.attach_spans(points, spans(spark, sf_dir), "section_title").select("event_id", "section_title")


@register("contents_join", """WITH sp AS (SELECT l_orderkey AS doc_id, l_linenumber AS section_no, 'T' || l_linenumber AS title, (l_partkey % 20)::INT AS a, (l_partkey % 20 + l_suppkey % 10)::INT AS b FROM lineitem), p AS (SELECT o_orderkey AS doc_id, (o_custkey % 30)::INT AS page FROM orders),
m AS (SELECT p.doc_id, title, row_number() OVER (PARTITION BY p.doc_id ORDER BY section_no) AS n FROM p JOIN sp ON sp.doc_id = p.doc_id AND page BETWEEN a AND b) SELECT p.doc_id, coalesce(title, 'Unknown') AS title FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND n = 1""")
def contents_join(spark, sf_dir):
    """The first match wins. Keys are unique in this table but for (order, line)."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section_no"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("title"), (F.col("l_partkey") % 20).cast("int").alias("page_start"), (F.col("l_partkey") % 20 + F.col("l_suppkey") % 10).cast("int").alias("page_end"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 30).cast("int").alias("page_number"))
    return sections.attach_spans(p, s, "title", last=False).select("doc_id", "title")


CONTENTS = [("d", 1, i, t) for i, t in enumerate(["Contents", "PERFORMANCE REPORT ...... 3", "Overview of the year ..... 4", "a long title that goes", "on here ....... 6", "ACCOUNTABILITY REPORT .... 9", "Overview of the year ..... 4"], 1)]
CONTENT_PAGES = [("d", 5, "the performance report begins"), ("d", 6, "overview of the year"), ("d", 8, "long title that goes here"), ("d", 11, "accountability report"), ("d", 12, "more")]


@register("contents", "SELECT * FROM " + rows_sql([(1, "PERFORMANCE REPORT", 1, "PERFORMANCE REPORT", 5, 5), (2, "Overview of the year", 2, "PERFORMANCE REPORT", 6, 7), (3, "a long title that goes on here", 2, "PERFORMANCE REPORT", 8, 10), (4, "ACCOUNTABILITY REPORT", 1, "ACCOUNTABILITY REPORT", 11, 12)], "section_no, title_raw, level, section_title, page_start, page_end"))
def contents(spark, sf_dir):
    """A page of contents, from lines to spans."""
    lines = spark.createDataFrame(CONTENTS, "doc_id string, page_number int, line_no int, text string")
    pages = spark.createDataFrame(CONTENT_PAGES, "doc_id string, page_number int, text string")
    kept = lines.join(sections.contents_pages(sections.contents_scores(lines)).select("doc_id", "page_number"), ["doc_id", "page_number"])
    items = sections.parse_contents(kept)
    last = pages.groupBy("doc_id").agg(F.max("page_number").alias("last_page"))
    return sections.contents_spans(items, sections.page_offset(items, pages), last).drop("doc_id")


@register("canonical_titles", "SELECT * FROM " + rows_sql([("Notes to the Accounts (continued)", "FINANCIAL STATEMENTS", "NOTES TO THE ACCOUNTS"), ("Performance  Report", "PERFORMANCE REPORT", "PERFORMANCE REPORT"), ("b. overview", "B. OVERVIEW", "B) OVERVIEW"), ("Note 4. Staff", "FINANCIAL STATEMENTS", "NOTE 4 STAFF"), ("iv) risk", "IV) RISK", "iv) RISK"), ("", "Unknown", "Unknown")], "title, section, subsection"))
def canonical_titles(spark, sf_dir):
    """P11."""
    t = F.col("title")
    rows = [(x,) for x in ("Notes to the Accounts (continued)", "Performance  Report", "b. overview", "Note 4. Staff", "iv) risk", "")]
    return spark.createDataFrame(rows, "title string").select("title", sections.section_title(t).alias("section"), sections.subsection_title(t).alias("subsection"))


# tables: an order's items


def item_tables(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    row = F.array(F.concat_ws(" ", F.lit("Line"), F.col("l_linenumber").cast("string")), F.format_number("l_extendedprice", 2), F.concat(F.format_number(F.col("l_discount") * 100, 1), F.lit("%")), F.when(F.col("l_tax") > 0.04, F.concat(F.lit("("), F.col("l_quantity").cast("int").cast("string"), F.lit(")"))).otherwise("-"))
    listed = d.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("r"))
    headers = F.array(*map(F.lit, ("", "Price Q1", "Discount & more Q2", "Qty Q3")))
    return listed.select(F.col("l_orderkey").cast("string").alias("table_id"), F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), headers.alias("headers"), F.col("r.row").alias("cells"))


@register("table_facts", """WITH i AS (SELECT * FROM lineitem) SELECT l_orderkey AS doc_id, 'line_' || l_linenumber AS row_label_norm, h AS column_header_norm, q AS quarter, round(v, 6) AS value_num, p AS is_percent FROM (
SELECT l_orderkey, l_linenumber, 'price_q1' AS h, 'q1' AS q, round(l_extendedprice, 2) AS v, false AS p FROM i UNION ALL SELECT l_orderkey, l_linenumber, 'discount_and_more_q2', 'q2', round(l_discount * 100, 1), true FROM i UNION ALL SELECT l_orderkey, l_linenumber, 'qty_q3', 'q3', -l_quantity::INT, false FROM i WHERE l_tax > 0.04)""")
def table_facts(spark, sf_dir):
    """E9, M3."""
    return tables.facts(item_tables(spark, sf_dir), "doc_id").select("doc_id", "row_label_norm", "column_header_norm", "quarter", F.round("value_num", 6).alias("value_num"), "is_percent")


@register("table_lookup", """WITH i AS (SELECT * FROM lineitem), best AS (SELECT l_orderkey, arg_max(CASE WHEN l_tax > 0.04 THEN NULL END, 1) AS x, max(round(l_extendedprice, 2)) AS v FROM i GROUP BY l_orderkey) SELECT l_orderkey AS query_id, v AS value_num, 'price_q1' AS column_header_norm FROM best""")
def table_lookup(spark, sf_dir):
    """The largest price; the row term fits nothing and is passed over."""
    t = item_tables(spark, sf_dir)
    f = tables.facts(t, "doc_id").withColumn("page", F.lit(1)).withColumn("table_type", F.lit("unknown"))
    q = t.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(1).alias("page"), F.lit("other").alias("table_type"), F.array(F.lit("nothing")).alias("row_terms"), F.array(F.lit("Price")).alias("column_terms"), F.lit("q1").alias("quarter"), F.lit(False).alias("prefer_percent"))
    return tables.lookup(q, f).select("query_id", "value_num", "column_header_norm")


@register("markdown_round_trip", """SELECT l_orderkey::VARCHAR AS table_id, count(*) AS n_rows, 4 AS n_columns FROM lineitem GROUP BY l_orderkey""")
def markdown_round_trip(spark, sf_dir):
    """Rendered and parsed again; rows with equal cells only."""
    parsed = tables.parse_markdown(F.concat(F.lit("before\n"), tables.markdown(F.col("headers"), F.col("cells"))))
    # as the rows of a list: a filter on a column would parse a second time
    same = F.filter(F.array(parsed), lambda m: m["cells"] == F.col("cells"))
    return item_tables(spark, sf_dir).select("table_id", F.explode(same).alias("m")).select("table_id", F.size("m.cells").alias("n_rows"), F.size("m.headers").alias("n_columns"))


@register("table_chunks")
def table_chunks(spark, sf_dir):
    """All four strategies."""
    return tables.table_chunk_sets(item_tables(spark, sf_dir), ("baseline", "row_preserving", "row_blocks", "two_stage"), 60)


@register("distinct_tables", """WITH t AS (SELECT l_orderkey, count(*) AS n, min(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS a FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n FROM t""")
def distinct_tables(spark, sf_dir):
    """Each table twice, once kept."""
    t = item_tables(spark, sf_dir)
    return tables.distinct_tables(t.unionByName(t.withColumn("table_id", F.concat(F.col("table_id"), F.lit("copy"))))).agg(F.count("*").alias("n"))


@register("best_rows")
def best_rows(spark, sf_dir):
    """T4, T5."""
    return tables.best_rows(tables.row_records(item_tables(spark, sf_dir)), 2).select("table_id", "row_no", "label", "line")


# answers: the best chunks of each query


def results(spark, sf_dir) -> DataFrame:
    q = asked(spark, sf_dir).select("query_id", F.concat(F.lit("What was the total value of "), F.left("text", F.lit(60)), F.lit("?")).alias("question"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("text"), F.array((F.col("doc_id") % 9).cast("int")).alias("pages"))
    # the hits meet the texts first: they alone are known to be few
    met = sparse_list(spark, sf_dir, 8).select("query_id", "rank", "chunk_id").join(d, "chunk_id").join(q, "query_id")
    return met.select("chunk_id", "query_id", "rank", "question", "text", "pages", F.lit(False).alias("is_table"))


@register("number_answers")
def number_answers(spark, sf_dir):
    """Q1, E14, T6."""
    return answering.best_number(results(spark, sf_dir))


@register("predicted_answers")
def predicted_answers(spark, sf_dir):
    """Q2, Q3, E15."""
    return answering.predict_answer(results(spark, sf_dir))


@register("single_chunk_answers", r"""SELECT doc_id, CASE WHEN m <> '' THEN trim(m) END AS answer FROM (SELECT doc_id, regexp_extract(text, '[0-9][0-9,]*(?:\.[0-9]+)?') AS m FROM documents)""")
def single_chunk_answers(spark, sf_dir):
    """Q4."""
    return table(spark, sf_dir, "documents").select("doc_id", answering.single_chunk_answer(F.lit("how many?"), F.col("text")).alias("answer"))


#: question, intent, text of the best chunk, text of the next, answer, label
ASKED = [
    ("How many show significant delay in Q2?", "general", "Status Significant Delay 3 - 7 1 end", None, "Status Significant Delay 3 - 7 1 end", "Snippet"),
    ("How many show significant delay in Q3?", "general", "Status Significant  Delay 3 - 7 1 end", None, "Status Significant  Delay 3 - 7 1 end", "Snippet"),
    ("Significant delay in q3?", "general", "Status Significant Delay 3 - 7 1 end", None, "7", "Significant Delay (Q3)"),
    ("How many are on track in Q1?", "general", "The plan. on track 12 10 9 8.", None, "12", "On Track (Q1)"),
    ("How many are on track?", "general", "The plan. On Track 12 10 9 8.", None, "The plan.", "Snippet"),
    ("What proportion was complete?", "general", "Of all, 62.5% of actions were complete.", None, "62.5%", "Complete (%)"),
    ("What proportion was complete?", "general", "It is complete for 40% of them", None, "40%", "Complete (%)"),
    ("Which board committee owns the strategic risk register?", "general", "Here the audit & risk committee has delegated responsibility.", None, "Audit & Risk Committee", "Delegated Committee"),
    ("When did the board endorse the risk appetite and the strategic risk profile?", "general", "It endorsed the Risk Appetite Statement on the 3rd May 2021. More.", "The board endorsed a strategic risk profile in June 2021.", "Risk Appetite: 3rd May 2021; Strategic Risk Profile: June 2021", "Board Endorsements"),
    ("When did it endorse the risk appetite?", "general", "Endorsed the risk appetite statement on 1 May 2020. It endorsed the risk appetite statement on 2 May 2020.", None, "2 May 2020", "Risk Appetite Endorsement"),
    ("When did it endorse the strategic risk profile?", "general", "They endorsed the strategic risk profile again in July 2022.", None, "July 2022", "Strategic Risk Profile Endorsement"),
    ("What significant issue did the accountable officer name?", "general", "None. A funding arrangement is late. Other.", None, "A funding arrangement is late.", "Significant Issue"),
    ("How many are on track in Q1?", "table_metric_on_track", "A table! On Track 12 10 9 8", None, "A table!", "Snippet"),
    ("What else?", "general", "One sentence. Two.", None, "One sentence.", "Snippet"),
    ("What else?", "general", "", None, "(no chunk text available)", "Snippet"),
    ("What else?", "general", "  ", None, "(no extraction rule matched)", "Snippet"),
]


@register("fallback_answers", "SELECT * FROM " + rows_sql([(i, *row[4:]) for i, row in enumerate(ASKED)], "id, answer, label"))
def fallback_answers(spark, sf_dir):
    """Q8: every rule, and the snippet behind them."""
    rows = [(i, *row[:4]) for i, row in enumerate(ASKED)]
    d = spark.createDataFrame(rows, "id int, question string, intent string, text string, next string")
    found = answering.extraction_answer(F.col("question"), F.col("intent"), F.col("text"), F.array_compact(F.array("next")))
    return d.select("id", found["answer"].alias("answer"), found["label"].alias("label"))


@register("dimensions", """SELECT item_id, CASE WHEN k = 0 THEN 'currency' WHEN k = 1 THEN 'percent' WHEN k = 2 THEN 'currency' END AS dimension, CASE WHEN k = 0 THEN 'variance,surplus,deficit,overspend,underspend,budget' WHEN k = 3 THEN 'deficit,surplus,overspend,shortfall,variance,total,cash requirement' ELSE '' END AS cues
FROM (SELECT item_id, CASE WHEN item_id % 4 = 3 THEN 3 ELSE item_id % 4 END AS k FROM benchmark) WHERE k < 3 UNION ALL SELECT item_id, 'currency', 'deficit,surplus,overspend,shortfall,variance,total,cash requirement' FROM benchmark WHERE item_id % 4 = 3""")
def dimensions(spark, sf_dir):
    """Q1: the dimension that is asked for, and the cues."""
    k = F.col("item_id") % 4
    q = F.when(k == 0, "What was the spending?").when(k == 1, "Which proportion of funding?").when(k == 2, "What FUNDING did it get?").otherwise("Overall total cash requirement and shortfall?")
    return table(spark, sf_dir, "benchmark").select("item_id", answering.expected_dimension(q).alias("dimension"), F.array_join(answering.cue_terms(q), ",").alias("cues"))


@register("prompts", f"""WITH {BM25}, r AS (SELECT query_id, rank, length(left(text, 2200)) AS n, sum(length(left(text, 2200))) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS s FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 8),
k AS (SELECT *, max(CASE WHEN rank <= 5 AND s <= 9000 THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS bad FROM r) SELECT query_id, count(*) AS n_chunks, sum(n) AS n_chars FROM k WHERE bad = 0 GROUP BY query_id""")
def prompts(spark, sf_dir):
    """Q5."""
    return answering.prompts(results(spark, sf_dir)).select("query_id", "n_chunks", "n_chars")


@register("citations", f"""WITH {BM25} SELECT query_id, 2 AS parsed, count(*) FILTER (rank = 1) AS valid, CASE WHEN count(*) FILTER (rank = 1) > 0 THEN 'ok' ELSE 'insufficient_evidence' END AS status, count(*) FILTER (rank = 1) / 2 AS confidence FROM sparse WHERE rank <= 8 GROUP BY query_id""")
def citations(spark, sf_dir):
    """Each answer cites its first chunk rightly, and once wrongly."""
    r = results(spark, sf_dir)
    one = r.where("rank = 1").select("query_id", F.concat(F.lit("As in [p0001_"), F.col("chunk_id").cast("string"), F.lit(", p. "), F.get("pages", F.lit(0)).cast("string"), F.lit("] and (p0001_x p77).")).alias("answer"))
    cited = one.select("query_id", F.explode(arrays.citations_in(F.col("answer"))).alias("c")).select("query_id", "c.*")
    there = r.select("query_id", F.concat(F.lit("p0001_"), F.col("chunk_id").cast("string")).alias("chunk_id"), "pages")
    out = answering.check_citations(cited, there)
    s = answering.answer_status(F.lit("x"), F.col("parsed"), F.col("valid"))
    return out.select("query_id", "parsed", "valid", s["status"].alias("status"), s["confidence"].alias("confidence"))


RAW = ['{"answer": "a", "evidence_span": "b {x}"}', 'so: {"answer": null, "evidence_span": null} ok', '{"answer": "a"}', '{"answer": 3, "evidence_span": "b"}', 'no json', '{"answer": "a", "evidence_span": "b", "more": 1}']


@register("parse_extractions", "SELECT * FROM " + rows_sql([(0, "a", "b {x}", 1), (1, None, None, 1), (2, None, None, 0), (3, None, None, 0), (4, None, None, 0), (5, None, None, 0)], "id, answer, evidence_span, ok"))
def parse_extractions(spark, sf_dir):
    """A4, A5, F21."""
    p = arrays.parse_extraction(F.col("raw"))
    return spark.createDataFrame(list(enumerate(RAW)), "id int, raw string").select("id", p["answer"].alias("answer"), p["evidence_span"].alias("evidence_span"), p["ok"].cast("int").alias("ok"))


@register("parse_generations", "SELECT event_id, props AS answer, 0 AS n FROM events")
def parse_generations(spark, sf_dir):
    """JSON without an answer is text."""
    p = arrays.parse_generation(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", p["answer"].alias("answer"), F.size(p["citations"]).alias("n"))


@register("page_lists", "SELECT * FROM " + rows_sql([("3", "3"), ("[5, 3, 3]", "3,5"), ('[{"element": 7}]', "7"), ("2.0", "2"), ("x", ""), ("2.5", "")], "raw, pages"))
def page_lists(spark, sf_dir):
    """A1, A2, A3."""
    rows = [(x,) for x in ("3", "[5, 3, 3]", '[{"element": 7}]', "2.0", "x", "2.5")]
    return spark.createDataFrame(rows, "raw string").select("raw", F.array_join(arrays.pages_list(F.col("raw"), True), ",").alias("pages"))


@register("page_spans", "SELECT l_orderkey, l_linenumber, array_to_string(range(least(a, b), greatest(a, b) + 1), ',') AS pages FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 7)::INT AS a, (l_suppkey % 7)::INT AS b FROM lineitem)")
def page_spans(spark, sf_dir):
    """A2."""
    p = arrays.pages_from_span((F.col("l_partkey") % 7).cast("int"), (F.col("l_suppkey") % 7).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(p, ",").alias("pages"))


@register("query_ids", "SELECT conv_id, turn, regexp_matches(role || '-' || conv_id, '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AS ok, role AS prefix, conv_id::INT AS number FROM conversations")
def query_ids(spark, sf_dir):
    """A9."""
    i = F.concat_ws("-", "role", F.col("conv_id").cast("string"))
    p = arrays.query_id_parts(i)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", arrays.is_query_id(i).alias("ok"), p["prefix"].alias("prefix"), p["number"].alias("number"))
