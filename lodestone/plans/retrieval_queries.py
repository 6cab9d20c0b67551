"""Registered queries: retrieval, fusion, pages and evaluation, with their SQL.

Documents are chunks, benchmark items are queries; the vector of number n stands for
the item or document n. A query's gold documents hold its text verbatim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, evaluation
from ..operators import retrieval as rt
from ..sources import io

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_INDEXES: dict[tuple[str, str, int], DataFrame] = {}


def index(spark, sf_dir) -> DataFrame:
    """The documents' BM25 index, built once in an application for a state of the table."""
    key = io.version(spark, f"{sf_dir}/documents.parquet")
    if key not in _INDEXES:
        _INDEXES[key] = io.stored(rt.bm25_index(chunks(spark, sf_dir)), "bm25")
    return _INDEXES[key]


def sparse_list(spark, sf_dir, k=100) -> DataFrame:
    """The k best documents of each query, written: k rows a query are few for what they are joined with."""
    best = rt.bm25_top_k(asked(spark, sf_dir), index(spark, sf_dir), k, digits=6)
    return io.stored(best.withColumn("score", F.round("score", 6)), "sparse")


def vector_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    q = vectors.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    return q, vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")


def dense_list(spark, sf_dir, k=100) -> DataFrame:
    return rt.dense_top_k(*vector_sides(spark, sf_dir), k, "chunk_id", digits=6).withColumn("score", F.round("score", 6))


TOK = r"regexp_extract_all(lower({}), '[a-z0-9][a-z0-9\-]{{1,}}')"
BM25 = rf"""
toks AS (SELECT doc_id, {TOK.format("text")} AS t FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
dfs AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, st GROUP BY term),
qt AS (SELECT DISTINCT item_id, unnest({TOK.format("text")}) AS term FROM benchmark),
bm AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN post USING (term) JOIN dfs USING (term), st GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 100)"""
DENSE = """
dn AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
       round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: p[1]::DOUBLE * p[2])), 6) AS score
       FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id CROSS JOIN embeddings c),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn QUALIFY rank <= 100)"""
BOTH = f"""WITH {BM25}, {DENSE},
met AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dr, s.rank AS sr, d.score AS ds, s.score AS ss
        FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
rrf AS (SELECT *, coalesce(0.5 / (20 + dr), 0) AS dp, coalesce(2.0 / (20 + sr), 0) AS sp,
        row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(0.5 / (20 + dr), 0) + coalesce(2.0 / (20 + sr), 0), 12) DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM met),
sc AS (SELECT *, 0.5 * coalesce(CASE WHEN max(ds) OVER w > min(ds) OVER w THEN (ds - min(ds) OVER w) / (max(ds) OVER w - min(ds) OVER w) END, 0)
              + 2.0 * coalesce(CASE WHEN max(ss) OVER w > min(ss) OVER w THEN (ss - min(ss) OVER w) / (max(ss) OVER w - min(ss) OVER w) END, 0) AS score
       FROM met WINDOW w AS (PARTITION BY query_id)),
scr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM sc)"""


@register("bm25_topk", f"WITH {BM25} SELECT query_id, rank, chunk_id, score FROM sparse WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """The ten best documents of each query."""
    return sparse_list(spark, sf_dir, 10).select("query_id", "rank", "chunk_id", "score")


@register("bm25_zero_filled", f"""WITH {BM25}, every AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, coalesce(bm.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN bm ON bm.query_id = b.item_id AND bm.chunk_id = d.doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM every QUALIFY rank <= 100""")
def bm25_zero_filled(spark, sf_dir):
    """Chunks without a term rank last, in corpus order, and fill the list."""
    found = sparse_list(spark, sf_dir, 100)
    return rt.fill_with_zeros(found, asked(spark, sf_dir), chunks(spark, sf_dir), 100).select("query_id", "rank", "chunk_id", "score")


@register("bm25_term_stats", f"WITH {BM25} SELECT term, df, round(idf, 9) AS idf FROM dfs WHERE df > 1")
def bm25_term_stats(spark, sf_dir):
    """G1."""
    i = index(spark, sf_dir)
    return rt.term_stats(rt.postings(i), rt.corpus_stats(i)).where("df > 1").select("term", "df", F.round("idf", 9).alias("idf"))


@register("okapi_topk", f"""WITH {BM25}, ow AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS w FROM post, st GROUP BY term),
oi AS (SELECT term, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM ow) ELSE w END AS w FROM ow),
oq AS (SELECT item_id, unnest({TOK.format("text")}) AS term FROM benchmark),
os AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM oq JOIN post USING (term) JOIN oi USING (term), st GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM os QUALIFY rank <= 10""")
def okapi_topk(spark, sf_dir):
    """The Okapi form."""
    best = rt.okapi_top_k(asked(spark, sf_dir), index(spark, sf_dir), 10, digits=6)
    return best.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@register("tokenizer_variants", r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]{1,}')) AS with_hyphens, len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9]{1,}')) AS without FROM documents""")
def tokenizer_variants(spark, sf_dir):
    """P8."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.tokenize(F.col("text"))).alias("with_hyphens"), F.size(tx.tokenize(F.col("text"), False)).alias("without"))


@register("dense_topk", f"WITH {DENSE} SELECT query_id, rank, chunk_id, score FROM dense WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    """M2, W1, J5."""
    return dense_list(spark, sf_dir, 10).select("query_id", "rank", "chunk_id", "score")


@register("l2_normalize", """SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first FROM (
SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3 / greatest(sqrt(list_sum(list_transform(embedding, lambda y: (y::DOUBLE * 3) * (y::DOUBLE * 3)))), 1e-12)) AS v FROM embeddings)""")
def l2_normalize(spark, sf_dir):
    """M1: vectors of three times their length, back to length 1."""
    v = rt.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    out = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return out.select("vec_id", F.round(rt.inner_product(F.col("v"), F.col("v")), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@register("rrf_fusion", f"{BOTH} SELECT query_id, rank, chunk_id, round(dp + sp, 9) AS score FROM rrf WHERE rank <= 20")
def rrf_fusion(spark, sf_dir):
    """W4, J8."""
    return rt.fuse("rrf", dense_list(spark, sf_dir), sparse_list(spark, sf_dir)).where("rank <= 20").select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


@register("score_fusion", f"{BOTH} SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM scr WHERE rank <= 20")
def score_fusion(spark, sf_dir):
    """W6, W7."""
    return rt.fuse("score_fusion", dense_list(spark, sf_dir), sparse_list(spark, sf_dir)).where("rank <= 20").select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


@register("rrf_breakdown", f"""{BOTH} SELECT query_id, rank, round(dp, 9) AS dense_part, round(sp, 9) AS sparse_part,
CASE WHEN least(dp, sp) / (dp + sp) >= 0.30 THEN 'high' WHEN least(dp, sp) / (dp + sp) >= 0.18 THEN 'medium' ELSE 'low' END AS balance FROM rrf WHERE rank <= 10""")
def rrf_breakdown(spark, sf_dir):
    """W16."""
    fused = rt.rrf_fuse(dense_list(spark, sf_dir), sparse_list(spark, sf_dir)).where("rank <= 10")
    return fused.select("query_id", "rank", F.round("dense_part", 9).alias("dense_part"), F.round("sparse_part", 9).alias("sparse_part"), rt.balance(F.col("dense_part"), F.col("sparse_part")).alias("balance"))


@register("retrieval_margin", f"""WITH {BM25}, m AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top1, max(CASE WHEN rank = 2 THEN score END) AS top2 FROM sparse GROUP BY query_id)
SELECT query_id, top1, top2, round(top1 - top2, 6) AS margin, coalesce(round(top1 - top2, 6) < 0.002, false) AS low FROM m""")
def retrieval_margin(spark, sf_dir):
    """W15."""
    m = rt.margins(sparse_list(spark, sf_dir, 2))
    return m.select("query_id", "top1", "top2", F.round("margin", 6).alias("margin"), F.coalesce(F.round("margin", 6) < 0.002, F.lit(False)).alias("low"))


@register("model_blend", f"""{BOTH}, mb AS (SELECT r.*, dp + sp AS base, CASE WHEN r.rank <= 50 THEN dn.score END AS ms FROM rrf r LEFT JOIN dn ON dn.query_id = r.query_id AND dn.chunk_id = r.chunk_id),
mc AS (SELECT *, base + 0.2 * coalesce(CASE WHEN max(ms) OVER w > min(ms) OVER w THEN (ms - min(ms) OVER w) / (max(ms) OVER w - min(ms) OVER w) END, 0) AS score FROM mb WINDOW w AS (PARTITION BY query_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, rank) AS rank, chunk_id, round(score, 9) AS score FROM mc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, rank) <= 20""")
def model_blend(spark, sf_dir):
    """W8, with cosine as the model's score."""
    model = rt.dense_scores(*vector_sides(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("model_score"))
    fused = rt.rrf_fuse(dense_list(spark, sf_dir), sparse_list(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")
    return rt.blend_model_scores(fused, model).where("rank <= 20").select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


HITS = f"""WITH {BM25}, {DENSE}, hits AS (SELECT query_id, chunk_id % 7 AS doc_id, chunk_id % 13 AS page_number, CASE WHEN chunk_id % 5 > 0 THEN chunk_id END AS chunk_id, rank, 1.0 AS w, 0 AS l FROM dense
UNION ALL SELECT query_id, chunk_id % 7, chunk_id % 13, CASE WHEN chunk_id % 5 > 0 THEN chunk_id END, rank, 0.5, 1 FROM sparse),
k AS (SELECT *, coalesce(chunk_id::VARCHAR, doc_id || ':' || page_number) AS key FROM hits),
f AS (SELECT query_id, key, sum(w / (20 + rank)) AS score, arg_min(chunk_id, l * 1000 + rank) AS chunk_id, arg_min(page_number, l * 1000 + rank) AS page_number FROM (SELECT * FROM k) GROUP BY query_id, key)
SELECT query_id, key, round(score, 9) AS score FROM f"""


@register("hit_fusion", HITS)
def hit_fusion(spark, sf_dir):
    """Named lists; hits without chunk count by page."""
    def shaped(df):
        c = F.col("chunk_id")
        return df.select("query_id", (c % 7).alias("doc_id"), (c % 13).alias("page_number"), F.when(c % 5 > 0, c.cast("string")).alias("chunk_id"), "rank")

    out = rt.fuse_hits({"dense": shaped(dense_list(spark, sf_dir)), "bm25": shaped(sparse_list(spark, sf_dir))}, weights={"bm25": 0.5})
    return out.select("query_id", F.coalesce("chunk_id", F.concat_ws(":", "doc_id", "page_number")).alias("key"), F.round("score", 9).alias("score"))


def page_hits_input(spark, sf_dir) -> DataFrame:
    """Chunk hits with pages: chunk c is on page c % 9 + 1, every third on the next one too."""
    hits, c = sparse_list(spark, sf_dir, 20), F.col("chunk_id")
    page = (c % 9 + 1).cast("int")
    return hits.select("query_id", "rank", "score", (c % 4).alias("doc_id"), page.alias("page_number"), c.cast("string").alias("chunk_id"), F.when(c % 3 == 0, F.array(page, page + 1)).otherwise(F.array(page)).alias("pages"))


PAGES = f"""WITH {BM25}, h AS (SELECT query_id, rank, score, chunk_id % 4 AS doc_id, (chunk_id % 9 + 1)::INT AS p, chunk_id FROM sparse WHERE rank <= 20),
e AS (SELECT query_id, rank, 0 AS pos, score, doc_id, p AS page, chunk_id FROM h UNION ALL SELECT query_id, rank, 1, score, doc_id, p + 1, chunk_id FROM h WHERE chunk_id % 3 = 0),
f AS (SELECT query_id, doc_id, page, min(rank * 2 + pos) AS o FROM e WHERE rank <= 15 GROUP BY ALL),
pages AS (SELECT f.query_id, row_number() OVER (PARTITION BY f.query_id ORDER BY o) AS rank, f.doc_id, f.page AS page_number FROM f)"""


@register("page_collapse", f"{PAGES} SELECT query_id, rank, doc_id, page_number FROM pages")
def page_collapse(spark, sf_dir):
    """15 chunks to unique pages."""
    return rt.collapse_pages(page_hits_input(spark, sf_dir), 15).select("query_id", "rank", "doc_id", "page_number")


@register("rank_documents", f"""WITH {BM25}, d AS (SELECT query_id, source AS doc_id, max(score) AS score FROM sparse JOIN documents ON documents.doc_id = chunk_id GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM d QUALIFY rank <= 5""")
def rank_documents(spark, sf_dir):
    """Sources by their best document."""
    owner = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"))
    return rt.rank_documents(sparse_list(spark, sf_dir).drop("rank").join(owner, "chunk_id"), 5).select("query_id", "rank", "doc_id", "score")


GOLD = "gold AS (SELECT item_id AS query_id, list_sort(list(doc_id)) AS gold_pages FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id)"
EVAL = f"""WITH {BM25}, {GOLD},
pred AS (SELECT query_id, list(chunk_id ORDER BY rank) AS predicted FROM sparse WHERE rank <= 10 GROUP BY query_id),
ev AS (SELECT b.item_id AS query_id, coalesce(gold_pages, []) AS g, coalesce(predicted, []) AS p FROM benchmark b LEFT JOIN gold ON gold.query_id = b.item_id LEFT JOIN pred ON pred.query_id = b.item_id),
fr AS (SELECT *, list_min(list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN list_contains(g, p[i]) THEN i END), lambda r: r IS NOT NULL)) AS first_rank FROM ev)"""


def gold(spark, sf_dir) -> DataFrame:
    """(query_id, gold_pages): documents that hold a query's text, found by its beginning, then exactly."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    starts = items.withColumn("head", F.left("passage", F.lit(24))).where(F.length("passage") > 0)
    found = docs.join(rt.small(starts), F.contains("text", F.col("head")) & F.contains("text", F.col("passage")))
    have = found.groupBy(F.col("item_id").alias("query_id")).agg(F.array_sort(F.collect_set("doc_id")).alias("gold_pages"))
    return items.select(F.col("item_id").alias("query_id")).join(have, "query_id", "left").withColumn("gold_pages", F.coalesce("gold_pages", F.array().cast("array<bigint>")))


def evaluated(spark, sf_dir) -> DataFrame:
    hits = sparse_list(spark, sf_dir, 10).select("query_id", "rank", F.col("chunk_id").alias("page_number"))
    return evaluation.evaluate_pages(hits, gold(spark, sf_dir))


@register("evaluate_pages", f"""{EVAL} SELECT query_id, first_rank, round(coalesce(1.0 / first_rank, 0), 9) AS reciprocal_rank, coalesce(first_rank <= 1, false) AS hit_at_1, coalesce(first_rank <= 3, false) AS hit_at_3,
CASE WHEN len(g) = 0 THEN 'missing_gold_pages' WHEN len(p) = 0 THEN 'no_results' WHEN first_rank IS NULL THEN 'not_retrieved' WHEN first_rank > 1 THEN 'ranked_low' END AS failure_type FROM fr""")
def evaluate_pages(spark, sf_dir):
    """V1, V2, V3, V11."""
    return evaluated(spark, sf_dir).select("query_id", "first_rank", F.round("reciprocal_rank", 9).alias("reciprocal_rank"), "hit_at_1", "hit_at_3", "failure_type")


@register("table_hits", f"""{EVAL}, th AS (SELECT query_id, min(rank) AS first FROM sparse JOIN fr USING (query_id) WHERE rank <= 10 AND chunk_id % 2 = 0 AND list_contains(g, chunk_id) GROUP BY query_id)
SELECT query_id, coalesce((first <= 1)::INT, 0)::DOUBLE AS table_hit_at_1, coalesce((first <= 10)::INT, 0)::DOUBLE AS table_hit_at_10 FROM fr LEFT JOIN th USING (query_id)""")
def table_hits(spark, sf_dir):
    """V5: documents of even numbers stand for tables."""
    hits = sparse_list(spark, sf_dir, 10).select("query_id", "rank", (F.col("chunk_id") % 2 == 0).alias("is_table"), F.array("chunk_id").alias("pages"))
    return evaluation.table_hits(hits, gold(spark, sf_dir).select("query_id", "gold_pages"), (1, 10))


@register("evaluation_summary", f"""{EVAL} SELECT count(*) AS n_queries, round(avg(coalesce(first_rank <= 1, false)::INT), 9) AS hit_at_1, round(avg(coalesce(first_rank <= 3, false)::INT), 9) AS hit_at_3, round(avg(coalesce(first_rank <= 5, false)::INT), 9) AS hit_at_5,
round(avg(coalesce(first_rank <= 10, false)::INT), 9) AS hit_at_10, round(avg(coalesce(1.0 / first_rank, 0)), 9) AS mrr FROM fr WHERE len(g) > 0""")
def evaluation_summary(spark, sf_dir):
    """Over the queries that have gold."""
    out = evaluation.summarize(evaluated(spark, sf_dir).where(F.size("gold_pages") > 0))
    return out.select("n_queries", *(F.round(c, 9).alias(c) for c in out.columns if c != "n_queries"))


@register("metrics_by_k", f"""{EVAL} SELECT k::INT AS k, count(*) AS n, round(avg((len(list_intersect(p[1:k], g)) > 0)::INT), 9) AS hit_rate, round(avg(len(list_intersect(p[1:k], g)) / greatest(len(p[1:k]), 1)), 9) AS precision,
round(avg(CASE WHEN first_rank <= k THEN 1.0 / first_rank ELSE 0 END), 9) AS mrr FROM fr, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k""")
def metrics_by_k(spark, sf_dir):
    """G6, V4."""
    out = evaluation.metrics_by_k(evaluated(spark, sf_dir))
    return out.select("k", "n", *(F.round(c, 9).alias(c) for c in ("hit_rate", "precision", "mrr")))


@register("leakage", f"""WITH {BM25}, h AS (SELECT query_id, source AS doc_id, 'src' || (query_id % 20) AS own FROM sparse JOIN documents ON documents.doc_id = chunk_id WHERE rank <= 10)
SELECT query_id, count(*) FILTER (doc_id <> own) AS n_away, array_to_string(list_sort(list(DISTINCT doc_id) FILTER (doc_id <> own)), ',') AS docs, round(count(*) FILTER (doc_id <> own) / count(*), 9) AS rate FROM h GROUP BY query_id""")
def leakage(spark, sf_dir):
    """Sources other than the one that a query is about."""
    owner = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"))
    hits = sparse_list(spark, sf_dir, 10).join(owner, "chunk_id")
    own = asked(spark, sf_dir).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("doc_id"))
    out = evaluation.leakage(hits.select("query_id", "doc_id"), own)
    return out.select("query_id", "n_away", F.array_join("docs", ",").alias("docs"), F.round("rate", 9).alias("rate"))


@register("gold_presence", """WITH q AS (SELECT doc_id AS query_id, source AS doc_id, unnest([(n_chars % 50)::INT, (n_chars % 7)::INT]) AS page FROM documents),
c AS (SELECT DISTINCT source AS doc_id, (doc_id % 40)::INT AS page FROM documents)
SELECT query_id, bool_or(c2.doc_id IS NOT NULL) AS doc_there, count(c.page) AS n_pages_there FROM q LEFT JOIN c USING (doc_id, page) LEFT JOIN (SELECT DISTINCT doc_id FROM c) c2 ON c2.doc_id = q.doc_id GROUP BY query_id""")
def gold_presence(spark, sf_dir):
    """Sources as documents."""
    d, n = table(spark, sf_dir, "documents"), F.col("n_chars")
    q = d.select(F.col("doc_id").alias("query_id"), F.col("source").alias("doc_id"), F.array((n % 50).cast("int"), (n % 7).cast("int")).alias("gold_pages"))
    c = d.select(F.col("source").alias("doc_id"), F.array((F.col("doc_id") % 40).cast("int")).alias("pages"))
    return evaluation.gold_presence(q, c)


@register("filters_with_fallback", """SELECT 'es' AS wanted, doc_id FROM documents WHERE (lang = 'es' AND source = 'src3') OR NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'es' AND source = 'src3') UNION ALL SELECT 'none', doc_id FROM documents""")
def filters_with_fallback(spark, sf_dir):
    """a filter that fits, and one that fits nothing and is dropped."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc_id"), F.col("lang").alias("section_title"))
    some = rt.apply_filters(d, doc_id="src3", section="ES").select(F.lit("es").alias("wanted"), F.col("id").alias("doc_id"))
    return some.unionByName(rt.apply_filters(d, doc_id="nowhere").select(F.lit("none").alias("wanted"), F.col("id").alias("doc_id")))


@register("multi_variant_merge", f"""WITH {BM25}, v AS (SELECT query_id % 10 AS query_id, chunk_id, score, query_id // 10 AS variant FROM bm),
m AS (SELECT query_id, chunk_id, max(score) AS score, arg_max(variant, score * 1000 - variant / 1000) AS variant FROM v GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, variant, chunk_id) AS rank, chunk_id, score FROM m QUALIFY rank <= 10""")
def multi_variant_merge(spark, sf_dir):
    """Items of the same last digit as variants of one query.

    The first ten of a merged list are among the first ten of the variant that each has its best score from:
    what is before it there is before it in the merged list too.
    """
    v = sparse_list(spark, sf_dir, 10).select((F.col("query_id") % 10).alias("query_id"), "chunk_id", "score", F.floor(F.col("query_id") / 10).alias("variant"))
    return rt.merge_variants(v).where("rank <= 10").select("query_id", "rank", "chunk_id", "score")


def rerank_input(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns of users as questions, documents as chunks with made-up sections."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("what was the total cost of "), "text").alias("text"), F.lit("Overview").alias("expected_section"), F.lit("Costs").alias("expected_subsection"))
    i = F.col("doc_id")
    c = table(spark, sf_dir, "documents").select(
        i.alias("chunk_id"), "text", (i % 2 == 0).alias("is_table"), F.when(i % 3 == 0, "Performance report").otherwise("Notes").alias("section_title"),
        F.when(i % 5 == 0, " costs ").otherwise("other").alias("subsection_title"), F.lit(True).alias("segment_has_search_hit"), F.when(i % 7 == 0, "cross_page_continuation").otherwise("MATCH").alias("segment_boundary_type"),
    )
    return sparse_list(spark, sf_dir, 20).select("query_id", "chunk_id", "score", "rank"), q, c


@register("lexical_rerank")
def lexical_rerank(spark, sf_dir):
    """W9, W10, W11, P6, P9, M5, F15."""
    return rt.rerank(*rerank_input(spark, sf_dir), subsection_boost=0.05, cross_page_penalty=0.08).withColumn("score", F.round("score", 9))


@register("min_rank", """SELECT doc_id, source, rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS place FROM documents""")
def min_rank(spark, sf_dir):
    """W17."""
    from pyspark.sql import Window

    return table(spark, sf_dir, "documents").select("doc_id", "source", F.rank().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc())).alias("place"))


# chunking

LINES = """lines AS (SELECT doc_id, i, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS ln FROM (SELECT doc_id, text, 0 AS i FROM documents))"""
PAGED = f"""{LINES}, pages AS (SELECT doc_id, (ln // 10 + 1)::INT AS page_number, string_agg(line, chr(10) ORDER BY ln) AS text FROM lines GROUP BY ALL)"""


@register("pages", f"WITH {PAGED} SELECT doc_id, page_number, md5(text) AS digest FROM pages")
def pages(spark, sf_dir):
    """Ten lines to a page."""
    return chunking.pages_of(table(spark, sf_dir, "documents")).select("doc_id", "page_number", F.md5("text").alias("digest"))


@register("word_windows", f"""WITH {PAGED}, w AS (SELECT doc_id, page_number, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM pages),
s AS (SELECT *, unnest(range(0, greatest(0, ceil((len(w) - 168) / 126.0))::INT + 1)) AS idx FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, page_number, idx, w[idx * 126 + 1 : idx * 126 + 168] AS part FROM s)
SELECT doc_id || ':p' || lpad(page_number::VARCHAR, 4, '0') || '_' || lpad(idx::VARCHAR, 3, '0') AS chunk_id, len(part)::INT AS word_count, greatest(1, floor(len(part) / 0.75))::INT AS token_count, md5(array_to_string(part, ' ')) AS digest FROM c WHERE len(part) >= 20""")
def word_windows(spark, sf_dir):
    """E1, E2, E3, E5, F3."""
    c = chunking.chunks_of(chunking.pages_of(table(spark, sf_dir, "documents")))
    return c.select("chunk_id", "word_count", "token_count", F.md5("text").alias("digest"))


@register("chunk_offsets", f"""WITH {PAGED}, w AS (SELECT doc_id, page_number, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM pages),
s AS (SELECT *, unnest(range(0, greatest(0, ceil((len(w) - 168) / 126.0))::INT + 1)) AS idx FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, page_number, idx, w[idx * 126 + 1 : idx * 126 + 168] AS part FROM s WHERE len(w[idx * 126 + 1 : idx * 126 + 168]) >= 43),
p AS (SELECT *, lag(part) OVER (PARTITION BY doc_id, page_number ORDER BY idx) AS prev FROM c),
h AS (SELECT *, coalesce(len(prev), 0) - coalesce(list_max(list_filter(range(1, least(len(prev), len(part)) + 1), lambda k: prev[len(prev) - k + 1 : len(prev)] = part[1 : k])), 0) AS step FROM p)
SELECT doc_id || ':p' || lpad(page_number::VARCHAR, 4, '0') || '_' || lpad(idx::VARCHAR, 3, '0') AS chunk_id, sum(step) OVER (PARTITION BY doc_id, page_number ORDER BY idx) AS start FROM h""")
def chunk_offsets(spark, sf_dir):
    """Where windows start, found again from the words that neighbours share (the most, where words repeat)."""
    return chunking.offsets(chunking.chunks_of(chunking.pages_of(table(spark, sf_dir, "documents")), least=43)).select("chunk_id", "start")


@register("repeated_edges", f"""WITH {LINES}, n AS (SELECT doc_id, (ln // 10 + 1) AS page, ln, trim(regexp_replace(line, '[ \\t\\n\\r]+', ' ', 'g')) AS line FROM lines),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln DESC) AS b FROM n WHERE line <> ''),
e AS (SELECT doc_id, page, line, 'header' AS edge FROM p WHERE a <= 5 UNION ALL SELECT doc_id, page, line, 'footer' FROM p WHERE b <= 5),
z AS (SELECT doc_id, count(DISTINCT page) AS n FROM n GROUP BY doc_id)
SELECT e.doc_id, edge, line, count(DISTINCT page) AS pages FROM e JOIN z ON e.doc_id = z.doc_id GROUP BY e.doc_id, edge, line, z.n HAVING count(DISTINCT page) >= greatest(1, ceil(0.4 * z.n)) AND z.n > 1""")
def repeated_edges(spark, sf_dir):
    """G3."""
    return chunking.repeated_edges(chunking.page_lines(table(spark, sf_dir, "documents")))


@register("drop_repeated_edges", f"""WITH {LINES}, n AS (SELECT doc_id, (ln // 10 + 1) AS page, ln, line AS raw, trim(regexp_replace(line, '[ \\t\\n\\r]+', ' ', 'g')) AS line FROM lines),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln DESC) AS b FROM n WHERE line <> ''),
e AS (SELECT doc_id, page, line, 'header' AS edge FROM p WHERE a <= 5 UNION ALL SELECT doc_id, page, line, 'footer' FROM p WHERE b <= 5),
z AS (SELECT doc_id, count(DISTINCT page) AS n FROM n GROUP BY doc_id),
r AS (SELECT e.doc_id, edge, line FROM e JOIN z ON e.doc_id = z.doc_id GROUP BY e.doc_id, edge, line, z.n HAVING count(DISTINCT page) >= greatest(1, ceil(0.4 * z.n)) AND z.n > 1),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln DESC) AS b FROM n)
SELECT doc_id, page::INT AS page_number, (ln % 10 + 1)::INT AS line_no, md5(raw) AS digest FROM x WHERE NOT (a <= 5 AND EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND r.line = x.line AND edge = 'header')) AND NOT (b <= 5 AND EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND r.line = x.line AND edge = 'footer'))""")
def drop_repeated_edges(spark, sf_dir):
    """G3, applied."""
    lines = chunking.page_lines(table(spark, sf_dir, "documents"))
    return chunking.drop_edges(lines, chunking.repeated_edges(lines)).select("doc_id", "page_number", "line_no", F.md5("text").alias("digest"))


@register("segments")
def segments(spark, sf_dir):
    """E4, E5."""
    return chunking.segments(chunking.pages_of(table(spark, sf_dir, "documents")))


@register("cross_page_chunks")
def cross_page_chunks(spark, sf_dir):
    """W24."""
    return chunking.cross_page_chunks(chunking.pages_of(table(spark, sf_dir, "documents")))
