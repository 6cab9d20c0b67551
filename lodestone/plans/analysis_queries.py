"""Registered queries: experiments, corpus analytics, sources and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import analytics, evaluation
from ..operators import retrieval as rt
from ..sources import io
from ..streaming import events as ev
from .retrieval_queries import BM25, DENSE, dense_list, gold, sparse_list, table, vector_sides

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def systems(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two systems over orders: the value and the hit of each."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("c"))
    shaped = lambda m, n: d.select("query_id", (F.col("c") % m < n).alias("hit"), (F.col("c") % m / F.lit(float(m))).alias("value"))
    return shaped(7, 5), shaped(5, 3)


SYSTEMS = "s AS (SELECT o_orderkey AS q, o_custkey % 7 < 5 AS ha, o_custkey % 5 < 3 AS hb, o_custkey % 7 / 7.0::DOUBLE AS va, o_custkey % 5 / 5.0::DOUBLE AS vb FROM orders)"


@register("mcnemar_table", f"WITH {SYSTEMS} SELECT count(*) FILTER (ha AND hb) AS both, count(*) FILTER (ha AND NOT hb) AS only_a, count(*) FILTER (NOT ha AND hb) AS only_b, count(*) FILTER (NOT ha AND NOT hb) AS neither FROM s")
def mcnemar_table(spark, sf_dir):
    """G14, J12."""
    return evaluation.mcnemar_counts(*systems(spark, sf_dir))


@register("win_loss_tie", f"WITH {SYSTEMS} SELECT count(*) FILTER (va - vb > 1e-12) AS wins, count(*) FILTER (va - vb < -1e-12) AS losses, count(*) FILTER (abs(va - vb) <= 1e-12) AS ties FROM s")
def win_loss_tie(spark, sf_dir):
    """G13, U3."""
    return evaluation.win_loss_tie(*systems(spark, sf_dir))


@register("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    """G15."""
    a, b = systems(spark, sf_dir)
    out = evaluation.paired_bootstrap(a, b, 200)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@register("rank_survival", """WITH r AS (SELECT event_type, CASE WHEN event_id % 13 < 11 THEN event_id % 13 + 1 ELSE 11 END AS r FROM events), e AS (SELECT event_type, k, count(*) AS n, avg((r > k)::INT) AS p FROM r, (SELECT unnest(range(0, 11)) AS k) GROUP BY ALL)
SELECT event_type, k::INT AS k, n, round(p, 9) AS p, round(greatest((p + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n) - 1.959963984540054 * sqrt(p * (1 - p) / n + 1.959963984540054 * 1.959963984540054 / (4 * n * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n), 0), 9) AS low FROM e""")
def rank_survival(spark, sf_dir):
    """G17."""
    i = F.col("event_id") % 13
    out = evaluation.survival(table(spark, sf_dir, "events").select("event_type", F.when(i < 11, (i + 1).cast("int")).alias("rank")), ["event_type"])
    return out.select("event_type", "k", "n", F.round("p", 9).alias("p"), F.round("low", 9).alias("low"))


@register("stable_buckets", "SELECT doc_id, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 10000 AS bucket, ('0x' || substr(sha1('1|' || doc_id), 1, 8))::BIGINT % 5 AS fold FROM documents")
def stable_buckets(spark, sf_dir):
    """M10."""
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.stable_bucket(F.col("doc_id").cast("string")).alias("bucket"), evaluation.folds(F.col("doc_id"), F.lit(1), 5).alias("fold"))


CV = """g AS (SELECT user_id % 6 AS config, event_id % 3 AS repeat, event_id % 5 AS fold, value FROM events), f AS (SELECT config, repeat, fold, avg(value) AS m FROM g GROUP BY ALL)"""


@register("grid_search", f"WITH {CV}, c AS (SELECT config, avg(m) AS mean, coalesce(stddev_samp(m), 0) AS std, count(*) AS n FROM f GROUP BY config) SELECT config, round(mean, 9) AS mean, round(std, 9) AS std, n, row_number() OVER (ORDER BY round(mean, 12) DESC, round(std, 12), config) AS place FROM c")
def grid_search(spark, sf_dir):
    """G11, G12, E16."""
    v = table(spark, sf_dir, "events").select((F.col("user_id") % 6).alias("config"), (F.col("event_id") % 3).alias("repeat"), (F.col("event_id") % 5).alias("fold"), "value")
    out = evaluation.grid_search(v)
    return out.select("config", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "n", "place")


@register("fusion_grid", f"""WITH {BM25}, {DENSE}, w AS (SELECT * FROM (VALUES (0, 20, 0.5, 2.0), (1, 60, 1.0, 1.0), (2, 20, 2.0, 0.5)) t(config, k, dw, sw)),
m AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dr, s.rank AS sr FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
r AS (SELECT config, query_id, chunk_id, row_number() OVER (PARTITION BY config, query_id ORDER BY round(coalesce(dw / (k + dr), 0) + coalesce(sw / (k + sr), 0), 12) DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM m, w)
SELECT config, query_id, chunk_id FROM r WHERE rank = 1""")
def fusion_grid(spark, sf_dir):
    """Rankings are made once, every configuration reuses them."""
    dense, sparse, out = dense_list(spark, sf_dir), sparse_list(spark, sf_dir), None
    for i, (k, dw, sw) in enumerate(((20, 0.5, 2.0), (60, 1.0, 1.0), (20, 2.0, 0.5))):
        part = rt.rrf_fuse(dense, sparse, k, dw, sw).where("rank = 1").select(F.lit(i).alias("config"), "query_id", "chunk_id")
        out = part if out is None else out.unionByName(part)
    return out


@register("regression_gate", """SELECT 'value' AS metric, 'each' AS kind, round(min(v), 9) AS value, 0.5::DOUBLE AS bound, min(v) >= 0.5 AS passed FROM (SELECT user_id, avg(value) AS v FROM events GROUP BY 1) UNION ALL SELECT 'value', 'mean', round(avg(v), 9), 1.0, avg(v) >= 1 FROM (SELECT user_id, avg(value) AS v FROM events GROUP BY 1)""")
def regression_gate(spark, sf_dir):
    """G29."""
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("value"))
    return evaluation.regression_gate(m, {"value": 0.5}, {"value": 1.0}).withColumn("value", F.round("value", 9))


@register("failure_categories", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'FP1_missing_content' WHEN event_id % 7 = 0 THEN 'FP2_missed_top_rank' WHEN event_id % 5 = 0 THEN 'FP3_not_in_context' WHEN event_id % 3 = 0 THEN 'FP4_not_extracted' WHEN event_id % 2 = 0 THEN 'FP5_wrong_format' WHEN value > 100 THEN 'FP6_incorrect_specificity' WHEN value > 50 THEN 'FP7_incomplete' END AS failure FROM events""")
def failure_categories(spark, sf_dir):
    """V6, V7, V8."""
    i, v = F.col("event_id"), F.col("value")
    f = evaluation.failure_category(i % 11 != 0, i % 7 != 0, i % 5 != 0, i % 3 != 0, i % 2 != 0, F.when(v > 100, "none").when(v > 50, "partial").otherwise("full"))
    return table(spark, sf_dir, "events").select("event_id", f.alias("failure"))


@register("content_hashes")
def content_hashes(spark, sf_dir):
    """V14, M9."""
    return evaluation.content_hash(table(spark, sf_dir, "documents"), "doc_id")


@register("describe", """SELECT source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std_pop, round(stddev_samp(n_chars), 6) AS std_samp, min(n_chars) AS min, max(n_chars) AS max, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY source""")
def describe(spark, sf_dir):
    """G8, G9, M8."""
    out = analytics.describe(table(spark, sf_dir, "documents"), "n_chars", "source")
    return out.select("source", "n", "min", "max", *(F.round(c, 6).alias(c) for c in ("mean", "std_pop", "std_samp", "p50", "p95", "p99")))


@register("over_limits", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 300) AS above_300, count(*) FILTER (n_chars > 4000) AS above_4000, round(count(*) FILTER (n_chars > 300) / count(*), 9) AS share_300, round(count(*) FILTER (n_chars > 4000) / count(*), 9) AS share_4000 FROM documents GROUP BY lang")
def over_limits(spark, sf_dir):
    """G30."""
    out = analytics.over_limits(table(spark, sf_dir, "documents"), "n_chars", (300, 4000), "lang")
    return out.select("lang", "n", "above_300", "above_4000", F.round("share_300", 9).alias("share_300"), F.round("share_4000", 9).alias("share_4000"))


@register("table_text_split", "SELECT lang, round(avg(n_chars) FILTER (doc_id % 2 = 0), 6) AS table_mean, round(avg(n_chars) FILTER (doc_id % 2 = 1), 6) AS text_mean, round(avg(n_chars) FILTER (doc_id % 2 = 0) - avg(n_chars) FILTER (doc_id % 2 = 1), 6) AS delta FROM documents GROUP BY lang")
def table_text_split(spark, sf_dir):
    """One conditional aggregate."""
    mean = lambda r: F.avg(F.when(F.col("doc_id") % 2 == r, F.col("n_chars")))
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(mean(0).alias("table_mean"), mean(1).alias("text_mean"))
    return out.select("lang", F.round("table_mean", 6).alias("table_mean"), F.round("text_mean", 6).alias("text_mean"), F.round(F.col("table_mean") - F.col("text_mean"), 6).alias("delta"))


ACRONYM = r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z][A-Z0-9]{1,7}$'))"


@register("acronyms", f"""WITH t AS (SELECT doc_id, unnest({ACRONYM}) AS term FROM documents), q AS (SELECT conv_id, unnest({ACRONYM}) AS term FROM conversations WHERE role = 'user'),
a AS (SELECT term, count(*) AS in_text, count(DISTINCT doc_id) AS in_docs FROM t GROUP BY term), b AS (SELECT term, count(*) AS in_questions, count(DISTINCT conv_id) AS question_docs FROM q GROUP BY term)
SELECT coalesce(a.term, b.term) AS term, coalesce(in_text, 0) AS in_text, coalesce(in_docs, 0) AS in_docs, coalesce(in_questions, 0) AS in_questions, coalesce(question_docs, 0) AS question_docs,
round(3 * coalesce(in_questions, 0) + 2 * coalesce(question_docs, 0) + coalesce(in_docs, 0) + ln(1.0 + coalesce(in_text, 0)), 6) AS score FROM a FULL JOIN b ON a.term = b.term""")
def acronyms(spark, sf_dir):
    """No long forms are in these documents."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("query_id"), "text")
    out = analytics.acronyms(table(spark, sf_dir, "documents"), q)
    return out.select("term", "in_text", "in_docs", "in_questions", "question_docs", F.round(F.col("score") - 1.5 * F.col("pairs"), 6).alias("score"))


@register("presence_matrix", r"""WITH w AS (SELECT DISTINCT source AS grp, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'))) AS term FROM documents), f AS (SELECT * FROM w WHERE term IN ('the', 'de', 'und', 'token'))
SELECT grp AS "group", term, count(*) AS present FROM f GROUP BY CUBE (grp, term) HAVING grp IS NOT NULL OR term IS NOT NULL""")
def presence_matrix(spark, sf_dir):
    """G19."""
    return analytics.presence_matrix(table(spark, sf_dir, "documents"), ["the", "de", "und", "token"], "source")


@register("presence_pivot", "SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS g0, count(*) FILTER (user_id % 3 = 1) AS g1, count(*) FILTER (user_id % 3 = 2) AS g2 FROM events GROUP BY event_type")
def presence_pivot(spark, sf_dir):
    """G25."""
    out = table(spark, sf_dir, "events").withColumn("g", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")))
    return out.groupBy("event_type").pivot("g", ["g0", "g1", "g2"]).agg(F.count(F.lit(1)))


@register("era_summary", r"""WITH d AS (SELECT doc_id, 2000 + doc_id % 12 AS year, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]{1,}') AS t FROM documents), e AS (SELECT CASE WHEN year < 2005 THEN 'early' ELSE 'late' END AS era, * FROM d WHERE year < 2010)
SELECT era, count(*) AS n_docs, round(avg(len(t)), 6) AS avg_words, any_value(v) AS distinct_tokens FROM e JOIN (SELECT era, count(DISTINCT x) AS v FROM (SELECT era, unnest(t) AS x FROM e) GROUP BY era) USING (era) GROUP BY era""")
def era_summary(spark, sf_dir):
    """G20."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (2000 + F.col("doc_id") % 12).cast("int").alias("year"))
    eras = spark.createDataFrame([("early", 2000, 2004), ("late", 2005, 2009)], "era string, first int, last int")
    return analytics.era_summary(d, eras).select("era", "n_docs", F.round("avg_words", 6).alias("avg_words"), "distinct_tokens")


def labelled_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@register("centroids", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL),
d AS (SELECT e.label, vec_id, round(sqrt(sum((x - m) * (x - m))), 9) AS away FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY ALL)
SELECT label AS "group", arg_min(vec_id, away) AS medoid, round(avg(away), 6) AS radius, count(*) AS n FROM d GROUP BY label""")
def centroids(spark, sf_dir):
    """G23."""
    out = analytics.centroids(labelled_vectors(spark, sf_dir), "label")
    return out.withColumn("radius", F.round("radius", 6))


@register("sampled_similarity")
def sampled_similarity(spark, sf_dir):
    """G21."""
    out = analytics.sampled_similarity(labelled_vectors(spark, sf_dir), "label")
    return out.select("group", "pairs", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"))


@register("retrieval_evidence", f"WITH {DENSE}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM dn) SELECT query_id, round(avg(score) FILTER (r <= 10), 6) AS retrieved, round(avg(score) FILTER (r > 10), 6) AS rest FROM a GROUP BY query_id")
def retrieval_evidence(spark, sf_dir):
    """G22."""
    s = rt.dense_scores(*vector_sides(spark, sf_dir)).withColumn("score", F.round("score", 6))
    out = analytics.retrieval_evidence(rt.top_k(s, 1 << 30, "chunk_id"))
    return out.select("query_id", F.round("retrieved", 6).alias("retrieved"), F.round("rest", 6).alias("rest"))


@register("topic_grid", """WITH p AS (SELECT l_extendedprice AS x, l_quantity AS y FROM lineitem), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT least(floor((x - x0) / (x1 - x0) * 10), 9)::INT AS bx, least(floor((y - y0) / (y1 - y0) * 10), 9)::INT AS by, count(*) AS n FROM p, e GROUP BY ALL""")
def topic_grid(spark, sf_dir):
    """G24."""
    return analytics.grid_counts(table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y")))


@register("counts_with_share", "SELECT event_type, user_id % 4 AS arm, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 9) AS share FROM events GROUP BY event_type, user_id % 4")
def counts_with_share(spark, sf_dir):
    """G26."""
    out = analytics.counts_with_share(table(spark, sf_dir, "events").withColumn("arm", F.col("user_id") % 4), "event_type", "arm")
    return out.withColumn("share", F.round("share", 9))


@register("best_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def best_per_group(spark, sf_dir):
    """G27."""
    return analytics.best_per(table(spark, sf_dir, "documents"), "source", F.col("n_chars").desc(), F.col("doc_id")).select("source", "doc_id")


@register("answer_rates", """SELECT count(*) AS n, count(*) FILTER (event_type = 'click') AS ok, count(*) FILTER (event_type = 'view') AS insufficient, count(*) FILTER (event_type = 'error') AS errors, round(sum(event_id % 3) / sum(event_id % 3 + 1), 9) AS citation_rate, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.9), 6) AS p90_ms FROM events""")
def answer_rates(spark, sf_dir):
    """G28."""
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    status = F.when(t == "click", "ok").when(t == "view", "insufficient_evidence").when(t == "error", "error").otherwise("other")
    out = analytics.rates(e.select(status.alias("status"), (F.col("event_id") % 3).alias("valid"), (F.col("event_id") % 3 + 1).alias("parsed"), F.col("value").alias("latency_ms")))
    return out.select("n", "ok", "insufficient", "errors", F.round("citation_rate", 9).alias("citation_rate"), F.round("mean_ms", 6).alias("mean_ms"), F.round("p90_ms", 6).alias("p90_ms"))


@register("variant_columns", "SELECT coalesce(a.k, b.k) AS k, a.n AS first, b.n AS second FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k")
def variant_columns(spark, sf_dir):
    """Outer merge of variants as a pivot."""
    o = table(spark, sf_dir, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return analytics.merge_variants({"first": part("F"), "second": part("O")}, "k", "n")


@register("compare_runs", """WITH a AS (SELECT doc_id AS k, n_chars AS v FROM documents), b AS (SELECT doc_id + 1 AS k, n_chars + (doc_id % 5 = 0)::INT AS v FROM documents)
SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def compare_runs(spark, sf_dir):
    """A run against one whose keys are moved by one."""
    d = table(spark, sf_dir, "documents")
    new = d.select((F.col("doc_id") + 1).alias("k"), (F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("int")).alias("v"))
    return analytics.compare_runs(d.select(F.col("doc_id").alias("k"), F.col("n_chars").alias("v")), new, "k", "v")


@register("transitions", 'SELECT "group", period, next_period, round(nv - v, 9) AS delta FROM (SELECT source AS "group", lang AS period, avg(n_chars) AS v, lead(lang) OVER w AS next_period, lead(avg(n_chars)) OVER w AS nv FROM documents GROUP BY source, lang WINDOW w AS (PARTITION BY source ORDER BY lang)) WHERE next_period IS NOT NULL')
def transitions(spark, sf_dir):
    """V15."""
    d = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("group"), F.col("lang").alias("period")).agg(F.avg("n_chars").alias("value"))
    return analytics.transitions(d).withColumn("delta", F.round("delta", 9))


@register("difficulty_join", "SELECT d.lang, l.quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def difficulty_join(spark, sf_dir):
    """J13, J9."""
    labels = table(spark, sf_dir, "labels").dropDuplicates(["doc_id"]).select("doc_id", "quality")
    return table(spark, sf_dir, "documents").join(rt.small(labels), "doc_id", "left").groupBy("lang", "quality").agg(F.count("*").alias("n"))


@register("eval_audit")
def eval_audit(spark, sf_dir):
    """V12."""
    c = table(spark, sf_dir, "conversations")
    users, bots = c.where("role = 'user'"), c.where("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    items = users.join(bots, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"), "answer", F.col("conv_id").alias("doc_id"))
    return analytics.audit(items, table(spark, sf_dir, "documents")).select("query_id", F.array_join("flags", ",").alias("flags"))


#: suffix, question, answer_type, difficulty, category
TEMPLATES = [("DEF", "What deficit did {owner} report in {year}?", "numeric", "easy", "finance"), ("STAFF", "How many staff had {owner} in {year_end}?", "numeric", "medium", "workforce"), ("RISK", "What is the main risk of {owner}?", "text", "hard", "risk")]


@register("silver_set", """WITH t AS (SELECT * FROM (VALUES ('DEF', 'What deficit did {owner} report in {year}?', 'numeric', 'easy'), ('STAFF', 'How many staff had {owner} in {year_end}?', 'numeric', 'medium'), ('RISK', 'What is the main risk of {owner}?', 'text', 'hard')) t(suffix, question, answer_type, difficulty)),
d AS (SELECT doc_id, source AS owner, 2010 + doc_id % 15 AS y FROM documents)
SELECT 'Q_' || right((y + 1)::VARCHAR, 2) || '_' || suffix AS query_id, doc_id, replace(replace(replace(question, '{owner}', owner), '{year}', y || '-' || (y + 1)), '{year_end}', (y + 1)::VARCHAR) AS question, answer_type, difficulty, 'a' || doc_id AS expected_answer, (doc_id % 7)::INT AS page
FROM t, d WHERE (doc_id + length(suffix)) % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 4 <> 1""")
def silver_set(spark, sf_dir):
    """Templates times documents, kept where the answer is sure."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("owner"), (2010 + i % 15).alias("year_start"), (2011 + i % 15).alias("year_end"))
    asked_ = evaluation.silver_questions(spark.createDataFrame(TEMPLATES, "suffix string, question string, answer_type string, difficulty string, category string"), docs)
    status = F.when((i + F.length(F.regexp_extract("query_id", "[A-Z]+$", 0))) % 3 == 0, "ok").otherwise("error")
    answer = F.when(i % 5 != 0, F.concat(F.lit("a"), i.cast("string")))
    answers = asked_.select("query_id", "doc_id", status.alias("status"), answer.alias("answer"), F.when(i % 4 == 1, 0.5).otherwise(1.0).alias("confidence"), F.array((i % 7).cast("int")).alias("pages"))
    return evaluation.silver_set(asked_, answers).select("query_id", "doc_id", "question", "answer_type", "difficulty", "expected_answer", F.get("expected_pages", F.lit(0)).alias("page"))


@register("gold_documents", "SELECT item_id AS query_id, coalesce(array_to_string(list_sort(list(doc_id) FILTER (doc_id IS NOT NULL)), ','), '') AS docs FROM benchmark LEFT JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id")
def gold_documents(spark, sf_dir):
    """Documents that hold an item word for word."""
    return gold(spark, sf_dir).select("query_id", F.array_join("gold_pages", ",").alias("docs"))


@register("wilson_interval", """SELECT lang, n, round(p, 9) AS p, round((p + c / 2 - h) / (1 + c), 9) AS low, round((p + c / 2 + h) / (1 + c), 9) AS high FROM (SELECT *, 1.959963984540054 * sqrt(p * (1 - p) / n + c / (4 * n)) AS h FROM (
SELECT *, 1.959963984540054 * 1.959963984540054 / n AS c FROM (SELECT lang, count(*) AS n, avg((n_chars > 1000)::INT) AS p FROM documents GROUP BY lang)))""")
def wilson_interval(spark, sf_dir):
    """M8."""
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg((F.col("n_chars") > 1000).cast("int")).alias("p"))
    low, high = numeric.wilson(F.col("p"), F.col("n"))
    return out.select("lang", "n", F.round("p", 9).alias("p"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


# sources


def _folder(spark, name: str) -> str:
    return f"{io.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("hits_csv", f"WITH {BM25} SELECT query_id::VARCHAR AS query_id, rank::INT AS rank, score, (chunk_id % 9)::VARCHAR || ',' || (chunk_id % 9 + 1)::VARCHAR AS pages FROM sparse WHERE rank <= 5")
def hits_csv(spark, sf_dir):
    """Hits out to CSV and in again, lists too."""
    c = (F.col("chunk_id") % 9).cast("int")
    hits = sparse_list(spark, sf_dir, 5).select(F.col("query_id").cast("string").alias("query_id"), F.col("rank").cast("int").alias("rank"), "score", F.array(c, c + 1).alias("pages"))
    io.write_hits_csv(hits, path := _folder(spark, "hits"))
    back = io.read_hits_csv(spark, path, "query_id string, rank int, score double, pages string")
    return back.withColumn("pages", F.array_join("pages", ","))


@register("index_round_trip", "SELECT d.doc_id AS chunk_id, length(text) AS n, len(embedding) AS width FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
def index_round_trip(spark, sf_dir):
    """Chunks with vectors, written and read."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text").join(v, "chunk_id", "left_semi")
    io.save_index(c, v, path := _folder(spark, "index"))
    return io.read_table(spark, path).select("chunk_id", F.length("text").alias("n"), F.size("embedding").alias("width"))


@register("index_meta_only", "SELECT d.doc_id AS chunk_id, d.lang, len(embedding) AS width FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
def index_meta_only(spark, sf_dir):
    """An index's chunks written anew under the vectors that are there."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang").join(v, "chunk_id", "left_semi")
    io.save_index(c.select("chunk_id"), v, old := _folder(spark, "index"))
    io.rebuild_meta(spark, old, c, new := _folder(spark, "index"))
    return io.read_table(spark, new).select("chunk_id", "lang", F.size("embedding").alias("width"))


@register("eval_set_json", "SELECT item_id::VARCHAR AS query_id, text, 1 AS n_pages FROM benchmark")
def eval_set_json(spark, sf_dir):
    """An evaluation set as JSON lines."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"), F.array((F.col("item_id") % 5).cast("int")).alias("expected_pages"))
    io.write_jsonl(b, path := _folder(spark, "eval"))
    return io.read_eval_lines(spark, path).select("query_id", "text", F.size("gold_pages").alias("n_pages"))


@register("manifest", 'SELECT source AS trust_id, doc_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM documents GROUP BY ROLLUP (source, doc_id)')
def manifest(spark, sf_dir):
    """S15."""
    return io.manifest(table(spark, sf_dir, "documents").select(F.col("source").alias("trust_id"), "doc_id"))


@register("global_index", "SELECT source AS doc_id, doc_id AS chunk_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) = CASE WHEN source < 'src2' THEN count(*) ELSE -1 END)")
def global_index(spark, sf_dir):
    """Only documents whose counts agree."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"))
    counts = d.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("doc_id") < "src2", F.col("n")).otherwise(-1))
    return io.global_index(d, counts)


@register("union_by_name", "SELECT doc_id AS id, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT conv_id, NULL, role FROM conversations")
def union_by_name(spark, sf_dir):
    """S18, U1, U2."""
    return io.union_all(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role"))


@register("document_list", "SELECT source AS doc_id, count(*) AS chunks, count(DISTINCT doc_id % 7) AS pages, count(*) FILTER (doc_id % 5 = 0) AS tables FROM documents GROUP BY source ORDER BY source LIMIT 7")
def document_list(spark, sf_dir):
    """S17."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), (F.col("doc_id") % 7).alias("page_number"), (F.col("doc_id") % 5 == 0).alias("is_table"))
    return io.list_documents(d, 7)


@register("files", "SELECT 'benchmark' AS doc_id UNION ALL SELECT 'labels'")
def files(spark, sf_dir):
    """S1."""
    found = io.discover(spark, sf_dir, "{labels,benchmark}.parquet").select("doc_id")
    return found


@register("final_order", "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS place FROM documents")
def final_order(spark, sf_dir):
    """Places by range, then within a part of the range."""
    d = table(spark, sf_dir, "documents")
    from pyspark.sql import Window

    sizes = d.groupBy("source").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1))).fillna(0)
    placed = d.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).join(rt.small(before.select("source", "before")), "source")
    return placed.select("doc_id", "source", (F.col("before") + F.col("i")).alias("place"))


# streams, run to their end


def drained(spark, stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All rows that a stream gives for the files that are there."""
    path = _folder(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{path}/out").outputMode("append").start()
    else:
        def last(df, epoch):
            df.write.mode("overwrite").parquet(f"{path}/out")

        q = writer.foreachBatch(last).outputMode(mode).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@register("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Tumbling windows of a stream."""
    out = drained(spark, ev.window_counts(ev.read_events(spark, sf_dir)), "windows", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@register("sliding_windows", "SELECT count(*) AS n, sum(c) AS total FROM (SELECT s, event_type, count(*) AS c FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL)")
def sliding_windows(spark, sf_dir):
    """Sliding windows, on the table."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.window_counts(e, "1 hour", "30 minutes").agg(F.count("*").alias("n"), F.sum("n").alias("total"))


@register("sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, i""")
def sessions(spark, sf_dir):
    """Session windows."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@register("stream_distinct", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_distinct(spark, sf_dir):
    """Duplicates dropped within the watermark."""
    out = drained(spark, ev.distinct_events(ev.read_events(spark, sf_dir, late="30 days")), "distinct", "append")
    return out.agg(F.count("*").alias("n"))


@register("stream_routes")
def stream_routes(spark, sf_dir):
    """Questions routed as they come."""
    turns = ev.read_stream(spark, sf_dir, "conversations.parquet", "conv_id bigint, turn bigint, role string, text string")
    return drained(spark, ev.score_stream(turns.select(F.col("conv_id").alias("query_id"), "text")), "routes", "append")


@register("stream_rate_limit")
def stream_rate_limit(spark, sf_dir):
    """At most five events of a user in an hour; state per user."""
    return drained(spark, ev.rate_limited(ev.read_events(spark, sf_dir), 5, 3600), "limit", "append")
