"""Corpus analytics and experiment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .retrieval import inner_product


def describe(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Count, mean, both deviations, extremes, quantiles (linear) of a column."""
    c = F.col(column)
    p = lambda q: F.percentile(c, q)
    return df.groupBy(*by).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std_pop"), F.stddev_samp(c).alias("std_samp"),
        F.min(c).alias("min"), F.max(c).alias("max"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"),
    )


def over_limits(df: DataFrame, column: str, limits: tuple[int, ...], *by: str) -> DataFrame:
    """How many rows are above each limit, and their share."""
    c = F.col(column)
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(c > x).alias(f"above_{x}") for x in limits), *((F.count_if(c > x) / F.count("*")).alias(f"share_{x}") for x in limits))


ACRONYM = r"^[A-Z][A-Z0-9]{1,7}$"
LONG_FORM = r"((?:[A-Z][a-z]+ ){1,6}[A-Z][a-z]+) \(([A-Z][A-Z0-9]{1,7})\)"


def acronyms(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(term, in_text, in_docs, in_questions, question_docs, pairs, score): capital words by how much they matter.

    Score: 3 for a use in questions, 2 for a question with it, 1.5 for a long form, 1 for a
    document with it, and the logarithm of uses.
    """
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0)
    used = lambda df, key: df.select(key, F.explode(F.filter(words, lambda w: F.rlike(w, F.lit(ACRONYM)))).alias("term"))
    text = used(docs, "doc_id").groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("in_text"), F.count("*").alias("in_docs"))
    asked = used(questions, "query_id").groupBy("term", "query_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("in_questions"), F.count("*").alias("question_docs"))
    forms = docs.select(F.explode(F.regexp_extract_all("text", F.lit(LONG_FORM), 2)).alias("term")).groupBy("term").agg(F.count("*").alias("pairs"))
    met = text.join(asked, "term", "full").join(forms, "term", "left").fillna(0)
    score = 3 * F.col("in_questions") + 2 * F.col("question_docs") + 1.5 * F.col("pairs") + F.col("in_docs") + F.log(1.0 + F.col("in_text"))
    return met.withColumn("score", score)


def presence_matrix(docs: DataFrame, terms: list[str], by: str) -> DataFrame:
    """(group, term, present) with margins: how many groups have a term, how many terms a group has. Null stands for all."""
    found = docs.select(F.col(by).alias("group"), F.explode(F.array_intersect(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")), F.array(*map(F.lit, terms)))).alias("term"))
    return found.distinct().cube("group", "term").agg(F.count("*").alias("present")).where("group is not null or term is not null")


def era_summary(docs: DataFrame, eras: DataFrame) -> DataFrame:
    """(era, n_docs, avg_words, distinct_tokens, top_terms) of documents with a year, by eras (era, first, last)."""
    years = eras.select("era", F.explode(F.sequence("first", "last")).alias("year"))
    tokens = tx.tokenize(F.col("text"))
    placed = docs.join(F.broadcast(years), "year").select("era", "doc_id", tokens.alias("tokens"))
    sizes = placed.groupBy("era").agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_words"))
    counted = placed.select("era", F.explode("tokens").alias("term")).groupBy("era", "term").agg(F.count("*").alias("n"))
    vocabulary = counted.groupBy("era").agg(F.count("*").alias("distinct_tokens"))
    w = Window.partitionBy("era").orderBy(F.col("n").desc(), "term")
    top = counted.where(F.length("term") >= 5).withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("era").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("t"))
    return sizes.join(vocabulary, "era").join(top.select("era", F.col("t.term").alias("top_terms")), "era", "left")


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(group, centroid, medoid, radius): mean vector of a group, the member nearest to it, and their mean distance."""
    each = vectors.select(F.col(by).alias("group"), "chunk_id", F.posexplode("embedding").alias("i", "x"))
    mean = each.groupBy("group", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    middle = mean.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("group", F.col("c.x").alias("centroid"))
    away = F.sqrt(F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    met = vectors.withColumn("group", F.col(by)).join(middle, "group").withColumn("away", F.round(away, 9))
    return met.groupBy("group").agg(F.min_by("chunk_id", F.struct("away", "chunk_id")).alias("medoid"), F.avg("away").alias("radius"), F.count("*").alias("n"))


def pca_radius(vectors: DataFrame, by: str, k: int = 2) -> DataFrame:
    """(group, n, radius): mean distance of a group's members from its middle in the first k components of all vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    shaped = vectors.select(F.col(by).alias("group"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    flat = PCA(k=k, inputCol="v", outputCol="p").fit(shaped).transform(shaped).select("group", vector_to_array("p").alias("p"))
    middle = flat.groupBy("group").agg(*(F.avg(F.get("p", F.lit(i))).alias(f"m{i}") for i in range(k)))
    away = sum(((F.get("p", F.lit(i)) - F.col(f"m{i}")) ** 2 for i in range(k)), F.lit(0.0))
    return flat.join(middle, "group").groupBy("group").agg(F.count("*").alias("n"), F.avg(F.sqrt(away)).alias("radius"))


def sampled_similarity(vectors: DataFrame, by: str, step: int = 7) -> DataFrame:
    """(group, pairs, mean, p95): cosines of each vector with the one `step` places on in its group."""
    w = Window.partitionBy(by).orderBy(F.xxhash64("chunk_id"), "chunk_id")
    met = vectors.withColumn("other", F.lead("embedding", step).over(w)).where("other is not null")
    return met.select(F.col(by).alias("group"), inner_product(F.col("embedding"), F.col("other")).alias("c")).groupBy("group").agg(F.count("*").alias("pairs"), F.avg("c").alias("mean"), F.percentile("c", 0.95).alias("p95"))


def retrieval_evidence(ranked: DataFrame) -> DataFrame:
    """(query_id, retrieved, rest, margin): mean score of the ten best against all others."""
    top = F.col("rank") <= 10
    out = ranked.groupBy("query_id").agg(F.avg(F.when(top, F.col("score"))).alias("retrieved"), F.avg(F.when(~top, F.col("score"))).alias("rest"))
    return out.withColumn("margin", F.col("retrieved") - F.col("rest"))


def grid_counts(points: DataFrame, bins: int = 10) -> DataFrame:
    """(bx, by, n) of points (x, y): counts in equal bins between the extremes."""
    ends = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    met = points.crossJoin(F.broadcast(ends))
    cell = lambda v, a, b: F.least(F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * bins), F.lit(bins - 1)).cast("int")
    return met.groupBy(cell("x", "x0", "x1").alias("bx"), cell("y", "y0", "y1").alias("by")).agg(F.count("*").alias("n"))


def counts_with_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """Counts of values in groups and their share of the group."""
    out = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def best_per(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")


def rates(log: DataFrame) -> DataFrame:
    """One row: how answers (status, parsed, valid, latency_ms) went."""
    return log.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "insufficient_evidence").alias("insufficient"), F.count_if(F.col("status") == "error").alias("errors"),
        F.try_divide(F.sum("valid"), F.sum("parsed")).alias("citation_rate"), F.avg("latency_ms").alias("mean_ms"), F.percentile("latency_ms", 0.9).alias("p90_ms"),
    )


def merge_variants(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One column for each named frame, rows of all keys: a pivot of their union, not a chain of joins."""
    every = None
    for name, df in frames.items():
        part = df.select(key, F.lit(name).alias("_variant"), value)
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).pivot("_variant", list(frames)).agg(F.first(value))


def compare_runs(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Both runs' values side by side, with status same, changed, added or removed. Keys have to be unique."""
    for df in (old, new):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} isn't unique")
    met = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return met.withColumn("status", status)


def transitions(values: DataFrame) -> DataFrame:
    """(group, period, next_period, delta): the change of a value from each period of a group to the next."""
    w = Window.partitionBy("group").orderBy("period")
    met = values.withColumn("next_period", F.lead("period").over(w)).withColumn("delta", F.lead("value").over(w) - F.col("value"))
    return met.where("next_period is not null").select("group", "period", "next_period", "delta")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """`df`, or an error that names a key that comes twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"not unique: {twice[0].asDict()}")
    return df


def audit(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, flags): what is wrong with items (query_id, question, answer, doc_id) of an evaluation set."""
    met = items.join(texts.select("doc_id", F.col("text").alias("t")), "doc_id", "left")
    words = F.filter(tx.tokenize(F.col("answer")), lambda w: F.length(w) >= 4)
    supported = F.size(F.array_intersect(words, tx.tokenize(F.col("t")))) > 0
    n = F.regexp_extract("answer", "[0-9][0-9.,]*", 0)
    flags = {
        "no_question": F.trim(F.coalesce("question", F.lit(""))) == "", "no_answer": F.trim(F.coalesce("answer", F.lit(""))) == "", "no_document": F.col("t").isNull(),
        "short_question": F.size(tx.tokenize(F.col("question"))) < 3, "long_answer": F.length("answer") > 400, "answer_not_in_document": ~F.contains("t", F.col("answer")),
        "number_not_in_document": (n != "") & ~F.contains("t", n), "no_keyword_support": ~supported,
    }
    return met.select("query_id", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in flags.items()))).alias("flags"))
