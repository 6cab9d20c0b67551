"""Evaluation of ranked pages and of extracted answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import numeric


def hit_at_k(predicted: Column, gold: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(predicted, 1, k), gold), F.lit(False))


def first_rank(predicted: Column, gold: Column) -> Column:
    """Rank of the first gold page; null if none."""
    ranks = F.filter(F.transform(predicted, lambda p, i: F.when(F.array_contains(gold, p), i + 1)), lambda r: r.isNotNull())
    return F.get(ranks, F.lit(0))


def reciprocal_rank(predicted: Column, gold: Column) -> Column:
    return F.coalesce(1.0 / first_rank(predicted, gold), F.lit(0.0))


def precision_at_k(predicted: Column, gold: Column, k: int) -> Column:
    """Hits among the first k over how many there are."""
    top = F.slice(predicted, 1, k)
    hits = F.size(F.filter(top, lambda p: F.array_contains(gold, p)))
    return F.when(F.size(top) > 0, hits / F.size(top)).otherwise(F.lit(0.0))


def table_hits(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query_id, table_hit_at_k for each k): 1.0 if a table among the first k chunks stands on a gold page.

    `results`: query_id, rank, is_table, pages; `gold`: query_id, gold_pages. Queries without gold or without results have 0.0.
    """
    met = results.join(gold, "query_id").where(F.coalesce("is_table", F.lit(False)) & F.coalesce(F.arrays_overlap("pages", "gold_pages"), F.lit(False)))
    first = met.groupBy("query_id").agg(F.min("rank").alias("first"))
    hit = lambda k: F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"table_hit_at_{k}")
    return gold.select("query_id").join(first, "query_id", "left").select("query_id", *map(hit, ks))


def silver_questions(templates: DataFrame, docs: DataFrame) -> DataFrame:
    """Every template (suffix, question, answer_type, difficulty, category) filled in for every document (doc_id, owner, year_start, year_end).

    Templates are a short list: they are sent to the documents.
    """
    filled = F.col("question")
    for name, value in (("{owner}", F.col("owner")), ("{year}", F.concat_ws("-", "year_start", "year_end")), ("{year_end}", F.col("year_end").cast("string"))):
        filled = F.replace(filled, F.lit(name), value)
    number = F.concat(F.lit("Q_"), F.right(F.col("year_end").cast("string"), F.lit(2)), F.lit("_"), F.col("suffix"))
    return docs.crossJoin(F.broadcast(templates)).select(number.alias("query_id"), "doc_id", filled.alias("question"), "answer_type", "difficulty", "category", F.col("year_end").alias("year"))


def silver_set(questions: DataFrame, answers: DataFrame, least: float = 1.0) -> DataFrame:
    """Questions whose generated answer (query_id, doc_id, status, answer, confidence, pages) is sure: status ok, an answer, enough confidence.

    The pages of the first result become the expected pages, the answer the expected answer.
    """
    sure = answers.where((F.col("status") == "ok") & (F.coalesce("answer", F.lit("")) != "") & (F.coalesce("confidence", F.lit(0.0)) >= least))
    return questions.join(sure.select("query_id", "doc_id", F.coalesce("pages", F.array().cast("array<int>")).alias("expected_pages"), F.col("answer").alias("expected_answer")), ["query_id", "doc_id"])


def failure_type(predicted: Column, gold: Column) -> Column:
    """Why a query failed; null if its first page is right."""
    rank = first_rank(predicted, gold)
    return (
        F.when(F.size(gold) == 0, "missing_gold_pages").when(F.size(predicted) == 0, "no_results")
        .when(rank.isNull(), "not_retrieved").when(rank > 1, "ranked_low")
    )


def predictions(page_hits: DataFrame, queries: DataFrame) -> DataFrame:
    """`queries` with the ranked pages of each; those without hits stay, with none."""
    listed = page_hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page_number"))).alias("r"))
    listed = listed.select("query_id", F.col("r.page_number").alias("predicted"))
    return queries.join(listed, "query_id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<int>")))


def evaluate_pages(page_hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each query (query_id, gold_pages): hits, reciprocal rank, first rank, failure."""
    p, g = F.col("predicted"), F.col("gold_pages")
    met = predictions(page_hits, queries)
    return met.select(
        "query_id", "predicted", "gold_pages", *(hit_at_k(p, g, k).alias(f"hit_at_{k}") for k in lex.KS),
        reciprocal_rank(p, g).alias("reciprocal_rank"), first_rank(p, g).alias("first_rank"), failure_type(p, g).alias("failure_type"),
    )


def summarize(results: DataFrame) -> DataFrame:
    """Means over queries; 0 for none."""
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return results.agg(F.count("*").alias("n_queries"), *(mean(f"hit_at_{k}").alias(f"hit_at_{k}") for k in lex.KS), mean("reciprocal_rank").alias("mrr"))


def metrics_by_k(results: DataFrame, ks: tuple[int, ...] = lex.KS) -> DataFrame:
    """A row for each k: hit rate, mean precision, reciprocal rank within k."""
    each = results.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    p, g = F.col("predicted"), F.col("gold_pages")
    top = F.slice(p, F.lit(1), F.col("k"))
    hits = F.size(F.filter(top, lambda x: F.array_contains(g, x)))
    precision = F.when(F.size(top) > 0, hits / F.size(top)).otherwise(F.lit(0.0))
    within = F.when(F.col("first_rank") <= F.col("k"), 1.0 / F.col("first_rank")).otherwise(F.lit(0.0))
    return each.groupBy("k").agg(F.count("*").alias("n"), F.avg((hits > 0).cast("double")).alias("hit_rate"), F.avg(precision).alias("precision"), F.avg(within).alias("mrr"))


def leakage(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Documents retrieved that aren't the query's (query_id, doc_id): number, list, share of hits."""
    met = hits.join(expected.select("query_id", F.col("doc_id").alias("own")), "query_id")
    away = F.col("doc_id") != F.col("own")
    return met.groupBy("query_id").agg(
        F.count_if(away).alias("n_away"), F.array_sort(F.collect_set(F.when(away, F.col("doc_id")))).alias("docs"), (F.count_if(away) / F.count("*")).alias("rate")
    )


def gold_presence(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether a query's document and pages are in the corpus at all: exploded to pages, so it is an equi-join."""
    pages = chunks.select("doc_id", F.explode("pages").alias("page")).distinct()
    asked = queries.select("query_id", "doc_id", F.explode_outer("gold_pages").alias("page"))
    met = asked.join(pages.withColumn("there", F.lit(1)), ["doc_id", "page"], "left")
    docs = chunks.select("doc_id").distinct().withColumn("doc_there", F.lit(True))
    counted = met.groupBy("query_id", "doc_id").agg(F.count("there").alias("n_pages_there"))
    return counted.join(docs, "doc_id", "left").select("query_id", F.coalesce("doc_there", F.lit(False)).alias("doc_there"), "n_pages_there")


def numbers_match(expected: Column, found: Column, expected_percent: Column, found_percent: Column) -> Column:
    """'full' within 1 or 1 %, 'partial' within 5 or 5 %, else 'none'; percents only with percents."""
    diff = F.abs(expected - found)
    return (
        F.when(expected_percent != found_percent, "none")
        .when(diff <= F.greatest(F.lit(1.0), 0.01 * F.abs(expected)), "full")
        .when(diff <= F.greatest(F.lit(5.0), 0.05 * F.abs(expected)), "partial").otherwise("none")
    )


def normalize_answer(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[£$]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[\s,]+", " "), "[^a-z0-9% ]+", " "), " +", " "))


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)


def expected_in_context(expected: Column, context: Column, kind: Column) -> Column:
    """Whether an expected answer stands in a context, numbers as numbers."""
    e = normalize_answer(expected)
    plain = (e != "") & F.contains(normalize_answer(context), e)
    return F.when(F.coalesce(expected, F.lit("")) == "", F.lit(False)).when(kind == "number", F.size(F.array_intersect(numbers_in(expected), numbers_in(context))) > 0).otherwise(plain)


def format_matches(answer: Column, kind: Column) -> Column:
    date = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b|\b[0-9]{1,2}\s+[A-Z][a-z]+\s+[0-9]{4}\b"
    return F.when(kind == "number", F.size(numbers_in(answer)) > 0).when(kind == "date", F.rlike(answer, F.lit(date))).when(kind == "list", F.rlike(answer, F.lit("[,;\n]| and "))).otherwise(F.lit(True))


def answer_match(expected: Column, found: Column, kind: Column) -> Column:
    """'correct', 'partial', 'incorrect' or 'not_scored' of an extracted answer."""
    e, x = normalize_answer(expected), normalize_answer(found)
    want, got = numeric.normalize_value(expected), numeric.normalize_value(found)
    percent = lambda n: n["dimension"] == "percent"
    close = F.coalesce(numbers_match(want["value"], got["value"], percent(want), percent(got)), F.lit("none"))
    listed = numbers_in(expected)
    shared = F.size(F.array_intersect(listed, numbers_in(found)))
    words = F.array_distinct(F.filter(F.split(e, " "), lambda w: F.length(w) > 3))
    number = (
        F.when(close == "full", "correct").when(close == "partial", "partial")
        .when((F.size(listed) > 0) & (shared == F.size(F.array_distinct(listed))), "correct").when(shared > 0, "partial").otherwise("incorrect")
    )
    plain = F.when((e != "") & F.contains(x, e), "correct").when(F.arrays_overlap(words, F.split(x, " ")), "partial").otherwise("incorrect")
    return F.when(F.coalesce(expected, F.lit("")) == "", "not_scored").when(kind == "number", number).otherwise(plain)


def accuracy(scored: DataFrame) -> DataFrame:
    """(n_scored, accuracy, partial_rate) of rows with status, over those that are scored."""
    s = F.when(F.col("status") != "not_scored", F.col("status"))
    return scored.agg(F.count(s).alias("n_scored"), F.avg((s == "correct").cast("double")).alias("accuracy"), F.avg((s == "partial").cast("double")).alias("partial_rate"))


FAILURES = ("FP1_missing_content", "FP2_missed_top_rank", "FP3_not_in_context", "FP4_not_extracted", "FP5_wrong_format", "FP6_incorrect_specificity", "FP7_incomplete")


def failure_category(doc_there: Column, retrieved: Column, in_context: Column, extracted: Column, format_ok: Column, match: Column) -> Column:
    """The first stage at which an answer was lost; null for a full match."""
    return (
        F.when(~doc_there, FAILURES[0]).when(~retrieved, FAILURES[1]).when(~in_context, FAILURES[2])
        .when(~extracted, FAILURES[3]).when(~format_ok, FAILURES[4]).when(match == "none", FAILURES[5]).when(match == "partial", FAILURES[6])
    )


def win_loss_tie(a: DataFrame, b: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Of two systems (query_id, value) over the queries that both have."""
    diff = F.col("a.value") - F.col("b.value")
    met = a.alias("a").join(b.alias("b"), F.col("a.query_id") == F.col("b.query_id"))
    return met.agg(F.count_if(diff > tolerance).alias("wins"), F.count_if(diff < -tolerance).alias("losses"), F.count_if(F.abs(diff) <= tolerance).alias("ties"))


def mcnemar_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """The 2x2 table of two systems' hits (query_id, hit)."""
    x, y = F.col("a.hit"), F.col("b.hit")
    met = a.alias("a").join(b.alias("b"), F.col("a.query_id") == F.col("b.query_id"))
    return met.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def mcnemar_p(only_a: int, only_b: int) -> tuple[float, float]:
    """Exact two-sided binomial p, and the chi-squared one with continuity correction."""
    import math

    n, low = only_a + only_b, min(only_a, only_b)
    if n == 0:
        return 1.0, 1.0
    exact = min(1.0, 2.0 * sum(math.comb(n, i) for i in range(low + 1)) / 2.0**n)
    chi = max(0.0, abs(only_a - only_b) - 1) ** 2 / n
    return exact, math.erfc(math.sqrt(chi / 2.0))


def wilcoxon(a: DataFrame, b: DataFrame) -> tuple[float, float]:
    """Signed-rank statistic of b over a and its one-sided p (normal approximation, ties averaged, zeros left out)."""
    import math

    met = a.alias("a").join(b.alias("b"), F.col("a.query_id") == F.col("b.query_id")).select(F.round(F.col("b.value") - F.col("a.value"), 12).alias("d")).where("d != 0")
    # equal sizes are one row, so that the window runs over distinct sizes only
    sizes = met.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = sizes.withColumn("rank", before + (F.col("n") + 1) / 2.0)
    row = ranks.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("t")).first()
    if not row["n"]:
        return 0.0, 1.0
    n = row["n"]
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - row["t"] / 48.0)
    z = (row["w"] - n * (n + 1) / 4.0) / spread if spread else 0.0
    return float(row["w"]), 0.5 * math.erfc(z / math.sqrt(2.0))


def paired_bootstrap(a: DataFrame, b: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Resampled mean differences of paired values: mean, 2.5 % and 97.5 % points.

    Every pair enters a round as often as a Poisson(1) draw by the hash of pair and
    round says, so a round is a weighted mean, and pairs are counted where they are.
    """
    met = a.alias("a").join(b.alias("b"), F.col("a.query_id") == F.col("b.query_id")).select(F.col("a.query_id").alias("q"), (F.col("a.value") - F.col("b.value")).alias("d"))
    each = met.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = F.pmod(F.xxhash64("q", "round", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    weight, total, chance = F.lit(0), 0.0, 0.36787944117144233
    for n in range(12):
        total += chance
        weight = weight + (u >= total).cast("int")
        chance /= n + 1
    means = each.groupBy("round").agg((F.sum(F.col("d") * weight) / F.sum(weight)).alias("m"))
    observed = met.agg(F.avg("d").alias("delta"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")).crossJoin(F.broadcast(observed)).select("delta", "low", "high")


def survival(ranks: DataFrame, groups: list[str], most: int = 10) -> DataFrame:
    """P(rank > k) for k = 0..most with Wilson's 95 % interval; a null rank is beyond all."""
    each = ranks.withColumn("r", F.coalesce(F.col("rank"), F.lit(most + 1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(most))))
    out = each.groupBy(*groups, "k").agg(F.count("*").alias("n"), F.avg((F.col("r") > F.col("k")).cast("double")).alias("p"))
    z, n, p = 1.959963984540054, F.col("n"), F.col("p")
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return out.withColumns({"low": F.greatest(centre - half, F.lit(0.0)), "high": F.least(centre + half, F.lit(1.0))})


def stable_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The first eight hex digits of a SHA-1, modulo."""
    return F.pmod(F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def folds(query_id: Column, repeat: Column, n: int) -> Column:
    """A query's fold in a repeat of cross-validation."""
    return stable_bucket(F.concat_ws("|", repeat.cast("string"), query_id.cast("string")), n)


def grid_search(values: DataFrame) -> DataFrame:
    """Configurations by mean and deviation (sample, null as 0) of fold means, best first.

    `values`: config, repeat, fold, value.
    """
    fold = values.groupBy("config", "repeat", "fold").agg(F.avg("value").alias("m"))
    out = fold.groupBy("config").agg(F.avg("m").alias("mean"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.round("mean", 12).desc(), F.round("std", 12), "config")))


def regression_gate(metrics: DataFrame, least: dict[str, float], least_mean: dict[str, float]) -> DataFrame:
    """A row for each bound (metric, kind, value, bound, passed): each document's least value, and the mean."""
    names = sorted({*least, *least_mean})
    row = metrics.agg(*(F.min(m).alias(f"min_{m}") for m in names), *(F.avg(m).alias(f"avg_{m}") for m in names))
    checks = [(m, "each", f"min_{m}", v) for m, v in sorted(least.items())] + [(m, "mean", f"avg_{m}", v) for m, v in sorted(least_mean.items())]
    structs = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(kind).alias("kind"), F.col(c).alias("value"), F.lit(v).alias("bound"), (F.col(c) >= v).alias("passed")) for m, kind, c, v in checks))
    return row.select(F.explode(structs).alias("x")).select("x.*")


def content_hash(df: DataFrame, *keys: str) -> DataFrame:
    """A hash of each row's JSON by key, to compare two runs."""
    return df.select(*keys, F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("sha256"))
