"""Answers out of retrieved chunks: numbers, fallback rules, prompts, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import numeric
from ..functions import text as tx

#: Words of a question that say nothing about what is asked for.
QUESTION_STOPWORDS = (
    "what", "which", "who", "where", "when", "why", "how", "much", "many", "did", "does", "do", "was", "were", "is", "are",
    "the", "for", "from", "with", "during", "year", "report", "reported", "amount", "number", "value", "total", "of", "in",
    "on", "to", "by", "and", "difference",
)
NUMBER = r"(?i)(?:£\s*)?(?:\(\s*)?[-+]?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s*\))?(?:\s*(?:\((?:£)?000\)|%|percent(?:age)?|million|millions|billion|billions|thousand|thousands|k\b|m\b|bn\b))?"
CUES = ("variance", "surplus", "deficit", "overspend", "underspend", "budget", "shortfall", "total", "cash requirement")


def keywords(question: Column) -> Column:
    found = F.regexp_extract_all(F.lower(question), F.lit(r"[a-z][a-z0-9\-]{2,}"), 0)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*QUESTION_STOPWORDS)))


def expected_dimension(question: Column) -> Column:
    q = F.lower(question)
    return F.when(tx.contains_any(q, lex.PERCENT_WORDS), "percent").when(tx.contains_any(q, lex.CURRENCY_WORDS), "currency")


def cue_terms(question: Column) -> Column:
    """What stands near an answer, given what a question is about."""
    q = F.lower(question)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.when(tx.contains_any(q, about), F.array(*map(F.lit, cues))).otherwise(none) for about, cues in lex.ANSWER_CUES)))


def number_spans(text: Column, width: int = 120) -> Column:
    """Numbers of a text with the characters around them: array of struct(raw, start, context).

    Each piece between numbers is as long as the number starts after the last one ended.
    """
    raws, gaps = F.regexp_extract_all(text, F.lit(NUMBER), 0), F.split(text, NUMBER, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<raw:string,start:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["gap"])
        return F.struct((start + F.length(p["raw"])).alias("at"), F.concat(a["out"], F.array(F.struct(F.trim(p["raw"]).alias("raw"), start.alias("start")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(raws)), raws, lambda g, r: F.struct(g.alias("gap"), r.alias("raw")))
    found = F.aggregate(pairs, zero, step, lambda a: a["out"])
    around = lambda x: F.substring(text, F.greatest(x["start"] - width, F.lit(0)) + 1, F.length(x["raw"]) + width + F.least(x["start"], F.lit(width)))
    return F.transform(found, lambda x: F.struct(x["raw"].alias("raw"), x["start"].alias("start"), around(x).alias("context")))


def numeric_candidates(results: DataFrame) -> DataFrame:
    """Scored numbers of retrieved chunks (query_id, question, rank, chunk_id, text, is_table), one a row."""
    each = results.select("query_id", "question", "rank", "chunk_id", "is_table", F.explode(number_spans(F.col("text"))).alias("x")).select("query_id", "question", "rank", "chunk_id", "is_table", "x.*")
    q, c = F.lower("question"), F.lower("context")
    norm = numeric.normalize_value(F.col("raw"))
    count_in = lambda words: F.size(F.filter(words, lambda w: F.contains(c, w)))
    wanted, got = expected_dimension(F.col("question")), norm["dimension"]
    hint = F.when(wanted.isNull(), 0.0).when(wanted == got, F.when(got == "count", 0.25).otherwise(1.5)).otherwise(-1.0)
    cues = count_in(cue_terms(F.col("question")))
    cue = F.when(cues > 0, 1.1 * cues).when(tx.contains_any(c, ("deficit", "surplus", "overspend", "shortfall", "budget", "spend", "income", "expenditure")), 0.6).otherwise(0.0)
    about = tx.contains_any(q, ("budget", "spend", "differ", "overspend"))
    row = F.when(about & F.contains(c, F.lit("variance")) & tx.contains_any(c, ("surplus", "deficit", "overspend", "underspend")), 2.2).otherwise(0.0)
    row = row + F.when(about & tx.contains_any(c, ("memorandum", "in year out-turn", "core revenue resource")), 0.8).otherwise(0.0)
    told = F.when(about & tx.contains_any(c, ("reported a surplus", "reported a deficit", "retained reserves", "general reserves")), -2.4).otherwise(0.0)
    frame = ("total", "cash requirement", "resource limit")
    structure = F.when(~tx.contains_any(q, frame) & tx.contains_any(c, frame), -1.8).otherwise(0.0)
    year = F.when(F.rlike("raw", F.lit("^(?:19|20)[0-9]{2}$")), -2.0).otherwise(0.0)
    small = F.when((wanted == "currency") & (F.abs(norm["value"]) > 0) & (F.abs(norm["value"]) < 100_000), -0.8).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 3.0 - 0.2 * F.greatest(F.col("rank") - 1, F.lit(0))) + 0.9 * count_in(keywords(F.col("question"))) + hint + cue + row + told + structure + year + small
    score = score - F.when(F.coalesce("is_table", F.lit(False)), 0.15).otherwise(0.0)
    return each.where(norm.isNotNull()).select("query_id", "rank", "chunk_id", "start", "raw", "context", F.round(score, 6).alias("score"), got.alias("dimension"), wanted.alias("wanted"), numeric.canonical_text(F.col("raw")).alias("canonical"))


def best_number(results: DataFrame, least: float = 1.5) -> DataFrame:
    """(query_id, answer, score, reason): the best number, or why there is none."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank", "start")
    best = numeric_candidates(results).withColumn("n", F.row_number().over(w)).where("n = 1")
    unit = F.rlike("raw", F.lit(r"(?i)£|\b(?:m|bn|million|billion|thousand)\b|\(£?000\)")) | F.contains("context", F.lit("£"))
    reason = F.when(F.col("score") < least, "low_confidence").when((F.col("wanted") == "currency") & ~unit, "currency_unit_not_supported")
    told = best.select("query_id", F.when(reason.isNull(), F.col("canonical")).alias("answer"), "score", reason.alias("reason"))
    return results.select("query_id").distinct().join(told, "query_id", "left").withColumn("reason", F.when(F.col("score").isNull(), "no_numeric_candidates").otherwise(F.col("reason")))


def single_chunk_answer(question: Column, text: Column) -> Column:
    """The first number of the kind that is asked for; null without one."""
    wanted = expected_dimension(question)
    percent = F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)?\s*(?:%|percent)", 0)
    money = F.regexp_extract(text, r"(?i)£\s*[0-9][0-9,]*(?:\.[0-9]+)?(?:\s*(?:million|billion|m|bn|k))?", 0)
    number = F.regexp_extract(text, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0)
    found = F.when(wanted == "percent", percent).when(wanted == "currency", money).otherwise(number)
    return F.when(found != "", F.trim(found))


NO_RULE, NO_TEXT = "(no extraction rule matched)", "(no chunk text available)"
_DAY = r"(?i)endorsed.*?on(?: the)?\s+([0-9]{1,2}(?:st|nd|rd|th)?\s+[A-Z][a-z]+\s+[0-9]{4})"
_MONTH = r"(?i)endorsed.*?strategic risk profile.*?in\s+([A-Z][a-z]+\s+[0-9]{4})"


def _sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def first_sentence(text: Column) -> Column:
    """At most 200 characters of the first sentence; null if there is none."""
    return F.trim(F.left(F.get(F.filter(_sentences(F.regexp_replace(text, r"^\s+|\s+$", "")), lambda x: x != ""), F.lit(0)), F.lit(200)))


def _of_quarter(label: str, question: Column, text: Column) -> Column:
    """struct(answer, label): of four values behind a label the one of the quarter that a question names; '-' is none."""
    pattern = rf"(?i){label}\s+([0-9-]+)\s+([0-9-]+)\s+([0-9-]+)\s+([0-9-]+)"
    answer, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in (4, 3, 2, 1):
        asked = F.contains(question, F.lit(f"q{i}"))
        value = F.regexp_extract(text, pattern, i)
        answer = F.when(asked, F.when(~value.isin("", "-"), value)).otherwise(answer)
        name = F.when(asked, F.lit(f"{label} (Q{i})")).otherwise(name)
    return F.struct(answer.alias("answer"), name.alias("label"))


def extraction_answer(question: Column, intent: Column, text: Column, others: Column) -> Column:
    """struct(answer, label): what the rule for a question finds in its best chunk, else that chunk's first sentence.

    `others` are the texts of the next chunks, in order. The first rule whose words the question has is the only one tried.
    """
    q = F.lower(question)
    has = lambda *words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))
    found = lambda p, t=text, g=1: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    pair = lambda answer, label: F.struct(answer.alias("answer"), F.lit(label).alias("label"))
    low = F.lower
    # where both endorsements are asked for, 'endorsed' counts in any case
    days = lambda t, any_case: F.array_compact(F.transform(F.filter(_sentences(t), lambda x: F.contains(low(x) if any_case else x, F.lit("endorsed")) & F.contains(low(x), F.lit("risk appetite statement"))), lambda x: found(_DAY, x)))
    months = lambda t, any_case: F.array_compact(F.transform(F.filter(_sentences(t), lambda x: F.contains(low(x) if any_case else x, F.lit("endorsed")) & F.contains(low(x), F.lit("strategic risk profile"))), lambda x: found(_MONTH, x)))
    profile = F.coalesce(F.try_element_at(months(text, True), F.lit(-1)), F.get(F.flatten(F.transform(others, lambda t: months(t, True))), F.lit(0)))
    appetite = F.try_element_at(days(text, True), F.lit(-1))
    both = F.nullif(F.concat_ws("; ", F.concat(F.lit("Risk Appetite: "), appetite), F.concat(F.lit("Strategic Risk Profile: "), profile)), F.lit(""))
    share = F.coalesce(found(r"(?i)([0-9]+(?:\.[0-9]+)?)%[^\n]{0,80}complete"), found(r"(?i)complete[^\n]{0,80}?([0-9]+(?:\.[0-9]+)?)%"))
    committee = F.coalesce(*(found(f"(?i)the ([A-Za-z &-]+ committee) {v} delegated responsibility") for v in ("have", "has")))
    titled = F.array_join(F.transform(F.split(F.trim(committee), "-"), lambda w: F.initcap(w)), "-")
    issue = F.get(F.filter(_sentences(text), lambda x: F.contains(low(x), F.lit("funding arrangement"))), F.lit(0))
    rule = (
        F.when(F.startswith(intent, F.lit("table_metric_")), pair(F.coalesce(first_sentence(text), F.lit(NO_RULE)), "Snippet"))
        .when(has("significant", "delay"), _of_quarter("Significant Delay", q, text))
        .when(has("on track"), _of_quarter("On Track", q, text))
        .when(has("proportion", "complete"), pair(F.concat(share, F.lit("%")), "Complete (%)"))
        .when(has("board committee", "strategic risk register"), pair(titled, "Delegated Committee"))
        .when(has("endorse", "risk appetite", "strategic risk profile"), pair(both, "Board Endorsements"))
        .when(has("endorse", "risk appetite"), pair(F.get(days(text, False), F.lit(0)), "Risk Appetite Endorsement"))
        .when(has("endorse", "strategic risk profile"), pair(F.get(months(text, False), F.lit(0)), "Strategic Risk Profile Endorsement"))
        .when(has("significant issue", "accountable officer"), pair(F.trim(issue), "Significant Issue"))
    )
    snippet = pair(F.coalesce(first_sentence(text), F.lit(NO_RULE)), "Snippet")
    nothing = F.coalesce(text, F.lit("")) == ""
    return F.when(nothing, pair(F.lit(NO_TEXT), "Snippet")).when(F.coalesce(rule["answer"], F.lit("")) != "", rule).otherwise(snippet)


def sentence_answer(results: DataFrame) -> DataFrame:
    """(query_id, answer, chunk_id): the sentence that shares most words with the question; the first of equals."""
    sentences = F.split("text", r"(?<=[.!?])\s+")
    each = results.select("query_id", "rank", "chunk_id", keywords(F.col("question")).alias("k"), F.posexplode(sentences).alias("pos", "sentence"))
    shared = F.size(F.array_intersect("k", F.regexp_extract_all(F.lower("sentence"), F.lit(r"[a-z][a-z0-9\-]{2,}"), 0)))
    w = Window.partitionBy("query_id").orderBy(F.col("shared").desc(), "rank", "pos")
    return each.withColumn("shared", shared).withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", F.trim("sentence").alias("answer"), "chunk_id", "shared")


def anchors_near(text: Column, anchors: Column, reach: int = 260) -> Column:
    """Whether all anchors of a question stand within `reach` characters of each other."""
    places = F.transform(anchors, lambda a: F.call_function("locate", F.lower(a), F.lower(text)))
    return (F.size(anchors) == 0) | (F.forall(places, lambda p: p > 0) & (F.array_max(places) - F.array_min(places) <= reach))


def entity_anchors(question: Column) -> Column:
    """Names in a question: runs of capitalised words that don't begin it."""
    return F.array_distinct(F.regexp_extract_all(question, F.lit(r"(?<=[a-z,] )([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*)"), 1))


def predict_answer(results: DataFrame) -> DataFrame:
    """(query_id, answer, source): number, entity, phrase or sentence, the first that applies.

    Questions for numbers take the best number of chunks in which the question's names stand
    near each other; other questions a phrase behind 'is', 'was' or 'were', else a sentence.
    """
    gated = results.where(anchors_near(F.col("text"), entity_anchors(F.col("question"))))
    numbers = best_number(gated.where(tx.is_numeric_question(F.col("question")))).where("answer is not null").select("query_id", F.col("answer").alias("number"))
    sentences = sentence_answer(gated).select("query_id", F.col("answer").alias("sentence"), "shared")
    phrase = F.nullif(F.regexp_extract("sentence", r"(?i)\b(?:is|was|were)\s+((?:the|an?)\s+[^,.;]{3,80})", 1), F.lit(""))
    met = results.select("query_id").distinct().join(numbers, "query_id", "left").join(sentences, "query_id", "left")
    usable = F.coalesce(F.col("shared") >= 2, F.lit(False))
    source = F.when(F.col("number").isNotNull(), "number").when(usable & phrase.isNotNull(), "phrase").when(usable, "sentence")
    return met.select("query_id", F.coalesce("number", F.when(usable, F.coalesce(phrase, F.col("sentence")))).alias("answer"), source.alias("source"))


def prompts(results: DataFrame, most_chunks: int = 5, most_chars: int = 9000, each_chars: int = 2200) -> DataFrame:
    """(query_id, n_chunks, n_chars, prompt): chunks in order, each cut, up to the first that would overflow."""
    w = Window.partitionBy("query_id").orderBy("rank")
    cut = results.withColumn("part", F.left("text", F.lit(each_chars))).withColumn("so_far", F.sum(F.length("part")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("rank") <= most_chunks) & (F.col("so_far") <= most_chars)
    kept = cut.withColumn("bad", F.max((~fits).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("bad = 0")
    listed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "part"))).alias("c"), F.first("question").alias("question"))
    blocks = F.transform("c", lambda x: F.concat(F.lit("["), x["chunk_id"].cast("string"), F.lit("]\n"), x["part"]))
    n = F.aggregate("c", F.lit(0), lambda a, x: a + F.length(x["part"]))
    return listed.select("query_id", F.size("c").alias("n_chunks"), n.alias("n_chars"), F.concat_ws("\n\n", F.array_join(blocks, "\n\n"), F.concat(F.lit("Question: "), "question")).alias("prompt"))


def check_citations(citations: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, parsed, valid): cited (chunk_id, page) of each query, and how many of them were retrieved."""
    there = results.select("query_id", "chunk_id", F.explode("pages").alias("page")).distinct().withColumn("ok", F.lit(1))
    return citations.join(there, ["query_id", "chunk_id", "page"], "left").groupBy("query_id").agg(F.count("*").alias("parsed"), F.count("ok").alias("valid"))


def answer_status(answer: Column, parsed: Column, valid: Column) -> Column:
    """struct(status, confidence): ok with a valid citation, else too little evidence, or an error without an answer."""
    status = F.when(answer.isNull(), "error").when(F.coalesce(valid, F.lit(0)) > 0, "ok").otherwise("insufficient_evidence")
    return F.struct(status.alias("status"), F.when(parsed > 0, valid / parsed).otherwise(F.lit(0.0)).alias("confidence"))


def validate_span(answer: Column, span: Column, context: Column) -> Column:
    """struct(answer, span): both null unless the span stands in the context word for word."""
    ok = F.coalesce((span != "") & F.contains(context, span), F.lit(False))
    return F.struct(F.when(ok, answer).alias("answer"), F.when(ok, span).alias("evidence_span"))
