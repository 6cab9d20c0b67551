"""Sections of documents: labels carried forward, spans, contents tables, interval joins."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import classify


def clean_label(text: Column) -> Column:
    s = F.regexp_replace(tx.normalize_line(F.coalesce(text, F.lit(""))), r"(?i)\(\s*cont(?:inued)?\.?\s*\)|\bcontinued\b", "")
    s = tx.normalize_line(s)
    return F.when((s == "") | (F.lower(s) == "unknown"), "Unknown").otherwise(s)


#: Titles that stand for whole bands of a report.
STATEMENTS = (
    "financial statements", "consolidated statement of", "statement of consolidated", "statement of financial position",
    "statement of comprehensive net expenditure", "statement of cash flow", "statement of cashflows", "statement of cash flows",
    "statement of changes in taxpayer", "notes to the accounts",
)
BANDS = (
    ("performance report", "PERFORMANCE REPORT"), ("accountability report", "ACCOUNTABILITY REPORT"),
    ("independent auditor", "INDEPENDENT AUDITOR'S REPORT"), ("directions by the scottish ministers", "DIRECTIONS BY THE SCOTTISH MINISTERS"),
)


def section_title(text: Column) -> Column:
    s = clean_label(text)
    n = tx.normalize_title(s)
    begins = F.rlike(n, F.lit("^(note |accounting policies|accounting convention)"))
    out = F.upper(s)
    for needle, band in reversed(BANDS):
        out = F.when(F.contains(n, F.lit(needle)), band).otherwise(out)
    return F.when(s == "Unknown", s).when(tx.contains_any(n, STATEMENTS) | begins, "FINANCIAL STATEMENTS").otherwise(out)


def subsection_title(text: Column) -> Column:
    """Notes, letters and roman numerals in one form."""
    s = clean_label(text)
    note, letter, roman = r"(?i)^\s*note\s+([0-9]+)\.?\s*(.*)$", r"^\s*([A-Za-z])[.)]?\s+(.+)$", r"(?i)^\s*(i|ii|iii|iv|v|vi|vii|viii|ix|x)[.)]?\s+(.+)$"
    part = lambda p, g: F.regexp_extract(s, p, g)
    noted = F.trim(F.concat(F.lit("NOTE "), part(note, 1), F.lit(" "), F.upper(part(note, 2))))
    return (
        F.when(s == "Unknown", s).when(F.rlike(s, F.lit(note)), noted)
        .when(F.rlike(s, F.lit(letter)), F.concat(F.upper(part(letter, 1)), F.lit(") "), F.upper(part(letter, 2))))
        .when(F.rlike(s, F.lit(roman)), F.concat(F.lower(part(roman, 1)), F.lit(") "), F.upper(part(roman, 2)))).otherwise(F.upper(s))
    )


def carry_labels(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, part, section_title, subsection_title) of pages with labels where they change.

    Part and section hold until another comes; a new section ends the subsection.
    """
    w = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    held = pages.withColumn("part", F.last("part", ignorenulls=True).over(w)).withColumn("group", F.count("section_title").over(w))
    within = Window.partitionBy("doc_id", "group").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    section, sub = F.last("section_title", ignorenulls=True).over(w), F.last("subsection_title", ignorenulls=True).over(within)
    unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
    return held.select("doc_id", "page_number", unknown(F.col("part")).alias("part"), unknown(section).alias("section_title"), unknown(sub).alias("subsection_title"))


def labels_from_lines(lines: DataFrame) -> DataFrame:
    """Labels that pages' own lines give: the first of each kind on a page, null where there is none."""
    t = F.col("text")
    pick = lambda value, when: F.min_by(F.when(when, value), F.when(when, F.col("line_no")))
    noise = F.coalesce(classify.is_signature_noise(t), F.lit(False))
    return lines.groupBy("doc_id", "page_number").agg(
        pick(classify.part_label(t), classify.part_label(t).isNotNull()).alias("part"),
        pick(section_title(t), classify.is_section_anchor(t) & ~noise).alias("section_title"),
        pick(subsection_title(t), classify.is_lettered_subsection(t) & ~classify.is_section_anchor(t) & ~noise).alias("subsection_title"),
    )


def labels_of_lines(lines: Column) -> Column:
    """struct(part, section_title, subsection_title) of a page's lines: `labels_from_lines` for one array."""
    first = lambda when: F.get(F.filter(lines, when), F.lit(0))
    quiet = lambda t: ~F.coalesce(classify.is_signature_noise(t), F.lit(False))
    section = first(lambda t: classify.is_section_anchor(t) & quiet(t))
    sub = first(lambda t: classify.is_lettered_subsection(t) & ~classify.is_section_anchor(t) & quiet(t))
    titled = lambda line, title: tx.let(line, lambda t: F.when(t.isNotNull(), title(t)))
    part = classify.part_label(first(lambda t: classify.part_label(t).isNotNull()))
    return F.struct(part.alias("part"), titled(section, section_title).alias("section_title"), titled(sub, subsection_title).alias("subsection_title"))


def carried(labels: Column) -> Column:
    """`carry_labels` for one document: an array of struct(part, section_title, subsection_title), a page each."""
    none = F.lit(None).cast("string")
    fields = "array<struct<part:string,section_title:string,subsection_title:string>>"
    zero = F.struct(none.alias("part"), none.alias("section"), none.alias("sub"), F.array().cast(fields).alias("done"))
    unknown = lambda c: F.coalesce(c, F.lit("Unknown"))

    def step(a: Column, x: Column) -> Column:
        part, section = F.coalesce(x["part"], a["part"]), F.coalesce(x["section_title"], a["section"])
        sub = F.coalesce(x["subsection_title"], F.when(x["section_title"].isNull(), a["sub"]))
        done = F.struct(unknown(part).alias("part"), unknown(section).alias("section_title"), unknown(sub).alias("subsection_title"))
        return F.struct(part.alias("part"), section.alias("section"), sub.alias("sub"), F.concat(a["done"], F.array(done)).alias("done"))

    return F.aggregate(labels, zero, step, lambda a: a["done"])


def section_spans(labels: DataFrame, page_wise: bool = False) -> DataFrame:
    """Runs of consecutive pages with the same labels (doc_id, section_no, labels, page_start, page_end, text, word_count).

    With `page_wise`, every page after a document's first run is a row of its own.
    """
    doc = Window.partitionBy("doc_id").orderBy("page_number")
    key = F.struct("part", "section_title", "subsection_title")
    new = F.coalesce((F.lag(key).over(doc) != key) | (F.lag("page_number").over(doc) != F.col("page_number") - 1), F.lit(True)).cast("int")
    run = F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0))
    numbered = labels.withColumn("new", new).withColumn("run", run)
    if page_wise:
        numbered = numbered.withColumn("run", F.when(F.col("run") == 1, 1).otherwise(F.col("page_number") + 1_000_000))
    out = numbered.groupBy("doc_id", "run", "part", "section_title", "subsection_title").agg(
        F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("t")
    )
    text = F.trim(F.array_join(F.col("t.text"), "\n"))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    w = Window.partitionBy("doc_id").orderBy("page_start")
    return out.select("doc_id", F.row_number().over(w).alias("section_no"), "part", "section_title", "subsection_title", "page_start", "page_end", text.alias("section_text"), words.alias("word_count"))


def attach_spans(points: DataFrame, spans: DataFrame, *columns: str, last: bool = True) -> DataFrame:
    """Points (doc_id, page_number) with `columns` of the span that holds them, 'Unknown' without one.

    Of several spans the last by section_no counts, or the first. Spans are turned into
    their pages, so the join is by equality.
    """
    pages = spans.select("doc_id", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page_number"), "section_no", *columns)
    order = F.col("section_no") if last else -F.col("section_no")
    one = pages.groupBy("doc_id", "page_number").agg(F.max_by(F.struct(*columns), order).alias("x"))
    met = points.join(one, ["doc_id", "page_number"], "left")
    return met.select(*points.columns, *(F.coalesce(F.col("x")[c].cast("string"), F.lit("Unknown")).alias(c) for c in columns))


# contents


#: A contents line: a title, dots or spaces, a page number.
CONTENTS_LINE = r"^\s*(.{3,}?)[ .…]{2,}\s*([0-9]{1,3})\s*$"


def contents_scores(lines: DataFrame) -> DataFrame:
    """(doc_id, page_number, score): the share of lines that look like contents, and more where the word stands."""
    fits = F.rlike("text", F.lit(CONTENTS_LINE)).cast("double")
    said = F.max(F.rlike("text", F.lit(r"(?i)^\s*(table of )?contents\s*$")).cast("double"))
    return lines.where("trim(text) != ''").groupBy("doc_id", "page_number").agg(F.least(F.lit(1.0), F.avg(fits) + 0.3 * said).alias("score"))


def contents_pages(scores: DataFrame, seed: float = 0.55, near: float = 0.28) -> DataFrame:
    """Pages that score enough, and their neighbours that score less, but enough beside one."""
    w = Window.partitionBy("doc_id").orderBy("page_number")

    def seeded(page: Column, score: Column, by: int) -> Column:
        return F.coalesce((page == F.col("page_number") + by) & (score >= seed), F.lit(False))

    before = seeded(F.lag("page_number").over(w), F.lag("score").over(w), -1)
    behind = seeded(F.lead("page_number").over(w), F.lead("score").over(w), 1)
    kept = (F.col("score") >= seed) | ((F.col("score") >= near) & (before | behind))
    return scores.withColumn("kept", kept).where("kept").drop("kept")


def parse_contents(lines: DataFrame) -> DataFrame:
    """(doc_id, item_no, title_raw, title_norm, printed_page, level): entries of contents pages, once for a title and page.

    A line without a number is carried to the next line with one.
    """
    doc = Window.partitionBy("doc_id").orderBy("page_number", "line_no")
    clean = lines.where("trim(text) != ''").withColumn("number", F.regexp_extract("text", CONTENTS_LINE, 2).try_cast("int"))
    ends = F.sum(F.col("number").isNotNull().cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    grouped = clean.withColumn("item", F.coalesce(ends, F.lit(0)))
    piece = F.when(F.col("number").isNotNull(), F.regexp_extract("text", CONTENTS_LINE, 1)).otherwise(F.trim("text"))
    one = grouped.withColumn("piece", piece).groupBy("doc_id", "item").agg(F.array_sort(F.collect_list(F.struct("page_number", "line_no", "piece"))).alias("p"), F.max("number").alias("printed_page"))
    title = tx.normalize_line(F.element_at(F.col("p.piece"), -1))
    carried = F.when((F.size("p") > 1) & F.rlike(F.element_at(F.col("p.piece"), -1), F.lit(r"^\p{Ll}")), F.concat_ws(" ", F.element_at(F.col("p.piece"), -2), title)).otherwise(title)
    named = one.where("printed_page is not null").select("doc_id", "item", carried.alias("title_raw"), "printed_page").withColumn("title_norm", tx.normalize_title(F.col("title_raw")))
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "title_norm", "printed_page").orderBy("item"))).where("n = 1")
    level = F.when(F.rlike("title_raw", F.lit(r"^[A-Z0-9 ,&'()-]+$")), 1).otherwise(2)
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("item")).alias("item_no"), "title_raw", "title_norm", "printed_page", level.alias("level"))


def page_offset(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, offset, confidence): what to add to printed pages, the commonest offset of titles found on pages.

    A title is found on the first page with the largest share of its words (of four letters
    or more), at least two of them or all, and at least 0.34. Titles meet pages by word.
    """
    words = items.select("doc_id", "item_no", "printed_page", F.array_distinct(F.filter(F.split("title_norm", " "), lambda w: F.length(w) >= 4)).alias("w"))
    asked = words.select("doc_id", "item_no", "printed_page", F.size("w").alias("n"), F.explode("w").alias("word"))
    there = pages.select("doc_id", "page_number", F.explode(F.array_distinct(F.split(tx.normalize_title(F.col("text")), " "))).alias("word"))
    hits = asked.join(there, ["doc_id", "word"]).groupBy("doc_id", "item_no", "printed_page", "n", "page_number").agg(F.count("*").alias("hit"))
    fit = hits.where((F.col("hit") >= F.least(F.lit(2), F.col("n"))) & (F.col("hit") / F.col("n") >= 0.34))
    best = fit.groupBy("doc_id", "item_no", "printed_page").agg(F.max_by("page_number", F.struct(F.col("hit") / F.col("n"), -F.col("page_number"))).alias("page"))
    votes = best.groupBy("doc_id", (F.col("page") - F.col("printed_page")).alias("offset")).agg(F.count("*").alias("v"), F.min("item_no").alias("first"))
    total = votes.groupBy("doc_id").agg(F.sum("v").alias("n"), F.max_by(F.struct("offset", "v"), F.struct("v", -F.col("first"))).alias("x"))
    return total.select("doc_id", F.col("x.offset").alias("offset"), (0.5 * F.col("x.v") / F.col("n") + 0.5 * F.least(F.lit(1.0), F.col("n") / 12)).alias("confidence"))


def contents_spans(items: DataFrame, offsets: DataFrame, last_pages: DataFrame) -> DataFrame:
    """(doc_id, section_no, title_raw, level, section_title, page_start, page_end): each entry up to the next one."""
    w = Window.partitionBy("doc_id").orderBy("item_no")
    met = items.join(offsets, "doc_id").join(last_pages, "doc_id")
    start = F.greatest(F.lit(1), F.least(F.col("printed_page") + F.col("offset"), F.col("last_page")))
    placed = met.withColumn("page_start", start.cast("int"))
    end = F.coalesce(F.lead("page_start").over(w) - 1, F.col("last_page"))
    section = F.last(F.when(F.col("level") == 1, F.col("title_raw")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("doc_id", F.col("item_no").alias("section_no"), "title_raw", "level", F.coalesce(section, F.col("title_raw")).alias("section_title"), "page_start", F.greatest("page_start", end).cast("int").alias("page_end"))


def title_matches(wanted: DataFrame, titles: DataFrame, overlap: float = 0.6, sequence: float = 0.75) -> DataFrame:
    """For each (doc_id, wanted) the first of the document's titles (position, title) alike by words or by letters.

    Letters are compared by the share of matching blocks, in Python, only where words don't decide
    and neither lengths nor counts of letters rule it out.
    """
    @F.pandas_udf("double")
    def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def ratio(x: str, y: str) -> float:
            m = difflib.SequenceMatcher(None, x, y)
            return m.ratio() if m.quick_ratio() >= sequence else 0.0

        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)])

    met = wanted.join(titles, "doc_id").withColumn("words", tx.token_set_ratio(F.col("wanted"), F.col("title")))
    sure = met.where(F.col("words") >= overlap).select("doc_id", "wanted", "position", "title")
    a, b = tx.normalize_title(F.col("wanted")), tx.normalize_title(F.col("title"))
    near = 2 * F.least(F.length(a), F.length(b)) >= sequence * (F.length(a) + F.length(b))
    rest = met.where((F.col("words") < overlap) & near).withColumn("r", block_ratio(a, b))
    every = sure.unionByName(rest.where(F.col("r") >= sequence).select("doc_id", "wanted", "position", "title"))
    return every.groupBy("doc_id", "wanted").agg(F.min_by("title", "position").alias("title"), F.min("position").alias("position"))
