"""Pages, repeated lines, segments, windows and overlap across pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import text as tx


def page_lines(docs: DataFrame, per_page: int = 10) -> DataFrame:
    """(doc_id, page_number, line_no, text): lines of documents, so many to a page; all from 1."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return lines.select("doc_id", (F.floor(F.col("i") / per_page) + 1).cast("int").alias("page_number"), (F.col("i") % per_page + 1).alias("line_no"), "text")


def pages_of(docs: DataFrame, per_page: int = 10) -> DataFrame:
    """(doc_id, page_number, text): consecutive lines joined; one row at a time, no shuffle."""
    lines = F.split("text", "\n", -1)
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / per_page).cast("int"))
    parts = F.transform(starts, lambda p: F.array_join(F.slice(lines, p * per_page + 1, per_page), "\n"))
    out = docs.select("doc_id", F.posexplode(parts).alias("p", "text"))
    return out.select("doc_id", (F.col("p") + 1).cast("int").alias("page_number"), "text")


def repeated_edges(lines: DataFrame, share: float = 0.4, top: int = 5, bottom: int = 5, floor: bool = False) -> DataFrame:
    """(doc_id, edge, line, pages): lines at the top or bottom of enough pages of a document.

    The threshold is ceil(share * pages), 1 at least; or int(share * pages) with `floor`.
    """
    clean = lines.withColumn("line", tx.normalize_line(F.col("text"))).where("line != ''")
    page = ["doc_id", "page_number"]
    placed = clean.withColumn("from_top", F.row_number().over(Window.partitionBy(*page).orderBy("line_no"))).withColumn("from_bottom", F.row_number().over(Window.partitionBy(*page).orderBy(F.col("line_no").desc())))
    edges = placed.withColumn("edge", F.explode(F.array_compact(F.array(F.when(F.col("from_top") <= top, "header"), F.when(F.col("from_bottom") <= bottom, "footer")))))
    counted = edges.groupBy("doc_id", "edge", "line").agg(F.countDistinct("page_number").alias("pages"))
    sizes = lines.groupBy("doc_id").agg(F.countDistinct("page_number").alias("n"))
    bound = F.floor(share * F.col("n")) if floor else F.greatest(F.lit(1), F.ceil(share * F.col("n")))
    return counted.join(sizes, "doc_id").where((F.col("pages") >= bound) & (F.col("n") > 1)).select("doc_id", "edge", "line", "pages")


def drop_edges(lines: DataFrame, repeated: DataFrame, top: int = 5, bottom: int = 5) -> DataFrame:
    """`lines` without repeated ones, where they stand at their edge."""
    page = Window.partitionBy("doc_id", "page_number")
    placed = lines.withColumn("line", tx.normalize_line(F.col("text"))).withColumn("a", F.row_number().over(page.orderBy("line_no"))).withColumn("b", F.row_number().over(page.orderBy(F.col("line_no").desc())))
    head = repeated.where("edge = 'header'").select("doc_id", "line").withColumn("is_head", F.lit(True))
    foot = repeated.where("edge = 'footer'").select("doc_id", "line").withColumn("is_foot", F.lit(True))
    met = placed.join(head, ["doc_id", "line"], "left").join(foot, ["doc_id", "line"], "left")
    gone = F.coalesce(F.col("is_head") & (F.col("a") <= top), F.lit(False)) | F.coalesce(F.col("is_foot") & (F.col("b") <= bottom), F.lit(False))
    return met.where(~gone).select("doc_id", "page_number", "line_no", "text")


def _frequent(values: Column, bound: Column) -> Column:
    """Values that are in an array at least `bound` times."""
    def of(v: Column) -> Column:
        starts = F.filter(F.transform(v, lambda x, i: F.when((i == 0) | (F.get(v, i - 1) != x), i)), lambda i: i.isNotNull())
        return tx.let(starts, lambda at: F.transform(F.filter(F.transform(at, lambda a, j: F.struct(a.alias("a"), (F.coalesce(F.get(at, j + 1), F.size(v)) - a).alias("n"))), lambda x: x["n"] >= bound), lambda x: F.get(v, x["a"])))

    return tx.let(F.array_sort(values), of)


def clean_pages(docs: DataFrame, per_page: int = 10, share: float = 0.4, top: int = 5, bottom: int = 5) -> DataFrame:
    """(doc_id, pages: array of (page_number, lines)): what `drop_edges` leaves of `page_lines` with their `repeated_edges`, pages without lines left out.

    One row at a time, without a shuffle: doc_id has to be unique. A document's lines are in memory, as its text is.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("text"), tx.normalize_line(x).alias("line")))
    starts = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / per_page).cast("int"))
    paged = tx.let(lines, lambda x: F.transform(starts(F.size(x)), lambda p: F.slice(x, p * per_page + 1, per_page)))
    full = lambda page: F.transform(F.filter(page, lambda x: x["line"] != ""), lambda x: x["line"])
    # each page counts a line once
    heads = F.flatten(F.transform("edges", lambda x: F.array_distinct(F.slice(x, 1, top))))
    feet = F.flatten(F.transform("edges", lambda x: F.array_distinct(F.slice(x, F.greatest(F.size(x) - bottom + 1, F.lit(1)), F.lit(bottom)))))
    n = F.size("paged")
    bound = F.greatest(F.lit(1), F.ceil(share * n))
    none = F.array().cast("array<string>")
    made = docs.where(F.col("text").isNotNull()).select("doc_id", paged.alias("paged"))
    made = made.select("doc_id", "paged", F.when(n > 1, F.transform("paged", full)).alias("edges"))
    made = made.select("doc_id", "paged", F.when(n > 1, _frequent(heads, bound)).otherwise(none).alias("heads"), F.when(n > 1, _frequent(feet, bound)).otherwise(none).alias("feet"))

    def left(page: Column) -> Column:
        gone = lambda x, i: ((i < top) & F.array_contains("heads", x["line"])) | ((i >= F.size(page) - bottom) & F.array_contains("feet", x["line"]))
        return F.transform(F.filter(page, lambda x, i: ~gone(x, i)), lambda x: x["text"])

    kept = F.transform("paged", lambda page, p: F.struct((p + 1).cast("int").alias("page_number"), left(page).alias("lines")))
    return made.select("doc_id", F.filter(kept, lambda x: F.size(x["lines"]) > 0).alias("pages"))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows; the last one is the first that reaches the end."""
    if overlap >= size:
        raise ValueError("the overlap has to be smaller than the window")
    step = size - overlap
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def word_windows(text: Column, size: int = lex.WINDOW_WORDS, overlap: int = lex.OVERLAP_WORDS) -> Column:
    """Array of windows of words."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.transform(window_starts(F.size(words), size, overlap), lambda i: F.array_join(F.slice(words, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def window_sizes(tokens: int, overlap: int) -> tuple[int, int]:
    """What a window of tokens is in words, where no tokenizer is at hand."""
    return max(50, int(0.75 * tokens)), max(10, int(0.75 * overlap))


def token_estimate(words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(words / 0.75).cast("int"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def chunks_of(pages: DataFrame, size: int = lex.WINDOW_WORDS, overlap: int = lex.OVERLAP_WORDS, least: int = lex.LEAST_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of pages (doc_id, page_number, text): windows of enough words; numbers of dropped ones stay free. `keep`: more columns of the page."""
    each = pages.select("doc_id", "page_number", *keep, F.posexplode(word_windows(F.col("text"), size, overlap)).alias("chunk_index", "text"))
    words = word_count(F.col("text"))
    local = F.format_string("p%04d_%03d", "page_number", "chunk_index")
    return each.where(words >= least).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), local).alias("chunk_id"), "doc_id", "page_number", "chunk_index", "text",
        words.alias("word_count"), token_estimate(words).alias("token_count"), F.array("page_number").alias("pages"), *keep,
    )


#: Numbered headings before which a line break is put; lines that open a segment; what a search looks for.
INSERT = r"(\b[0-9]+(?:\.[0-9]+){1,4}\s+[A-Z][A-Za-z][^\n]{0,120})"
MATCH = (r"^[0-9]+(?:\.[0-9]+){1,5}\b", r"(?i)^[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3}\s+(?:integration\s+joint\s+board\s*\(ijb\)|ijb)\b")
SEARCH = r"(?i)\b(?:integration\s+joint\s+boards?|ijbs?)\b"
UPPERCASE = r"^[A-Z][A-Z0-9 ,/&()\-]{8,}$"


def segments(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, segment, title, text, boundary_type, has_search_hit): pages cut at headings, lines joined by a space."""
    inserted = F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), INSERT, "\n$1")
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split(inserted, r"\r?\n")).alias("i", "raw"))
    line = F.regexp_replace("raw", r"^\s+|\s+$", "")
    opens = tx._any(*(F.rlike(line, F.lit(p)) for p in MATCH))
    large = F.rlike(line, F.lit(UPPERCASE)) & (F.size(F.split(line, r"\s+")) <= 14)
    kind = F.when(opens, F.when(F.rlike(line, F.lit(f"^(?:{INSERT})")), "INSERT").otherwise("MATCH")).when(large, "MATCH")
    typed = lines.select("doc_id", "page_number", "i", line.alias("line"), kind.alias("opens")).where("line != ''")
    page = Window.partitionBy("doc_id", "page_number").orderBy("i")
    numbered = typed.withColumn("segment", F.sum(F.col("opens").isNotNull().cast("int")).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.bool_or(F.rlike("line", F.lit(SEARCH)))
    whole = numbered.groupBy("doc_id", "page_number", "segment").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"), F.coalesce(F.min_by("opens", "i"), F.lit("CONTINUATION")).alias("boundary_type"), hit.alias("has_search_hit"))
    title = F.when(F.col("boundary_type") == "CONTINUATION", "segment_000").otherwise(F.left(F.regexp_replace(F.get("l.line", F.lit(0)), r"\s+", " "), F.lit(96)))
    return whole.select("doc_id", "page_number", "segment", title.alias("title"), F.array_join(F.col("l.line"), " ").alias("text"), "boundary_type", "has_search_hit")


def cross_page_chunks(pages: DataFrame, most: int = 320) -> DataFrame:
    """Where a page stops within a sentence: its end and the next page's beginning, as a chunk of both."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    clean = pages.select("doc_id", "page_number", tx.normalize_line(F.col("text")).alias("text")).where("text != ''")
    met = clean.withColumn("next", F.lead("text").over(w)).withColumn("next_page", F.lead("page_number").over(w))
    open_ = ~F.rlike("text", F.lit(r"[.!?:;]['\")\]]*$")) & F.col("next").isNotNull()
    tail, head = F.right("text", F.lit(most)), F.left("next", F.lit(most))
    # from the last sentence's beginning, to the first one's end, where they are in reach
    tail = F.regexp_replace(tail, r"^.*[.!?]\s+(?=\S)", "")
    ended = F.regexp_extract(head, r"^(.*?[.!?])(?:\s|$)", 1)
    head = F.when(ended != "", ended).otherwise(head)
    local = F.format_string("p%04d_x%03d", "page_number", F.lit(0))
    return met.where(open_).select(
        F.concat_ws(":", F.col("doc_id").cast("string"), local).alias("chunk_id"), "doc_id", "page_number", F.concat_ws(" ", tail, head).alias("text"),
        F.array("page_number", "next_page").alias("pages"), F.lit("CROSS_PAGE_CONTINUATION").alias("segment_boundary_type"),
    )


def offsets(chunks: DataFrame) -> DataFrame:
    """Where each chunk starts in words: after the one before, less the words that both share."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("chunk_index")
    words = F.split("text", " ")
    shared = F.coalesce(tx.shared_suffix_prefix(F.lag(words).over(w), words), F.lit(0))
    placed = chunks.select("chunk_id", "doc_id", "page_number", "chunk_index", F.size(words).alias("n"), shared.alias("shared"), F.coalesce(F.lag(F.size(words)).over(w), F.lit(0)).alias("before"))
    start = F.sum(F.col("before") - F.col("shared")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("chunk_id", "shared", start.alias("start"))
