"""Classifiers of pages and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import numeric
from ..functions import text as tx


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x) != "")


def page_needs_ocr(text: Column, least: int = 50, alpha: float = 0.3, digit: float = 0.6) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    digits = (F.length(t) - F.length(F.regexp_replace(t, r"\p{Nd}", ""))) / F.greatest(F.length(t), F.lit(1))
    return (F.length(t) < least) | ((numeric.alpha_ratio(t) < alpha) & (digits < digit))


def ocr_quality(text: Column) -> Column:
    """struct of four flags and whether two or more hold."""
    raw = F.coalesce(text, F.lit(""))
    tokens = F.regexp_extract_all(F.lower(raw), F.lit("[a-z]+"), 0)
    dense = F.regexp_replace(raw, r"(?U)\s", "")
    noisy = F.length(F.regexp_replace(dense, r"[\p{L}\p{N}£%.,()/\-:'’+&]", "")) / F.greatest(F.length(dense), F.lit(1))
    short = F.filter(tokens, lambda t: F.length(t) <= 4)
    # a sorted list has equal tokens next to each other: one that equals the one 20 places on comes more than 20 times
    ordered = F.array_sort(short)
    often = F.get(F.transform(F.array(ordered), lambda o: F.exists(F.zip_with(o, F.slice(o, 21, 1_000_000), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)), F.lit(0))
    repeated = F.rlike(raw, F.lit(r"(?i)\b([A-Za-z]{2,4})\b(?:\s+\1){4,}")) | often
    flags = {
        "low_text_density": (F.length(raw) < 200) | (F.size(tokens) < 30), "high_symbol_ratio": noisy > 0.35,
        "repeated_garbage": repeated, "low_line_count": F.size(_lines(raw)) < 4,
    }
    total = reduce(lambda a, b: a + b, (f.cast("int") for f in flags.values()))
    return F.struct(*(f.alias(n) for n, f in flags.items()), (total >= 2).alias("reject"))


def is_corrupted_ocr(text: Column) -> Column:
    """Replacement characters, or hardly any letters or digits."""
    t = F.coalesce(text, F.lit(""))
    known = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(F.regexp_replace(t, r"(?U)\s", "")), F.lit(1))
    return F.contains(t, F.lit("�")) | (known < 0.3)


def is_targets_table(text: Column) -> Column:
    """Many amounts with separators, and resource limits or currency marks."""
    large = _count(text, r"\b[0-9]{1,3}(?:,[0-9]{3})+\b")
    return (large >= 10) & ((_count(text, r"(?i)resource\s+limit") >= 3) | ((_count(text, r"£\s*[0-9]|£000") >= 6) & (large >= 14)))


def numeric_tokens(line: Column) -> Column:
    patterns = (r"\([0-9][0-9,]*\)", r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?", r"[0-9]+(?:\.[0-9]+)?%", r"[0-9]+(?:\.[0-9]+)?", r"\b-\b")
    return reduce(lambda a, b: a + b, (_count(line, p) for p in patterns))


#: Words of table headers, and keywords of raw lines.
HEADER_WORDS = ("limit", "actual", "variance", "reported", "consolidated", "assets", "liabilities", "outturn", "surplus", "deficit", "net")
RAW_KEYWORDS = ("note", "£", "£000", "£'000", "total", "balance", "expenditure", "income", "assets", "liabilities", "depreciation", "impairment")


def is_small_financial_table(text: Column) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    words = lambda x: F.array_distinct(F.transform(F.split(F.lower(x), " +"), lambda w: F.regexp_replace(w, "^[.,;:()]+|[.,;:()]+$", "")))
    headed = F.array(*map(F.lit, HEADER_WORDS))

    def measured(x: Column) -> Column:
        """What one line has, computed once."""
        return F.struct(x.alias("x"), numeric_tokens(x).alias("t"))

    def judged(rows: Column) -> Column:
        spaced = F.exists(rows, lambda r: (_count(r["x"], "  ") >= 3) & (r["t"] >= 2))
        bodies = F.transform(rows, lambda r: (F.rlike(r["x"], F.lit("[A-Za-z]")) & (r["t"] >= 2)).cast("int"))
        heads = F.transform(rows, lambda r: F.size(F.array_intersect(words(r["x"]), headed)) >= 2)

        def windows(body: Column) -> Column:
            dense = F.exists(F.transform(body, lambda b, i: total(F.slice(body, i + 1, 12)) >= 3), lambda x: x)
            return dense | F.exists(F.transform(heads, lambda h, i: h & (total(F.slice(body, i + 2, 12)) >= 2)), lambda x: x)

        return spaced | tx.let(bodies, windows)

    lines = _lines(text)
    marked = F.rlike(text, F.lit(r"(?i)£\s*'?000'?s?|\(£\s*'?000'?\)"))
    return F.coalesce(F.when(marked, tx.let(lines, lambda x: (F.size(x) >= 4) & tx.let(F.transform(x, measured), judged))), F.lit(False))


def is_table_like(text: Column) -> Column:
    def spaced(lines: Column) -> Column:
        spaces = F.aggregate(F.transform(lines, lambda x: _count(x, "  ")), F.lit(0), lambda a, x: a + x) / F.greatest(F.size(lines), F.lit(1))
        return (F.size(lines) >= 1) & (spaces > 0.3)

    ratio = numeric.digit_ratio(text) > 0.15
    return F.coalesce(is_targets_table(text) | (ratio & tx.let(_lines(text), spaced)) | is_small_financial_table(text), F.lit(False))


def is_table_like_raw(lines: Column) -> Column:
    """The same question of raw lines, before they are cleaned."""
    text = F.lower(F.array_join(lines, "\n"))
    hits = reduce(lambda a, b: a + b, (F.contains(text, F.lit(k)).cast("int") for k in RAW_KEYWORDS))
    hits = hits + F.rlike(text, F.lit(r"\b20[0-9]{2}/[0-9]{2}\b")).cast("int") + F.rlike(text, F.lit(r"£\s?[0-9,]+(?:\.[0-9]+)?")).cast("int")
    bands = F.exists(lines, lambda x: _count(x, r"\b[0-9]+\s*[-–]\s*[0-9]+\b") >= 2) & (hits >= 1)
    full = F.filter(lines, lambda x: F.trim(x) != "")
    wide = F.size(F.filter(full, lambda x: F.contains(x, F.lit("  ")) | F.contains(x, F.lit("\t")))) / F.greatest(F.size(full), F.lit(1))
    ratio = numeric.digit_ratio(text)
    return (F.size(lines) >= 2) & (bands | ((ratio >= 0.15) & (((hits >= 2) & (ratio > 0.15)) | ((F.size(full) >= 3) & (wide > 0.5)))))


def is_graphics_table(drawings: Column) -> Column:
    """Grids out of drawn shapes: array of struct(op, x0, y0, x1, y1, filled); op is l, re or c."""
    dx, dy = (lambda d: F.abs(d["x1"] - d["x0"])), (lambda d: F.abs(d["y1"] - d["y0"]))
    n = lambda f: F.size(F.filter(drawings, f))
    box = n(lambda d: (d["op"] == "re") & ~d["filled"] & (dx(d) >= 30) & (dy(d) >= 12))
    h = n(lambda d: (d["op"] == "l") & (dy(d) <= 2) & (dx(d) >= 30)) + 2 * box
    v = n(lambda d: (d["op"] == "l") & ~((dy(d) <= 2) & (dx(d) >= 30)) & (dx(d) <= 2) & (dy(d) >= 30)) + 2 * box
    rects, curves = n(lambda d: (d["op"] == "re") & ~d["filled"]), n(lambda d: d["op"] == "c")
    plot = (curves > 3.0 * (h + v)) & (rects < 2)
    return (F.size(drawings) > 0) & ~plot & (((rects >= 4) & (h >= 8) & (v >= 4)) | ((h >= 10) & (v >= 5)))


def column_aligned_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page_number, aligned) of lines with x0: text in at least five columns of at least six lines."""
    bucket = F.bround(F.col("x0") / 12) * 12
    page = ["doc_id", "page_number"]
    buckets = lines.groupBy(*page, bucket.alias("b")).agg(F.count("*").alias("n"), F.count_if(F.rlike("text", F.lit(r"\p{Nd}"))).alias("d"))
    out = buckets.groupBy(*page).agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.count_if((F.col("n") >= 6) & F.col("b").isNotNull()).alias("dense"))
    return out.select(*page, ((F.col("n") >= 12) & (F.col("d") >= 6) & (F.col("dense") >= 5)).alias("aligned"))


def has_many_numbers(text: Column) -> Column:
    return numeric.digit_ratio(text) > 0.10


def table_type(text: Column) -> Column:
    """The type with the most keywords, the first of equals; 'unknown' without any."""
    def scored(t: Column) -> Column:
        return F.array(*(
            F.struct(reduce(lambda a, b: a + b, (F.contains(t, F.lit(k)).cast("int") for k in keys)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name"))
            for i, (name, keys) in enumerate(lex.TABLE_TYPES.items())
        ))

    best = tx.let(tx.normalize_line(F.lower(F.coalesce(text, F.lit("")))), lambda t: F.array_max(scored(t)))
    return tx.let(best, lambda b: F.when(b["n"] > 0, b["name"]).otherwise("unknown"))


def classify_page(text: Column) -> Column:
    def of(x: Column) -> Column:
        table, kind = x["table"], F.when(x["table"] & (x["kind"] != "unknown"), x["kind"])
        confidence = F.when(kind.isNotNull(), "high").when(table, "medium").otherwise("low")
        return F.struct(table.alias("is_table"), kind.alias("table_type"), (~table).alias("is_text"), x["many"].alias("has_numbers"), confidence.alias("confidence"))

    return tx.let(F.struct(is_table_like(text).alias("table"), table_type(text).alias("kind"), has_many_numbers(text).alias("many")), of)


def accept_ocr_table(text: Column) -> Column:
    """struct(accepted, table_type): pay tables, strongly numeric pages, or known headers."""
    t, kind = F.lower(F.coalesce(text, F.lit(""))), table_type(text)
    pay = tx.contains_any(t, ("remuneration", "salary", "pension")) & (_count(t, "[0-9]{2,}") >= 6)
    strong = (numeric.digit_ratio(t) > 0.2) & (_count(t, r"[0-9][0-9,]{2,}") >= 10)
    accepted = pay | strong | (kind != "unknown")
    return F.struct(accepted.alias("accepted"), F.when(pay, "staff_costs").when(kind != "unknown", kind).when(strong, "numeric").alias("table_type"))


# headings


def part_label(line: Column) -> Column:
    return F.when(F.rlike(line, F.lit(r"(?i)\bPart\s+A\b")), "Part A").when(F.rlike(line, F.lit(r"(?i)\bPart\s+B\b")), "Part B")


def is_numbered_heading(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^\s*[0-9]+(\.[0-9]+)*\s+.+"))


def _heading_shape(line: Column) -> Column:
    n = F.length(line)
    return (n >= 4) & (n <= 110) & ~F.contains(line, F.lit("•")) & ~F.rlike(line, F.lit(r"(?i)\bpage\s+[0-9]+\b"))


def is_heading_text(line: Column) -> Column:
    s = F.trim(line)
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}"))))
    enough = (capital >= F.greatest(F.lit(2), F.floor(F.size(words) / 2))) | is_numbered_heading(s)
    return _heading_shape(s) & ~F.rlike(s, F.lit("[.:;]$")) & ~F.lower(s).isin("contents", "table of contents") & ~F.rlike(s, F.lit("[.,;]")) & enough


def is_lettered_subsection(line: Column) -> Column:
    s = F.trim(line)
    return _heading_shape(s) & F.rlike(s, F.lit(r"^[A-Z](?:[.)])?\s+.+"))


#: Words of section banners, and of report-wide headings.
ANCHOR_WORDS = ("REPORT", "ANALYSIS", "STATEMENT", "GOVERNANCE")
GLOBAL_WORDS = ("ANNUAL", "ACCOUNTS", "YEAR", "ENDED", "NHS", "BOARD", "SCOTLAND", "GRAMPIAN")


def _words_in(line: Column, words) -> Column:
    return F.arrays_overlap(F.concat(F.regexp_extract_all(F.upper(line), F.lit("[A-Z]+"), 0), F.array(F.lit(""))), F.array(*map(F.lit, words)))


def is_section_anchor(line: Column) -> Column:
    s = tx.normalize_line(F.coalesce(line, F.lit("")))
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    upper = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) / F.greatest(F.length(letters), F.lit(1))
    dated = F.rlike(F.upper(s), F.lit(r"\b(?:19|20)[0-9]{2}\b|\b(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC)\b"))
    return (F.length(s) >= 8) & (F.length(s) <= 48) & _words_in(s, ANCHOR_WORDS) & ~_words_in(s, GLOBAL_WORDS) & ~dated & (upper >= 0.80)


def is_global_heading(line: Column) -> Column:
    return _words_in(tx.normalize_line(F.coalesce(line, F.lit(""))), GLOBAL_WORDS)


#: Lines that signing tools leave.
SIGNATURE_NOISE = (
    r"(?i)^\s*(docusign\s+envelope\s+id\s*:|digitally\s+signed\b|electronic(ally)?\s+signed\b|signature\s+verified\b"
    r"|verification\s+(code|id|url|link|status)\b|certificate(\s+of\s+completion)?\b|certification\s+stamp\b)"
)


def is_signature_noise(line: Column) -> Column:
    return F.rlike(line, F.lit(SIGNATURE_NOISE))


def heading_candidates(lines: DataFrame, boost: float = 0.85) -> DataFrame:
    """(doc_id, page_number, line_no, heading) among a page's first 30 lines (text, max_size, p95).

    A single letter takes the next line along; of consecutive letters every other one does.
    """
    w = Window.partitionBy("doc_id", "page_number").orderBy("line_no")
    near = lines.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("text").over(w)).where("place <= 30")
    lone = F.rlike(F.trim("text"), F.lit(r"^[A-Z][.)]?$")) & F.col("next").isNotNull()
    pair = F.concat(F.left(F.trim("text"), F.lit(1)), F.lit(" "), F.trim("next"))
    joins = lone & is_lettered_subsection(pair)
    flagged = near.withColumn("joins", F.coalesce(joins, F.lit(False)))
    # within a run of lines that could each take the next, the first, third, ... do
    islands = flagged.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy("doc_id", "page_number", "joins").orderBy("place")))
    odd = islands.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page_number", "joins", "run").orderBy("place")))
    taking = odd.withColumn("takes", F.col("joins") & (F.col("nth") % 2 == 1))
    free = taking.withColumn("taken", F.coalesce(F.lag("takes").over(w), F.lit(False))).where(~F.col("taken") & (F.col("text") != "") & part_label(F.col("text")).isNull())
    large = F.coalesce("max_size", F.lit(0.0)) >= boost * F.coalesce("p95", F.lit(0.0))
    heading = F.when(F.col("takes"), pair).when(is_lettered_subsection(F.col("text")) | (is_heading_text(F.col("text")) & large), F.col("text"))
    return free.select("doc_id", "page_number", "line_no", heading.alias("heading")).where("heading is not null")


# geometry


def strip_margins(lines: DataFrame) -> DataFrame:
    """`lines` (x0, y0, x1, y1, page_width, page_height, rotation) whose midpoints aren't in the margins.

    8 % above and below; of rotated or wide pages 2 % at the sides.
    """
    turned = F.pmod("rotation", F.lit(360)).isin(90, 270) | (F.col("page_width") / F.greatest("page_height", F.lit(1.0)) > 1.2)
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    side = (x >= 0.02 * F.col("page_width")) & (x <= 0.98 * F.col("page_width"))
    upright = (y >= 0.08 * F.col("page_height")) & (y <= 0.92 * F.col("page_height"))
    return lines.where(F.when(turned, side).otherwise(upright))


def wants_other_extractor(text: Column, rotation: Column, width: Column, height: Column) -> Column:
    turned = F.pmod(rotation, F.lit(360)).isin(90, 270) | (width / F.greatest(height, F.lit(1.0)) > 1.2)
    return turned & (F.length(F.trim(text)) < 100)


def choose_extraction(candidates: DataFrame, lattice: int = 85) -> DataFrame:
    """Of table extractions of a page (method, accuracy, whitespace, n_rows, n_cols) the one that counts.

    Passes in order, each with its gate; the first pass with a table wins, and in it the largest.
    """
    gate = (
        ((F.col("method") == "lattice") & (F.col("accuracy") >= lattice) & (F.col("whitespace") <= 40))
        | ((F.col("method") == "hybrid") & (F.col("accuracy") >= 80) & (F.col("whitespace") <= 45)) | (F.col("method") == "stream")
    )
    order = F.when(F.col("method") == "lattice", 0).when(F.col("method") == "hybrid", 1).otherwise(2)
    w = Window.partitionBy("doc_id", "page_number").orderBy(order, (F.col("n_rows") * F.col("n_cols")).desc(), F.col("n_cols").desc(), F.col("accuracy").desc(), "table_no")
    return candidates.where(gate).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def regions(lines: DataFrame) -> DataFrame:
    """(doc_id, page_number, region, line_count, y0, y1, text): lines split at wide vertical gaps.

    A gap is wide above 18 and above 1.8 times the page's median line height. Regions of a
    single line join the one above.
    """
    page = Window.partitionBy("doc_id", "page_number")
    tall = lines.withColumn("median", F.median(F.col("y1") - F.col("y0")).over(page))
    gap = F.col("y0") - F.lag("y1").over(page.orderBy("y0", "x0"))
    cut = tall.withColumn("cut", (F.coalesce(gap, F.lit(0.0)) > F.greatest(F.lit(18.0), 1.8 * F.col("median"))).cast("int"))
    numbered = cut.withColumn("part", F.sum("cut").over(page.orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, 0)))
    sized = numbered.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page_number", "part")))
    opens = (F.col("cut") == 1) & (F.col("n") > 1)
    merged = sized.withColumn("region", F.sum(opens.cast("int")).over(page.orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, 0)))
    out = merged.groupBy("doc_id", "page_number", "region").agg(F.count("*").alias("line_count"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))).alias("l"))
    return out.select("doc_id", "page_number", "region", "line_count", "y0", "y1", F.array_join(F.col("l.text"), "\n").alias("text"))


def lines_of_words(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page_number, line_no, text, x0, x1, y0, y1): positioned words (doc_id, page_number, text, x0, x1, top, bottom) as lines.

    From the top on, a word joins the line whose first word is at most `tolerance` above it; a line's words go from left to right.
    """
    page = words.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "x1", "bottom", "text"))).alias("w"))
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("lines"))

    def step(a: Column, w: Column) -> Column:
        opens = a["y"].isNull() | (F.abs(w["top"] - a["y"]) > tolerance)
        n = F.when(opens, a["n"] + 1).otherwise(a["n"])
        return F.struct(F.when(opens, w["top"].cast("double")).otherwise(a["y"]).alias("y"), n.alias("n"), F.concat(a["lines"], F.array(n)).alias("lines"))

    placed = page.select("doc_id", "page_number", F.explode(F.arrays_zip("w", F.aggregate("w", zero, step, lambda a: a["lines"]).alias("line"))).alias("x"))
    each = placed.select("doc_id", "page_number", F.col("x.line").alias("line"), "x.w.*")
    told = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("x0", "top", "text"))), lambda x: F.trim(x["text"])), lambda x: x != ""), " ")
    lines = each.groupBy("doc_id", "page_number", "line").agg(told.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("y0"), F.max("bottom").alias("y1"))
    order = Window.partitionBy("doc_id", "page_number").orderBy("y0", "x0")
    return lines.withColumn("text", tx.normalize_line(F.col("text"))).where("text != ''").withColumn("line_no", F.row_number().over(order)).drop("line")
