"""Tables: facts, markdown, row records and the chunks that they make.

A table is a row: table_id, page_number, headers array<string>, cells array<array<string>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions import text as tx


def facts(tables: DataFrame, *keys: str) -> DataFrame:
    """Numeric cells, one a row, with their labels: rows of the first column, columns of the headers."""
    rows = tables.select(*keys, "headers", F.posexplode("cells").alias("row_no", "row"))
    label = F.trim(F.get("row", F.lit(0)))
    each = rows.where(label != "").select(*keys, "headers", "row_no", label.alias("row_label_raw"), F.posexplode("row").alias("column_no", "cell")).where("column_no > 0")
    header = F.trim(F.coalesce(F.get("headers", F.col("column_no")), F.lit("")))
    n = numeric.coerce_number(F.col("cell"))
    out = each.select(
        *keys, "row_no", "column_no", "row_label_raw", tx.normalize_key(F.col("row_label_raw")).alias("row_label_norm"), header.alias("column_header_raw"),
        tx.normalize_key(header).alias("column_header_norm"), tx.quarter(header).alias("quarter"), F.trim("cell").alias("value_raw"), n["value"].alias("value_num"), n["is_percent"].alias("is_percent"),
    )
    return out.where("value_num is not null")


def lookup(questions: DataFrame, table_facts: DataFrame) -> DataFrame:
    """The fact that answers each question (query_id, doc_id, page, table_type, row_terms, column_terms, quarter, prefer_percent).

    Facts of the document are narrowed by page, type, row, column, quarter and percent in
    turn; a step that would leave none is passed over. The latest quarter and the largest
    value win.
    """
    f = table_facts.select("doc_id", *(F.col(c).alias(f"f_{c}") for c in ("page", "table_type", "row_label_norm", "row_label_raw", "column_header_norm", "column_header_raw", "quarter", "value_raw", "value_num", "is_percent")))
    met = questions.join(f, "doc_id")
    w = Window.partitionBy("query_id")
    has = lambda terms, text: F.exists(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.contains(text, F.replace(F.lower(t), F.lit(" "), F.lit("_"))))
    steps = (
        F.col("f_page") == F.col("page"), F.col("f_table_type") == F.col("table_type"), has(F.col("row_terms"), F.col("f_row_label_norm")),
        has(F.col("column_terms"), F.col("f_column_header_norm")), F.col("f_quarter") == F.col("quarter"), F.col("prefer_percent") & F.col("f_is_percent"),
    )
    for step in steps:
        met = met.withColumn("fits", F.coalesce(step, F.lit(False))).withColumn("any_fits", F.max("fits").over(w))
        met = met.where(~F.col("any_fits") | F.col("fits")).drop("fits", "any_fits")
    order = Window.partitionBy("query_id").orderBy(F.col("f_quarter").desc_nulls_last(), F.col("f_value_num").desc(), "f_row_label_norm", "f_column_header_norm")
    return met.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", F.col("f_value_raw").alias("value_raw"), F.col("f_value_num").alias("value_num"), F.col("f_row_label_norm").alias("row_label_norm"), F.col("f_column_header_norm").alias("column_header_norm"))


def markdown(headers: Column, cells: Column, most_rows: int = 30, most_columns: int = 10) -> Column:
    """A table as markdown."""
    def line(row: Column) -> Column:
        cleaned = F.transform(F.slice(row, 1, most_columns), lambda c: F.replace(tx.normalize_line(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("/")))
        return F.concat(F.lit("| "), F.array_join(cleaned, " | "), F.lit(" |"))

    rule = F.transform(F.slice(headers, 1, most_columns), lambda c: F.lit("---"))
    return F.array_join(F.concat(F.array(line(headers), line(rule)), F.transform(F.slice(cells, 1, most_rows), line)), "\n")


def parse_markdown(text: Column) -> Column:
    """struct(headers, cells) of the first markdown table of a text; null without one. Short rows are filled up."""
    split = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    is_rule = lambda r: F.forall(r, lambda c: F.rlike(c, F.lit("^[-: ]*-[-: ]*$")))
    lines = F.transform(F.filter(F.split(text, r"\r?\n"), lambda x: F.contains(x, F.lit("|"))), lambda x: F.struct(split(x).alias("cells")))
    typed = F.transform(lines, lambda x: F.struct(x["cells"].alias("cells"), is_rule(x["cells"]).alias("rule")))

    # lines, the rule's place, the body and its width are each worked out once for a text
    def placed(lines: Column) -> Column:
        return tx.let(F.array_position(F.transform(lines, lambda x: x["rule"]), True).cast("int"), lambda at: below(lines, at))

    def below(lines: Column, at: Column) -> Column:
        body = F.transform(F.filter(lines, lambda x, i: (i >= at) & ~x["rule"]), lambda x: x["cells"])
        head = F.get(lines, at - 2)["cells"]
        return F.when(at > 1, tx.let(body, lambda b: F.when(F.size(b) > 0, filled(head, b))))

    def filled(head: Column, body: Column) -> Column:
        fill = lambda r, width: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
        width = F.greatest(F.size(head), F.array_max(F.transform(body, lambda r: F.size(r))))
        return tx.let(width, lambda n: F.struct(fill(head, n).alias("headers"), F.transform(body, lambda r: fill(r, n)).alias("cells")))

    return tx.let(typed, placed)


def clean_table(headers: Column, cells: Column) -> Column:
    """struct(headers, cells): blank rows go; a first row that is mostly words becomes the header of a table without one."""
    trimmed = F.transform(cells, lambda r: F.transform(r, lambda c: tx.normalize_line(F.coalesce(c, F.lit("")))))
    full = F.filter(trimmed, lambda r: F.exists(r, lambda c: c != ""))
    first = F.get(full, F.lit(0))
    wordy = F.size(F.filter(first, lambda c: F.rlike(c, F.lit(r"\p{L}")) & ~F.rlike(c, F.lit("^[0-9(£-]")))) / F.greatest(F.size(first), F.lit(1)) > 0.5
    bare = F.forall(headers, lambda h: F.rlike(F.coalesce(h, F.lit("")), F.lit("^(|[0-9]+|Unnamed.*)$")))
    promote = bare & F.coalesce(wordy, F.lit(False))
    return F.struct(F.when(promote, first).otherwise(headers).alias("headers"), F.when(promote, F.slice(full, F.lit(2), F.greatest(F.size(full), F.lit(1)))).otherwise(full).alias("cells"))


def summary(headers: Column, cells: Column, kind: Column, most_rows: int = 5) -> Column:
    """A few sentences for search: type, columns, first row labels."""
    labels = F.filter(F.transform(F.slice(cells, 1, most_rows), lambda r: F.trim(F.get(r, F.lit(0)))), lambda c: c != "")
    return F.concat(F.lit("Table ("), F.coalesce(kind, F.lit("unknown")), F.lit(") with columns "), F.array_join(F.filter(headers, lambda h: h != ""), ", "), F.lit(". Rows: "), F.array_join(labels, "; "), F.lit("."))


#: Cells that count as blank; words and rows of a table's chunks; words of a first line that tells a unit.
BLANK = ("", "-", "—", "n/a", "na", "none")
SUMMARY_WORDS, KEY_ROWS = 140, 5
BLOCK_WORDS, BLOCK_WORDS_MOST, BLOCK_ROWS, BLOCK_FACTS = 320, 450, 10, 24
UNIT_SIGNS = ("£", "%", "000", "million", "m ")

_NONE = "array<string>"


def _is_blank(cell: Column) -> Column:
    return F.lower(F.trim(cell)).isin(*BLANK)


def _named(headers: Column) -> Column:
    """Headers with a number for those without a name."""
    return F.transform(headers, lambda h, i: F.when(tx.normalize_line(F.coalesce(h, F.lit(""))) == "", F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(tx.normalize_line(h)))


def _is_category(label: Column, cells: Column) -> Column:
    """A label of four letters or more without a digit, and at most one other cell, which isn't a number."""
    full = F.filter(cells, lambda c: ~_is_blank(c))
    digit = lambda c: F.rlike(c, F.lit("[0-9]"))
    return (F.length(label) >= 4) & ~digit(label) & ~F.exists(full, digit) & (F.size(full) <= 1)


def row_records(tables: DataFrame) -> DataFrame:
    """(table_id, row_no, category, label, line, fact_lines): rows with the last category row above ('General' before any); categories aren't records."""
    clean = F.transform("row", lambda c: tx.normalize_line(F.coalesce(c, F.lit(""))))
    rows = tables.select("table_id", _named(F.col("headers")).alias("headers"), F.posexplode("cells").alias("row_no", "row")).withColumn("row", clean)
    rows = rows.where(F.exists("row", lambda c: c != ""))
    label, cells = F.get("row", F.lit(0)), F.slice("row", F.lit(2), F.greatest(F.size("row"), F.lit(1)))
    is_category = _is_category(label, cells)
    w = Window.partitionBy("table_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("category", F.coalesce(F.last(F.when(is_category, label), ignorenulls=True).over(w), F.lit("General")))
    line = F.array_join(F.transform("row", lambda c: F.when(c == "", F.lit("-")).otherwise(c)), " | ")
    named = F.when(label == "", F.concat(F.lit("row_"), (F.col("row_no") + 1).cast("string"))).otherwise(label)
    subject = F.when(F.lower("category") != "general", F.concat(F.lit("[Category: "), F.col("category"), F.lit("] "), named)).otherwise(named)
    column = lambda i: F.coalesce(F.get("headers", i + 1), F.concat(F.lit("col_"), (i + 1).cast("string")))
    told = F.transform(cells, lambda c, i: F.when(c != "", F.concat(F.lit("- "), subject, F.lit(" > "), column(i), F.lit(" : "), c)))
    return held.where(~is_category).select("table_id", "row_no", "category", label.alias("label"), line.alias("line"), F.array_compact(told).alias("fact_lines"))


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def pack_lines(lines: Column, prefix: Column, budget: int) -> Column:
    """Greedy packs of whole lines under a budget of tokens, each with the prefix on top.

    A line that is over the budget alone makes a pack of its own. Tokens are words / 0.75.
    """
    tokens = lambda words: F.when(words > 0, F.greatest(F.lit(1), F.floor(words / 0.75))).otherwise(0)
    left = max(40, budget) - F.when(prefix != "", tx.let(_word_count(prefix), tokens)).otherwise(F.lit(0))
    # words are counted once a line, not once for each time that a step needs them
    counted = F.transform(lines, lambda x: F.struct(x.alias("line"), _word_count(x).alias("n")))
    zero = F.struct(F.array().cast(_NONE).alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def packed(room: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            fits = a["open"].isNull() | (tokens(a["n"] + x["n"]) <= room)
            return F.struct(
                F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"),
                F.when(fits, F.concat_ws("\n", a["open"], x["line"])).otherwise(x["line"]).alias("open"), F.when(fits, a["n"] + x["n"]).otherwise(x["n"]).alias("n"),
            )

        return F.aggregate(counted, zero, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))

    return F.transform(tx.let(left, packed), lambda p: F.when(prefix != "", F.concat(prefix, F.lit("\n"), p)).otherwise(p))


def _cut(text: Column, words: int) -> Column:
    """The first `words` words, one space apart, of a text that has more."""
    def of(t: Column) -> Column:
        split = F.filter(F.split(t, r"\s+"), lambda w: w != "")
        return tx.let(split, lambda w: F.when(F.size(w) > words, F.array_join(F.slice(w, 1, words), " ")).otherwise(F.trim(t)))

    return tx.let(text, of)


def _block_head(caption: Column, page: Column, kind: Column) -> list[Column]:
    return [F.concat(F.lit("Table: "), caption), F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Type: "), kind)]


def _is_general(category: Column) -> Column:
    return (category == "") | (F.lower(category) == "general")


def _block_text(rows: Column, head: list[Column], told: Column) -> Column:
    """A group of row records as text: what the table is, categories, columns (`told`), rows and facts."""
    def of(own: Column) -> Column:
        several = F.size(own) > 1
        line = lambda r: F.when(several & ~_is_general(r["category"]), F.concat(r["category"], F.lit(" :: "), r["line"])).otherwise(r["line"])
        facts = F.slice(F.flatten(F.transform(rows, lambda r: r["facts"])), 1, BLOCK_FACTS)
        return F.concat_ws(
            "\n", *head,
            F.when(several, F.concat(F.lit("Categories in block: "), F.array_join(F.slice(own, 1, 4), " | "))).when(F.size(own) == 1, F.concat(F.lit("Active category: "), F.get(own, F.lit(0)))),
            F.concat(F.lit("Columns: "), told), F.lit("Rows:"), told, F.transform(rows, line), F.when(F.size(facts) > 0, F.lit("Facts:")), facts,
        )

    return tx.let(F.array_distinct(F.filter(F.transform(rows, lambda r: r["category"]), lambda c: ~_is_general(c))), of)


_RECORD = "row_no:int,category:string,line:string,facts:array<string>"


def _records(headers: Column, cleaned: Column) -> Column:
    """`row_records` of one table as an array of struct(row_no, category, line, facts); `cleaned`: cells in one line each, '' for none."""
    typed = F.transform(cleaned, lambda r, i: F.struct(i.alias("row_no"), r.alias("row"), F.get(r, F.lit(0)).alias("label"), F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1))).alias("cells")))
    full = F.filter(typed, lambda x: F.exists(x["row"], lambda c: c != ""))
    column = lambda i: F.coalesce(F.get(headers, i + 1), F.concat(F.lit("col_"), (i + 1).cast("string")))

    def record(x: Column, category: Column) -> Column:
        named = F.when(x["label"] == "", F.concat(F.lit("row_"), (x["row_no"] + 1).cast("string"))).otherwise(x["label"])
        subject = F.when(F.lower(category) != "general", F.concat(F.lit("[Category: "), category, F.lit("] "), named)).otherwise(named)
        told = lambda s: F.transform(x["cells"], lambda c, i: F.when(c != "", F.concat(F.lit("- "), s, F.lit(" > "), column(i), F.lit(" : "), c)))
        line = F.array_join(F.transform(x["row"], lambda c: F.when(c == "", F.lit("-")).otherwise(c)), " | ")
        return F.struct(x["row_no"].alias("row_no"), category.alias("category"), line.alias("line"), F.array_compact(tx.let(subject, told)).alias("facts"))

    zero = F.struct(F.lit("General").alias("category"), F.array().cast(f"array<struct<{_RECORD}>>").alias("done"))

    def step(a: Column, x: Column) -> Column:
        category = lambda is_: F.struct(F.when(is_, x["label"]).otherwise(a["category"]).alias("category"), F.when(is_, a["done"]).otherwise(F.concat(a["done"], F.array(record(x, a["category"])))).alias("done"))
        return tx.let(_is_category(x["label"], x["cells"]), category)

    return F.aggregate(full, zero, step, lambda a: a["done"])


def _grouped(records: Column, fixed: Column, target: int, hard: int, most_rows: int) -> Column:
    """Records in groups: array of arrays. The words of a group's `_block_text` are summed up from those of its parts, of which `fixed` is the same for all."""
    counted = F.transform(records, lambda r: F.struct(
        r.alias("r"), _word_count(r["line"]).alias("line"), F.when(_is_general(r["category"]), F.array().cast("array<struct<c:string,w:int>>")).otherwise(F.array(F.struct(r["category"].alias("c"), _word_count(r["category"]).alias("w")))).alias("own"),
        F.transform(r["facts"], _word_count).alias("facts"),
    ))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    # what a group has: its categories, words of lines, of categories before lines, of facts, and how many facts
    nothing = F.struct(F.array().cast("array<struct<c:string,w:int>>").alias("own"), F.lit(0).alias("lines"), F.lit(0).alias("marks"), F.lit(0).alias("facts"), F.lit(0).alias("n"))

    def with_(a: Column, x: Column) -> Column:
        more = F.slice(x["facts"], F.lit(1), F.greatest(F.lit(BLOCK_FACTS) - a["n"], F.lit(0)))
        return F.struct(
            F.array_distinct(F.concat(a["own"], x["own"])).alias("own"), (a["lines"] + x["line"]).alias("lines"),
            (a["marks"] + F.coalesce(F.get(x["own"], F.lit(0))["w"] + 1, F.lit(0))).alias("marks"), (a["facts"] + total(more)).alias("facts"), (a["n"] + F.size(more)).alias("n"),
        )

    def words(a: Column) -> Column:
        shown = F.slice(a["own"], 1, 4)
        named = F.when(F.size(a["own"]) > 1, total(F.transform(shown, lambda o: o["w"])) + F.size(shown) + 2 + a["marks"]).when(F.size(a["own"]) == 1, F.get(a["own"], F.lit(0))["w"] + 2).otherwise(0)
        return fixed + named + a["lines"] + F.when(a["n"] > 0, a["facts"] + 1).otherwise(0)

    sized = lambda a: tx.let(a, lambda s: F.struct(s.alias("s"), words(s).alias("words")))
    group = f"struct<rows:array<struct<{_RECORD}>>,words:int>"
    none = F.array().cast(f"array<struct<{_RECORD}>>")
    zero = F.struct(F.array().cast(f"array<{group}>").alias("done"), F.struct(none.alias("rows"), F.lit(0).alias("words")).alias("open"), nothing.alias("s"))

    def step(a: Column, x: Column) -> Column:
        rows = a["open"]["rows"]

        def chosen(m: Column) -> Column:
            fits = (F.size(rows) == 0) | ((F.size(rows) < most_rows) & (m["words"] <= target))
            grown = F.struct(a["done"].alias("done"), F.struct(F.concat(rows, F.array(x["r"])).alias("rows"), m["words"].alias("words")).alias("open"), m["s"].alias("s"))
            anew = tx.let(sized(with_(nothing, x)), lambda o: F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), F.struct(F.array(x["r"]).alias("rows"), o["words"].alias("words")).alias("open"), o["s"].alias("s")))
            return F.when(fits, grown).otherwise(anew)

        return tx.let(sized(with_(a["s"], x)), chosen)

    groups = F.aggregate(counted, zero, step, lambda a: F.when(F.size(a["open"]["rows"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    return F.flatten(F.transform(groups, lambda g: F.when((F.size(g["rows"]) > 1) & (g["words"] > hard), F.transform(g["rows"], lambda r: F.array(r))).otherwise(F.array(g["rows"]))))


def _clean(cells: Column) -> Column:
    return F.transform(cells, lambda r: F.transform(r, lambda c: tx.normalize_line(F.coalesce(c, F.lit("")))))


def _blocks(headers: Column, cleaned: Column, head: list[Column], told: Column, target: int = BLOCK_WORDS, hard: int = BLOCK_WORDS_MOST, most_rows: int = BLOCK_ROWS) -> Column:
    """Array of struct(first_row, last_row, text) of a table; `headers` are its columns' names in facts, `told` those of the block.

    Words only grow with a group's rows: a table whose records are within the bounds together is one group, without going through them.
    """
    block = lambda g, text: F.struct(F.get(g, F.lit(0))["row_no"].alias("first_row"), F.element_at(g, -1)["row_no"].alias("last_row"), text.alias("text"))
    fixed = _word_count(F.concat_ws("\n", *head, F.concat(F.lit("Columns: "), told), F.lit("Rows:"), told))
    none = F.array().cast("array<struct<first_row:int,last_row:int,text:string>>")

    def of(records: Column) -> Column:
        groups = tx.let(fixed, lambda n: _grouped(records, n, target, hard, most_rows))
        several = F.transform(groups, lambda g: block(g, _cut(_block_text(g, head, told), hard)))
        whole = lambda t: F.when(_word_count(t) <= min(target, hard), F.array(block(records, F.trim(t)))).otherwise(several)
        return F.when(F.size(records) > most_rows, several).when(F.size(records) > 0, tx.let(_block_text(records, head, told), whole)).otherwise(none)

    return tx.let(_records(headers, cleaned), of)


def row_blocks(tables: DataFrame, target: int = BLOCK_WORDS, hard: int = BLOCK_WORDS_MOST, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """(table_id, block_no, first_row, last_row, text): row records in order, grouped up to a target of words and a number of rows.

    A group over the hard limit falls apart into its rows. `tables` has caption, page_number, kind and names besides its cells.
    A table at a time, without a shuffle.
    """
    head = _block_head(F.col("caption"), F.col("page_number"), F.col("kind"))
    blocks = _blocks(_named(F.col("headers")), _clean(F.col("cells")), head, F.array_join("names", " | "), target, hard, most_rows)
    return tables.select("table_id", F.posexplode(blocks).alias("block_no", "b")).select("table_id", "block_no", "b.*")


def table_chunks(tables: DataFrame, strategy: str = "baseline", budget: int = 224) -> DataFrame:
    """(chunk_id, table_id, page_number, text, table_chunk_kind) by strategy.

    `tables` may have summary, table_type and injected_facts. baseline: summary, facts and
    markdown in one; row_preserving: packs of whole rows under the table's name and columns;
    row_blocks: a summary with key rows, then groups of rows with their facts; anything else:
    a header chunk with units and years of the first rows, then the packs.
    """
    return table_chunk_sets(tables, (strategy,), budget).drop("strategy")


def table_chunk_sets(tables: DataFrame, strategies: tuple[str, ...], budget: int = 224) -> DataFrame:
    """`table_chunks` of several strategies, with the strategy's name; tables are read once."""
    there = lambda name, other: F.col(name) if name in tables.columns else other
    none = F.lit(None).cast("string")
    told = there("summary", summary(F.col("headers"), F.col("cells"), there("table_type", F.lit("unknown"))))
    first = tx.normalize_line(F.get(F.split("summary", "\n"), F.lit(0)))
    # each step's columns are used several times in the next one, so they are steps of their own
    base = tables.select(
        "table_id", "page_number", "headers", "cells", told.alias("summary"), there("injected_facts", none).alias("facts"),
        F.initcap(F.replace(there("table_type", none), F.lit("_"), F.lit(" "))).alias("kind"), _named(F.col("headers")).alias("names"), _clean(F.col("cells")).alias("cleaned"),
    )
    base = base.withColumn("caption", tx.let(first, lambda f: F.when(f == "", "Unknown").otherwise(F.left(f, F.lit(120)))))
    columns = F.concat(F.lit("COLUMNS: "), F.array_join("names", " | "))
    prefix = F.concat(F.lit("TABLE | page="), F.col("page_number").cast("string"), F.lit(" | "), F.col("caption"), F.lit("\n"), columns)
    lines = F.transform("cleaned", lambda r: F.array_join(F.transform(r, lambda c: F.when(c == "", F.lit("-")).otherwise(c)), " | "))
    base = base.withColumn("prefix", prefix).withColumn("lines", lines)
    if any(s not in ("baseline", "row_blocks") for s in strategies):
        base = base.withColumn("packs", F.coalesce(pack_lines(F.col("lines"), F.col("prefix"), budget), F.array().cast(_NONE)))
    each = F.flatten(F.array(*(_by_strategy(s) for s in strategies)))
    out = base.select("table_id", "page_number", F.explode(each).alias("x"))
    name = F.concat_ws("_", "table_id", "x.kind", F.col("x.i").cast("string"))
    return out.select(name.alias("chunk_id"), "table_id", "page_number", "x.text", F.col("x.kind").alias("table_chunk_kind"), "x.strategy")


def _by_strategy(strategy: str) -> Column:
    """Array of struct(strategy, kind, i, text) of what `table_chunk_sets` has prepared."""
    numbered = lambda texts, kind: F.transform(texts, lambda t, i: F.struct(F.lit(strategy).alias("strategy"), F.lit(kind).alias("kind"), i.alias("i"), t.alias("text")))
    if strategy == "baseline":
        injected = F.when(F.coalesce("facts", F.lit("")) != "", F.concat(F.lit("Table (header-injected facts):\n\n"), F.col("facts")))
        return numbered(F.array(F.concat_ws("\n\n", "summary", injected, F.lit("Table (markdown):"), markdown(F.col("headers"), F.col("cells")))), "full_table")
    if strategy == "row_preserving":
        return numbered(F.col("packs"), "row_preserving")
    if strategy == "row_blocks":
        rich = F.filter(F.transform("cleaned", lambda r: F.filter(r, lambda c: c != "")), lambda r: F.size(r) >= 2)
        keys = F.transform(F.slice(rich, 1, KEY_ROWS), lambda r: F.concat(F.lit("\n- "), F.array_join(F.slice(r, 1, 4), " | ")))
        listed = tx.let(F.array_join(keys, ""), lambda k: F.when(k != "", F.concat(F.lit("Key rows:"), k)))
        head = _block_head(F.col("caption"), F.col("page_number"), F.col("kind"))
        whole = F.concat_ws(
            "\n", *head, F.nullif(F.trim("summary"), F.lit("")),
            F.concat(F.lit("Columns: "), F.array_join(F.slice("names", 1, 8), " | ")), listed,
        )
        opening = F.when(F.size("cells") > 0, F.array(_cut(whole, SUMMARY_WORDS))).otherwise(F.array().cast(_NONE))
        blocks = _blocks(F.col("names"), F.coalesce("cleaned", F.array().cast(f"array<{_NONE}>")), head, F.array_join("names", " | "))
        return F.concat(numbered(opening, "summary"), numbered(F.transform(blocks, lambda x: x["text"]), "row_block"))
    early = F.slice("lines", 1, 5)
    units = F.get(F.filter(early, lambda x: tx.contains_any(x, UNIT_SIGNS)), F.lit(0))
    years = F.get(F.filter(early, lambda x: F.rlike(x, F.lit(r"\b(19|20)[0-9]{2}(?:/[0-9]{2,4})?\b"))), F.lit(0))
    header = F.concat_ws("\n", "prefix", F.concat(F.lit("UNITS: "), units), F.concat(F.lit("YEAR_LABELS: "), years))
    return F.concat(numbered(F.array(header), "header"), numbered(F.col("packs"), "body"))


def distinct_tables(tables: DataFrame) -> DataFrame:
    """The first (by table_id) of tables with the same shape and the same first 2 x 3 cells."""
    corner = F.to_json(F.transform(F.slice("cells", 1, 2), lambda r: F.slice(r, 1, 3)))
    w = Window.partitionBy("doc_id", F.size("cells"), F.size("headers"), corner).orderBy("table_id")
    return tables.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def best_rows(records: DataFrame, n: int = 25) -> DataFrame:
    """The n rows of each table with the most numbers, the first of equals, in their order."""
    count = F.regexp_count("line", F.lit("[0-9][0-9,.]*"))
    w = Window.partitionBy("table_id").orderBy(count.desc(), "row_no")
    return records.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")


def merge_split_rows(records: DataFrame) -> DataFrame:
    """Rows whose label comes without values take the values of the next row without a label.

    `records`: table_id, row_no, label, values array<string>.
    """
    w = Window.partitionBy("table_id").orderBy("row_no")
    empty = lambda v: F.forall(v, lambda c: F.trim(c) == "")
    met = records.withColumn("next_label", F.lead("label").over(w)).withColumn("next_values", F.lead("values").over(w)).withColumn("last_label", F.lag("label").over(w)).withColumn("last_values", F.lag("values").over(w))
    takes = (F.trim("label") != "") & empty(F.col("values")) & (F.trim("next_label") == "") & ~empty(F.col("next_values"))
    taken = (F.trim("label") == "") & ~empty(F.col("values")) & (F.trim("last_label") != "") & empty(F.col("last_values"))
    return met.where(~F.coalesce(taken, F.lit(False))).select("table_id", "row_no", "label", F.when(F.coalesce(takes, F.lit(False)), F.col("next_values")).otherwise(F.col("values")).alias("values"))
