"""Pages and tables as markdown with their headings and facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx


def heading_lines(part: Column, section: Column, subsection: Column) -> Column:
    """'# part', '## section', '### subsection', without unknown ones."""
    def line(mark: str, label: Column) -> Column:
        s = tx.normalize_line(F.coalesce(label, F.lit("")))
        return F.when((s != "") & (F.lower(s) != "unknown"), F.concat(F.lit(f"{mark} "), s))

    return F.array_compact(F.array(line("#", part), line("##", section), line("###", subsection)))


def table_block(tables: Column) -> Column:
    """Tables (array of struct(summary, facts, markdown)) as quoted summaries and facts above their markdown."""
    def of(t: Column) -> Column:
        facts = F.filter(F.split(F.coalesce(t["facts"], F.lit("")), r"\r?\n"), lambda x: F.trim(x) != "")
        quoted = F.when(F.size(facts) > 0, F.concat(F.lit("> Table facts:\n"), F.array_join(F.transform(facts, lambda x: F.concat(F.lit("> "), x)), "\n")))
        told = F.when(F.trim(t["summary"]) != "", F.concat(F.lit("> Table summary: "), F.trim(t["summary"])))
        return F.concat_ws("\n\n", told, quoted, F.nullif(F.trim(t["markdown"]), F.lit("")))

    return F.array_join(F.filter(F.transform(tables, of), lambda x: x != ""), "\n\n")


def page_markdown(page_number: Column, text: Column, part: Column, section: Column, subsection: Column, tables: Column | None = None) -> Column:
    """A page with its headings, its number, its text and, if given, its tables."""
    block = F.nullif(table_block(tables), F.lit("")) if tables is not None else F.lit(None).cast("string")
    body = F.array_compact(F.array(F.concat(F.lit("#### Page "), page_number.cast("string")), F.nullif(F.trim(F.coalesce(text, F.lit(""))), F.lit("")), block))
    return F.array_join(F.concat(heading_lines(part, section, subsection), body), "\n\n")


def with_headings(chunk: Column, part: Column, section: Column, subsection: Column) -> Column:
    """A chunk under its headings, unless it begins with one or is empty."""
    t, lines = F.trim(F.coalesce(chunk, F.lit(""))), heading_lines(part, section, subsection)
    bare = (t != "") & ~F.startswith(t, F.lit("#")) & (F.size(lines) > 0)
    return F.when(bare, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), t)).otherwise(t)


def merge_headers(rows: Column, width: Column) -> Column:
    """Header rows as one: each column's cells from top to bottom, each once."""
    def column(j: Column) -> Column:
        cells = F.array_distinct(F.filter(F.transform(rows, lambda r: tx.normalize_line(F.coalesce(F.get(r, j), F.lit("")))), lambda c: c != ""))
        return F.array_join(cells, " ")

    return F.transform(F.sequence(F.lit(0), width - 1), column)


def is_number_like(cell: Column) -> Column:
    return F.rlike(F.trim(cell), F.lit(r"^[(£-]*[0-9][0-9,.]*[)%]*$"))


#: Short names of columns, by what their header holds.
ALIASES = (("salary", "Salary"), ("bonus", "Bonus"), ("benefits in kind", "Benefits"), ("sub total", "Subtotal"), ("subtotal", "Subtotal"), ("pension", "Pension"))


def aliases(headers: Column) -> Column:
    def name(h: Column, j: Column) -> Column:
        low = F.lower(h)
        out = F.when(F.contains(low, F.lit("total")) & F.contains(low, F.lit("remuneration")), "Total remuneration").otherwise(F.concat(F.lit("col_"), j.cast("string")))
        for needle, short in reversed(ALIASES):
            out = F.when(F.contains(low, F.lit(needle)), short).otherwise(out)
        return F.when(j == 0, "Row label").otherwise(out)

    return F.transform(headers, name)


def row_map(headers: Column, cells: Column, most: int = 25) -> Column:
    """'- label -> alias=value ; ...' for the rows with the most numbers (two at least), in the table's order."""
    names = aliases(headers)
    numbers = lambda r: F.size(F.filter(r, is_number_like))
    listed = F.filter(F.transform(cells, lambda r, i: F.struct((-numbers(r)).alias("less"), i.alias("i"), r.alias("r"))), lambda x: (x["less"] <= -2) & (F.trim(F.get(x["r"], F.lit(0))) != ""))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(listed), 1, most), lambda x: F.struct(x["i"].alias("i"), x["r"].alias("r"))))

    def line(x: Column) -> Column:
        pairs = F.transform(x["r"], lambda c, j: F.when((j > 0) & is_number_like(c), F.concat(F.get(names, j), F.lit("="), F.trim(c))))
        return F.concat(F.lit("- "), F.trim(F.get(x["r"], F.lit(0))), F.lit(" -> "), F.array_join(F.array_compact(pairs), " ; "))

    return F.transform(chosen, line)


def enriched(markdown: Column, headers: Column, cells: Column) -> Column:
    """A table's markdown with its column headers and row map below, where there are rows for one."""
    lines = row_map(headers, cells)
    more = F.concat(F.lit("\nColumn headers: "), F.array_join(headers, " | "), F.lit("\nRow map:\n"), F.array_join(lines, "\n"), F.lit("\n"))
    return F.when(F.size(lines) > 0, F.concat(F.rtrim(markdown), more)).otherwise(markdown)
