"""Pages, lists and JSON out of loose values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def unique(values: Column) -> Column:
    """Distinct values, the first of each, in their order."""
    return F.array_distinct(values)


def pages_from_span(start: Column, end: Column) -> Column:
    """All pages of a span; a reversed one counts the other way round."""
    return F.when(start.isNotNull() & end.isNotNull(), F.sequence(F.least(start, end), F.greatest(start, end)))


def page_structs(pages: Column) -> Column:
    return F.transform(pages, lambda p: F.struct(p.alias("element")))


def int_if_whole(text: Column) -> Column:
    """Whole numbers out of text such as '3', '3.0' or ' 3 '; else null."""
    t = F.trim(text)
    return F.when(F.rlike(t, F.lit(r"^[-+]?[0-9]+(\.0+)?$")), F.regexp_extract(t, r"^([-+]?[0-9]+)", 1).try_cast("int"))


def pages_list(text: Column, sort: bool = False) -> Column:
    """Pages out of '3', '[3, 5]' or '[{"element": 3}]'; what is no number is left out."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), 0), int_if_whole)
    kept = F.array_compact(found)
    return F.array_sort(F.array_distinct(kept)) if sort else kept


def first_json_object(text: Column) -> Column:
    """The first balanced {...} of a text; braces in strings don't count."""
    chars = F.split(F.substring(text, F.locate("{", F.coalesce(text, F.lit(""))), F.length(text)), "")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        n = a["n"] + 1
        escaped = a["quoted"] & ~a["escaped"] & (c == "\\")
        quoted = F.when((c == '"') & ~a["escaped"], ~a["quoted"]).otherwise(a["quoted"])
        depth = a["depth"] + F.when(~a["quoted"] & (c == "{"), 1).when(~a["quoted"] & (c == "}"), -1).otherwise(0)
        end = F.when((a["end"] == 0) & (depth == 0) & ~a["quoted"] & (c == "}"), n).otherwise(a["end"])
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), n.alias("n"), end.alias("end"))

    def cut(a: Column) -> Column:
        return F.when(a["end"] > 0, F.array_join(F.slice(chars, F.lit(1), a["end"]), ""))

    return F.when(F.contains(text, F.lit("{")), F.aggregate(chars, zero, step, cut))


def parse_extraction(raw: Column) -> Column:
    """struct(answer, evidence_span, ok): the first JSON object, with exactly these keys, strings or null."""

    def of(body: Column) -> Column:
        keys = F.array_sort(F.json_object_keys(body))
        parsed = F.from_json(body, "answer string, evidence_span string")
        plain = lambda name: F.rlike(body, F.lit(rf'"{name}"\s*:\s*("|null)'))
        ok = F.coalesce((keys == F.array(F.lit("answer"), F.lit("evidence_span"))) & plain("answer") & plain("evidence_span"), F.lit(False))
        return F.struct(F.when(ok, parsed["answer"]).alias("answer"), F.when(ok, parsed["evidence_span"]).alias("evidence_span"), ok.alias("ok"))

    return let(first_json_object(raw), of)


def parse_generation(raw: Column) -> Column:
    """struct(answer, citations): JSON, else JSON in a code fence, else the text itself."""
    schema = "answer string, citations array<struct<chunk_id:string,page:string>>"
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    direct, inner = F.from_json(F.trim(raw), schema), F.from_json(fenced, schema)
    none = F.array().cast("array<struct<chunk_id:string,page:string>>")
    answer = F.coalesce(direct["answer"], inner["answer"], F.trim(raw))
    return F.struct(answer.alias("answer"), F.coalesce(direct["citations"], inner["citations"], none).alias("citations"))


def citations_in(answer: Column) -> Column:
    """Distinct struct(chunk_id, page) of '[id, p. 3]', '(id p3)' and 'id:page 3' marks, in that order."""
    chunk, out = r"([A-Za-z0-9_:\-]*p[0-9]{4}[A-Za-z0-9_:\-]*)", []
    for pattern in (rf"\[{chunk}\s*,\s*p(?:age)?\.?\s*([0-9]+)\]", rf"\({chunk}\s+p(?:age)?\.?\s*([0-9]+)\)", rf"{chunk}\s*:\s*page\s*([0-9]+)"):
        ids, pages = (F.regexp_extract_all(answer, F.lit(pattern), g) for g in (1, 2))
        out.append(F.zip_with(ids, pages, lambda i, p: F.struct(i.alias("chunk_id"), p.try_cast("int").alias("page"))))
    return F.array_distinct(F.concat(*out))


def is_query_id(value: Column) -> Column:
    return F.rlike(value, F.lit("^[A-Za-z0-9][A-Za-z0-9_.-]*$"))


def query_id_parts(value: Column) -> Column:
    """struct(prefix, number) of 'name-12' or 'name_12'."""
    pattern = "^(.*?)[-_]?([0-9]+)$"
    return F.when(F.rlike(value, F.lit(pattern)), F.struct(F.regexp_extract(value, pattern, 1).alias("prefix"), F.regexp_extract(value, pattern, 2).try_cast("int").alias("number")))
