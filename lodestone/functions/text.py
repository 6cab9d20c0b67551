"""Text functions: Columns in, Columns out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lex


def let(value: Column, body) -> Column:
    """`body(value)`, with the value computed once for a row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, needles) -> Column:
    return _any(*(F.contains(text, F.lit(n)) for n in needles))


def in_map(token: Column, mapping: dict[str, str]) -> Column:
    """What `mapping` has for a token, else the token."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, token), token)


def normalize_line(s: Column) -> Column:
    """White space, Unicode's too, collapsed to single spaces; none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normalize_page_text(s: Column) -> Column:
    """A page as one clean line: line ends, invisible characters, ligatures and bullets."""
    out = F.replace(s, F.lit("\r"), F.lit("\n"))
    out = F.translate(out, "­￾" + "".join(lex.ZERO_WIDTH), "")
    out = F.replace(out, F.lit("\xa0"), F.lit(" "))
    for ligature, letters in lex.LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    for bullet in "•▶":
        out = F.replace(out, F.lit(bullet), F.lit("- "))
    return normalize_line(out)


def find_text_artifacts(s: Column) -> Column:
    """How many soft hyphens, zero-width characters and ligatures are left."""
    return F.struct(
        F.regexp_count(s, F.lit("­")).alias("soft_hyphen"),
        F.regexp_count(s, F.lit("[" + "".join(lex.ZERO_WIDTH) + "]")).alias("zero_width"),
        F.regexp_count(s, F.lit("[" + "".join(lex.LIGATURES) + "]")).alias("ligature"),
    )


def dehyphenate(lines: Column) -> Column:
    """Lines where one that ends in '-' takes in a next one that begins with a lower-case letter."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        joins = F.endswith(acc["open"], F.lit("-")) & F.rlike(F.ltrim(line), F.lit(r"^\p{Ll}"))
        merged = F.concat(F.left(acc["open"], F.length(acc["open"]) - 1), F.ltrim(line))
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), line.alias("open")))
            .when(joins, F.struct(F.concat(acc["done"], F.array(merged)).alias("done"), F.lit(None).cast("string").alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), line.alias("open")))
        )

    return F.aggregate(lines, zero, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def year_from_name(name: Column) -> Column:
    """'2022-2023' or '2022' out of a file name; null without a year."""
    years = F.regexp_extract_all(name, F.lit("((?:19|20)[0-9]{2})"), 1)
    return F.when(F.size(years) >= 2, F.concat_ws("-", F.get(years, F.lit(0)), F.get(years, F.lit(1)))).when(F.size(years) == 1, F.get(years, F.lit(0)))


def _first(text: Column, pattern: str, build) -> Column:
    """`build` of a pattern's groups, null where it doesn't match."""
    return F.when(F.rlike(text, F.lit(pattern)), build(lambda g: F.regexp_extract(text, pattern, g)))


def year_range_from_text(text: Column) -> Column:
    t = F.translate(normalize_line(text), "–—", "--")
    year = r"((?:19|20)[0-9]{2})"
    return F.coalesce(
        _first(t, rf"\b{year}\s*[-/]\s*([0-9]{{2}})\b", lambda g: F.concat_ws("-", g(1), g(2))),
        _first(t, rf"\b{year}\s*-\s*{year}\b", lambda g: F.concat_ws("-", g(1), g(2))),
        _first(t, rf"\b{year}\s*(?:to|TO)\s*{year}\b", lambda g: F.concat_ws("-", g(1), g(2))),
    )


def period_end_date(text: Column) -> Column:
    """ISO date out of 'period ended 31 March 2023'; null for a date that doesn't exist."""
    pattern = r"(?i)\bperiod\s+ended\s+([0-9]{1,2})\s+([A-Za-z]+)\s+((?:19|20)[0-9]{2})\b"
    t = normalize_line(text)
    months = F.create_map(*(x for i, m in enumerate(lex.MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))))
    month = F.try_element_at(months, F.lower(F.regexp_extract(t, pattern, 2)))
    day = F.lpad(F.regexp_extract(t, pattern, 1), 2, "0")
    iso = F.concat_ws("-", F.regexp_extract(t, pattern, 3), month, day)
    return F.when(F.rlike(t, F.lit(pattern)) & month.isNotNull(), F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))


def tokenize(text: Column, hyphens: bool = True) -> Column:
    """Tokens for BM25."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]{1,}" if hyphens else "[a-z0-9][a-z0-9]{1,}"), 0)


def rerank_normalize(text: Column) -> Column:
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.replace(F.lower(stripped), F.lit("’"), F.lit("'")), r"(?U)\s+", " ")


def normalize_token(token: Column) -> Column:
    """A token's canonical form without its plural ending."""
    t = in_map(token, lex.CANONICAL)
    n = F.length(t)
    stem = (
        F.when(F.endswith(t, F.lit("ies")) & (n > 4), F.concat(F.left(t, n - 3), F.lit("y")))
        .when(F.endswith(t, F.lit("es")) & (n > 4) & ~F.endswith(t, F.lit("ses")), F.left(t, n - 2))
        .when(F.endswith(t, F.lit("s")) & (n > 3) & ~F.endswith(t, F.lit("ss")), F.left(t, n - 1))
        .otherwise(t)
    )
    return in_map(stem, lex.CANONICAL)


def normalized_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(rerank_normalize(text), F.lit(r"[a-z0-9][a-z0-9'%\-]{1,}"), 0), normalize_token)


def query_entities(question: Column) -> Column:
    """Distinct tokens of a question that can be looked for, in their order."""
    def wanted(t: Column) -> Column:
        return (F.length(t) >= 2) & ~t.isin(*lex.STOPWORDS) & ~(F.rlike(t, F.lit("^[0-9]+$")) & (F.length(t) < 3))

    return F.array_distinct(F.filter(normalized_tokens(question), wanted))


def is_numeric_question(question: Column) -> Column:
    q = rerank_normalize(question)
    return (
        contains_any(q, lex.NUMERIC_PHRASES)
        | F.rlike(q, F.lit(r"\bq[1-4]\b"))
        | contains_any(q, "%£")
        | F.arrays_overlap(F.concat(normalized_tokens(q), F.array(F.lit(""))), F.array(*map(F.lit, lex.NUMERIC_TOKENS)))
    )


def numeric_density(text: Column) -> Column:
    """The share of number-like tokens."""
    tokens = F.regexp_extract_all(rerank_normalize(text), F.lit("[a-z0-9.,%-]+"), 0)
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.rlike(t, F.lit("[0-9]")))) / F.size(tokens)).otherwise(F.lit(0.0))


def is_search_hit_question(question: Column) -> Column:
    return F.rlike(rerank_normalize(question), F.lit(r"\b(?:integration\s+joint\s+boards?|ijbs?)\b"))


def quarter(text: Column) -> Column:
    """The first of q1 to q4 that a text names."""
    t, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(None).cast("string")
    for q in ("q4", "q3", "q2", "q1"):
        out = F.when(F.contains(t, F.lit(q)), q).otherwise(out)
    return out


def normalize_key(text: Column) -> Column:
    """snake_case."""
    t = F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_title(text: Column) -> Column:
    """A contents title for comparison."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "–—’‘", "--''")
    return normalize_line(F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " "))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Jaccard of the word sets of two titles."""
    x, y = (F.array_distinct(F.filter(F.split(normalize_title(t), " "), lambda w: w != "")) for t in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def embedding_text(section: Column, subsection: Column, text: Column, is_table: Column) -> Column:
    """What an encoder gets: section, subsection unless a table, and text."""
    def known(x: Column) -> Column:
        return F.when((F.trim(x) != "") & (F.lower(F.trim(x)) != "unknown"), F.trim(x))

    return F.concat_ws("\n", known(section), F.when(~F.coalesce(is_table, F.lit(False)), known(subsection)), text)


def snippet(text: Column, most: int = 280) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit(" ..."))).otherwise(text)


def shared_suffix_prefix(a: Column, b: Column) -> Column:
    """The most tokens that end one array and begin the other."""
    most = F.least(F.size(a), F.size(b))
    fits = F.filter(F.when(most > 0, F.sequence(F.lit(1), most)), lambda k: F.slice(a, F.size(a) - k + 1, k) == F.slice(b, F.lit(1), k))
    return F.coalesce(F.array_max(fits), F.lit(0))


def trust_of(doc_id: Column, names: dict[str, str]) -> Column:
    """A document's owner by the longest known start of its id, else 'NHS ' and the id's first part."""
    base = F.initcap(F.regexp_replace(F.regexp_extract(doc_id, "^([A-Za-z_ ]+)", 1), "[_ ]+$", ""))
    out = F.concat(F.lit("NHS "), base)
    for prefix in sorted(names, key=len):
        out = F.when(F.startswith(F.lower(doc_id), F.lit(prefix.lower())), names[prefix]).otherwise(out)
    return out


def route(question: Column) -> Column:
    """Intent of a question, with confidence and hints; the first rule that fits."""
    q = F.lower(normalize_line(F.coalesce(question, F.lit(""))))

    def has(*needles: str) -> Column:
        return contains_any(q, needles)

    def struct(intent: str, confidence: float, rows: Column | None = None, columns: Column | None = None, percent: Column | None = None, hint: str | None = None) -> Column:
        none = F.array().cast("array<string>")
        return F.struct(
            F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"), (rows if rows is not None else none).alias("row_terms"),
            (columns if columns is not None else none).alias("column_terms"), quarter(q).alias("quarter"),
            (percent if percent is not None else F.lit(False)).alias("prefer_percent"), F.lit(hint).cast("string").alias("table_type_hint"),
        )

    def terms(*words: str) -> Column:
        return F.array(*map(F.lit, words))

    staff = (
        F.when(has("pension"), terms("pension_cost", "pension")).when(has("remuneration"), terms("total_remuneration", "remuneration"))
        .when(has("total") & has("staff") & has("cost"), terms("total_staff_costs", "staff_costs")).otherwise(terms("staff_costs", "employee_benefit", "remuneration"))
    )
    rows = terms("total_emissions", "emissions")
    for needle, found in (("total emission", ("total_emissions",)), ("medical gas", ("medical_gases",)), ("business travel", ("business_travel",)), ("fleet", ("nhs_fleet_travel", "fleet_travel")), ("water", ("water",)), ("waste", ("waste",)), ("building energy", ("building_energy",))):
        rows = F.when(has(needle), terms(*found)).otherwise(rows)
    columns = F.array_compact(F.array(F.when(has("target"), "target emissions"), F.when(has("change"), "percentage change"), F.when(has("difference"), "percentage difference")))
    endorse = has("endorse") & (has("risk appetite") | has("strategic risk profile"))
    return (
        F.when(has("significant") & has("delay"), struct("table_metric_significant_delay", 0.95, terms("significant_delay")))
        .when(has("on track"), struct("table_metric_on_track", 0.95, terms("on_track")))
        .when(has("proportion") & has("complete"), struct("table_metric_complete_ratio", 0.9, terms("complete"), percent=F.lit(True)))
        .when(has(*lex.STAFF_COSTS), struct("table_metric_staff_costs", 0.85, staff, hint="staff_costs"))
        .when(has(*lex.EMISSIONS), struct("table_metric_emissions", 0.8, rows, columns, has("percent"), "unknown"))
        .when(has(*lex.FINANCIAL_TARGETS), struct("table_metric_financial_targets", 0.85, hint="financial_targets"))
        .when(has(*lex.FINANCIAL_STATEMENTS), struct("table_metric_financial_statements", 0.8, hint="income_statement"))
        .when(has(*lex.PERFORMANCE), struct("table_metric_performance", 0.8, percent=has("percent", "rate")))
        .when(has("board committee") & has("strategic risk register"), struct("governance_board_committee", 0.85))
        .when(endorse & has("risk appetite") & has("strategic risk profile"), struct("governance_endorsements", 0.9))
        .when(endorse, struct("governance_endorsements", 0.8))
        .when(has("significant issue") & has("accountable officer"), struct("governance_significant_issue", 0.85))
        .otherwise(struct("unknown", 0.5))
    )


def rewrites(question: Column) -> Column:
    """Variants of a question: with synonyms, and with a hint of the table it is about."""
    trimmed, lower, expanded = F.trim(question), F.lower(question), question
    for term, added in lex.SYNONYMS.items():
        expanded = F.when(F.contains(lower, F.lit(term)), F.concat(expanded, F.lit(f" ({added})"))).otherwise(expanded)
    intent = route(question)["intent"]
    hint = (
        F.when(intent == "table_metric_staff_costs", F.concat(trimmed, F.lit(" in staff cost table (employee benefits, pension, remuneration)")))
        .when(intent == "table_metric_emissions", F.concat(trimmed, F.lit(" in emissions table (target emissions, percentage change)")))
        .when(F.startswith(intent, F.lit("table_metric_")), F.concat(trimmed, F.lit(" in performance table by quarter")))
    )
    return F.array_compact(F.array(F.when(expanded != question, F.trim(expanded)), hint))


def distinct_variants(variants: Column) -> Column:
    """The first of variants that differ in case only, in their order."""
    trimmed = F.filter(F.transform(variants, lambda v: F.trim(v)), lambda v: v != "")
    return F.filter(trimmed, lambda v, i: ~F.exists(F.slice(trimmed, F.lit(1), i), lambda w: F.lower(w) == F.lower(v)))
