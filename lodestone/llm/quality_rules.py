"""Quality rules: fixed limits, and divergence from references of languages.

Two histograms of a document are compared with references by Jensen-Shannon
distance (base 2, so 0 to 1): one of character classes, one of a language's common
words and all other words. Each counts only from a least length on. The language is
the one whose three most common words occur most often in the text itself, the
first listed of equals.

All of it is DataFrame functions over one row at a time; there is no shuffle.

Defined results: null and empty texts have no words, and fail for being too short.
Texts are read whole. Repeated rows, null keys and extra columns pass through.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

#: Character classes and their usual shares in running text of any of the languages.
CLASSES = ("lower", "upper", "digit", "space", "stop", "other")
CLASS_SHARES = (0.79, 0.025, 0.01, 0.155, 0.019, 0.001)

#: Common words, the most common first, and how often each comes in 1000 words.
COMMON = {
    "en": (("the", 62), ("of", 32), ("and", 28), ("to", 26), ("in", 21), ("a", 21), ("is", 10), ("that", 11), ("for", 9), ("it", 9), ("was", 9), ("with", 7), ("as", 7), ("on", 7), ("be", 6), ("by", 5), ("are", 5), ("this", 5)),
    "fr": (("de", 60), ("la", 35), ("le", 30), ("et", 25), ("les", 24), ("des", 20), ("en", 17), ("un", 14), ("du", 14), ("une", 12), ("que", 12), ("est", 11), ("pour", 9), ("qui", 9), ("dans", 9), ("sur", 7), ("par", 7), ("au", 6)),
    "de": (("der", 38), ("die", 37), ("und", 30), ("in", 19), ("den", 15), ("von", 12), ("zu", 11), ("das", 11), ("mit", 10), ("ist", 9), ("des", 9), ("im", 9), ("dem", 8), ("auf", 8), ("eine", 7), ("ein", 7), ("nicht", 7), ("als", 6)),
    "es": (("de", 62), ("la", 39), ("que", 31), ("el", 29), ("en", 27), ("y", 26), ("a", 21), ("los", 17), ("se", 14), ("del", 13), ("las", 11), ("un", 10), ("por", 10), ("con", 9), ("una", 9), ("no", 9), ("para", 8), ("su", 8)),
}


class Limits(NamedTuple):
    """Guards and largest distances. A document below a guard isn't judged by that histogram."""

    least_chars: int = 200
    class_distance: float = 0.35
    least_words: int = 50
    word_distance: float = 0.6


def _term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares of the same size."""
    parts = F.zip_with(p, q, lambda a, b: (_term(a, (a + b) / 2) + _term(b, (a + b) / 2)) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, F.lit(pattern), F.lit("")))


def class_counts(text: Column, spaces: Column) -> Column:
    """Code points of each of CLASSES, given those of white space; what is in none of the others is other."""
    total = F.length(text)
    known = {name: total - _without(text, pattern) for name, pattern in (("lower", r"\p{Ll}+"), ("upper", r"\p{Lu}+"), ("digit", "[0-9]+"), ("stop", r"[.,;:!?'\"()-]+"))}
    five = F.array(*(spaces if name == "space" else known[name] for name in CLASSES[:-1]))
    return let(five, lambda c: F.concat(c, F.array(total - F.aggregate(c, F.lit(0), lambda acc, x: acc + x))))


def _shares(counts: Column) -> Column:
    def of(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        return let(total, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

    return let(counts, of)


def _languages() -> Column:
    rows = []
    for words in COMMON.values():
        shares = [n / 1000 for _, n in words]
        rows.append(F.struct(
            F.array(*(F.lit(w) for w, _ in words)).alias("words"),
            F.array(*map(F.lit, [*shares, 1 - sum(shares)])).alias("shares"),
        ))
    return F.array(*rows)


def _common_words(line: Column) -> Column:
    """The words of any language's list that a line has, in their order, a space before and one behind each."""
    known = sorted({w for words in COMMON.values() for w, _ in words})
    words = F.split(F.regexp_replace(F.lower(line), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " ")
    return F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: w.isin(*known)), "  "), F.lit(" "))


def _occurrences(spaced: Column, word: Column) -> Column:
    """Of a word in a line whose words have a space before and one behind each."""
    held = F.concat(F.lit(" "), word, F.lit(" "))
    return ((F.length(spaced) - F.length(F.replace(spaced, held, F.lit("")))) / F.length(held)).cast("bigint")


def repeated_words(words: Column, width: int) -> list[tuple[str, Column]]:
    """Steps that lead to the number of words in windows found twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Only texts that have a
    repeated window sort theirs.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    last = F.size(words) - width
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(F.col("_hashes"), i + k) for k in range(width)))))
    ordered = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )

    def twin(x: Column, j: Column) -> Column:
        near = [F.get(F.col("_ordered"), j + d)["h"] for d in (-1, 1)]
        return F.when((near[1] == x["h"]) | ((j > 0) & (near[0] == x["h"])), x["i"])

    # get() of a negative index is null, so the first has no twin before it
    starts = F.array_sort(F.filter(F.transform("_ordered", twin), lambda i: i.isNotNull()))
    covered = F.aggregate(
        F.col("_starts"), F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, i: F.struct((i + width).alias("end"), (acc["n"] + i + width - F.greatest(acc["end"], i)).alias("n")),
        lambda acc: acc["n"],
    )
    return [("_hashes", hashes), ("_windows", windows), ("_ordered", ordered), ("_starts", starts), ("_covered", F.coalesce(covered, F.lit(0)))]


def quality_measures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each of `docs`, with its columns in `_doc` and the measures beside it.

    Measures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint),
    class_distance and word_distance (null below the guards), base_failed, kept.
    """
    text = F.coalesce(F.col("_doc")["text"], F.lit(""))
    out = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    squeezed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    out = out.withColumn("_text", text).withColumn("_squeezed", squeezed)
    out = out.withColumn("_words", F.when(F.col("_squeezed") == "", F.array().cast("array<string>")).otherwise(F.split("_squeezed", " ")))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_lines", lines).withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": (F.length("_squeezed") - F.greatest(F.size("_words") - 1, F.lit(0))).cast("bigint"),
        "n_symbols": (F.length("_text") - _without(F.col("_text"), r"[#*$%&|<>]+")).cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_common": _common_words(F.col("_squeezed")),
    })
    out = out.withColumn("_classes", _shares(class_counts(F.col("_text"), (F.length("_text") - F.col("word_chars")).cast("int"))))
    for name, column in repeated_words(F.col("_words"), 8):
        out = out.withColumn(name, column)

    def hits(language: Column) -> Column:
        first = F.slice(language["words"], 1, 3)
        return F.aggregate(first, F.lit(0).cast("bigint"), lambda acc, w: acc + _occurrences(F.col("_common"), w))

    ranked = F.array_sort(F.transform(_languages(), lambda x, i: F.struct((-hits(x)).alias("less"), i.alias("i"), x.alias("x"))))
    out = out.withColumn("_language", F.when(F.col("n_words") >= limits.least_words, F.get(ranked, F.lit(0))["x"]))
    found = F.transform(F.col("_language")["words"], lambda w: _occurrences(F.col("_common"), w))
    out = out.withColumn("_found", found)
    others = F.greatest(F.col("n_words") - F.aggregate("_found", F.lit(0).cast("bigint"), lambda acc, x: acc + x), F.lit(0).cast("bigint"))
    out = out.withColumn("_shares", _shares(F.concat("_found", F.array(others))))
    reference = F.array(*map(F.lit, CLASS_SHARES))
    failed = (F.col("n_words") < 20) | (100 * F.col("_covered") > 30 * F.col("n_words"))
    far = F.coalesce(F.col("class_distance") > limits.class_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > limits.word_distance, F.lit(False))
    return (
        out.withColumn("class_distance", F.when(F.length("_text") >= limits.least_chars, js_distance(F.col("_classes"), reference)))
        .withColumn("word_distance", F.when(F.col("n_words") >= limits.least_words, js_distance(F.col("_shares"), F.col("_language")["shares"])))
        .select("_doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("_covered").alias("n_repeat_words"), "class_distance", "word_distance", failed.alias("base_failed"), (~failed & ~far).alias("kept"))
    )


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass all rules, with the columns of `docs`."""
    # with the row number beside it, the filter isn't evaluated below, on the texts again
    judged = quality_measures(docs, limits).withColumn("_row", F.monotonically_increasing_id())
    judged = judged.where((F.col("_row") >= 0) & F.col("kept"))
    return judged.select(*(F.col("_doc")[c].alias(c) for c in docs.columns))
