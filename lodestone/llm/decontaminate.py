"""Benchmark decontamination: a prefix-filtered join of shingle sets.

A benchmark item is cut into windows of 13 words (all of it where it has fewer). A
window's shingles are the hashes of four words in a row (of all its words where it
has fewer than four). A document that holds a window holds each of its shingles, so
one is enough to find it: the rarest. Shingles are ordered by how often they come in
the benchmark, then by their length in letters, the longer first, then by hash.

Texts are read once, for all sizes of shingles. Positions whose shingle may be some
window's rarest (a Bloom filter sized by the benchmark tells; none beyond about a million
windows, then every position is carried) carry the words around them into a join by
shingle. Length and position say where the window would have to lie, and its words are
compared there. What is shuffled are those positions, never texts.

All of it is DataFrame functions.

Defined results: null and empty texts have no words and no hits; so have items without
words. Items with a null id count for hits, not for the items listed. Repeated documents
are judged one by one; repeated items count once. Texts are read whole. An empty
benchmark contaminates nothing. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import fresh, let, materialize, number_rows, scratch, without_rows, word_line

SHINGLE = 4


def _words(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def _shingles(hashes: Column, size: int) -> Column:
    """Hashes of `size` words in a row, by the position of the first."""
    last = F.size(hashes) - size
    one = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))))
    return F.when(last >= 0, one).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct (item_id, window, n): each item's windows as lines of n words."""
    words = benchmark.select("item_id", _words(word_line(F.col("text"))).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - width, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("words", i + 1, width), " "))
    out = words.select("item_id", F.least(F.size("words"), F.lit(width)).alias("n"), F.explode(cut).alias("window"))
    return out.distinct()


def rarest_shingles(windows: DataFrame, size: int) -> DataFrame:
    """For each window the shingle to look for: (shingle, at, window, n)."""
    words = F.split("window", " ")
    hashed = windows.select("window", "n", words.alias("words"), F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    letters = F.length(F.array_join(F.slice("words", F.col("at") + 1, size), ""))
    each = hashed.select("window", "n", "words", F.posexplode(_shingles(F.col("hashes"), size)).alias("at", "shingle")).select("window", "n", "at", "shingle", letters.alias("letters"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    order = F.struct("often", -F.col("letters"), "shingle", "at")
    return each.join(often, "shingle").groupBy("window", "n").agg(F.min_by(F.struct("shingle", "at"), order).alias("x")).select("x.shingle", "x.at", "window", "n")


def _looked_at(needed: DataFrame, sizes: list[int], width: int):
    """A function from a text's words to the places whose shingle may be needed, each with the words around it."""
    bits = bloom.build(needed, "shingle")

    def likely(words: Column) -> Column:
        def around(i: Column, s: Column) -> Column:
            first = F.greatest(i - width + 1, F.lit(0))
            return F.struct(s.alias("shingle"), i.alias("place"), first.alias("first"), F.slice(words, first + 1, 2 * width).alias("near"))

        def passing(shingles: Column) -> Column:
            marked = F.transform(shingles, lambda s, i: F.when(bits.may_contain(s), i))
            return F.transform(F.filter(marked, lambda i: i.isNotNull()), lambda i: around(i, F.get(shingles, i)))

        def of_sizes(hashes: Column) -> Column:
            return F.concat(*(let(_shingles(hashes, size), passing) for size in sizes))

        return F.struct(F.size(words).cast("bigint").alias("n_words"), let(F.transform(words, lambda w: F.xxhash64(w)), of_sizes).alias("likely"))

    return likely


def _hits(read: DataFrame, needed: DataFrame) -> DataFrame:
    """Places of documents where a window's words stand: (_row, start, n, window)."""
    exact = read.select("_row", F.explode("read.likely").alias("x")).select("_row", "x.*").join(needed, "shingle")
    start = F.col("place") - F.col("at")
    inside = start - F.col("first")
    fits = (start >= 0) & (inside + F.col("n") <= F.size("near"))
    same = F.array_join(F.slice("near", F.greatest(inside, F.lit(0)) + 1, F.col("n")), " ") == F.col("window")
    return exact.where(fits & same).select("_row", start.alias("start"), "n", "window")


def _union_length(places: Column) -> Column:
    """How many words the intervals (start, n) cover together."""
    return F.aggregate(
        F.array_sort(places), F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("hit")),
        lambda acc, p: F.struct(
            F.greatest(acc["end"], p["start"] + p["n"]).alias("end"),
            (acc["hit"] + F.greatest(p["start"] + p["n"] - F.greatest(acc["end"], p["start"]), F.lit(0))).alias("hit"),
        ),
        lambda acc: acc["hit"],
    )


def _judge(numbered: DataFrame, row: str, benchmark: DataFrame, width: int, keep: bool) -> tuple[DataFrame, DataFrame | None]:
    """What one reading of the texts gives, and what is hit: (_row, hit, longest, ids); None without any window.

    The first has the columns of `numbered` but for text, under `doc`, besides _row and `read`.
    """
    windows = item_windows(benchmark, width)
    distinct = windows.select("window", "n").distinct()
    sizes = [r["s"] for r in distinct.select(F.least("n", F.lit(SHINGLE)).alias("s")).distinct().orderBy("s").collect()]
    other = F.struct(*(c for c in numbered.columns if c not in ("text", row)), F.lit(0).alias(fresh(numbered, "_none")))
    words = _words(word_line(F.col("text")))
    if not sizes:
        return numbered.select(F.col(row).alias("_row"), other.alias("doc"), F.struct(F.size(words).cast("bigint").alias("n_words")).alias("read")), None
    needed = None
    for size in sizes:
        own = rarest_shingles(distinct.where(F.least("n", F.lit(SHINGLE)) == size), size)
        needed = own if needed is None else needed.unionByName(own)
    needed = materialize(needed, "prefixes", keep=keep)
    likely = _looked_at(needed, sizes, width)
    read = materialize(numbered.select(F.col(row).alias("_row"), other.alias("doc"), let(words, likely).alias("read")), "read", keep=keep)
    named = _hits(read, needed).join(windows.select("window", F.col("item_id").cast("string").alias("item_id")), "window")
    judged = named.groupBy("_row").agg(
        F.collect_set(F.struct("start", "n")).alias("places"), F.array_sort(F.collect_set("item_id")).alias("ids"), F.max("n").alias("longest")
    )
    return read, judged.select("_row", _union_length(F.col("places")).alias("hit"), "longest", "ids")


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """`docs` without the texts, with n_words, n_hit, item_ids (sorted strings) and contaminated.

    A document is contaminated if at least one word in `share` of its words is hit.
    """
    row = fresh(docs, "_row")
    names = {n: fresh(docs, n) for n in ("n_words", "n_hit", "item_ids", "contaminated")}
    read, judged = _judge(number_rows(docs, row), row, benchmark, width, True)
    none, no_ids = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    own = [F.col("doc")[c].alias(c) for c in docs.columns if c != "text"] + [F.col("read.n_words").alias(names["n_words"])]
    if judged is None:
        return read.select(*own, none.alias(names["n_hit"]), no_ids.alias(names["item_ids"]), F.lit(False).alias(names["contaminated"]))
    hit = F.coalesce(F.col("hit"), none)
    return read.join(judged, "_row", "left").select(
        *own, hit.alias(names["n_hit"]), F.coalesce("ids", no_ids).alias(names["item_ids"]),
        ((hit > 0) & (share * hit >= F.col("read.n_words"))).alias(names["contaminated"]),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The documents without a benchmark passage, with the columns of `docs`.

    A document goes if it holds a window of `width` words. Windows of shorter items may be
    a common phrase: those count by the share of words that all hits make up.
    """
    row = fresh(docs, "_row")
    numbered = number_rows(docs, row)
    with scratch(docs.sparkSession):
        read, judged = _judge(numbered.select(row, "text"), row, benchmark, width, False)
        if judged is None:
            return docs
        met = read.select("_row", "read.n_words").join(judged, "_row")
        gone = met.where((F.col("longest") == width) | (share * F.col("hit") >= F.col("n_words"))).select("_row")
        gone = materialize(gone, "gone", keep=True)
    return without_rows(numbered, row, gone).select(*docs.columns)
