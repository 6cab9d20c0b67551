"""Repeated strings: maximal repeats of at least `length` bytes, all their occurrences.

A suffix array of the whole corpus would be one sort of every byte. Here it is a
sparse one, in pieces. A string of `length` bytes holds length - gram + 1 grams; the
one with the least hash (the leftmost of equals) is its anchor, so equal strings have
the same anchor at the same place. Texts are reduced to their anchors, one in about
120 bytes. Anchors of a hash that comes once are dropped: nothing is repeated there.

What is left is grouped by hash. The bytes around an anchor, as far as a string of
`length` bytes can reach, are its context; equal contexts collapse into a class. In a
group of several classes, the contexts' parts from the anchor on form an enhanced
suffix array (sorted, with longest common prefixes). A stack scan visits its
common-prefix intervals from the deepest up; where intervals join, occurrences of
different branches are compared in the order of their parts before the anchor, read
backwards, so each meets the one that extends furthest to the left among those that
first diverge there to the right. Extension left and prefix together of at least
`length` bytes make a repeat of both.

A group of more than `group` classes is first split into halves, and what is still as
large into bands. Two contexts whose
extensions make up a repeat agree in at least one of a few strings around the anchor,
each nearly as long as the repeat; so classes are grouped anew by each of those, which
leaves those alone that share but a common line. A band's group of more than
`band_group` classes isn't gathered: its contexts' strings of `length` bytes in that
band are counted by hash, in a distributed way with partial sums. All three give the
same result.

Defined results: null and empty texts, and those shorter than `length` bytes, have no
repeat. Matches don't cross texts. Copies of a text are removed in all places, the
first included. Rows are judged as places of their own, whatever their keys; extra
columns pass through. An empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import discard, free_memory, fresh, materialize, number_rows, scratch, ship_by_value

ship_by_value(__name__)


class Settings(NamedTuple):
    length: int = 400
    gram: int = 100
    group: int = 2000
    bands: int = 6
    band_group: int = 20_000
    across: bool = False


#: For passages of more than `PASSAGE_WORDS` words that other rows have too; those of under 240 bytes aren't looked for.
PASSAGES = Settings(length=240, gram=60, group=20_000, across=True)
PASSAGE_WORDS = 50


#: Bytes handled at once, unless a single text is longer.
BLOCK = 1 << 18
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.bytes = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(_ODD, -1, 1 << 64)
            for name, base in (("up", _ODD), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, s: Settings, powers: Powers) -> tuple[np.ndarray, ...]:
    """Of texts `data[bounds[i]:bounds[i + 1]]`: each anchor's text, place, hash, context's hash, bytes before and behind."""
    empty = tuple(np.empty(0, np.int64) for _ in range(6))
    if len(data) < s.length:
        return empty
    powers.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(powers.bytes[data] * powers.up[: len(data)], out=sums[1:])
    grams = _mix((sums[s.gram :] - sums[: -s.gram]) * powers.down[: len(data) - s.gram + 1])
    # the hash's high bits, then the place: the least is the leftmost of the least hash
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    keys = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least(keys, s.length - s.gram + 1)
    inside = np.zeros(len(least) + 1, np.int64)
    sizes = np.diff(bounds)
    for a, n in zip(bounds[:-1][sizes >= s.length].tolist(), sizes[sizes >= s.length].tolist(), strict=True):
        inside[a] += 1
        inside[a + n - s.length + 1] -= 1
    good = np.cumsum(inside[:-1]) > 0
    marked = np.zeros(len(grams), bool)
    marked[(least[good] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    place = np.flatnonzero(marked)
    if not len(place):
        return empty
    text = np.searchsorted(bounds, place, "right") - 1
    reach = s.length - s.gram
    before = np.minimum(place - bounds[text], reach)
    behind = np.minimum(bounds[text + 1] - place - s.gram, reach)
    a, b = place - before, place + s.gram + behind
    context = (sums[b] - sums[a]) * powers.down[a]
    context = _mix(_mix(context) + before.astype(np.uint64) * np.uint64(1009) + behind.astype(np.uint64) * np.uint64(9176) * np.uint64(_ODD))
    return text, place - bounds[text], grams[place].view(np.int64), context.view(np.int64), before, behind


def find_anchors(texts: DataFrame, s: Settings) -> DataFrame:
    """(row, place, hash, context, before, behind) of rows (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            strings = batch.column(1)
            if strings.null_count:
                strings = strings.fill_null("")
            strings = strings.cast(pa.large_string())
            offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
            raw = strings.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
            rows, at = batch.column(0).to_numpy(), 0
            while at < len(rows):
                to = min(len(rows), max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1))
                text, place, gram, context, before, behind = anchors(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], s, powers)
                if len(text):
                    columns = [rows[at + text], place.astype(np.int32), gram, context, before.astype(np.int32), behind.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "place", "hash", "context", "before", "behind"])
                at = to
        free_memory()

    return texts.mapInArrow(run, "row bigint, place int, hash bigint, context bigint, before int, behind int")


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # equal up to low, different within high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def group_extents(lefts: list[bytes], rights: list[bytes], length: int, owners: list | None = None) -> tuple[list[int], list[int]]:
    """For different contexts of one anchor: how far repeats of `length` bytes reach before and from the anchor; 0 if none.

    `lefts` are read backwards from the anchor; `rights` begin with it. With `owners` (the row of a context
    that only one row has, else None), two contexts of the same owner aren't compared.
    """
    m = len(rights)
    far_left, far_right = [0] * m, [0] * m
    suffixes = sorted(range(m), key=lambda i: rights[i])
    by_left = sorted(range(m), key=lambda i: lefts[i])
    rank = [0] * m
    for r, i in enumerate(by_left):
        rank[i] = r

    def meet(i: int, j: int, depth: int) -> None:
        left = common(lefts[i], lefts[j])
        if left + depth >= length:
            for x in (i, j):
                far_left[x] = max(far_left[x], left)
                far_right[x] = max(far_right[x], depth)

    def join(one: list[int], two: list[int], depth: int) -> list[int]:
        """Two branches of an interval, each as ranks in order; the smaller goes into the larger."""
        if len(one) < len(two):
            one, two = two, one
        for r in two:
            at, i = bisect_left(one, r), by_left[r]
            for near, way in ((at - 1, -1), (at, 1)):
                seen: set = set()
                while 0 <= near < len(one):
                    j = by_left[one[near]]
                    if owners is None or owners[i] is None or owners[j] != owners[i]:
                        meet(j, i, depth)
                        if owners is None or owners[j] is None:
                            break
                        # what lies further off has a nearer one of another owner, once two owners are passed
                        seen.add(owners[j])
                        if len(seen) > 1:
                            break
                    near += way
            one.insert(at, r)
        return one

    stack: list[tuple[int, list[int]]] = []  # depth of the interval with what is below, members
    for p, i in enumerate(suffixes):
        depth = common(rights[suffixes[p - 1]], rights[i]) if p else 0
        # intervals deeper than the prefix shared with this suffix are complete
        while stack and stack[-1][0] > depth:
            d, top = stack.pop()
            below_depth, below = stack.pop()
            stack.append((below_depth, join(below, top, d)))
        stack.append((depth, [rank[i]]))
    while len(stack) > 1:
        d, top = stack.pop()
        below_depth, below = stack.pop()
        stack.append((below_depth, join(below, top, d)))
    return far_left, far_right


def _extents_of_groups(groups: DataFrame, s: Settings) -> DataFrame:
    """(hash, context, left, right) out of rows (hash, members: contexts with their bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for i in range(len(batch)):
                hash_, members = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                lefts = [m["bytes"][: m["before"]][::-1] for m in members]
                rights = [m["bytes"][m["before"] :] for m in members]
                owners = [m["low"] if m["low"] == m["high"] else None for m in members] if s.across else None
                left, right = group_extents(lefts, rights, s.length, owners)
                out += [(hash_, m["context"], a, b) for m, a, b in zip(members, left, right, strict=True) if b]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["hash", "context", "left", "right"])
        free_memory()

    return groups.mapInArrow(run, "hash bigint, context bigint, left int, right int")


def _around(left: Column, size: Column) -> Column:
    """The bytes of a context from `left` before its anchor on."""
    return F.substring(F.col("bytes"), F.col("before") - left + 1, size)


def _in_bands(classes: DataFrame, s: Settings, n: int) -> DataFrame:
    """Classes once for each band whose string they hold, with the string's hashes and the group's size.

    In band b the extension behind the anchor is from b steps on, so the one before it has
    to be more than what the next band would leave.
    """
    reach = s.length - s.gram
    step = -(-reach // n)
    bands = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(max(0, reach - step * (b + 1))).alias("need"), F.lit(step * b).alias("behind")) for b in range(-(-reach // step))))
    held = F.filter(bands, lambda x: (x["need"] <= F.col("before")) & (x["behind"] <= F.col("behind")))
    each = classes.select("hash", "context", "before", "behind", "low", "high", "bytes", F.explode(held).alias("b"))
    string = _around(F.col("b.need"), F.col("b.need") + F.col("b.behind") + s.gram)
    keyed = each.select("hash", "context", "before", "behind", "low", "high", "bytes", F.col("b.band").alias("band"), F.xxhash64(string).alias("b1"), F.xxhash64(F.lit(7), string).alias("b2"))
    key = ["hash", "band", "b1", "b2"]
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("members")).where("members > 1")
    return keyed.join(sizes, key)


def _extents_by_count(members: DataFrame, s: Settings) -> DataFrame:
    """The same for groups of any size: a band's strings of `length` bytes around the anchor, counted by two hashes."""
    reach = s.length - s.gram
    step = -(-reach // s.bands)
    most = F.least(F.col("before"), reach - step * F.col("band"))
    least = F.greatest(F.lit(0), reach - F.col("behind"), reach - step * (F.col("band") + 1))
    lefts = F.when(least <= most, F.sequence(least, most))
    each = members.select("hash", "context", "band", "before", "low", "high", "bytes", F.explode(lefts).alias("left"))
    string = _around(F.col("left"), F.lit(s.length))
    each = each.select("hash", "context", "band", "low", "high", "left", F.xxhash64(string).alias("h1"), F.xxhash64(F.lit(7), string).alias("h2"))
    # with the anchor and its place in the string: one string may hold several anchors
    key = ["hash", "band", "left", "h1", "h2"]
    several = F.min("low") < F.max("high") if s.across else F.count("*") > 1
    often = each.groupBy(*key).agg(several.alias("several")).where("several").select(*key)
    found = each.join(often, key, "left_semi")
    return found.groupBy("hash", "context").agg(F.max("left").alias("left"), (s.length - F.min("left")).cast("int").alias("right"))


def repeated_places(docs: DataFrame, row: str, s: Settings = Settings()) -> DataFrame:
    """(row, spans): for rows with repeats the merged (start, end) of bytes that they cover; `row` is a column of `number_rows`."""
    with scratch(docs.sparkSession):
        return _places(docs, row, s)


def _places(docs: DataFrame, row: str, s: Settings) -> DataFrame:
    texts = docs.select(F.col(row).alias("row"), "text")
    every = materialize(find_anchors(texts, s), "anchors")
    # written, so that both sides of the join are dealt for it and a hot hash can be split
    again = materialize(every.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash"), "again")
    repeated = materialize(every.join(again, "hash"), "repeated")
    discard(every)
    by_class = repeated.groupBy("hash", "context").agg(
        F.count("*").alias("times"), F.min(F.struct("row", "place")).alias("at"), F.max("row").alias("high"), F.first("before").alias("before"), F.first("behind").alias("behind")
    )
    classes = materialize(by_class, "contexts")
    counted = materialize(classes.groupBy("hash").agg(F.count("*").alias("members")).where("members > 1"), "counted")
    different = classes.join(counted, "hash").select("hash", "context", "members", "before", "behind", "high", F.col("at.row").alias("row"), F.col("at.place").alias("place"))
    different = materialize(different, "different")
    likely = texts.where(bloom.build(different.select("row").distinct(), "row").may_contain(F.col("row")))
    bytes_ = F.substring(F.col("text").cast("binary"), F.col("place") - F.col("before") + 1, F.col("before") + F.col("behind") + s.gram)
    held = materialize(different.join(likely, "row").select("hash", "context", "members", "before", "behind", F.col("row").alias("low"), "high", bytes_.alias("bytes")), "bytes")
    gathered = F.collect_list(F.struct("context", "before", "low", "high", "bytes")).alias("members")
    groups = held.where(F.col("members") <= s.group).groupBy("hash").agg(gathered)
    # halves first: they leave most classes of a common line alone
    halves = materialize(_in_bands(held.where(F.col("members") > s.group), s, 2), "halves")
    again = halves.where(F.col("members") > s.group).select("hash", "context", "before", "behind", "low", "high", "bytes").dropDuplicates(["hash", "context"])
    banded = materialize(_in_bands(again, s, s.bands), "bands")
    for part, most in ((halves, s.group), (banded, s.band_group)):
        groups = groups.unionByName(part.where(F.col("members") <= most).groupBy("hash", "band", "b1", "b2").agg(gathered).select("hash", "members"))
    found = _extents_of_groups(groups, s).unionByName(_extents_by_count(banded.where(F.col("members") > s.band_group), s))
    whole = classes.where("at.row < high" if s.across else "times > 1").select("hash", "context", F.col("before").alias("left"), (F.col("behind") + s.gram).alias("right"))
    extents = whole.unionByName(found).groupBy("hash", "context").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    extents = materialize(extents, "extents")
    covered = repeated.join(extents, ["hash", "context"]).select("row", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"))
    merged = covered.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("parts"))
    return materialize(merged.select("row", _merge(F.col("parts")).alias("spans")), "spans", keep=True)


def _merge(parts: Column) -> Column:
    """Sorted intervals with those that touch or overlap made one."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

    def closed(acc: Column) -> Column:
        return F.when(acc["start"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))

    def step(acc: Column, p: Column) -> Column:
        apart = p["start"] > acc["end"]
        return F.struct(
            F.when(apart, closed(acc)).otherwise(acc["done"]).alias("done"),
            F.when(apart, p["start"]).otherwise(acc["start"]).alias("start"),
            F.when(apart, p["end"]).otherwise(F.greatest(acc["end"], p["end"])).alias("end"),
        )

    return F.aggregate(parts, zero, step, closed)


def _kept(text: Column, spans: Column) -> Column:
    """The bytes of a text outside its spans."""
    raw = text.cast("binary")
    zero = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        gap = F.substring(raw, acc["at"] + 1, p["start"] - acc["at"])
        return F.struct(p["end"].alias("at"), F.concat(acc["kept"], gap).alias("kept"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["kept"], F.substring(raw, acc["at"] + 1, F.octet_length(text))))


def count_passages(numbered: DataFrame, row: str, s: Settings = PASSAGES, words: int = PASSAGE_WORDS) -> DataFrame:
    """(row, n, bytes): for rows with passages of more than `words` whole words that other rows have too, how many and their bytes."""
    with scratch(numbered.sparkSession):
        found = repeated_places(numbered, row, s)
        likely = numbered.select(F.col(row).alias("row"), "text").where(bloom.build(found, "row").may_contain(F.col(row)))
        raw = F.col("text").cast("binary")
        # with a byte more at either end, to tell whole words
        around = F.concat(F.when(F.col("x.start") == 0, F.lit(b" ")).otherwise(F.lit(b"")), F.substring(raw, F.greatest(F.col("x.start"), F.lit(1)), F.col("x.end") - F.greatest(F.col("x.start") - 1, F.lit(0)) + 1), F.when(F.col("x.end") == F.octet_length("text"), F.lit(b" ")).otherwise(F.lit(b"")))
        spans = found.join(likely, "row").select("row", "text", F.explode("spans").alias("x"))
        long = spans.where(F.regexp_count(around.cast("string"), F.lit(r"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]+(?=[\x20\x09-\x0D])")) > words)
        told = long.groupBy("row").agg(F.count("*").alias("n"), F.sum(F.col("x.end") - F.col("x.start")).alias("bytes"))
        return materialize(told, "passages", keep=True)


def remove_repeats(docs: DataFrame, s: Settings = Settings(), passages: Settings | None = None) -> DataFrame:
    """`docs` without the texts, with n_bytes, n_removed, spans and kept_sha256 of each whole text.

    With settings for `passages`, n_passages and passage_bytes too (`count_passages`).
    Of up to a million texts that lose a part, only those (and one in some hundred others) are
    shuffled; beyond that, all texts are.
    """
    row = fresh(docs, "_row")
    names = {n: fresh(docs, n) for n in ("n_bytes", "n_removed", "spans", "kept_sha256", "n_passages", "passage_bytes")}
    numbered = number_rows(docs, row)
    found = repeated_places(numbered, row, s)
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, p: acc + p["end"] - p["start"])
    sized = found.select("row", "spans", length.alias("removed"))
    text = F.coalesce(F.col("text"), F.lit(""))
    likely = numbered.select(F.col(row).alias("row"), text.alias("text")).where(bloom.build(found, "row").may_contain(F.col(row)))
    partly = sized.where(F.size("spans") > 0).join(likely, "row").select("row", "spans", "removed", F.sha2(_kept(F.col("text"), F.col("spans")), 256).alias("kept"))
    if passages is not None:
        partly = partly.join(count_passages(numbered, row, passages), "row", "full")
    at = f"{row}_"
    measured = numbered.withColumns({names["n_bytes"]: F.octet_length(text).cast("bigint"), names["kept_sha256"]: F.sha2(text.cast("binary"), 256)})
    other = [c for c in docs.columns if c != "text"]
    thin = measured.select(*other, row, names["n_bytes"], names["kept_sha256"])
    changed = partly.select(F.struct("*").alias(at))
    joined, zero = thin.join(changed, F.col(row) == F.col(at)["row"], "left"), F.lit(0).cast("bigint")
    return joined.select(
        *other, names["n_bytes"], F.coalesce(F.col(at)["removed"], zero).alias(names["n_removed"]),
        F.coalesce(F.col(at)["spans"], F.array().cast("array<struct<start:int,end:int>>")).alias(names["spans"]),
        F.coalesce(F.col(at)["kept"], names["kept_sha256"]).alias(names["kept_sha256"]),
        *([F.coalesce(F.col(at)["n"], zero).alias(names["n_passages"]), F.coalesce(F.col(at)["bytes"], zero).alias(names["passage_bytes"])] if passages is not None else []),
    )
