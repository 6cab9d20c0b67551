"""Near duplicates by order MinHash, verified by banded alignment.

A text is its lower-cased words; shingles are five words in a row, labelled with how
often they occurred before. A sketch takes the few labelled shingles with the least
hashes and keeps them in the order of the text, so it agrees where two texts agree in
what they say and in its order: the chance falls with edits and with rearrangement.
Several sketches are taken; texts that share one are in a bucket, and are candidates.

Two texts are linked if an alignment of their words, within the band of diagonals that the
bound allows, shows one of two things at a similarity of 0.8. Either words: edits (a word put
in, left out or replaced) are at most 1 - `similarity` of the longer text's words. Or
shingles: matched / (all of both - matched) is at least `similarity`; the alignment of fewest
insertions and deletions is tried first; where it falls short, the one that matches most
shingles decides. Classes are the connected components of links.

Copies (the same words) collapse first. In a bucket, a few turns link a member of each
component to a hub, the first turn in a part of the sketches, so that a large group costs few
links for each member. Then the pairs of members that are still in different components are
settled, all of them: in a bucket of up to `SMALL` members pair by pair; for members of larger
ones by an exact set join. Linked texts have at least 0.8 of the longer one's words in common
(`least_words`). So of each text's rarest words, as many as it can lack and one more, they
share one at least: only texts that do meet, in any bucket. Texts that share many of them (a line that
both repeat) meet at the first, the rarest: a word at which one of the `BEFORE` words that come before it in
both prefixes is shared too isn't the first. Counters of words (`bins`), and bits for the first few of
equal words in the set join, rule out pairs before their words are read, and never one that counts. So no
candidate pair is left out, and classes don't depend on the hubs. Rows of the set join are thus about one
for a pair that may have enough words in common. In a crowd of texts that do, and aren't linked, those still
are the crowd's pairs: each has to be looked at.

Defined results: null texts and texts without words are in classes of their own, row by
row. Texts of fewer than five words match only copies. Texts are read whole. Repeated
rows keep their rows. An empty table gives none. Extra columns pass through. A class's
id is the doc_id of its first row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import free_memory, fresh, materialize, number_rows, scratch, ship_by_value, without_rows, word_line
from .components import components

ship_by_value(__name__)


#: Words handled at once, unless a single text has more.
BLOCK = 400_000
#: Members of a bucket that are compared pair by pair; larger ones go into the set join.
SMALL = 4
#: Words of a prefix that each of its rows has with it, those just before.
BEFORE = 16
#: Bits of a text in the set join, and how many of equal words have one.
BITS = 2048
EQUAL = 8
#: Counters of words in a text's `bins`.
BINS = 256


class Settings(NamedTuple):
    width: int = 5
    sketches: int = 32
    picks: int = 2
    similarity: float = 0.8
    rounds: int = 2
    small: int = SMALL


def most_edits(words, s: Settings):
    """How many edits a link to a text of so many words that isn't longer may take."""
    return np.floor((1 - s.similarity) * words + 1e-9)


def least_words(words, s: Settings):
    """How many of its words a text has in common with any text linked to it that isn't longer.

    An edit takes one at most; matched shingles that make up the similarity stand in one run at worst.
    """
    return np.minimum(words - most_edits(words, s), np.ceil(s.similarity * (words - s.width + 1) - 1e-6) + s.width - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_shingles(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of shingles of texts (slices of `words`), text after text, the text of each, and how many each text has.

    A text of fewer words than `width` has one shingle, of all its words.
    """
    odd = np.uint64(0x9E3779B97F4A7C15)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(owner)) if len(owner) else np.empty(0, np.int64)
    shingles = np.zeros(len(owner), np.uint64)
    reach = np.repeat(sizes + starts, counts)
    for j in range(width):
        at = first + j
        inside = at < reach
        values = np.where(inside, words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(7))
        shingles = _mix(shingles * odd + values + np.uint64(j + 1))
    return shingles, owner, counts


def shingle_hashes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same shingles, labelled with how often they came before in their text, and how many each text has."""
    shingles, owner, counts = plain_shingles(words, starts, sizes, width)
    order = np.argsort(shingles ^ _mix(owner.astype(np.uint64) + np.uint64(1)), kind="stable")
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = (shingles[order[1:]] == shingles[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    place = np.arange(len(order))
    run = place - np.maximum.accumulate(np.where(same, 0, place))
    labels = np.empty(len(order), np.uint64)
    labels[order] = run.astype(np.uint64)
    return np.where(labels > 0, _mix(shingles + labels * np.uint64(0x9E3779B97F4A7C15)), shingles), counts


def order_sketches(shingles: np.ndarray, counts: np.ndarray, s: Settings) -> np.ndarray:
    """A row of `s.sketches` values for each text with a shingle, 0 for others."""
    out = np.zeros((len(counts), s.sketches), np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    spread = 6.0 * s.picks
    limit = np.where(counts > spread, (2.0**64 * 0.999) * spread / np.maximum(counts, 1), 2.0**64 * 0.999).astype(np.uint64)
    limit[counts <= spread] = np.uint64(0xFFFFFFFFFFFFFFFF)
    bar = np.repeat(limit, counts)
    want = np.minimum(counts, s.picks)
    for j in range(s.sketches):
        seed = _mix(np.array([j + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0]
        hashed = shingles * (seed | np.uint64(1))  # shingles are mixed already
        at = np.flatnonzero(hashed <= bar)
        few = np.flatnonzero(np.bincount(owner[at], minlength=len(counts)) < want)
        if len(few):
            every = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in few])
            at = np.concatenate([at[~np.isin(owner[at], few)], every])
        by = np.lexsort((at, hashed[at], owner[at]))
        at, whose = at[by], owner[at[by]]
        rank = np.arange(len(at)) - np.searchsorted(whose, whose, "left")
        chosen = np.sort(at[rank < s.picks])  # in the order of the texts
        whose = owner[chosen]
        value = np.full(len(counts), seed, np.uint64)
        turn = np.arange(len(chosen)) - np.searchsorted(whose, whose, "left")
        for p in range(s.picks):
            mine = chosen[turn == p]
            value[owner[mine]] = _mix(value[owner[mine]] * np.uint64(0x9E3779B97F4A7C15) + shingles[mine])
        out[:, j] = value
    out[counts == 0] = 0
    return out


def matched_shingles(a: list, b: list, width: int, most: int) -> int:
    """Shingles in common along an alignment of at most `most` insertions and deletions; -1 without one.

    Only diagonals that so many edits can reach are followed, each as far as it goes.
    """
    n, m, head = len(a), len(b), 0
    short = min(n, m)
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    n, m = n - tail, m - tail
    gain = lambda run: max(0, run - width + 1)
    # diagonal: furthest place in a, last run of matches, shingles before that run
    best = {0: (head, head, 0)}
    if head == n and head == m:
        return gain(head + tail)
    for d in range(1, most + 1):
        new = {}
        for k in range(-d, d + 1, 2):
            down, right = best.get(k + 1), best.get(k - 1)
            if down is None and right is None:
                continue
            if right is None or (down is not None and (down[0], down[2] + gain(down[1])) >= (right[0] + 1, right[2] + gain(right[1]))):
                x, run, score = down
            else:
                x, run, score = right[0] + 1, right[1], right[2]
            y = x - k
            if x > n or y > m:
                continue
            score += gain(run)
            start = x
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            if x == n and y == m:
                return score + gain(x - start + tail)
            new[k] = (x, x - start, score)
        best = new
    return -1


def most_matched(a: list, b: list, width: int, most: int, least: float) -> int:
    """The most shingles that any alignment of at most `most` insertions and deletions matches; -1 if below `least`.

    Row by row over the band of diagonals: the best score at a place, and that with a run of
    1 to `width` (or more) matches behind it.
    """
    n, m, never = len(a), len(b), -(1 << 30)
    x, y = np.asarray(a), np.asarray(b)
    diagonals = np.arange(-most, most + 1)
    best = np.where((diagonals >= 0) & (diagonals <= m), 0, never)
    runs = [np.full(len(diagonals), never)] * width
    for i in range(n):
        at = diagonals + i
        same = (at >= 0) & (at < m) & (y[np.clip(at, 0, m - 1)] == x[i])
        before = [best, *runs]
        runs = [np.where(same, before[r], never) for r in range(width - 1)]
        runs.append(np.where(same, np.maximum(before[width - 1], before[width]) + 1, never))
        best = np.append(best[1:], never)
        for run in runs:
            best = np.maximum(best, run)
        best = np.maximum.accumulate(best)
        if best[-1] + n - i - 1 < least - 1e-6:
            return -1
    return int(best[m - n + most])


def edits_within(a: list, b: list, most: int) -> int:
    """The fewest words to put in, leave out or replace that turn `a` into `b`; -1 if more than `most`.

    Column by column over the band of diagonals that `most` edits can reach. A column's cells are
    bits: where the next one down is one more (`up`) or one less (`down`) than it; the band moves down
    one row with each column. The sum of steps along the last cell's diagonal is the answer.
    """
    if len(a) < len(b):
        a, b = b, a
    head, short = 0, len(b)
    while head < short and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < short - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    found = len(a) - len(b)
    if found > most:
        return -1
    band = (1 << (2 * most + 1)) - 1
    watched = 1 << (found + most)
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    down = (1 << most) - 1  # above the first row, where nothing is, each cell is one less than that over it
    up = band ^ down
    for j, w in enumerate(b):
        same = where.get(w, 0)
        same = (same >> (j - most) if j >= most else same << (most - j)) & band
        equal = ((((same & up) + up) ^ up) | same | down) & band  # as much as the cell up left
        if not equal & watched:
            found += 1
            if found > most:
                return -1
        right_up = down | (band ^ (equal | up) & band)
        right_down = equal & up
        up = (right_down | (band ^ ((equal >> 1) | right_up))) & band
        down = (equal >> 1) & right_up
    return found


def alignment_similarity(a: list, b: list, s: Settings) -> float:
    """Of two lists of words; 0 where it must be below `s.similarity`."""
    if len(a) < s.width or len(b) < s.width:
        return float(a == b)
    total = len(a) + len(b) - 2 * (s.width - 1)
    least = s.similarity * total / (1 + s.similarity)
    most = int(total - 2 * least + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    found = matched_shingles(a, b, s.width, most)
    if found < s.similarity * (total - found):  # the shortest path isn't always the best one
        found = max(found, most_matched(a, b, s.width, most, least))
    return found / (total - found) if found >= 0 else 0.0


def shared_at_most(a: np.ndarray, b: np.ndarray, width: int) -> int:
    """How many shingles two texts have in common in any order: no alignment can match more."""

    def grams(words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - width + 1 + j].astype(np.uint64)
            out ^= out >> np.uint64(29)
        return np.sort(out)

    if len(a) < width or len(b) < width:
        return int(np.array_equal(a, b))
    x, y = grams(a), grams(b)
    # the n-th of equal shingles in one text meets the n-th in the other
    nth = np.arange(len(x)) - np.searchsorted(x, x, "left")
    return int((np.searchsorted(y, x, "right") - np.searchsorted(y, x, "left") > nth).sum())


def linked(x: np.ndarray, y: np.ndarray, s: Settings) -> bool:
    """Whether two texts, as numbers for words, are near enough."""
    if len(x) < s.width or len(y) < s.width:
        return bool(np.array_equal(x, y))
    longer = max(len(x), len(y))
    if shared_at_most(x, y, 1) < least_words(longer, s):
        return False
    a, b = x.tolist(), y.tolist()
    if edits_within(a, b, int(most_edits(longer, s))) >= 0:
        return True
    total = len(x) + len(y) - 2 * (s.width - 1)
    most = shared_at_most(x, y, s.width)
    return most >= s.similarity * (total - most) and alignment_similarity(a, b, s) >= s.similarity


def _word_hashes(text: Column, of, kind: str) -> Column:
    line = word_line(text)
    return F.when(line == "", F.array().cast(f"array<{kind}>")).otherwise(F.transform(F.split(line, " "), lambda w: of(w)))


def _binary(pairs: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(pairs).tobytes()
    offsets = np.arange(len(pairs) + 1, dtype=np.int32) * (pairs.itemsize * pairs.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(pairs), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def _by_blocks(batch: pa.RecordBatch, of) -> Iterator[pa.RecordBatch]:
    """What `of` makes of slices of a batch (row, words), each of `BLOCK` words at most or of a single text."""
    ends, at = batch.column(1).offsets.to_numpy()[1:].astype(np.int64), 0
    while at < len(ends):
        done = ends[at - 1] if at else ends[0] - len(batch.column(1)[0])
        to = max(at + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        yield of(batch.slice(at, to - at))
        at = to


def sketch_texts(rows: DataFrame, s: Settings) -> DataFrame:
    """(row, digest of the words, number of shingles, sketches, bins) of rows (row, words)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64)
        offsets = offsets - offsets[0]
        starts, sizes = offsets[:-1], np.diff(offsets)
        shingles, counts = shingle_hashes(words, starts, sizes, s.width)
        sketches = order_sketches(shingles, counts, s)
        place = (np.arange(len(words)) - np.repeat(starts, sizes)).astype(np.uint64)
        digest = np.zeros((len(sizes), 2), np.uint64)
        for j in range(2):
            step = _mix(words * np.uint64(2 * j + 3) + _mix(place + np.uint64(j << 40)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(step)])
            digest[:, j] = _mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes.astype(np.uint64))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bins = np.bincount(owner * BINS + (words >> np.uint64(32)).astype(np.int64) % BINS, minlength=len(sizes) * BINS)
        bins = np.minimum(bins, 255).astype(np.uint8).reshape(len(sizes), BINS)
        ends = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * s.sketches)
        listed = pa.ListArray.from_arrays(ends, pa.array(sketches.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), _binary(digest), pa.array(counts.astype(np.int64)), listed, _binary(bins)], ["row", "digest", "n", "sketches", "bins"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _by_blocks(batch, of)
        free_memory()

    return rows.mapInArrow(run, "row bigint, digest binary, n bigint, sketches array<bigint>, bins binary")


def _possible(pairs: DataFrame, features: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose counters of words allow a link: the sum of the lesser ones bounds what is in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longer = np.maximum(batch.column(2).to_numpy(), batch.column(3).to_numpy()) + s.width - 1
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BINS) for c in (batch.column(4), batch.column(5)))
            least = np.minimum(x, y)
            # a full counter says nothing
            good = (least.sum(axis=1, dtype=np.int64) >= least_words(longer, s)) | (least == 255).any(axis=1)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(features.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("bins").alias("bins_a")), "a")
    both = with_a.join(features.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("bins").alias("bins_b")), "b")
    return both.select("a", "b", "n_a", "n_b", "bins_a", "bins_b").mapInArrow(run, "a bigint, b bigint")


def _links(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of rows whose texts are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs, x_at), (ys, y_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            good = [linked(xs[x_at[i] : x_at[i + 1]], ys[y_at[i] : y_at[i + 1]], s) for i in range(len(batch))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        free_memory()

    with_a = pairs.join(texts.select(F.col("row").alias("a"), F.col("words").alias("words_a")), "a")
    both = with_a.join(texts.select(F.col("row").alias("b"), F.col("words").alias("words_b")), "b")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a bigint, b bigint")


def _near(a: Column, b: Column, s: Settings) -> Column:
    """Whether numbers of shingles allow a link."""
    # of words, the shorter text has 0.8 at least; of shingles, that is less by up to one
    return F.least(a, b) + 1 >= s.similarity * F.greatest(a, b)


def _hub_pairs(members: DataFrame, turn: int, s: Settings) -> DataFrame:
    """Pairs (a, b) of one member of each component with the hub of its group.

    Groups are the members of a bucket whose numbers of shingles lie in a band in which
    any two are near enough; each member is in two bands that overlap by half. Hubs go by the
    hash of what texts say (`mark`).
    """
    place = F.log("n") / math.log(1 / s.similarity + 1e-3)
    bands = F.array(F.floor(place) * 2, F.floor(place + 0.5) * 2 + 1)
    mark = F.xxhash64("mark", "bucket", F.lit(turn))
    banded = members.select("bucket", F.explode(bands).alias("band"), "label", F.struct(mark.alias("m"), "node", "n").alias("x"))
    chosen = banded.groupBy("bucket", "band", "label").agg(F.min("x").alias("x"))
    hub = chosen.groupBy("bucket", "band").agg(F.min(F.struct("x.m", "x.node", "x.n", "label")).alias("hub"), F.count("*").alias("several")).where("several > 1")
    met = chosen.join(hub, ["bucket", "band"]).where(F.col("hub.label") != F.col("label"))
    return met.where(_near(F.col("x.n"), F.col("hub.n"), s)).select(F.least("x.node", "hub.node").alias("a"), F.greatest("x.node", "hub.node").alias("b")).distinct()


def _least_shared(longer: Column, s: Settings) -> Column:
    """`least_words` if the longer text has so many shingles."""
    most = longer + (s.width - 1)
    return F.least(most - F.floor((1 - s.similarity) * most + 1e-9), F.ceil(s.similarity * longer - 1e-6) + (s.width - 1))


def _prefix_size(n: Column, longer: Column, s: Settings) -> Column:
    """How many of its rarest words decide whether a text of `n` shingles can be linked to another, if the longer of both has so many."""
    return (n + s.width - _least_shared(longer, s)).cast("int")


def _enough_bits(s: Settings) -> Column:
    """Whether the bits of two rows allow a link: each bit that the other lacks is a word that it lacks."""
    # written out, the join's code would be too long to be compiled
    both = F.aggregate(F.zip_with("bits", "x.bits", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda total, c: total + c)
    lost = F.greatest(F.col("ones") - F.col("n"), F.col("x.ones") - F.col("x.n")) - both
    return s.width - 1 - lost >= _least_shared(F.greatest("n", "x.n"), s)


def _meetings(groups: DataFrame, key: str, s: Settings) -> DataFrame:
    """Pairs (a, b) of rows of equal `key`s with different labels; again for another key.

    Rows of a key's most frequent label meet the others, never one another. Where rows have a `place` in
    their text's prefix, it has to lie in the prefix that the pair's lengths ask for, the `bits` of both have
    to allow a link, and no key of the ones `before` it may be one of those before the other's: the pair meets there.
    """
    placed = "place" in groups.columns
    counts = groups.groupBy(key, "label").agg(F.count("*").alias("c"))
    main = counts.groupBy(key).agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    marked = groups.join(main, key)
    own = ["node", "n", "label", *(["place", "before", "bits", "ones"] if placed else [])]
    others = marked.where("label != main").select(key, F.struct(*own).alias("x"))
    every = marked.select(key, *own, "main")
    fits = (F.col("label") != F.col("x.label")) & _near(F.col("n"), F.col("x.n"), s)
    # two rows that both aren't of the main label meet once
    fits = fits & ((F.col("label") == F.col("main")) | (F.col("node") < F.col("x.node")))
    if placed:
        longer = F.greatest("n", "x.n")
        fits = fits & (F.col("place") < _prefix_size(F.col("n"), longer, s)) & (F.col("x.place") < _prefix_size(F.col("x.n"), longer, s))
        fits = fits & ~F.arrays_overlap("before", "x.before") & _enough_bits(s)
    met = every.join(others, key).where(fits)
    return met.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b"))


def _prefixes(nodes: DataFrame, words: DataFrame, s: Settings) -> DataFrame:
    """(token, place, before, node, n, label, bits, ones): of each text its rarest words (labelled like shingles), as many as a linked text may lack and one more."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        hashes = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64)
        offsets = offsets - offsets[0]
        grams, counts = shingle_hashes(hashes, offsets[:-1], np.diff(offsets), 1)
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        owner = np.repeat(np.arange(len(counts)), counts)
        by = np.lexsort((hashes, owner))
        first = np.concatenate([[True], (hashes[by][1:] != hashes[by][:-1]) | (owner[by][1:] != owner[by][:-1])])[: len(by)]
        place = np.arange(len(by))
        few = by[place - np.maximum.accumulate(np.where(first, place, 0)) < EQUAL]
        has = np.zeros((len(counts), BITS), bool)
        has[owner[few], (_mix(grams[few]) % np.uint64(BITS)).astype(np.int64)] = True
        bits = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(has, axis=1).view(np.int64).ravel()), BITS // 64).cast(pa.list_(pa.int64()))
        columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(grams.view(np.int64))), bits, pa.array(has.sum(axis=1, dtype=np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["node", "tokens", "bits", "ones"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _by_blocks(batch, of)
        free_memory()

    listed = nodes.select("node").join(words.select(F.col("row").alias("node"), "words"), "node")
    listed = materialize(listed.mapInArrow(run, "node bigint, tokens array<bigint>, bits array<bigint>, ones bigint"), "tokens")
    tokens = listed.select("node", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    ranked = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("ranked"))
    prefix = F.slice("ranked", F.lit(1), _prefix_size(F.col("n"), F.col("n"), s))
    cut = ranked.join(nodes, "node").select("node", "n", "label", prefix.alias("prefix"))
    # words of one text only are the first in it, and no other text's
    alone = F.size(F.filter("prefix", lambda x: x["often"] == 1))
    shared = cut.select("node", "n", "label", alone.alias("alone"), F.filter("prefix", lambda x: x["often"] > 1)["token"].alias("shared"))
    each = shared.join(listed.select("node", "bits", "ones"), "node").select("*", F.posexplode("shared").alias("at", "token"))
    before = F.slice("shared", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    return each.select("token", (F.col("alone") + F.col("at")).alias("place"), before.alias("before"), "node", "n", "label", "bits", "ones")


def _remaining_pairs(members: DataFrame, features: DataFrame, words: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of members of a bucket in different components that may be linked: those of small buckets by `_possible`, those of large ones by the set join."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    mixed = materialize(members.join(sizes.select("bucket", "size"), "bucket"), "mixed")
    few = _possible(_meetings(mixed.where(F.col("size") <= s.small), "bucket", s).distinct(), features, s)
    large = mixed.where(F.col("size") > s.small).select("node", "n", "label").distinct()
    prefixes = materialize(_prefixes(materialize(large, "large"), words, s), "prefixes")
    return few.unionByName(_meetings(prefixes, "token", s)).distinct()


def near_duplicate_classes(docs: DataFrame, s: Settings = Settings(), key: str = "doc_id") -> tuple[DataFrame, str]:
    """`docs` with each row's class id, the `key` of the class's first row, in a new column whose name comes second."""
    numbered = number_rows(docs, row := fresh(docs, "_row"))
    of_row = first_rows(numbered, row, s)
    keys = numbered.select(F.col(row).alias("row"), F.col(key).alias("key"))
    heads = of_row.where("row = first").select("row").join(keys, "row").select(F.col("row").alias("first"), F.col("key").alias("class_id"))
    name = fresh(docs, "class_id")
    ids = of_row.join(heads, "first").select(F.col("row").alias(f"{row}_"), F.col("class_id").alias(name))
    return numbered.join(ids, F.col(row) == F.col(f"{row}_")).drop(row, f"{row}_"), name


def first_rows(numbered: DataFrame, row: str, s: Settings = Settings()) -> DataFrame:
    """(row, first): the first row of each row's class, by the numbers of `number_rows`."""
    with scratch(numbered.sparkSession):
        return _first_rows(numbered.select(F.col(row).alias("row"), "text"), s)


def _first_rows(texts: DataFrame, s: Settings) -> DataFrame:
    rows = texts.select("row", _word_hashes(F.col("text"), F.xxhash64, "bigint").alias("words"))
    features = materialize(sketch_texts(rows, s), "sketches")
    worded = features.where("n > 0")
    one = worded.groupBy("digest").agg(F.min("row").alias("node"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    nodes = materialize(one.withColumn("mark", F.xxhash64("digest")), "texts")
    keyed = nodes.where(F.col("n") > 1).select("node", "n", "mark", F.posexplode("sketches").alias("sketch", "bucket"))
    several = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = materialize(keyed.join(several, "bucket"), "buckets")
    likely = texts.where(bloom.build(members.select("node").distinct(), "node").may_contain(F.col("row")))
    words = materialize(likely.select("row", _word_hashes(F.col("text"), F.hash, "int").alias("words")), "words")
    links, tried, labels = None, None, None
    for turn in range(s.rounds + 1):
        some = members.where(F.col("sketch") < s.sketches // 4) if turn == 0 else members
        chosen = some.select("bucket", "node", "n", "mark", F.col("node").alias("label"))
        if labels is not None:
            labelled = some.join(labels, "node", "left")
            chosen = labelled.select("bucket", "node", "n", "mark", F.coalesce("label", "node").alias("label"))
        pairs = _hub_pairs(chosen, turn, s) if turn < s.rounds else _remaining_pairs(chosen, features, words, s)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if not pairs.limit(1).count():
            continue
        found = materialize(_links(_possible(pairs, features, s) if turn < s.rounds else pairs, words, s), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not found.limit(1).count():
            continue
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    if labels is None:
        named = nodes.select("digest", F.col("node").alias("first"))
    else:
        named = nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("first"))
    classed = features.select("row", "digest", "n").join(named, "digest", "left")
    first = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("row"))
    return materialize(classed.select("row", first.alias("first")), "classes", keep=True)


def keep_first(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One document, the first, of each class, with the columns of `docs`."""
    numbered = number_rows(docs, row := fresh(docs, "_row"))
    gone = first_rows(numbered, row, s).where("row != first").select(F.col("row").alias("_row"))
    return without_rows(numbered, row, gone).select(*docs.columns)
