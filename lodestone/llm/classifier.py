"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and of their
hashed character n-grams; a softmax layer turns that average into class
probabilities. Vectors and layer are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows.

Defined results: null and empty texts have no features and score the softmax of
the bias alone. Repeated words count each time. Texts of any length are read
whole. Without labels of both classes the model scores every text with the share
of label 1 (1.0 without any label). Rows are scored one by one, so repeated rows,
ties and null keys keep their rows; other columns, whatever their names, pass
through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_memory, fresh, ship_by_value

ship_by_value(__name__)

#: The largest number of labelled rows that the driver gathers to fit a model.
MAX_TRAINING_ROWS = 4000


@dataclass(frozen=True)
class Settings:
    dim: int = 16
    buckets: int = 1 << 17
    shortest: int = 3
    longest: int = 5
    epochs: int = 8
    rate: float = 0.3
    seed: int = 7
    max_rows: int = MAX_TRAINING_ROWS


@dataclass(frozen=True)
class Model:
    """What scoring needs: for each bucket, its vector times the difference of the two class rows."""

    settings: Settings
    margins: np.ndarray
    bias: float


def word_features(word: str, s: Settings) -> list[int]:
    """Buckets of a word and of its character n-grams with word ends marked."""
    raw = word.encode("utf-8", "surrogatepass")
    found = [zlib.crc32(raw) % s.buckets]
    if len(raw) == len(word):  # one byte a character
        marked = b"<" + raw + b">"
        for n in range(s.shortest, s.longest + 1):
            found += [zlib.crc32(marked[i : i + n], n) % s.buckets for i in range(len(marked) - n + 1)]
        return found
    text = f"<{word}>"
    for n in range(s.shortest, s.longest + 1):
        found += [zlib.crc32(text[i : i + n].encode("utf-8", "surrogatepass"), n) % s.buckets for i in range(len(text) - n + 1)]
    return found


def _crc_table() -> np.ndarray:
    """What crc32 makes of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


def weigh_words(words: list[str], margins: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the sum of `margins` over its `word_features` and how many it has; words of one byte a character at once."""
    sums, counts = np.zeros(len(words)), np.zeros(len(words), np.int64)
    plain = [i for i, word in enumerate(words) if word.isascii()]
    for i in sorted(set(range(len(words))) - set(plain)):
        ids = word_features(words[i], s)
        sums[i], counts[i] = margins[ids].sum(), len(ids)
    if not plain:
        return sums, counts
    raw = [words[i].encode() for i in plain]
    sizes = np.array([len(x) + 2 for x in raw])
    line = np.frombuffer(b"".join([b"<%b>" % x for x in raw]) + bytes(s.longest), np.uint8).astype(np.uint32)
    held = int(sizes.sum())
    owner = np.repeat(np.arange(len(raw)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(held)  # bytes from here to the word's end
    table, crc, found = _crc_table(), np.full(held, 0xFFFFFFFF, np.uint32), np.zeros(held)
    many = np.ones(len(raw), np.int64)
    for n in range(1, s.longest + 1):
        crc = table[(crc ^ line[n - 1 : n - 1 + held]) & np.uint32(255)] ^ (crc >> np.uint32(8))
        if n >= s.shortest:
            # another start of the sum flips the same bits of it for all strings of a length
            start = np.uint32(0xFFFFFFFF ^ zlib.crc32(bytes(n), n) ^ zlib.crc32(bytes(n)))
            found += np.where(room >= n, margins[(crc ^ start) % np.uint32(s.buckets)], 0.0)
            many += np.maximum(sizes - n + 1, 0)
    sums[plain] = margins[np.array([zlib.crc32(x) % s.buckets for x in raw])] + np.bincount(owner, found, len(raw))
    counts[plain] = many
    return sums, counts


def document_features(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and the share that each has in its average."""
    ids: list[int] = []
    for word in (text or "").split():
        ids.extend(word_features(word, s))
    if not ids:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    unique, counts = np.unique(np.asarray(ids, np.int32), return_counts=True)
    return unique, (counts / len(ids)).astype(np.float32)


def train(rows: list[tuple[str | None, int]], s: Settings = Settings()) -> Model:
    """Fits a model to (text, label) rows; the result depends on rows and settings only."""
    labels = np.array([int(y) for _, y in rows], np.int64)
    positive = int(labels.sum())
    if positive == 0 or positive == len(labels):
        share = 1.0 if len(labels) == positive else 0.0
        return Model(s, np.zeros(s.buckets), 40.0 if share else -40.0)
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1.0 / s.dim, 1.0 / s.dim, (s.buckets, s.dim))
    layer, bias = np.zeros((2, s.dim)), np.zeros(2)
    features = [document_features(text, s) for text, _ in rows]
    steps, step = s.epochs * len(rows), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            rate = s.rate * (1.0 - step / steps)
            step += 1
            ids, share = features[i]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(s.dim)
            scores = layer @ hidden + bias
            chances = np.exp(scores - scores.max())
            chances /= chances.sum()
            chances[labels[i]] -= 1.0
            into_vectors = chances @ layer
            layer -= rate * np.outer(chances, hidden)
            bias -= rate * chances
            if len(ids):
                # the average spreads a gradient thinly over buckets; each takes its share of a full step
                vectors[ids] -= (rate * np.minimum(1.0, share * len(ids)))[:, None] * into_vectors
    return Model(s, vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def score_texts(texts, model: Model, cache: dict) -> np.ndarray:
    """Chances of label 1. `cache` keeps what short words add, and is emptied when large."""
    out = np.empty(len(texts), np.float64)
    for first in range(0, len(texts), 500):
        split = [(text or "").split() for text in texts[first : first + 500]]
        new = {word for words in split for word in words if word not in cache}
        if len(cache) + len(new) > 400_000:
            cache.clear()
            new = {word for words in split for word in words}
        listed = list(new)
        for at in range(0, len(listed), 20_000):
            part = listed[at : at + 20_000]
            sums, counts = weigh_words(part, model.margins, model.settings)
            cache.update(zip(part, zip(sums.tolist(), counts.tolist())))
        for i, words in enumerate(split, first):
            total, n = 0.0, 0
            if words:
                known = [cache[word] for word in words]
                total, n = sum([x[0] for x in known]), sum([x[1] for x in known])
            margin = model.bias + (total / n if n else 0.0)
            out[i] = 1.0 / (1.0 + np.exp(-np.clip(margin, -500.0, 500.0)))
        for word in listed:
            if len(word) > 64:
                del cache[word]
    return out


def scorer(spark: SparkSession, model: Model):
    """A vectorised function from a text column to the chance of label 1."""
    # plain values: a worker without this package can read them
    shared = spark.sparkContext.broadcast((asdict(model.settings), model.margins, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        settings, margins, bias = shared.value
        own, cache = Model(Settings(**settings), margins, bias), {}
        for texts in batches:
            yield pd.Series(score_texts(texts, own, cache))
        cache.clear()
        free_memory()

    return score


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> list[tuple[str | None, int]]:
    """At most `settings.max_rows` labelled texts outside the held-out third, chosen by a hash of their ids."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    ones = usable.groupBy("doc_id").agg(F.min("quality").alias("_label")).where(F.col("_label").isin(0, 1))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = ones.orderBy(*order).limit(settings.max_rows)
    texts = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.orderBy(*order, "_text").limit(settings.max_rows).collect()
    return [(r["_text"], r["_label"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from labels of quality outside the held-out third."""
    return train(training_rows(docs, labels, settings), settings)


def with_quality(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """`docs` with each whole text's chance of label 1 in a new column."""
    return docs.withColumn(fresh(docs, name), scorer(docs.sparkSession, model)(F.col("text")))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least `threshold`, with the columns of `docs`."""
    name = fresh(docs, "_quality")
    return with_quality(docs, model, name).where(F.col(name) >= threshold).drop(name)
