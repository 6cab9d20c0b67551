"""Repeated strings against brute force over all strings of the length."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import repeats
from lodestone.llm.queries import QUERIES


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if times[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        yield len(r), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()


def across_spans(texts, length):
    """Of each text the maximal runs of bytes that strings of `length` bytes cover which another text has too."""
    raws = [(t or "").encode() for t in texts]
    rows = {}
    for d, r in enumerate(raws):
        for x in {r[i : i + length] for i in range(len(r) - length + 1)}:
            rows.setdefault(x, set()).add(d)
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if len(rows[r[i : i + length]]) > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        yield list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def made_texts(rng, letters, n, length):
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(length // 2, 3 * length))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            part = rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(2 * length)))
            if rng.random() < 0.3 and part:
                at = rng.randrange(len(part))
                part = part[:at] + rng.choice(letters) + part[at + 1 :]
            parts.append(part)
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("letters", "group", "bands", "band_group"), [("ab", 2000, 6, 9), ("abcdefghé ", 2000, 6, 9), ("abcdefghé ", 1, 6, 2000), ("abcdefghé ", 1, 6, 1), ("abcd", 3, 4, 3), ("ab", 1, 7, 2), ("a", 2000, 6, 9), ("a", 1, 6, 1)])
def test_small_lengths(spark, letters, group, bands, band_group):
    """All three ways, alone and together."""
    rng = random.Random(len(letters) + group)
    s = repeats.Settings(40, 10, group, bands, band_group)
    texts = made_texts(rng, letters, 120 if len(letters) > 1 else 12, 40) + [None, "", "x" * 39, "y" * 40, "z" * 41]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, Spans string").repartition(3)
    got = repeats.remove_repeats(df, s).collect()
    assert len(got) == len(texts)
    want = list(brute(texts, 40))
    for r in got:
        assert (r["n_bytes"], r["n_removed"], len(r["_spans"]), r["kept_sha256"]) == want[r["doc_id"]], texts[r["doc_id"]]


@pytest.mark.parametrize(("letters", "group", "bands", "band_group"), [("abcdefghé ", 2000, 6, 9), ("ab", 2000, 6, 9), ("abcdefghé ", 1, 6, 2000), ("abcdefghé ", 1, 6, 1), ("abcd", 3, 4, 3), ("a", 2000, 6, 9)])
def test_across_texts(spark, letters, group, bands, band_group):
    rng = random.Random(len(letters) + group + 7)
    s = repeats.Settings(40, 10, group, bands, band_group, True)
    texts = [2 * t if rng.random() < 0.4 else t for t in made_texts(rng, letters, 100 if len(letters) > 1 else 8, 40)] + [None, "", "y" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r["row"]: [tuple(x) for x in r["spans"]] for r in repeats.repeated_places(df, "row", s).collect()}
    assert {d: x for d, x in enumerate(across_spans(texts, 40)) if x} == got


def test_passages(spark, sf):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(3, 9)))
    own = lambda n: " ".join(word() for _ in range(n))
    long, short = own(51), own(50)
    texts = [f"{own(30)} {long} {own(9)}", f"{long}\n{own(80)}", f"{own(200)} {long}", f"{own(60)} {short} {own(60)}", f"{short} {own(70)}", f"{own(60)}", None, "", "of " * 300, 2 * (own(60) + " ")]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(2)
    assert {r["row"]: r["n"] for r in repeats.count_passages(df, "row").collect()} == {0: 1, 1: 1, 2: 1}
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    want = {}
    for d, spans in zip(docs, across_spans([d["text"] for d in docs], 240), strict=True):
        raw, n = (d["text"] or "").encode(), 0
        for a, b in spans:
            words = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
            n += sum(w.start() >= a and w.end() <= b for w in words) > 50
        want[d["doc_id"]] = n
    got = {r["doc_id"]: r["n_passages"] for r in QUERIES["op5_repeated_strings"](spark, sf).collect()}
    assert got == want and any(want.values())


def test_documents(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    want = dict(zip((d["doc_id"] for d in docs), brute([d["text"] for d in docs], 400), strict=True))
    got = QUERIES["op5_repeated_strings"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert any(0 < w[1] < w[0] for w in want.values())


def test_empty_table(spark, sf):
    assert repeats.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0


def test_group_extents_against_pairs():
    rng = random.Random(9)
    for _ in range(200):
        texts = list({("".join(rng.choice("ab") for _ in range(rng.randrange(12))), "".join(rng.choice("ab") for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(1, 14))})
        lefts, rights = [a.encode() for a, _ in texts], [b"#" + b.encode() for _, b in texts]
        got = repeats.group_extents(lefts, rights, 6)
        want = [[0] * len(texts), [0] * len(texts)]
        for i in range(len(texts)):
            for j in range(len(texts)):
                a, b = repeats.common(lefts[i], lefts[j]), repeats.common(rights[i], rights[j])
                if i != j and a + b >= 6:
                    want[0][i], want[1][i] = max(want[0][i], a), max(want[1][i], b)
        assert list(got) == want
        owners = [rng.choice([None, 1, 2, 3]) for _ in texts]
        want = [[0] * len(texts), [0] * len(texts)]
        for i in range(len(texts)):
            for j in range(len(texts)):
                a, b = repeats.common(lefts[i], lefts[j]), repeats.common(rights[i], rights[j])
                if i != j and a + b >= 6 and (owners[i] is None or owners[i] != owners[j]):
                    want[0][i], want[1][i] = max(want[0][i], a), max(want[1][i], b)
        assert list(repeats.group_extents(lefts, rights, 6, owners)) == want


def test_merge(spark):
    parts = spark.range(1).select(F.expr("array(named_struct('start', 0, 'end', 4), named_struct('start', 4, 'end', 6), named_struct('start', 5, 'end', 6), named_struct('start', 8, 'end', 9))").alias("p"))
    assert [tuple(x) for x in parts.select(repeats._merge(F.col("p")).alias("m")).first()["m"]] == [(0, 6), (8, 9)]
