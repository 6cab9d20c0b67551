"""Near duplicates against brute force on all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.llm import near_dups
from lodestone.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def word_edits(a, b):
    """Levenshtein distance of two lists of words, over the whole table."""
    known = {}
    x, y = (np.array([known.setdefault(w, len(known)) for w in t]) for t in (a, b))
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, w in enumerate(x):
        new = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != w))])
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


def brute_links(texts, similarity=0.8, edits=0.2):
    """Linked pairs of texts, of all that share a shingle (others can't be candidates)."""
    words = [words_of(t) for t in texts]
    bags = [shingles(w) for w in words]
    where, known = {}, {}
    for i, bag in enumerate(bags):
        for s in bag:
            where.setdefault(s, []).append(i)
    for i, bag in enumerate(bags):
        for j in {j for s in bag for j in where[s] if j < i}:
            key = (" ".join(words[i]), " ".join(words[j]))
            if key not in known:
                both, longer = sum((bag & bags[j]).values()), max(len(words[i]), len(words[j]))
                alike = both >= similarity * (sum(bag.values()) + sum(bags[j].values()) - both)
                known[key] = alike or key[0] == key[1] or min(len(words[i]), len(words[j])) >= 5 and abs(len(words[i]) - len(words[j])) <= edits * longer and word_edits(words[i], words[j]) <= edits * longer + 1e-9
            if known[key]:
                yield j, i


def brute_classes(texts):
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in brute_links(texts):
        a, b = sorted((root(i), root(j)))
        up[b] = a
    return [root(i) for i in range(len(texts))]


def partition(keys, ids):
    groups = {}
    for k, i in zip(keys, ids, strict=True):
        groups.setdefault(k, set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = QUERIES["op9_near_duplicates"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    ids, texts = list(docs), list(docs.values())
    links = [(ids[i], ids[j]) for i, j in brute_links(texts) if words_of(texts[i]) != words_of(texts[j])]
    of = {r["doc_id"]: r["class_id"] for r in got}
    assert len(links) > 50
    assert sum(of[i] == of[j] for i, j in links) >= 0.98 * len(links)
    want = partition(brute_classes(texts), ids)
    found = partition(of.values(), of)
    assert all(any(g <= w for w in want) for g in found)
    assert all(r["class_id"] <= r["doc_id"] for r in got)
    other = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    classed, name = near_dups.near_duplicate_classes(other)
    again = {r["doc_id"]: r[name] for r in classed.select("doc_id", name).collect()}
    assert partition(again.values(), again) == found


def test_edited_group_and_odd_rows(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = []
    for _ in range(150):
        text = list(base)
        for _ in range(rng.choice([1, 2])):
            text[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append(" ".join(text))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(40)]
    rows += [None, None, "", "...", "a b", "A, b!", "a b c", "x " * 30_000, "x " * 29_000, "x " * 3]
    half = len(base) // 2
    rows.append(" ".join(base[half:] + base[:half]))
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(rows)], "doc_id long, text string, Class_ID string").repartition(5)
    classed, name = near_dups.near_duplicate_classes(df)
    assert name == "_class_id"
    out = classed.collect()
    assert len(out) == len(rows)
    got = partition([r[name] for r in out], [r["doc_id"] for r in out])
    # the last text has the shingles of the group in another order, and stays alone
    aligned = partition(brute_classes(rows[:-1]), range(len(rows) - 1))
    assert got == aligned
    kept = near_dups.keep_first(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - sum(len(g) - 1 for g in aligned)
    empty, _ = near_dups.near_duplicate_classes(df.limit(0))
    assert empty.count() == 0
    same = spark.createDataFrame([(None, "one two three four five six")] * 3, "doc_id long, text string")
    assert near_dups.keep_first(same).count() == 1


def test_alignment_band():
    s = near_dups.Settings()
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(30) for _ in range(rng.randrange(5, 60))]
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = [rng.randrange(30)] * rng.randrange(2)
        got = near_dups.alignment_similarity(a, b, s)
        both = sum((shingles_of(a) & shingles_of(b)).values())
        bag = both / max(1, len(a) - 4 + len(b) - 4 - both) if len(b) > 4 else float(a == b)
        assert got <= bag + 1e-9
        assert near_dups.alignment_similarity(a, a, s) == 1.0


def shingles_of(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_sketches_feel_order(spark):
    df = spark.range(1).select(F.lit(0).cast("long").alias("row"), F.sequence(F.lit(1), F.lit(100)).cast("array<long>").alias("words"))
    turned = df.select("row", F.concat(F.slice("words", 51, 50), F.slice("words", 1, 50)).alias("words"))
    s = near_dups.Settings()
    a, b = (near_dups.sketch_texts(x, s).first()["sketches"] for x in (df, turned))
    assert sum(x == y for x, y in zip(a, b, strict=True)) < 12


def shared_passage(rng, families, letter):
    """Pairs of near copies, one pair a family, that all have a passage in common."""
    passage = [f"{letter}{i}" for i in range(60)]
    rows = []
    for f in range(families):
        own = [f"f{f}x{i}" for i in range(40)]
        rows += [" ".join(passage + own), " ".join(passage + own[:-1] + ["end"])]
    rng.shuffle(rows)
    return rows


def test_all_pairs_of_a_crowded_bucket(spark):
    s = near_dups.Settings(sketches=4, picks=1)
    for letter in "pqrstuvw":  # the first whose passage has the least hash for many
        rows = shared_passage(random.Random(3), 60, letter)
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        hashed = df.select(F.col("doc_id").alias("row"), near_dups._word_hashes(F.col("text"), F.xxhash64, "bigint").alias("words"))
        sketch = {r["row"]: r["sketches"][0] for r in near_dups.sketch_texts(hashed, s).collect()}
        if max(Counter(sketch.values()).values()) > 20:
            break
    assert max(Counter(sketch.values()).values()) > 20  # many families in one bucket
    family = lambda i: rows[i].split(" ")[60]
    want = Counter((family(i), sketch[i]) for i in sketch)
    want = {frozenset(i for i in sketch if (family(i), sketch[i]) == k) for k, n in want.items() if n > 1}
    classed, name = near_dups.near_duplicate_classes(df, s)
    out = classed.collect()
    found = partition([r[name] for r in out], [r["doc_id"] for r in out])
    assert all(any(w <= g for g in found) for w in want)  # members of large buckets may meet in others too
    assert all(len({family(i) for i in g}) == 1 for g in found)
    # pair by pair gives the same
    classed, name = near_dups.near_duplicate_classes(df, s._replace(small=1000))
    out = classed.collect()
    few = partition([r[name] for r in out], [r["doc_id"] for r in out])
    assert all(any(f <= g for g in found) for f in few) and all(any(w <= f for f in few) for w in want)


def test_crowd_with_a_repeated_line_meets_once_a_pair(spark):
    s, rng = near_dups.Settings(), random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(80):  # a line of two words over and over, and words of the text's own
        own = [vocabulary[int(3000 * rng.random() ** 4)] for _ in range(52)]
        texts.append(own + ["is", "onhe"] * rng.randrange(92, 100))
    texts += [["new", *t[1:]] for t in texts[:10]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row long, text string")
    words = df.select("row", near_dups._word_hashes(F.col("text"), F.hash, "int").alias("words"))
    nodes = words.select(F.col("row").alias("node"), (F.size("words") - 4).cast("long").alias("n"), F.col("row").alias("label"))
    met = [(r["a"], r["b"]) for r in near_dups._meetings(near_dups._prefixes(nodes, words, s), "token", s).collect()]
    bags = [Counter(t) for t in texts]
    every = [(i, j) for j in range(len(texts)) for i in range(j)]
    want = {(i, j) for i, j in every if sum((bags[i] & bags[j]).values()) >= near_dups.least_words(max(len(texts[i]), len(texts[j])), s)}
    assert want <= set(met) and {(i, 80 + i) for i in range(10)} <= want
    assert len(want) > 0.1 * len(every)  # words don't tell this crowd apart
    assert len(met) <= 1.3 * len(set(met))  # many words of the prefixes are shared, and a pair meets at the first


def test_hubs_of_near_lengths(spark):
    members = [("b", 10 * k + i, n, 10 * k + i, 977 * k + i) for k, n in enumerate((40, 100, 300, 900)) for i in range(5)]
    df = spark.createDataFrame([(1, *m[1:]) for m in members], "bucket long, node long, n long, label long, mark long")
    for turn in range(3):
        met = near_dups._hub_pairs(df, turn, near_dups.Settings()).collect()
        assert {x for r in met for x in (r["a"], r["b"])} == {m[1] for m in members}
        assert all(r["a"] // 10 == r["b"] // 10 for r in met)
    two = df.drop("bucket").crossJoin(spark.range(4).withColumnRenamed("id", "bucket"))
    hubs = {frozenset(r) for r in near_dups._hub_pairs(two, 0, near_dups.Settings()).collect()}
    assert len(hubs) > 16  # buckets take hubs of their own


def test_best_alignment_decides():
    s = near_dups.Settings()
    a = list(range(49))
    b = a[:20] + [a[21]] + a[21:]
    assert near_dups.alignment_similarity(a, b, s) == 0.8  # 40 of 50; along the fewest edits 39 of 51

    def slow(a, b):
        """Over all alignments."""
        best = {(0, 0, 0): 0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                for run in range(6):
                    at = best.get((i, j, run))
                    if at is None:
                        continue
                    onward = [((i + 1, j, 0), at), ((i, j + 1, 0), at)]
                    if i < len(a) and j < len(b) and a[i] == b[j]:
                        onward.append(((i + 1, j + 1, min(run + 1, 5)), at + (run >= 4)))
                    for to, value in onward:
                        best[to] = max(best.get(to, -1), value)
        return max(best.get((len(a), len(b), run), -1) for run in range(6))

    rng = random.Random(7)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randrange(20, 40))]
        b = list(a)
        for _ in range(rng.randrange(1, 3)):
            b[rng.randrange(len(b))] = rng.randrange(6)
        want = slow(a, b)
        total = len(a) + len(b) - 8
        assert near_dups.most_matched(a, b, 5, total, 0) == want
        got = near_dups.alignment_similarity(a, b, s)
        assert (got >= 0.8) == (want >= 0.8 * (total - want))


def test_edits_within():
    rng = random.Random(9)
    for _ in range(400):
        a = [rng.randrange(8) for _ in range(rng.randrange(0, 40))]
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = [rng.randrange(8) for _ in range(rng.randrange(3))]
        want = word_edits([str(w) for w in a], [str(w) for w in b])
        for most in (0, want - 1, want, want + 3, 50):
            assert near_dups.edits_within(a, b, max(most, 0)) == (want if want <= max(most, 0) else -1)


def test_linked_texts_share_enough_words():
    s = near_dups.Settings()
    rng = random.Random(11)
    for _ in range(300):
        a = np.array([rng.randrange(10) for _ in range(rng.randrange(6, 60))])
        b = a.tolist()
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(10)] * rng.randrange(2)
        b = np.array(b)
        total = len(a) + len(b) - 8
        in_order = near_dups.alignment_similarity(a.tolist(), b.tolist(), s) >= 0.8 if min(len(a), len(b)) >= 5 else False
        edited = word_edits(a.astype(str).tolist(), b.astype(str).tolist()) <= 0.2 * max(len(a), len(b)) + 1e-9
        if total > 0 and min(len(a), len(b)) >= 5:
            assert near_dups.linked(a, b, s) == (in_order or edited)
