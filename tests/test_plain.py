"""Queries that SQL doesn't say, against plain Python."""

import math
import random
import re

import pyarrow.parquet as pq
import pytest

from lodestone.operators import chunking, evaluation, tables


def squeezed(text):
    return re.sub(r"[ \t\n\r]+", " ", text).strip(" ")


def test_cross_page_chunks(spark, sf):
    want = {}
    docs = [(d["doc_id"], re.sub(r"[.!?]\n", "\n", d["text"])) for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    for doc_id, whole in docs:
        lines = whole.split("\n")
        pages = [(i // 10 + 1, squeezed("\n".join(lines[i : i + 10]))) for i in range(0, len(lines), 10)]
        pages = [p for p in pages if p[1]]
        for (number, text), (_, following) in zip(pages, pages[1:], strict=False):
            if re.search(r"[.!?:;]['\")\]]*$", text):
                continue
            tail = re.sub(r"^.*[.!?]\s+(?=\S)", "", text[-320:], flags=re.S)
            head = following[:320]
            ended = re.match(r"(.*?[.!?])(?:\s|$)", head)
            want[doc_id, number] = f"{tail} {ended[1] if ended else head}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["page_number"]): r["text"] for r in chunking.cross_page_chunks(chunking.pages_of(df)).collect()}
    assert got == want and want


def test_wilcoxon(spark):
    rng = random.Random(1)
    a = [(i, float(rng.randrange(6))) for i in range(60)]
    b = [(i, float(rng.randrange(8))) for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "query_id long, value double")
    w, p = evaluation.wilcoxon(frame(a), frame(b))
    d = [y - x for (_, x), (_, y) in zip(a, b, strict=True) if x != y]
    sizes = sorted(map(abs, d))
    rank = {s: sum(i + 1 for i, x in enumerate(sizes) if x == s) / sizes.count(s) for s in sizes}
    n, ties = len(d), sum(sizes.count(s) ** 3 - sizes.count(s) for s in set(sizes))
    up = sum(rank[abs(x)] for x in d if x > 0)
    z = (up - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert (w, p) == (pytest.approx(up), pytest.approx(0.5 * math.erfc(z / math.sqrt(2))))
    assert evaluation.wilcoxon(frame(a), frame(a)) == (0.0, 1.0)


def test_best_rows(spark):
    cells = [[f"row {chr(97 + i)}", *(["7"] * (i % 4)), *(["x"] * (3 - i % 4))] for i in range(12)]
    t = spark.createDataFrame([("t", 1, ["a", "b", "c", "d"], cells)], "table_id string, page_number int, headers array<string>, cells array<array<string>>")
    got = [r["row_no"] for r in tables.best_rows(tables.row_records(t), 5).collect()]
    kept = [r["row_no"] for r in tables.row_records(t).collect()]
    best = sorted(sorted(kept, key=lambda i: (-(i % 4), i))[:5])
    assert sorted(got) == best
