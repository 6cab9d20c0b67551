"""The pipeline stage by stage, and the queries that SQL can express."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lodestone.llm import secrets
from lodestone.llm.queries import ORACLES, QUERIES
from tests.compare import connect, same

from .test_free_style import check_pieces
from .test_native_style import dropped, words_of
from .test_near_dups import brute_classes


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    same(spark, connect(sf), sf, QUERIES[name], ORACLES[name])


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        before, kept = kept, {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":
            gone = set(before) - set(kept)
            assert gone and all(labels.get(d, 0) == 0 for d in gone)
        elif name == "near_duplicates":
            ids = sorted(before)
            roots = set(brute_classes([before[i] for i in ids]))
            assert {ids[r] for r in roots} <= set(kept) and len(kept) <= 1.005 * len(roots)
        elif name == "decontamination":
            bad = {d for d, gone in zip(before, dropped(list(before.items()), items), strict=True) if gone}
            assert bad and set(before) - set(kept) == bad
            windows = {tuple(w[i : i + 13]) for w in (words_of(t) for _, t in items) for i in range(len(w) - 12)}
            left = (words_of(t) for t in kept.values())
            assert not any(tuple(w[i : i + 13]) in windows for w in left for i in range(len(w) - 12))
        else:
            assert set(kept) == set(before)
            changed = {d for d in kept if kept[d] != before[d]}
            assert changed == {d for d in before if secrets.text_spans(before[d])}
            assert all("[secret]" in kept[d] for d in changed)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert check_pieces(rows, kept) < 0.02


def test_run_on_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "MarkSweepCompact", "PS MarkSweep"))


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_begin_with_heaps_given_back(spark, sf, at):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    before = full_collections(spark)
    corpus_pipeline.STAGES[at][1](spark, docs, sf)
    assert full_collections(spark) > before
