"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontaminate, licenses, near_dups, oracles, packing, quality_rules, repeats, secrets, url_filter, warc
from .common import read

TOKENIZER = "word_bpe_49k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs, "found").withColumn("base", F.filter("found", lambda s: s["base"]))
    starts = F.transform("base", lambda s: s["start"])
    told = F.filter("found", lambda s: s["base"] | s["kept"])
    return found.select(
        "doc_id", F.col("found_words").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        licenses.label_list(F.col("base")).alias("base_labels"), licenses.label_list(told).alias("labels"),
        licenses.score(F.col("found")).alias("score"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs, "doc_id", public_tokenizers.path(TOKENIZER))


def crawl_records(pages: DataFrame) -> DataFrame:
    """Pages as a crawl log: each a full response, then a revisit that agrees, then one that may not.

    The canonical URL is `pages` own; time is the page id times 8, plus 1 and 2 for the revisits.
    The third record's entity tag has changed for every fifth page.
    """
    tag = F.md5("html")
    base = pages.select("page_id", url_filter.canonical_url(F.col("url")).alias("url"), tag.alias("tag"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    k, changed = F.col("k"), (F.col("k") == 2) & (F.col("page_id") % 5 == 0)
    none = F.lit(None).cast("string")
    return base.select(
        (F.col("page_id") * 8 + k).alias("record_id"), "url", (F.col("page_id") * 8 + k).alias("at"),
        F.when(k == 0, "response").otherwise("revisit").alias("kind"),
        F.when(F.col("page_id") % 3 != 2, F.when(changed, F.concat(F.lit("x"), "tag")).otherwise(F.col("tag"))).alias("etag"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("m"), F.col("page_id").cast("string"))).alias("last_modified"),
        F.when(k == 0, F.col("tag")).otherwise(none).alias("digest"),
        F.create_map(F.lit("Date"), F.concat(F.lit("d"), k.cast("string")), F.lit("Content-Type"), F.when(k == 0, "text/html").otherwise("none")).alias("headers"),
    )


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(crawl_records(read(spark, sf_dir, "pages")))
    headers = F.col("merged_headers")
    return found.select("record_id", "url", "status", "response_id", F.get(F.map_values(F.map_filter(headers, lambda k, v: k == "date")), F.lit(0)).alias("date_header"), F.get(F.map_values(F.map_filter(headers, lambda k, v: k == "content-type")), F.lit(0)).alias("type_header"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), "found")
    spans = F.col("found")

    def of(*kinds: str) -> Column:
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    def joined(some: Column) -> Column:
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secrets.BASE_KINDS),
        F.sha2(joined(of(*secrets.BASE_KINDS)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), passages=repeats.PASSAGES)
    removed = F.col("n_removed") > 0
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256",
        removed.alias("removed"), "n_passages", "passage_bytes",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.quality_measures(docs)
    distances = [F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")]
    return judged.select(F.col("_doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *distances)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, read(spark, sf_dir, "labels"))
    scored = classifier.with_quality(docs, model, "score")
    return scored.select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, listed = url_filter.default_list(spark)
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules, listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed, name = near_dups.near_duplicate_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return classed.select("doc_id", F.col(name).alias("class_id"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    ids = F.col("item_ids")
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated",
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_packing": op2_packing,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_secret_scan": op4_secret_scan,
    "op5_repeated_strings": op5_repeated_strings,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_filter": op8_url_filter,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_decontamination": op10_decontamination,
}
ORACLES = dict(oracles.ORACLES)
