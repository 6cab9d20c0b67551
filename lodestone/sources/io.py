"""Files in and out: documents, pages, chunks, hits, evaluation sets, indexes."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators.analytics import require_unique


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or that of `setCheckpointDir`.

    A session whose executors are threads of the driver and that has neither gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written into the shared folder, and a scan of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version(spark: SparkSession, path: str) -> tuple[str, str, int]:
    """What tells a table's state in this application: where it is and when it last changed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    return spark.sparkContext.applicationId, path, status.getModificationTime()


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, path, size) of files, without reading them; the id is the name without its ending.

    A folder whose name fits counts as one file, of the size of all that it holds: a table may be one file or a folder of them.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath()
    above = len([part for part in root.split("/") if part])
    fits = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    parts = F.split(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", ""), "/")
    # the outermost folder or file below `folder` that fits
    at = F.array_position(F.transform(F.slice(parts, F.lit(above + 2), F.size(parts)), lambda name: F.rlike(name, F.lit(f"^(?:{fits})$"))), True)
    found = files.select("path", "length", parts.alias("parts"), at.cast("int").alias("at")).where("at > 0")
    inner = F.size("parts") - (above + 1 + F.col("at"))
    full = F.split("path", "/")
    whole = F.array_join(F.slice(full, F.lit(1), F.size(full) - inner), "/")
    sizes = found.groupBy(whole.alias("path")).agg(F.sum("length").alias("size"))
    return sizes.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "path", "size")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet; with partitions only those that `df` has are replaced."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_hits_csv(hits: DataFrame, path: str) -> None:
    """Hits as CSV; lists become JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in hits.dtypes]
    hits.select(*flat).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_hits_csv(spark: SparkSession, path: str, schema: str = "query_id string, rank int, score double, doc_id string, page_number int, chunk_id string, pages string") -> DataFrame:
    """Hits from CSV, with `pages` a list again."""
    df = spark.read.option("header", "true").option("escape", '"').schema(schema).csv(path)
    return df.withColumn("pages", arrays.pages_list(F.col("pages"))) if "pages" in df.columns else df


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


EVAL_FIELDS = "query_id string, query_text string, question string, query string, gold_pages array<string>, expected_pages array<string>, expected_answer string, difficulty string, doc_id string, evidence_layout string, expected_section string, expected_subsection string, rewrites array<string>"


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, gold_pages, ...) of a JSON file: a list of items, or an object with them in `queries`."""
    raw = spark.read.option("wholetext", "true").text(path)
    whole = F.from_json("value", f"array<struct<{_struct(EVAL_FIELDS)}>>")
    inner = F.from_json("value", f"struct<queries:array<struct<{_struct(EVAL_FIELDS)}>>>")["queries"]
    return _eval_items(raw.select(F.explode(F.when(F.rlike("value", F.lit(r"^\s*\[")), whole).otherwise(inner)).alias("q")).select("q.*"))


def read_eval_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of JSON lines, an item each: a set of any size, in as many tasks as it has splits."""
    return _eval_items(spark.read.schema(EVAL_FIELDS).json(path))


def _eval_items(items: DataFrame) -> DataFrame:
    pages = F.transform(F.coalesce("gold_pages", "expected_pages", F.array().cast("array<string>")), arrays.int_if_whole)
    text = F.coalesce("query_text", "question", "query")
    return items.select("query_id", text.alias("text"), F.array_compact(pages).alias("gold_pages"), "doc_id", "expected_answer", "difficulty", "evidence_layout", "expected_section", "expected_subsection", "rewrites")


def _struct(fields: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (f.strip().split(" ", 1) for f in fields.split(",")))


def save_index(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Chunks with their vectors in one table; ids have to be unique, and every chunk needs a vector."""
    require_unique(chunks, "chunk_id")
    met = chunks.join(vectors, "chunk_id", "left")
    if met.where("embedding is null").limit(1).count():
        raise ValueError("a chunk has no vector")
    write_table(met, path)


def rebuild_meta(spark: SparkSession, path: str, chunks: DataFrame, to: str) -> None:
    """An index's chunks anew, with the vectors that it has; the chunks have to be as many as the vectors, and the same."""
    vectors = read_table(spark, path).select("chunk_id", "embedding")
    found, wanted = vectors.count(), chunks.count()
    if found != wanted:
        raise ValueError(f"the index has {found} vectors, and there are {wanted} chunks")
    save_index(chunks, vectors, to)


def write_tables(tables: DataFrame, path: str) -> None:
    """Tables (table_id, headers, cells) as CSV lines: table_id, row number (0 is the header), cells."""
    rows = tables.select("table_id", F.posexplode(F.concat(F.array("headers"), "cells")).alias("row_no", "row"))
    quoted = F.transform("row", lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')))
    write_text(rows.select(F.concat_ws(",", "table_id", F.col("row_no").cast("string"), F.array_join(quoted, ",")).alias("line")), "line", path)


def global_index(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """Chunks of all documents whose number of chunks is the one that `counts` (doc_id, n) has."""
    sizes = parts.groupBy("doc_id").agg(F.count("*").alias("found")).join(counts, "doc_id").where("found = n")
    return parts.join(sizes.select("doc_id"), "doc_id", "left_semi")


def manifest(chunks: DataFrame) -> DataFrame:
    """Chunks by owner and document, with subtotals; null stands for all."""
    return chunks.rollup("trust_id", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of frames with different columns; what a frame lacks is null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def page_view(pages: DataFrame, doc_id, page_number: int) -> DataFrame:
    return pages.where((F.col("doc_id") == doc_id) & (F.col("page_number") == page_number))


def list_documents(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """(doc_id, chunks, pages, tables), the first by id."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.countDistinct("page_number").alias("pages"), F.count_if(F.coalesce("is_table", F.lit(False))).alias("tables")).orderBy("doc_id").limit(limit)


def write_manifest(path: str, **values) -> None:
    """What a run was, as a JSON file of the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values | {"written": datetime.now(UTC).isoformat(timespec="seconds")}, f, indent=2, sort_keys=True)
