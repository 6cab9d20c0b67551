"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything below U+0080 that is neither a digit nor a lower-case letter.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ship_by_value(name: str) -> None:
    """Python functions of module `name` travel to executors inside the task."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship_by_value(__name__)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's `spark.checkpoint.dir`, or the folder of `setCheckpointDir`. Only a
    session without either whose executors are threads of the driver (tests) gets a
    temporary folder, the same for the whole application.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Folders written by `materialize` since each open `scratch` began, the innermost last.
_SCRATCH: list[set[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are written inside, unless they are written to be kept."""
    _SCRATCH.append(set())
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes `df` as Parquet into the shared folder and returns a scan of it.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. `keep` is for
    tables that are read after the `scratch` around has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    if _SCRATCH and not keep:
        _SCRATCH[-1].add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Deletes a table of `materialize` that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestone-" in parent:
            _delete(df.sparkSession, parent)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_line(text: Column) -> Column:
    """The ASCII-lower-cased words of a text, one space apart; null gives ''."""
    upper_free = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")
    return F.trim(upper_free)


def count_words(line: Column) -> Column:
    """The number of words in a `word_line`."""
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(line == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def let(value: Column, body) -> Column:
    """`body(value)`, with the value computed once for a row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Plans made of these give the same rows in the same partitions each time.
_STEADY = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "View", "Relation"}


def _steady(plan) -> bool:
    children = plan.children()
    return plan.nodeName().split(" ")[0] in _STEADY and all(_steady(children.apply(i)) for i in range(children.size()))


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """`df` with a number for each row that is the same whenever the result is read.

    Numbers follow the places of rows in partitions. A table that isn't read straight
    from files is written first, and the split of files no longer follows the number
    of cores that the cluster has at the moment.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if not _steady(df._jdf.queryExecution().optimizedPlan()):
        df = materialize(df, "rows", keep=True)
    return df.withColumn(name, F.monotonically_increasing_id())


def without_rows(numbered: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of `numbered` (by `number_rows`) whose number isn't in the written table `gone` (_row).

    Rows that a Bloom filter clears are passed on where they are read; only the others meet `gone`.
    """
    from . import bloom

    may_go, at = bloom.build(gone, "_row"), fresh(numbered, "_gone")
    gone = gone.select(F.col("_row").alias(at))
    if may_go.words is None:
        return numbered.join(gone, F.col(row) == F.col(at), "left_anti")
    doubtful = may_go.may_contain(F.col(row))
    return numbered.where(~doubtful).unionByName(numbered.where(doubtful).join(gone, F.col(row) == F.col(at), "left_anti"))


def free_memory() -> None:
    """Gives back what a Python worker no longer uses; an idle worker is kept for a while, with all it holds."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trim_executors(spark: SparkSession) -> None:
    """Has each executor's JVM collect its garbage, so that it gives back the heap that earlier work has grown.

    The heap never shrinks otherwise, and a Python worker beside it needs memory of the same
    container. There is a task for each core, so each idle executor gets some. No result depends on it.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()
