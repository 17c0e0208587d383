"""What several operators share: staged tables, document columns and row keys."""

from __future__ import annotations

from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.session import shared_dir


HEAP_SHARE = 0.5  # of the driver's heap, beyond which its collector is asked to run

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if _made.get() is not None:
        _made.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def relieve(spark: SparkSession) -> None:
    """A collection of the driver's garbage once its heap has grown beyond ``HEAP_SHARE`` of what it may take.

    An operator of many small jobs leaves the plans and broadcasts of each behind; without this the heap
    grows to its limit, on small inputs too, and is not given back.
    """
    runtime = spark.sparkContext._jvm.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        runtime.gc()


def settled(build, spark: SparkSession, name: str) -> DataFrame:
    """``build()`` staged; the tables that it staged on the way are deleted once that is written.

    So are the shuffle files of its finished steps, which Spark deletes when the driver's collector has found
    that nothing refers to them; it is asked to run. A build that fails leaves its tables, as a build that is retried makes its own.
    """
    token = _made.set([])
    try:
        result, made = build(), _made.get()
    finally:
        _made.reset(token)
    result = stage(result, name)
    delete(spark, made)
    return result


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Folders of staged tables deleted through Hadoop's file system, nobody may read them any more; shuffles without a reader go too."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    jvm.System.gc()


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Only ``(doc_id, text)``; a null text is empty. Columns of other names never reach an operator.

    With ``carry`` a struct ``row`` of all columns but the text goes along, for ``unpacked``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *([row] if carry else []),
    )


def unpacked(rows: DataFrame, docs: DataFrame, text: str = "text", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` from ``rows`` with their carried ``row`` and a text, whose length ``n_chars`` is."""
    new = {text_col: F.col(text), "n_chars": F.length(text).cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def all_same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [same(left[n], right[n]) for n in names])


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
