"""Run totals from the ledger, and build results from JSON artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions.text import first_segment, last_segment

# Statuses that mean a node did not succeed, and duration bucket bounds in seconds.
FAILED_STATUSES = ["error", "fail", "runtime error"]
DURATION_BOUNDS = [0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000]

RUN_RESULTS_SCHEMA = (
    "metadata struct<invocation_id:string,generated_at:timestamp>, elapsed_time double, "
    "results array<struct<unique_id:string,status:string,execution_time:double,message:string,failures:bigint,"
    "timing:array<struct<name:string,started_at:timestamp,completed_at:timestamp>>>>"
)


def _last_attempt(ledger: DataFrame) -> DataFrame:
    """Each window's outcome is its last attempt within the run."""
    keys = ["run_id", "source", "table", "zone", "grain", "window_start"]
    values = F.struct("rows", "bytes", "error")
    return (
        ledger.groupBy(*keys)
        .agg(F.max_by(values, "attempt").alias("_v"))
        .select(*keys, "_v.rows", "_v.bytes", "_v.error")
    )


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Per run and table: planned windows, failed windows, rows and bytes of the others."""
    ok = F.col("error").isNull()
    return (
        _last_attempt(ledger)
        .groupBy("run_id", "source", "table", "zone")
        .agg(
            F.count(F.lit(1)).alias("windows"),
            F.count_if(~ok).alias("failed_windows"),
            F.coalesce(F.sum(F.when(ok, F.col("rows"))), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"),
        )
    )


def failed_windows(ledger: DataFrame) -> DataFrame:
    """One row per window whose last attempt failed, with its error."""
    return _last_attempt(ledger).where(F.col("error").isNotNull()).select(
        "run_id", "source", "table", "zone", "window_start", "error"
    )


def write_counters(ledger: DataFrame) -> DataFrame:
    """Rows and bytes written per (source, table, zone), over all runs."""
    return (
        ledger.where(F.col("error").isNull())
        .groupBy("source", "table", "zone")
        .agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    )


def duration_bucket(seconds: Column) -> Column:
    """Upper bound of the bucket holding ``seconds``; NULL above the last bound."""
    bound = F.lit(None).cast("int")
    for b in reversed(DURATION_BOUNDS):
        bound = F.when(seconds <= b, F.lit(b)).otherwise(bound)
    return bound


def duration_histogram(steps: DataFrame) -> DataFrame:
    """Per (step, outcome, bucket): count and sum of ``duration_seconds``."""
    return steps.groupBy("step", "outcome", duration_bucket(F.col("duration_seconds")).alias("upper_bound")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_seconds").alias("total_seconds")
    )


SKETCH_K = 400
SKETCH_ERROR = 0.0085  # of a rank, with 99 % confidence, for any number of values


def duration_sketches(steps: DataFrame, day: Column, k: int = SKETCH_K) -> DataFrame:
    """Per (step, outcome, day) a quantile sketch of ``duration_seconds`` and the number of values.

    A sketch has a bounded size and merges with others, so days are kept and any range is answered
    from them; the fixed buckets of ``duration_histogram`` stand beside it. Nulls are left out.
    """
    seconds = F.col("duration_seconds").cast("double")
    return (
        steps.where(seconds.isNotNull())
        .groupBy("step", "outcome", day.alias("day"))
        .agg(F.kll_sketch_agg_double(seconds, k).alias("sketch"), F.count(F.lit(1)).alias("n"))
    )


def sketched_quantiles(sketches: DataFrame, quantiles: list[float], k: int = SKETCH_K) -> DataFrame:
    """``(step, outcome, n, quantile, seconds)`` over all days of ``sketches``, which are merged."""
    whole = sketches.groupBy("step", "outcome").agg(
        F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n")
    )
    asked = [
        F.struct(F.lit(float(q)).alias("quantile"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("seconds"))
        for q in quantiles
    ]
    return whole.select("step", "outcome", "n", F.inline(F.array(*asked)))


def ledger_steps(ledger: DataFrame) -> DataFrame:
    """One step per table write of a run, for ``duration_histogram``."""
    return ledger.groupBy("run_id", "table", "attempt").agg(
        F.max("duration_seconds").alias("duration_seconds"), F.count("error").alias("errors")
    ).select(
        F.col("table").alias("step"),
        F.when(F.col("errors") > 0, F.lit("failure")).otherwise(F.lit("success")).alias("outcome"),
        "duration_seconds",
    )


def read_run_results(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Build artefacts: one JSON document per file, or one per line where they are kept together.

    An artefact that is broken or cut short raises when it is read.
    """
    return spark.read.schema(RUN_RESULTS_SCHEMA).json(path, multiLine=not one_per_line, mode="FAILFAST")


def _phase(name: str) -> Column:
    return F.get(F.filter(F.col("n.timing"), lambda t: t["name"] == name), F.lit(0))


def explode_results(docs: DataFrame) -> DataFrame:
    """One row per node: id, type, name, status, timing, failures, and whether it failed.

    Times come from the ``execute`` phase, else ``compile``; with neither, only the duration is
    known and it is the execution time.
    """
    phase = F.coalesce(_phase("execute"), _phase("compile"))
    nodes = docs.select(
        F.col("metadata.invocation_id").alias("invocation_id"),
        F.col("metadata.generated_at").alias("generated_at"),
        "elapsed_time",
        F.explode("results").alias("n"),
    )
    spent = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return nodes.select(
        "invocation_id",
        "generated_at",
        "elapsed_time",
        F.col("n.unique_id").alias("unique_id"),
        first_segment(F.col("n.unique_id")).alias("resource_type"),
        last_segment(F.col("n.unique_id")).alias("name"),
        F.col("n.status").alias("status"),
        F.col("n.execution_time").alias("execution_time"),
        F.col("n.message").alias("message"),
        F.col("n.failures").alias("failures"),
        phase["started_at"].alias("started_at"),
        phase["completed_at"].alias("completed_at"),
        F.col("n.status").isin(FAILED_STATUSES).alias("is_failed"),
    ).withColumn("duration_seconds", F.coalesce(spent, "execution_time"))


def run_results(spark: SparkSession, path: str) -> DataFrame:
    return explode_results(read_run_results(spark, path))


def status_counts(nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Node count per status, optionally within ``by`` columns such as the pass or resource type."""
    return nodes.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n_nodes"))


def failed_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_failed")


def build_totals(nodes: DataFrame, transforms: DataFrame, pass_col: str = "invocation_id") -> DataFrame:
    """One row per build step: nodes and failures of each pass, rows and bytes of each transform."""
    passes = nodes.groupBy(F.col(pass_col).alias("step")).agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if("is_failed").alias("failed")
    ).select(F.lit("pass").alias("kind"), "step", "nodes", "failed", F.lit(None).cast("bigint").alias("rows"),
             F.lit(None).cast("bigint").alias("bytes"))
    derived = ledger_summary(transforms).groupBy(F.col("table").alias("step")).agg(
        F.sum("failed_windows").alias("failed"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")
    ).select(F.lit("transform").alias("kind"), "step", F.lit(None).cast("bigint").alias("nodes"), "failed", "rows",
             "bytes")
    return passes.unionByName(derived)
