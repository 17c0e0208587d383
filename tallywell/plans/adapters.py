"""The benchmark tables in the roles of a tracker's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.operators.mentions import TEXT_FIELDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def raw_events(events: DataFrame) -> DataFrame:
    """Every event extracted twice; which extraction is later depends on the row."""
    cols = [
        F.col("event_id").cast("string").alias("id"),
        _id("usr-", "user_id").alias("issue_id"),
        "event_type",
        _id("actor-", "user_id").alias("actor"),
        F.lit(None).cast("string").alias("old_value"),
        F.col("props").alias("new_value"),
    ]
    ts = F.col("ts").alias("created_at")
    first = events.select(
        *cols, F.lit("first").alias("comment"), ts,
        (F.col("ts") + F.make_interval(mins=F.col("user_id").cast("int"))).cast("timestamp").alias("_extracted_at"),
    )
    again = events.select(
        *cols, F.lit("again").alias("comment"), ts,
        (F.col("ts") + F.expr("interval 75 minutes 30 seconds")).cast("timestamp").alias("_extracted_at"),
    )
    return first.unionAll(again)


def order_closings(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders as issues: created on the order date, closed on the last ship date when finished."""
    shipped = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last_ship"))
    return orders.join(shipped, "o_orderkey", "left").withColumn(
        "closed_at", F.when(F.col("o_orderstatus") == "F", F.col("last_ship"))
    )


def order_snapshots(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """``issues`` raw rows, one per order, on the snapshot of its order date."""
    return order_closings(orders, lineitem).select(
        _id("ord-", "o_orderkey").alias("id"),
        _id("order of ", "o_custkey").alias("title"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("issue_type"),
        F.col("o_custkey").alias("priority"),
        _id("cust-", "o_custkey").alias("assignee"),
        F.col("o_orderdate").alias("created_at"),
        F.col("last_ship").alias("updated_at"),
        "closed_at",
        *[F.concat(F.lit(f"{f} "), F.col("o_orderpriority")).alias(f)
          for f in ("close_reason", "description", "design", "acceptance_criteria", "notes")],
        F.col("o_orderdate").cast("date").alias("dt"),
        F.col("o_orderdate").cast("timestamp").alias("_extracted_at"),
    )


def customer_order_days(orders: DataFrame) -> DataFrame:
    """One state per customer and order day: that of the day's last order."""
    return (
        orders.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("order_day"))
        .agg(F.max_by(F.struct("o_orderstatus", "o_orderpriority"), "o_orderkey").alias("s"))
        .select("o_custkey", "order_day", "s.*")
    )


def line_texts(lineitem: DataFrame) -> DataFrame:
    """Each line as an issue row whose text fields name other orders; one declared field is absent."""
    return lineitem.select(
        _id("ord-", "l_orderkey").alias("issue_id"),
        F.concat(F.lit("see (ord-"), "l_partkey", F.lit(") and ord-"), "l_orderkey").alias("title"),
        F.concat(F.lit("blocked by ord-"), "l_suppkey", F.lit("."), "l_linenumber", F.lit(".")).alias("description"),
        F.concat(F.lit("ORD-"), "l_partkey", F.lit(" xord-1, ord-"), "l_suppkey", F.lit("-tail")).alias("design"),
        F.concat(F.lit("éord-"), "l_linenumber", F.lit(" ord-"), "l_linenumber", F.lit("A")).alias("notes"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("ord-"), "l_suppkey", F.lit(",ord-"), "l_suppkey")).alias(
            "close_reason"
        ),
    )


def document_texts(documents: DataFrame) -> DataFrame:
    """Documents as issues named after their source; every word of the text becomes a candidate id."""
    prefix = F.col("source")
    return documents.select(
        F.concat(prefix, F.lit("-"), F.col("doc_id")).alias("issue_id"),
        F.concat(F.lit("about "), prefix, F.lit("-"), F.col("n_chars")).alias("title"),
        F.expr("replace(text, ' ', concat(' ', source, '-'))").alias("description"),
        *[F.lit(None).cast("string").alias(f) for f in TEXT_FIELDS[2:]],
    )


def line_edges(lineitem: DataFrame) -> DataFrame:
    """Dependency edges from each order to its lines' suppliers; one snapshot per day."""
    return lineitem.select(
        F.concat(F.lit("dep-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"),
        _id("ord-", "l_orderkey").alias("issue_id"),
        F.col("l_returnflag").alias("type"),
        _id("ord-", "l_suppkey").alias("depends_on_issue_id"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_shipdate").cast("date").alias("dt"),
        F.col("l_shipdate").cast("timestamp").alias("_extracted_at"),
    )


def type_hour_ledger(events: DataFrame) -> DataFrame:
    """A ledger with a table per event type and up to three attempts per hour; first attempts fail."""
    start = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    attempt = (F.col("user_id") % 3 + 1).cast("int")
    return (
        events.groupBy(F.col("event_type").alias("table"), start.alias("window_start"), attempt.alias("attempt"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("props")).alias("bytes"))
        .select(
            F.lit("run-1").alias("run_id"),
            F.lit("app").alias("source"),
            "table",
            F.lit("raw").alias("zone"),
            F.lit("hour").alias("grain"),
            "window_start",
            (F.col("window_start") + F.expr("interval 1 hour")).alias("window_end"),
            F.when(F.col("attempt") == 1, F.lit(0)).otherwise(F.col("rows")).alias("rows"),
            F.when(F.col("attempt") == 1, F.lit(0)).otherwise(F.col("bytes")).alias("bytes"),
            "attempt",
            F.when(F.col("attempt") == 1, F.concat(F.lit("timeout in "), "table")).alias("error"),
        )
    )


def line_build_documents(lineitem: DataFrame) -> DataFrame:
    """One build artefact as JSON text per line: a model node and a test node."""
    started = F.col("l_shipdate").cast("timestamp")

    def timing(name: str, minutes: int):
        return F.struct(
            F.lit(name).alias("name"),
            started.alias("started_at"),
            (started + F.make_interval(mins=F.lit(minutes))).alias("completed_at"),
        )

    status = F.when(F.col("l_returnflag") == "R", "error").otherwise("success")
    model = F.struct(
        F.concat(F.lit("model.shop.part_"), "l_partkey").alias("unique_id"),
        status.alias("status"),
        F.col("l_quantity").alias("execution_time"),
        F.concat(F.lit("line "), "l_linenumber").alias("message"),
        F.lit(None).cast("bigint").alias("failures"),
        F.when(F.col("l_linestatus") == "F", F.array(timing("compile", 1), timing("execute", 2)))
        .otherwise(F.array(timing("compile", 1)))
        .alias("timing"),
    )
    test = F.struct(
        F.concat(F.lit("test.shop.unique_part.h"), "l_suppkey").alias("unique_id"),
        F.when(F.col("l_discount") > 0.05, "fail").otherwise("pass").alias("status"),
        F.col("l_tax").alias("execution_time"),
        F.lit(None).cast("string").alias("message"),
        F.col("l_linenumber").cast("bigint").alias("failures"),
        F.array(timing("none", 0)).alias("timing"),
    )
    doc = F.struct(
        F.struct(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("invocation_id"),
            started.alias("generated_at"),
        ).alias("metadata"),
        F.col("l_quantity").alias("elapsed_time"),
        F.array(model, test).alias("results"),
    )
    return lineitem.select(F.to_json(doc).alias("json"))


def tracker_tables(events: DataFrame, conversations: DataFrame) -> dict[str, DataFrame]:
    """All seven tracker tables: users are issues, and each event is a commit that changed its user."""
    null = F.lit(None).cast("string")
    user, event = F.col("user_id"), F.col("event_id").cast("string")
    usr = _id("usr-", "user_id")
    actor = F.concat(F.lit("actor-"), user % 7)
    status = F.create_map(
        *[F.lit(x) for pair in (("view", "open"), ("click", "in_progress"), ("purchase", "closed"),
                                ("error", "blocked"), ("signup", "deferred")) for x in pair]
    )[F.col("event_type")]
    created = F.lit("2023-12-31").cast("timestamp_ntz") + F.make_interval(mins=user.cast("int"))
    issue = [
        usr.alias("id"),
        F.concat(F.lit("user "), user).alias("title"),
        status.alias("status"),
        F.lit("task").alias("issue_type"),
        (user % 5).alias("priority"),
        actor.alias("assignee"),
        created.alias("created_at"),
        F.col("ts").alias("updated_at"),
        # many users, and some are created after the month: one is never closed before that
        F.when(F.col("event_type") == "purchase", F.greatest("ts", created)).alias("closed_at"),
        null.alias("close_reason"),
        F.concat(F.lit("like usr-"), user * 2, F.lit(".")).alias("description"),
        null.alias("design"),
        null.alias("acceptance_criteria"),
        F.concat(F.lit("see usr-"), user + 1).alias("notes"),
        F.col("ts").alias("commit_date"),
    ]
    said = F.make_date(F.lit(2024), F.lit(1), (F.col("conv_id") % 28 + 1).cast("int")).cast("timestamp_ntz")
    return {
        "events": events.select(
            event.alias("id"), usr.alias("issue_id"), F.lit("updated").alias("event_type"), actor.alias("actor"),
            null.alias("old_value"), F.col("props").alias("new_value"), null.alias("comment"),
            F.col("ts").alias("created_at"),
        ),
        "issue_history": events.select(*issue, event.alias("commit_hash"), actor.alias("committer")),
        "commits": events.select(
            event.alias("commit_hash"), actor.alias("committer"), F.col("ts").alias("date"),
            F.col("event_id").alias("commit_order"),
        ),
        "issues": events.select(*issue),
        "comments": conversations.select(
            F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
            _id("conv-", "conv_id").alias("issue_id"), F.col("role").alias("author"), "text",
            said.alias("created_at"), said.alias("commit_date"),
        ),
        "dependencies": events.select(
            _id("dep-", "user_id").alias("id"), usr.alias("issue_id"), F.lit("blocks").alias("type"),
            F.concat(F.lit("usr-"), user + 1).alias("depends_on_issue_id"), F.col("ts").alias("created_at"),
            F.col("ts").alias("commit_date"),
        ),
        "labels": events.select(usr.alias("issue_id"), F.col("event_type").alias("label"), F.col("ts").alias("commit_date")),
    }
