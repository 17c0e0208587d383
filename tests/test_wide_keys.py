"""Tracker tables of many users, as larger copies of the tables with shifted keys have them."""

from pyspark.sql import functions as F

from tallywell.plans import adapters as AD


def test_no_user_is_closed_before_created(spark):
    events = spark.sql(
        "select id event_id, timestamp_ntz'2024-01-15 10:00:00' ts, id * 9000 user_id, 'purchase' event_type, '{}' props"
        " from range(10)"
    )
    conversations = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    issues = AD.tracker_tables(events, conversations)["issues"]
    assert issues.where(F.col("closed_at") < F.col("created_at")).count() == 0
    on_time = issues.where("created_at < timestamp_ntz'2024-01-15 10:00:00'")
    assert on_time.where("closed_at = timestamp_ntz'2024-01-15 10:00:00'").count() == on_time.count() == 3
