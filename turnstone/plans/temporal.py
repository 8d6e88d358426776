"""Joins on time bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.operators import intervals
from turnstone.plans.catalogue import _FACTS, _facts, query, table


@query(f"SELECT e.event_id, f.predicate, f.object FROM events e JOIN (SELECT * FROM {_FACTS}) f ON f.subject = 'u' || e.user_id AND f.valid_from <= e.ts AND (f.valid_to IS NULL OR f.valid_to > e.ts)")
def facts_at_each_event(spark, sf):
    """All facts about a user that hold at the time of each of its events."""
    asked = table(spark, sf, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("subject"), "ts")
    return intervals.within(asked, _facts(spark, sf), "subject", "ts").select("event_id", "predicate", "object")


@query("SELECT e.event_id, l.ts AS since, l.event_id AS last FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') l ON e.user_id = l.user_id AND e.ts >= l.ts")
def last_error_before(spark, sf):
    """For every event the last error of its user until then."""
    events = table(spark, sf, "events")
    errors = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("last"))
    return intervals.last_before(events.select("event_id", "user_id", "ts"), errors, "user_id", "ts", "since", ["last"]).select("event_id", "since", "last")
