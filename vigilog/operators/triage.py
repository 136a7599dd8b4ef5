"""Triage events folded into alerts, and their audit trail.

A triage event is (alert_id, event_id, timestamp, actor, actor_role, status,
triage_note). Events of one alert apply in (timestamp, event_id) order. One
alert may own a large part of all events, so the fold over its history is a
prefix scan: each time chunk is worked on by itself and gives one summary row, and the summaries of
an alert are combined in order. Events never meet under their alert alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import ALERT_STATUSES, ALERTS, AUDIT, conform
from ..session import stage

NOTE_LIMIT = 1000


def _refusal() -> Column:
    """Why an event is not applied; NULL if it is."""
    known = F.coalesce(F.col("status").isin(*ALERT_STATUSES), F.lit(False))
    return F.when(~known, "unknown status").when(F.length("triage_note") > NOTE_LIMIT, "note too long")


def clean_events(events: DataFrame) -> DataFrame:
    """Events that are applied: an allowed status and no overlong note; notes trimmed, blank ones NULL.

    The others come out of ``refused_events``.
    """
    note = F.trim("triage_note")
    return events.where(_refusal().isNull()).withColumn("triage_note", F.when(note != "", note))


def refused_events(events: DataFrame) -> DataFrame:
    """The events that are not applied, whole, with the reason."""
    return events.withColumn("reason", _refusal()).where("reason IS NOT NULL")


def _scanned(events: DataFrame, chunk: str) -> DataFrame:
    """Applied events with what is known of them inside their chunk.

    ``_before`` is the status before the event and ``_taken`` the last actor who took the alert by changing its
    status; both are NULL for what only earlier chunks can tell.
    """
    inside = W.partitionBy("alert_id", "_chunk").orderBy("timestamp", "event_id")
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = clean_events(events).withColumn("_chunk", F.date_trunc(chunk, "timestamp"))
    rows = rows.withColumn("_before", F.lag("status").over(inside))
    # NULL before the first event of a chunk, so that one never counts as a change here.
    changed = F.when(F.col("status") != F.col("_before"), F.col("actor"))
    return rows.withColumn("_taken", F.last(changed, ignorenulls=True).over(so_far))


def _chunks(rows: DataFrame) -> DataFrame:
    """One summary per chunk of an alert, with what the chunks before it hand on.

    ``_first`` and ``_last`` are the chunk's outer events, ``_opening`` the first event of the alert.
    ``_earlier`` is the status and ``_held`` the last actor who took the alert before the chunk; ``_entry`` is the actor of
    the chunk's first event if that took it. None of them knows the alert: that is left to its first event.
    """
    order = F.struct("timestamp", "event_id")
    ends = rows.groupBy("alert_id", "_chunk").agg(
        F.min_by(F.struct("status", "actor"), order).alias("_first"),
        F.max_by(F.struct("status", "_taken", "triage_note", "timestamp"), order).alias("_last"),
    )
    chunks = W.partitionBy("alert_id").orderBy("_chunk")
    earlier = chunks.rowsBetween(W.unboundedPreceding, -1)
    known = ends.withColumn("_earlier", F.lag("_last.status").over(chunks)).withColumn(
        "_entry", F.when(F.col("_first.status") != F.col("_earlier"), F.col("_first.actor"))
    )
    taken = F.coalesce("_last._taken", "_entry")
    return known.withColumns(
        {
            "_held": F.last(taken, ignorenulls=True).over(earlier),
            "_opening": F.first("_first").over(chunks.rowsBetween(W.unboundedPreceding, 0)),
        }
    )


def _opener(status0: Column, assigned0: Column) -> Column:
    """The actor of an alert's first event if it takes the alert: its status changes, or nobody had it."""
    opening = F.col("_opening")
    return F.when((opening["status"] != status0) | assigned0.isNull(), opening["actor"])


def _assigned(column: str = "assigned_to") -> Column:
    return F.when(F.col(column) != "", F.col(column))


def triage_history(alerts: DataFrame, events: DataFrame, chunk: str = "hour") -> DataFrame:
    """Every applied event with the status before it and the assignee after it."""
    rows = stage(_scanned(events, chunk), "triage-events")
    known = alerts.select(F.col("id").alias("alert_id"), F.col("status").alias("_status0"), _assigned().alias("_assigned0"))
    handed = _chunks(rows).drop("_first", "_last").join(known, "alert_id")
    each = rows.join(handed, ["alert_id", "_chunk"])
    takers = ("_taken", "_entry", "_held", _opener(F.col("_status0"), F.col("_assigned0")), "_assigned0")
    return each.select(
        "alert_id",
        "event_id",
        "timestamp",
        "actor",
        "actor_role",
        F.coalesce("_before", "_earlier", "_status0").alias("old_status"),
        F.col("status").alias("new_status"),
        F.coalesce(*takers).alias("assigned_to"),
        "triage_note",
    )


def apply_triage(alerts: DataFrame, events: DataFrame, chunk: str = "hour") -> DataFrame:
    """Alerts after all their triage events: the summary of an alert's last chunk is all it takes."""
    last = F.struct(
        F.col("_last.status").alias("status"),
        F.coalesce("_last._taken", "_entry", "_held").alias("taken"),
        F.col("_last.triage_note").alias("triage_note"),
        F.col("_last.timestamp").alias("timestamp"),
    )
    final = _chunks(_scanned(events, chunk)).groupBy(F.col("alert_id").alias("id")).agg(
        F.max_by(last, "_chunk").alias("_t"), F.any_value("_opening").alias("_opening")
    )
    joined = conform(alerts, ALERTS).join(final, "id", "left")
    touched = F.col("_t").isNotNull()

    def updated(new: Column, old: str) -> Column:
        return F.when(touched, new).otherwise(F.col(old))

    assignee = F.coalesce("_t.taken", _opener(F.col("status"), _assigned()), _assigned())
    return conform(
        joined.withColumns(
            {
                "status": updated(F.col("_t.status"), "status"),
                "assigned_to": updated(assignee, "assigned_to"),
                "triage_note": updated(F.col("_t.triage_note"), "triage_note"),
                "updated_at": updated(F.col("_t.timestamp"), "updated_at"),
            }
        ),
        ALERTS,
    )


def triage_audit(alerts: DataFrame, events: DataFrame, chunk: str = "hour") -> DataFrame:
    """One audit row per applied event."""
    h = triage_history(alerts, events, chunk)
    details = F.to_json(
        F.struct("old_status", "new_status", "assigned_to", "triage_note"),
        {"ignoreNullFields": "false"},
    )
    rows = h.select(
        "timestamp",
        F.col("actor").alias("actor_username"),
        "actor_role",
        F.lit("alert_triage_update").alias("action"),
        F.lit("alert").alias("target_type"),
        F.col("alert_id").cast("string").alias("target_id"),
        details.alias("details"),
    )
    return conform(rows, AUDIT)
