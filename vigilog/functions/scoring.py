"""Risk arithmetic and display classes as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of an event type, and the weight of any other.
SEVERITY_WEIGHTS = {
    "bruteforce": 100,
    "recon": 75,
    "port_scan": 75,
    "scanning": 75,
    "anomaly": 40,
    "single_anomaly": 40,
}
OTHER_SEVERITY = 40

# Weight of a log source, and the weight of any other.
SOURCE_WEIGHTS = {"firewall": 100, "auth": 80, "nginx": 60, "api": 40, "db": 20}
OTHER_SOURCE = 30

# Shares of the three parts, and the alert threshold.
ANOMALY_SHARE, SEVERITY_SHARE, SOURCE_SHARE = 0.6, 0.3, 0.1
ALERT_THRESHOLD = 70


def _lookup(value: Column, table: dict[str, int], other: int) -> Column:
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(entries, F.lower(F.trim(value))), F.lit(other))


def norm_score(score: Column, score_max: Column) -> Column:
    """Score clipped to [0, max] on a 0-100 scale; 0 where max is not positive."""
    clipped = F.greatest(F.lit(0.0), F.least(score, score_max))
    return F.when(score_max > 0, clipped / score_max * 100.0).otherwise(F.lit(0.0))


def severity_weight(event_type: Column) -> Column:
    return _lookup(event_type, SEVERITY_WEIGHTS, OTHER_SEVERITY)


def source_weight(source: Column) -> Column:
    return _lookup(source, SOURCE_WEIGHTS, OTHER_SOURCE)


def risk(score: Column, score_max: Column, event_type: Column, source: Column) -> Column:
    """0-100 risk; halves round to even."""
    total = (
        norm_score(score, score_max) * ANOMALY_SHARE
        + severity_weight(event_type) * SEVERITY_SHARE
        + source_weight(source) * SOURCE_SHARE
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total, 0).cast("int")))


def event_class(login_fail_count: Column, port_entropy: Column) -> Column:
    """bruteforce above 10 failed logins, recon above 2 bits of port entropy, else anomaly."""
    return (
        F.when(F.coalesce(login_fail_count, F.lit(0)) > 10, "bruteforce")
        .when(F.coalesce(port_entropy, F.lit(0.0)) > 2.0, "recon")
        .otherwise("anomaly")
    )


def severity_of_risk(risk_score: Column) -> Column:
    return F.when(risk_score >= 90, "critical").when(risk_score >= 70, "high").otherwise("medium")


def severity_class(severity: Column) -> Column:
    """Lower-case known severity, else 'unknown'."""
    lowered = F.lower(severity)
    known = lowered.isin("critical", "high", "medium", "low")
    return F.when(known, lowered).otherwise("unknown")


def model_triggered(evidence: Column) -> Column:
    """The model named in the evidence JSON; '' where none (or a falsy value) is named."""
    value = F.get_json_object(evidence, "$.model_triggered")
    return F.when(value.isin("", "false", "0"), "").otherwise(F.coalesce(value, F.lit("")))


def ai_flag(evidence: Column) -> Column:
    return F.when(model_triggered(evidence) != "", "AI").otherwise("Manual")
