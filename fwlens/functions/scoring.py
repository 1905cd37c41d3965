"""Scores, severities, explanations and recommendations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fwlens.config import Config
from fwlens.functions.columns import literal_map

SEVERITIES = ("Low", "Medium", "High", "Critical")

# Advice per alert type.
RECOMMENDATIONS = {
    "Repeated blocked connections": [
        "Review authentication logs.",
        "Check whether a successful login occurred after the failures.",
        "Confirm whether the source is an authorized system.",
        "Review the targeted account or service.",
    ],
    "Port scan": [
        "Check whether the source is an authorized scanner.",
        "Identify the ports contacted.",
        "Inspect other activity from the same host.",
        "Verify whether the scan was planned.",
    ],
    "Host scan": [
        "Investigate why the source contacted many systems.",
        "Confirm whether it is an administrative or inventory tool.",
        "Inspect endpoint activity.",
    ],
    "Large outbound transfer": [
        "Verify the destination.",
        "Check whether the traffic corresponds to backup or update activity.",
        "Review the source system.",
        "Identify the transferred data when authorized.",
    ],
    "Suspicious off-hours activity": [
        "Confirm whether the activity was expected during the observed time.",
        "Review related blocked connections or unusual ports.",
        "Compare the source behavior with normal business-hours activity.",
    ],
}


def severity_of(score: Column, config: Config) -> Column:
    bands = config.severity
    return (
        F.when(score <= bands.low_max, "Low")
        .when(score <= bands.medium_max, "Medium")
        .when(score <= bands.high_max, "High")
        .otherwise("Critical")
    )


def severity_rank(severity: Column) -> Column:
    ranks = {name: place for place, name in enumerate(SEVERITIES, start=1)}
    return F.coalesce(literal_map(ranks)[severity], F.lit(0))


def alert_score(alert_type: Column, config: Config) -> Column:
    return F.coalesce(literal_map(config.alert_scores())[alert_type], F.lit(0))


def incident_score(types: Column, config: Config) -> Column:
    """Sum over the distinct alert types plus the bonus for several of them, at most 100."""
    kinds = F.array_distinct(types)
    total = F.aggregate(kinds, F.lit(0), lambda sum_so_far, kind: sum_so_far + alert_score(kind, config))
    bonus = F.when(F.size(kinds) > 1, config.correlation.multiple_alert_bonus).otherwise(0)
    return F.least(total + bonus, F.lit(100))


def score_breakdown(types: Column, config: Config) -> Column:
    kinds = F.array_sort(F.array_distinct(types))
    scored = F.filter(kinds, lambda kind: alert_score(kind, config) != 0)
    lines = F.transform(scored, lambda kind: F.concat(kind, F.lit(": +"), alert_score(kind, config).cast("string")))
    bonus = F.when(
        F.size(kinds) > 1, F.array(F.lit(f"Multiple alert types bonus: +{config.correlation.multiple_alert_bonus}"))
    ).otherwise(F.array().cast("array<string>"))
    final = F.array(F.concat(F.lit("Final score: "), incident_score(types, config).cast("string")))
    return F.array_join(F.concat(lines, bonus, final), " | ")


def recommendations(types: Column) -> Column:
    advice = F.create_map(
        *[part for kind, lines in RECOMMENDATIONS.items() for part in (F.lit(kind), F.array(*map(F.lit, lines)))]
    )
    none = F.array().cast("array<string>")
    per_type = F.transform(F.array_sort(F.array_distinct(types)), lambda kind: F.coalesce(advice[kind], none))
    return F.array_join(F.array_distinct(F.flatten(per_type)), " | ")


def incident_explanation(
    src_ip: Column, alerts: Column, events: Column, types_text: Column, destinations: Column, ports: Column, risk: Column
) -> Column:
    """``destinations`` and ``ports`` are the numbers of distinct values; their sentences appear only when positive."""
    return F.concat_ws(
        " ",
        F.format_string("The source IP %s produced %d alert(s) involving %d event(s).", src_ip, alerts, events),
        F.format_string("Observed alert type(s): %s.", types_text),
        F.when(destinations > 0, F.format_string("The activity affected %d destination value(s).", destinations)),
        F.when(ports > 0, F.format_string("The activity involved %d destination port value(s).", ports)),
        F.format_string(
            "These suspicious behaviors produced a risk score of %d out of 100 and require investigation.", risk
        ),
    )
