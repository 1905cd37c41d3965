"""Plain-language reasons for unusual windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fwlens.functions.columns import fixed1, general
from fwlens.operators.quantiles import column_quantiles

# Explained features and their wording, in order of preference.
LABELS = {
    "unique_dst_ports": "Number of destination ports",
    "bytes_sent_total": "Outgoing data volume",
    "unique_dst_ips": "Number of destination machines",
    "connection_count": "Connection count",
    "blocked_ratio": "Blocked-connection ratio",
    "bytes_received_total": "Incoming data volume",
}
OFF_HOURS_TEXT = "Activity occurred outside the configured working hours."
FALLBACK_TEXT = (
    "The combined behavior differs from the dataset baseline; no single feature exceeded 1.5 times its median."
)


def feature_medians(features: DataFrame) -> DataFrame:
    """One row with the exact median of each explained feature over all windows."""
    long = column_quantiles(features, list(LABELS), [0.5])
    return long.agg(
        *[F.coalesce(F.max(F.when(F.col("name") == name, F.col("quantile"))), F.lit(0.0)).alias(name) for name in LABELS]
    )


def explanation(medians: Column) -> Column:
    """Up to three statements per row, strongest first; ``medians`` is a struct with the explained features."""
    reasons = []
    for place, (name, label) in enumerate(LABELS.items()):
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        median = medians[name]
        times = F.when(median > 0, value / F.when(median > 0, median)).when(value > 0, value + 1).otherwise(1.0)
        text = F.concat(
            F.lit(f"{label} is "), fixed1(times), F.lit(" times higher than the dataset median ("), general(value),
            F.lit(" vs "), general(median), F.lit(")."),
        )
        reasons.append(F.when(times >= 1.5, F.struct((-times).alias("w"), F.lit(place).alias("p"), text.alias("t"))))
    off_hours = F.struct(F.lit(-2.0).alias("w"), F.lit(len(LABELS)).alias("p"), F.lit(OFF_HOURS_TEXT).alias("t"))
    reasons.append(F.when(F.col("off_hours_indicator") == 1, off_hours))
    strongest = F.slice(F.array_sort(F.array_compact(F.array(*reasons))), 1, 3)
    text = F.array_join(F.transform(strongest, lambda reason: reason["t"]), " ")
    return F.when(text != "", text).otherwise(FALLBACK_TEXT)


def explain_anomalies(features: DataFrame) -> DataFrame:
    """Adds ``ai_explanation``; the medians come as a one-row subquery."""
    medians = feature_medians(features).select(F.struct(*LABELS)).scalar()
    return features.withColumn("_medians", medians).withColumn("ai_explanation", explanation(F.col("_medians"))).drop("_medians")
