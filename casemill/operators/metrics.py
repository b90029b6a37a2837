"""The metric block: every value with the population it was computed over.

One aggregation computes all of it; a value without a population is NULL, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 30
DEFINITIONS = {
    "ticket_volume": "rows",
    "resolution_time_hours": "resolved cases with positive hours (all cases with positive hours if none is resolved)",
    "response_time_hours": "cases with response hours of zero or more",
    "escalation_rate": "cases whose escalation is known",
    "sla_breach_rate": "cases with a known service-level outcome",
    "csat": "cases with a rating",
}
METRICS = ["resolution_time_hours", "response_time_hours", "escalation_rate", "sla_breach_rate", "csat"]


def _in(name: str, columns: list[str], kind: str) -> Column:
    return F.col(name) if name in columns else F.lit(None).cast(kind)


def block(columns: list[str]) -> list[Column]:
    """Raw aggregates; ``finished`` turns them into the block."""
    hours, response = _in("resolution_time_hours", columns, "double"), _in("response_time_hours", columns, "double")
    resolved = F.coalesce(_in("is_resolved", columns, "boolean"), F.lit(False))
    escalated, breached, csat = _in("escalated", columns, "boolean"), _in("sla_breached", columns, "boolean"), _in("csat_score", columns, "double")
    timed, loose, answered = F.when(resolved & (hours > 0), hours), F.when(hours > 0, hours), F.when(response >= 0, response)
    return [
        F.count(F.lit(1)).alias("ticket_volume"),
        F.bool_or(resolved).alias("_any"),
        *(f(timed).alias(f"_t{k}") for k, f in enumerate((F.avg, F.median, F.count))),
        *(f(loose).alias(f"_l{k}") for k, f in enumerate((F.avg, F.median, F.count))),
        *(f(answered).alias(f"_r{k}") for k, f in enumerate((F.avg, F.median, F.count))),
        F.avg(escalated.cast("int")).alias("_e0"), F.count(escalated).alias("_e2"), F.avg(breached.cast("int")).alias("_s0"), F.count(breached).alias("_s2"),
        F.avg(csat).alias("_c0"), F.count(csat).alias("_c2"),
    ]


def finished(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded values beside their denominators."""
    pick = lambda k: F.when(F.col("_any"), F.col(f"_t{k}")).otherwise(F.col(f"_l{k}"))
    r4 = lambda c: F.round(c, 4)
    return raw.select(
        *keys,
        "ticket_volume",
        r4(pick(0)).alias("resolution_mean"), r4(pick(1)).alias("resolution_median"), F.coalesce(pick(2), F.lit(0)).alias("resolution_n"),
        r4(F.col("_r0")).alias("response_mean"), r4(F.col("_r1")).alias("response_median"), F.col("_r2").alias("response_n"),
        r4(F.col("_e0")).alias("escalation_rate"), F.col("_e2").alias("escalation_n"), r4(F.col("_s0")).alias("sla_breach_rate"), F.col("_s2").alias("sla_n"),
        r4(F.col("_c0")).alias("csat_mean"), F.col("_c2").alias("csat_n"),
        r4(F.try_divide(F.col("_c2"), F.col("ticket_volume"))).alias("csat_response_rate"),
    )


def metric_block(cases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return finished(cases.groupBy(*keys).agg(*block(cases.columns)), keys)


def grouping_sets(cases: DataFrame, dimensions: list[str]) -> DataFrame:
    """Overview and every dimension in one aggregation; ``dimension`` names the set."""
    sets = [[], *([F.col(d)] for d in dimensions)]
    raw = cases.groupingSets(sets, *(F.col(d) for d in dimensions)).agg(*block(cases.columns), *(F.grouping(d).alias(f"_g_{d}") for d in dimensions))
    named = raw.withColumn("dimension", F.coalesce(*(F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dimensions), F.lit("overview")))
    named = named.withColumn("category", F.coalesce(*(F.when(F.col(f"_g_{d}") == 0, F.col(d)) for d in dimensions)))
    return finished(named.filter("dimension = 'overview' OR category IS NOT NULL"), ["dimension", "category"])


def metric_record(value: Column, denominator: Column, definition: str, unit: str = "") -> Column:
    """One metric as a struct; no population: NULL with a note; a small one: a warning."""
    return F.struct(
        F.when(denominator > 0, F.round(value, 4)).alias("value"),
        denominator.alias("denominator"),
        F.lit(definition).alias("definition"),
        F.lit(unit).alias("unit"),
        F.when(denominator == 0, F.lit("no eligible rows")).alias("note"),
        F.when((denominator > 0) & (denominator < SMALL), F.lit("small sample")).alias("warning"),
    )
