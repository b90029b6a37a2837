"""Served aggregates: filters, overview, time buckets, dimensions and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.operators.metrics import finished, block, metric_block

UNITS = {"D": "day", "W": "week", "M": "month", "ME": "month", "Q": "quarter", "QE": "quarter"}


def apply_filters(cases: DataFrame, filters: dict[str, object], date_from: str | None = None, date_to: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Equality, IN and date filters; unknown fields are reported, not an error."""
    ignored: dict[str, str] = {}
    for name, wanted in filters.items():
        if wanted is None or wanted == []:
            continue
        if name not in cases.columns:
            ignored[name] = "no such field"
            continue
        cases = cases.filter(F.col(name).isin(*(wanted if isinstance(wanted, (list, tuple, set)) else [wanted])))
    for bound, value in ((">=", date_from), ("<=", date_to)):
        if value is not None:
            if "created_at" not in cases.columns:
                ignored["date"] = "created_at is not available"
            else:
                cases = cases.filter(F.expr(f"created_at {bound} timestamp_ntz'{value}'"))
    return cases, ignored


def overview(cases: DataFrame) -> DataFrame:
    """The metric block with open and resolved counts; a case without a status counts as open."""
    resolved = F.coalesce(F.sum(F.coalesce(F.col("is_resolved"), F.lit(False)).cast("long")), F.lit(0))
    raw = cases.agg(*block(cases.columns), resolved.alias("resolved_count"))
    return finished(raw.withColumn("open_count", F.col("ticket_volume") - F.col("resolved_count")), ["resolved_count", "open_count"])


def status_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def timeseries(cases: DataFrame, freq: str) -> DataFrame:
    """The block by the start of each day, week (from Monday), month or quarter."""
    dated = cases.filter("created_at IS NOT NULL").withColumn("bucket", F.date_trunc(UNITS[freq], "created_at").cast("date"))
    return metric_block(dated, ["bucket"])


def by_dimension(cases: DataFrame, dimension: str, sort_by: str = "ticket_volume", limit: int = 100) -> DataFrame:
    """The block by category, null left out, the largest ``sort_by`` first; a top-k report."""
    out = metric_block(cases.filter(F.col(dimension).isNotNull()), [dimension])
    return out.withColumn("small_sample", F.col("ticket_volume") < 30).orderBy(F.coalesce(F.col(sort_by), F.lit(-1)).desc(), dimension).limit(limit)


def paginate(cases: DataFrame, key: str, page: int, size: int, columns: list[str]) -> DataFrame:
    """One page by an explicit order; the page size is held to 1..200."""
    size = min(max(size, 1), 200)
    return cases.orderBy(key).offset((max(page, 1) - 1) * size).limit(size).select(*columns)
