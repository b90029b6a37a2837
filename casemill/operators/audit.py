"""What a table can support: field profiles, text repetition, outcomes, time, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as T
from casemill.functions import vocabulary as V


def profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """Non-null, share of nulls and distinct values of each field; '' counts as null for text."""
    kinds = dict(df.dtypes)

    def row(c: str) -> list[tuple[str, Column]]:
        value = F.when(F.col(c) != "", F.col(c)) if kinds[c] == "string" else F.col(c)
        return [
            ("non_null", F.count(value)),
            ("null_pct", F.round(F.coalesce(F.try_divide(100.0 * (F.count(F.lit(1)) - F.count(value)), F.count(F.lit(1))), F.lit(0.0)), 2)),
            ("n_distinct", F.count_distinct(value)),
        ]

    return _unrolled(df, {c: row(c) for c in fields})


def _unrolled(df: DataFrame, per: dict[str, list[tuple[str, Column]]], key: str = "field") -> DataFrame:
    aggs = [c.alias(f"_{k}_{i}") for k, columns in enumerate(per.values()) for i, (_, c) in enumerate(columns)]
    rows = [F.struct(F.lit(name).alias(key), *(F.col(f"_{k}_{i}").alias(label) for i, (label, _) in enumerate(columns))) for k, (name, columns) in enumerate(per.items())]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def numeric_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    def row(c: str) -> list[tuple[str, Column]]:
        x = F.col(c).cast("double")
        quantiles = [(f"p{int(p * 100):02d}", F.round(F.percentile(x, p), 4)) for p in (0.25, 0.5, 0.75, 0.95)]
        return [("n", F.count(x)), ("least", F.min(x)), *quantiles, ("greatest", F.max(x)), ("mean", F.round(F.avg(x), 4)), ("negative", F.count_if(x < 0)), ("zero", F.count_if(x == 0))]

    return _unrolled(df, {c: row(c) for c in fields})


def top_values(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


def text_profile(df: DataFrame, column: str) -> DataFrame:
    """Repetition and length of a text column; all rows count, nothing is sampled. Only digests are told apart, so no text is shuffled."""
    t = F.coalesce(F.col(column), F.lit(""))
    full = df.filter(F.trim(t) != "").select(
        F.sha2(t, 256).alias("t"), F.sha2(T.dedup_normalised(t), 256).alias("norm"), F.length(t).alias("chars"), F.size(F.split(T.squeezed(t), " ")).alias("words"),
        F.size(T.placeholders(t)).alias("tokens"),
    )
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_distinct(c), F.count(c)), F.lit(0.0)), 4)
    percentiles = lambda c: [F.floor(F.percentile(c, p)).alias(f"{c}_p{int(p * 100):02d}") for p in (0.05, 0.5, 0.95)]
    out = full.agg(
        F.count("t").alias("n"),
        F.count_distinct("t").alias("n_distinct"),
        (F.count("t") - F.count_distinct("t")).alias("n_duplicates"),
        share(F.col("t")).alias("unique_ratio"),
        share(F.col("norm")).alias("normalised_unique_ratio"),
        *percentiles("chars"),
        F.max("chars").alias("chars_max"),
        *percentiles("words"),
        F.round(100 * F.avg((F.col("words") > 256).cast("int")), 2).alias("pct_over_256_words"),
        F.count_if(F.col("tokens") > 0).alias("placeholder_rows"),
    )
    ratio = F.col("normalised_unique_ratio")
    return out.withColumn("repetition", F.when(ratio < 0.3, "high").when(ratio < 0.7, "moderate").otherwise("low"))


def numeric_outcome(df: DataFrame, column: str) -> DataFrame:
    """A numeric outcome: valid rows, middle and upper quartile, values of zero or less, distinct values, and whether those are too few."""
    x = F.col(column).cast("double")
    out = df.agg(
        F.count(x).alias("valid"), F.round(F.percentile(x, 0.5), 4).alias("p50"), F.round(F.percentile(x, 0.75), 4).alias("p75"),
        F.count_if(x <= 0).alias("nonpositive"), F.count_distinct(x).alias("n_distinct"),
    )
    return out.withColumn("few_values", F.col("n_distinct") <= 2)


def given_against_derived(df: DataFrame, given: str, start: str = "created_at", end: str = "resolved_at") -> DataFrame:
    """How far given durations (hours) agree with those between two timestamps, over rows that have both."""
    derived = T.hours_between(F.col(start), F.col(end))
    gap = F.abs(F.col(given).cast("double") - derived)
    return df.agg(F.count(gap).alias("n"), F.round(F.median(gap), 4).alias("median_gap"), F.round(F.try_divide(100.0 * F.count_if(gap <= 1), F.count(gap)), 2).alias("pct_within_1h"))


def examples(df: DataFrame, column: str, order: str, k: int = 3) -> DataFrame:
    """The first ``k`` non-empty values by ``order``, redacted and shortened: what a report may show."""
    value = F.col(column).cast("string")
    return df.filter(F.trim(value) != "").orderBy(order).limit(k).select(F.col(order), F.substring(T.redacted(value), 1, 80).alias("example"))


def triage_verdict(triaged: DataFrame) -> DataFrame:
    """The verdict on the whole table: good with a good text column (exit code 0), weak with a weak one (1), else unusable (3)."""
    best = triaged.agg(F.count_if(F.col("verdict") == "good").alias("good"), F.count_if(F.col("verdict") == "weak").alias("weak"))
    verdict = F.when(F.col("good") > 0, "good").when(F.col("weak") > 0, "weak").otherwise("unusable")
    return best.select("good", "weak", verdict.alias("verdict"), F.when(F.col("good") > 0, 0).when(F.col("weak") > 0, 1).otherwise(3).alias("exit_code"))


def pair_duplicates(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.filter((F.trim(a) != "") & (F.trim(b) != ""))
    return both.agg(F.count(F.lit(1)).alias("pairs"), (F.count(F.lit(1)) - F.count_distinct(F.struct(a, b))).alias("duplicates"))


def usable_note(column: str) -> Column:
    trimmed = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    return ~trimmed.isin(V.BOILERPLATE)


def outcome_crosstab(df: DataFrame, status: str, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull() & F.col(status).isNotNull()).groupBy(status).agg(F.count_if(F.col(target)).alias("positive"), F.count_if(~F.col(target)).alias("negative"))


def outcome(df: DataFrame, status: str, target: str) -> DataFrame:
    """Classes of a binary outcome, and whether the status alone decides it."""
    table = outcome_crosstab(df, status, target)
    sums = table.agg(F.coalesce(F.sum("positive"), F.lit(0)).alias("positive"), F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"), F.bool_and((F.col("positive") == 0) | (F.col("negative") == 0)).alias("deterministic_from_status"))
    both = F.col("positive") + F.col("negative")
    return sums.select("positive", "negative", F.round(F.try_divide("positive", both), 4).alias("prevalence"), ((F.col("positive") > 0) & (F.col("negative") > 0)).alias("both_classes"), "deterministic_from_status")


def leakage(df: DataFrame, column: str) -> DataFrame:
    """Rows that contain each phrase which tells an outcome."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    return _unrolled(df, {p: [("n_rows", F.count_if(F.contains(low, F.lit(p))))] for p in V.LEAKAGE}, "phrase")


def time_profile(df: DataFrame) -> DataFrame:
    """Range, density and plausibility of case times."""
    derived = (F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3.6e9
    dated = F.count("created_at")
    pairs = F.count(F.when(F.col("resolved_at").isNotNull(), F.col("created_at")))
    out = df.agg(
        F.min("created_at").cast("date").alias("first_day"),
        F.max("created_at").cast("date").alias("last_day"),
        F.datediff(F.max("created_at"), F.min("created_at")).alias("span_days"),
        F.count_distinct(F.to_date("created_at")).alias("distinct_days"),
        dated.alias("dated"),
        F.count_if(F.col("resolved_at") < F.col("created_at")).alias("violations"),
        F.round(F.try_divide(100.0 * F.count_if(F.col("resolved_at") < F.col("created_at")), pairs), 2).alias("violation_pct"),
        F.round(F.median(F.when(derived >= 0, derived)), 4).alias("derived_hours_p50"),
    )
    return out.withColumn("split_feasible", (F.col("span_days") >= 30) & (F.col("distinct_days") >= 10))


def month_density(df: DataFrame) -> DataFrame:
    return df.filter("created_at IS NOT NULL").groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def pii_totals(df: DataFrame, column: str) -> DataFrame:
    return _unrolled(df, {k: [("hits", F.coalesce(F.sum(c), F.lit(0)))] for k, c in T.pii_counts(F.col(column)).items()}, "kind")


def triage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whether a text column is worth indexing: unusable, weak or good, with the figures behind it."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.trim(F.col(c)).alias("value")) for c in columns)))).filter("value <> ''")
    values = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("times"))
    sums = values.groupBy("field").agg(
        F.sum("times").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.length("value") * F.col("times")).alias("chars"), F.max("times").alias("top")
    )
    ratio = F.round(F.col("n_distinct") / F.col("n"), 4)
    out = sums.select("field", "n", "n_distinct", ratio.alias("ratio"), F.round(F.col("chars") / F.col("n"), 1).alias("mean_chars"), F.round(100 * F.col("top") / F.col("n"), 2).alias("top_pct"))
    weak = (F.col("ratio") < 0.3) | (F.col("mean_chars") < 40)
    return out.withColumn("verdict", F.when((F.col("n") < 50) | (F.col("ratio") < 0.05), "unusable").when(weak, "weak").otherwise("good"))
