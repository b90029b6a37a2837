"""Ranking quality: metrics of judged queries, leave-one-out by a proxy label, regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranking: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """hit, recall, MRR and nDCG at ``k`` of each judged query; NULL without a positive grade.

    ``ranking``: ``(query_id, doc_id, rank)``; ``qrels``: ``(query_id, doc_id, grade)``.
    """
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id"))
    ideal = qrels.withColumn("i", ideal_rank).groupBy("query_id").agg(
        F.count_if(F.col("grade") > 0).alias("positives"), F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i"))).otherwise(0.0)).alias("idcg")
    )
    seen = ranking.filter(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.count_if(F.col("grade") > 0).alias("found"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg")
    )
    has = lambda c: F.when(F.col("positives") > 0, F.round(c, 6))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(seen, "query_id", "left").select(
        "query_id",
        has(F.when(F.coalesce(F.col("found"), F.lit(0)) > 0, 1.0).otherwise(0.0)).alias("hit"),
        has(zero(F.col("found") / F.col("positives"))).alias("recall"),
        has(zero(1.0 / F.col("first"))).alias("mrr"),
        has(zero(F.col("dcg") / F.col("idcg"))).alias("ndcg"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over scored queries, with how many ran and how many were scored."""
    return metrics.agg(F.count(F.lit(1)).alias("queries_run"), F.count("hit").alias("queries_scored"), *(F.round(F.avg(m), 4).alias(m) for m in ("hit", "recall", "mrr", "ndcg")))


def leave_one_out(hits: DataFrame, labels: DataFrame, k: int = 5, strict: bool = False) -> DataFrame:
    """Hit and MRR at ``k`` of each query, relevance by an equal label among the ranked documents.

    A query that ranks no document of its label is NULL; with ``strict`` it is zero.
    """
    q, d = labels.select(F.col("id").alias("query_id"), F.col("label").alias("_q")), labels.select(F.col("id").alias("doc_id"), F.col("label").alias("_d"))
    judged = hits.join(q, "query_id").join(d, "doc_id").groupBy("query_id").agg(
        F.count_if(F.col("_q") == F.col("_d")).alias("relevant"), F.min(F.when((F.col("_q") == F.col("_d")) & (F.col("rank") <= k), F.col("rank"))).alias("first")
    )
    scored = (F.col("relevant") > 0) | F.lit(strict)
    return judged.select(
        "query_id", F.when(scored, F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("hit"), F.when(scored, F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6)).alias("mrr")
    )


def random_baseline(labels: DataFrame, k: int) -> DataFrame:
    """Expected hit rate of ``k`` random draws without the query itself, from label counts."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(labels.agg(F.count(F.lit(1)).alias("total"))))
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest((F.col("total") - F.col("n") - i) / (F.col("total") - 1 - i), F.lit(0.0)))
    return sizes.withColumn("hit", 1 - miss).agg(F.round(F.sum(F.col("hit") * F.col("n")) / F.sum("n"), 6).alias("random_hit"))


def regression_gate(baseline: DataFrame, measured: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``(config, metric)`` of the baseline with what became of it; only baseline rows are looked at."""
    joined = baseline.join(measured, ["config", "metric"], "left")
    b, m = F.col("baseline"), F.col("measured")
    verdict = F.when(b.isNull() & m.isNull(), "unchanged").when(b.isNull(), "new").when(m.isNull(), "lost").when(m < b - tolerance, "regression").when(m > b + tolerance, "improvement").otherwise("unchanged")
    return joined.select("config", "metric", "baseline", "measured", verdict.alias("verdict"))


def validate_labels(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(problem, severity, n)`` of a judged set: what makes it unusable and what weakens it."""
    ids = corpus.select(F.col("id").alias("doc_id"))
    count = lambda df, name, severity: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), F.lit(severity).alias("severity"), "n")
    checks = [
        count(queries.groupBy("query_id").count().filter("count > 1"), "duplicate query id", "error"),
        count(queries.filter(F.trim(F.coalesce("text", F.lit(""))) == ""), "empty text", "error"),
        count(qrels.join(ids, "doc_id", "left_anti"), "unknown document", "error"),
        count(queries.join(ids.select(F.col("doc_id").alias("query_id")), "query_id", "left_semi"), "query is in the corpus", "error"),
        count(queries.join(qrels.filter("grade > 0"), "query_id", "left_anti"), "no positive grade", "warning"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out


def nearest_rank(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Percentiles that are values of the column."""
    return df.agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(f"p{int(p * 100):02d}") for p in shares))


def compare_configs(rankings: dict[str, DataFrame], qrels: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """``(config, k, queries_run, queries_scored, hit, recall, mrr, ndcg)`` of several rankings of one judged set."""
    parts = [summary(ranking_metrics(r, qrels, k)).select(F.lit(name).alias("config"), F.lit(k).alias("k"), "*") for name, r in rankings.items() for k in ks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def winner(report: DataFrame, metric: str = "recall", k: int = 5) -> DataFrame:
    """``(config, score, best)``: the configurations with the best ``metric`` at ``k``; ties are all best. None if nothing was scored."""
    scored = report.filter((F.col("k") == k) & F.col(metric).isNotNull()).select("config", F.col(metric).alias("score"))
    top = scored.agg(F.max("score").alias("_top"))
    return scored.crossJoin(F.broadcast(top)).select("config", "score", (F.abs(F.col("score") - F.col("_top")) < 1e-9).alias("best"))


def with_lift(measured: DataFrame, baseline: DataFrame, column: str, base: str) -> DataFrame:
    """``measured`` with how many times the one-row ``baseline`` it is; NULL where that is not above zero."""
    joined = measured.crossJoin(F.broadcast(baseline.select(F.col(base).alias("_base"))))
    return joined.withColumn("lift", F.when(F.col("_base") > 0, F.round(F.col(column) / F.col("_base"), 3))).drop("_base")
