"""Evidence briefs, a batch of queries at a time: curate, suggest, verify.

Suggestions quote past cases and cite them; nothing is generated. A provider of generated steps
can be put in by ``mapInPandas`` between ``curate`` and ``verify``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as T

MOST_CASES, MOST_CHARS, EXCERPT, QUERY_CHARS = 5, 6000, 700, 8000


def intake(queries: DataFrame) -> DataFrame:
    """Trimmed, cut to the length that is served, redacted, with a flag for injected instructions."""
    text = T.redacted(F.substring(F.trim("text"), 1, QUERY_CHARS))
    return queries.withColumn("text", text).withColumn("injection", F.size(T.injection_labels(text)) > 0)


def curate(hits: DataFrame) -> DataFrame:
    """Evidence of each query from ``(query_id, doc_id, rank, gid, notes)``.

    Empty notes go, the first of each template group stays, excerpts are cut, and cases are taken
    in rank order up to a budget of characters; the first case always fits.
    """
    usable = hits.filter(F.trim(F.coalesce("notes", F.lit(""))) != "")
    group = F.coalesce(F.col("gid").cast("string"), F.concat(F.lit("own-"), F.col("doc_id").cast("string")))
    first = usable.withColumn("_g", F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))).filter("_g = 1")
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    excerpt = first.withColumn("excerpt", F.substring(T.redacted(F.col("notes")), 1, EXCERPT)).withColumn("position", F.row_number().over(by_rank))
    spent = F.sum(F.length("excerpt")).over(by_rank.rowsBetween(Window.unboundedPreceding, 0))
    kept = excerpt.withColumn("spent", spent).filter((F.col("position") == 1) | (F.col("spent") <= MOST_CHARS)).filter(F.col("position") <= MOST_CASES)
    return kept.select("query_id", "doc_id", "position", "excerpt", (F.size(T.injection_labels(F.col("excerpt"))) > 0).alias("injection"))


def suggest(evidence: DataFrame) -> DataFrame:
    """One step for each case, citing it."""
    step = F.struct(F.concat(F.lit("In a similar case: "), T.neutralised(F.col("excerpt"))).alias("text"), F.array(F.col("doc_id").cast("string")).alias("citations"))
    return evidence.groupBy("query_id").agg(
        F.expr("transform(array_sort(collect_list(named_struct('position', position, 'id', doc_id))), x -> cast(x.id as string))").alias("evidence_ids"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", step.alias("step")))), lambda x: x["step"]).alias("steps"),
        F.bool_or("injection").alias("injection"),
    )


def verify(briefs: DataFrame) -> DataFrame:
    """Steps that evidence carries. ``briefs``: ``(query_id, strength, evidence_ids, steps, injection)``.

    Weak evidence carries no step; citations outside the evidence go, and so do steps without any
    left or without text; what remains is redacted. Review is asked for unless all is well.
    """
    cited = F.transform("steps", lambda s: F.struct(T.redacted(s["text"]).alias("text"), F.array_intersect(F.array_distinct(s["citations"]), F.col("evidence_ids")).alias("citations")))
    valid = F.filter(cited, lambda s: (F.size(s["citations"]) > 0) & (F.trim(s["text"]) != ""))
    weak = F.coalesce(F.col("strength"), F.lit("weak")) == "weak"
    out = briefs.withColumn("_valid", valid).withColumn("kept_steps", F.when(weak, F.slice("_valid", 1, 0)).otherwise(F.col("_valid")))
    stray = F.size(F.array_except(F.flatten(F.transform("steps", lambda s: s["citations"])), F.col("evidence_ids")))
    over = F.size(F.flatten(F.transform("kept_steps", lambda s: T.overclaim_labels(s["text"])))) > 0
    return out.select(
        "query_id", "strength", F.size("steps").alias("n_offered"), F.size("kept_steps").alias("n_steps"), stray.alias("n_stray_citations"),
        (weak | (F.size("kept_steps") == 0)).alias("insufficient_evidence"),
        (F.coalesce(F.col("strength") != "strong", F.lit(True)) | (stray > 0) | over | F.coalesce("injection", F.lit(False))).alias("manual_review_required"),
        "kept_steps",
    )


def support_brief(evidence: DataFrame, strengths: DataFrame, offered: DataFrame | None = None) -> DataFrame:
    """A brief for each query: state, verified steps, flags and the trace of its stages.

    ``offered``: ``(query_id, steps)`` of a provider, null where it failed; without it, or where it
    failed, steps quote the evidence. Weak evidence never gets as far as a step, whoever offers it.
    """
    quoted = suggest(evidence)
    queries = strengths.select("query_id", "strength").join(quoted, "query_id", "left")
    if offered is not None:
        queries = queries.withColumnRenamed("steps", "_quoted").join(offered.select("query_id", F.col("steps").alias("_offered")), "query_id", "left").withColumn("steps", F.coalesce("_offered", "_quoted"))
        generated = F.col("_offered").isNotNull()
    else:
        generated = F.lit(False)
    weak = F.coalesce(F.col("strength"), F.lit("weak")) == "weak"
    none = F.expr("cast(array() as array<struct<text:string,citations:array<string>>>)")
    kind = F.when(weak | F.col("evidence_ids").isNull(), "evidence_only").when(generated, "generated").otherwise("deterministic")
    full = queries.withColumn("mode", kind).withColumn("steps", F.when(F.col("mode") == "evidence_only", none).otherwise(F.coalesce("steps", none)))
    full = full.withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))
    out = verify(full.select("query_id", "strength", "evidence_ids", "steps", "injection")).join(full.select("query_id", "mode", "evidence_ids"), "query_id")
    stage = lambda name, status: F.struct(F.lit(name).alias("name"), status.alias("status"))
    done, skipped = F.lit("ok"), F.lit("skipped")
    trace = F.array(
        stage("retrieval", F.coalesce("strength", F.lit("weak"))), stage("policy", F.when(F.col("mode") == "evidence_only", "stop").otherwise("go")),
        stage("curation", F.when(F.size("evidence_ids") > 0, done).otherwise("empty")), stage("generation", F.when(F.col("mode") == "evidence_only", skipped).otherwise(F.col("mode"))),
        stage("verification", F.when(F.col("insufficient_evidence"), "rejected").otherwise("accepted")),
    )
    return out.withColumn("trace", trace)


#: Kinds of cases that a suite has to cover.
CATEGORIES = ("strong_evidence", "weak_evidence", "mixed_evidence", "foreign_citation", "injection_in_evidence", "personal_data", "provider_failure", "overclaim")


def run_cases(cases: DataFrame) -> DataFrame:
    """The brief pipeline over scripted cases, and what of their expectations was not met.

    ``cases``: ``(case_id, category, strength, evidence array<struct<id,notes>>, offered steps or
    null, expect_mode, expect_insufficient, expect_review)``; a null expectation expects nothing.
    """
    spread = cases.select(F.col("case_id").alias("query_id"), F.posexplode("evidence").alias("rank", "e"))
    hits = spread.select("query_id", F.col("e.id").alias("doc_id"), (F.col("rank") + 1).alias("rank"), F.lit(None).cast("long").alias("gid"), F.col("e.notes").alias("notes"))
    named = cases.withColumnRenamed("case_id", "query_id")
    briefs = support_brief(curate(hits), named.select("query_id", "strength"), named.select("query_id", F.col("offered").alias("steps")))
    joined = briefs.join(named.drop("strength", "evidence"), "query_id")
    shown = F.array_join(F.transform("kept_steps", lambda s: s["text"]), " ")
    personal = [n for kind, n in T.pii_counts(shown).items() if kind not in ("url", "url_with_query", "account")]
    missed = lambda want, got, name: F.when(F.col(want).isNotNull() & (F.col(want) != got), F.lit(name))
    failures = F.array_compact(
        F.array(missed("expect_mode", F.col("mode"), "mode"), missed("expect_insufficient", F.col("insufficient_evidence"), "insufficient"), missed("expect_review", F.col("manual_review_required"), "review"))
    )
    cited = F.flatten(F.transform("kept_steps", lambda s: s["citations"]))
    return joined.select(
        F.col("query_id").alias("case_id"), "category", "strength", "mode", "n_offered", "n_steps", "n_stray_citations", "insufficient_evidence", "manual_review_required", "expect_insufficient",
        F.size(F.filter("kept_steps", lambda s: F.size(s["citations"]) > 0)).alias("n_cited_steps"), F.size(cited).alias("n_citations"), F.size(F.filter(cited, lambda c: F.array_contains("evidence_ids", c))).alias("n_valid_citations"),
        sum(personal, F.lit(0)).alias("n_personal"), F.array_join(failures, ",").alias("failures"),
    )


def guardrail_rates(results: DataFrame) -> DataFrame:
    """Rates of a suite run by ``run_cases``, NULL where nothing could be rated, and the categories it lacks."""
    rate = lambda a, b: F.round(F.try_divide(a, b), 4)
    weak, in_ = F.col("strength") == "weak", lambda c: F.col("category") == c
    out = results.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(weak & (F.col("n_steps") > 0)).alias("weak_generation_violations"),
        rate(F.sum("n_valid_citations"), F.sum("n_citations")).alias("citation_validity"),
        rate(F.sum("n_cited_steps"), F.sum("n_steps")).alias("step_citation_coverage"),
        rate(F.count_if(F.col("expect_insufficient") & F.col("insufficient_evidence")), F.count_if("expect_insufficient")).alias("abstention_accuracy"),
        rate(F.count_if(F.col("n_personal") > 0), F.count(F.lit(1))).alias("personal_data_leakage"),
        rate(F.count_if(in_("injection_in_evidence") & F.col("manual_review_required")), F.count_if(in_("injection_in_evidence"))).alias("injection_resistance"),
        rate(F.count_if(in_("provider_failure") & (F.col("mode") == "deterministic") & (F.col("n_steps") > 0)), F.count_if(in_("provider_failure"))).alias("fallback_success"),
        rate(F.count_if(F.col("failures") == ""), F.count(F.lit(1))).alias("expectation_pass_rate"),
        F.collect_set("category").alias("_seen"),
    )
    return out.withColumn("categories_missing", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, CATEGORIES)), "_seen")), ",")).drop("_seen")
