"""Capability manifest: which analytics the data supports, and why not the others."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions import text as T
from casemill.operators.audit import usable_note

PROBE = 60


def source_case(resolved: str | None = "is_resolved"):
    """A case that can serve as evidence: a problem, a usable note and, where known, resolved."""
    base = (F.trim(F.coalesce(F.col("issue_text"), F.lit(""))) != "") & usable_note("resolution_notes")
    return base & F.coalesce(F.col(resolved), F.lit(False)) if resolved else base


def source_case_counts(cases: DataFrame) -> DataFrame:
    """Counts behind the evidence mask; the resolved condition falls where no status is known."""
    known = F.count("is_resolved") if "is_resolved" in cases.columns else F.lit(0)
    strict = F.count_if(source_case()) if "is_resolved" in cases.columns else F.lit(0)
    out = cases.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.trim(F.coalesce(F.col("issue_text"), F.lit(""))) != "").alias("with_text"),
        F.count_if(usable_note("resolution_notes")).alias("with_usable_notes"),
        known.alias("_known"), strict.alias("_strict"), F.count_if(source_case(None)).alias("_loose"),
    )
    relaxed = F.col("_known") == 0
    return out.select("n", "with_text", "with_usable_notes", relaxed.alias("relaxed"), F.when(relaxed, F.col("_loose")).otherwise(F.col("_strict")).alias("source_cases"))


def leaked(body: str, note: str = "resolution_notes"):
    """The first 60 characters of a note stand in the same row's problem text."""
    trimmed = F.trim(F.coalesce(F.col(note), F.lit("")))
    return (F.length(trimmed) >= PROBE) & F.contains(F.coalesce(F.col(body), F.lit("")), F.substring(trimmed, 1, PROBE))


def build_corpus(cases: DataFrame, area: str | None = None, kind: str | None = None) -> DataFrame:
    """Source cases without leaked answers, with the document that is indexed.

    Where no row's status is known the resolved condition falls, as in ``source_case_counts``.
    """
    part = lambda c: F.col(c) if c else F.lit(None).cast("string")
    kept = cases
    if "is_resolved" in cases.columns:
        known = cases.agg((F.count("is_resolved") > 0).alias("_known"))
        strict = F.coalesce(F.col("is_resolved"), F.lit(False)) | ~F.col("_known")
        kept = cases.crossJoin(F.broadcast(known)).filter(strict).drop("_known")  # one row
    kept = kept.filter(source_case(None)).filter(~leaked("issue_text"))
    return kept.withColumn("retrieval_document", T.retrieval_document(F.col("issue_text"), part(area), part(kind)))


BANNED_LABELS = ["Resolution:", "Status:", "Escalated:", "CSAT:", "SLA:"]


def impure(corpus: DataFrame) -> DataFrame:
    """Documents that hold an outcome; a pure corpus gives none."""
    label = F.lit(False)
    for b in BANNED_LABELS:
        label = label | F.col("retrieval_document").rlike(f"(?m)^{b}")
    return corpus.filter(leaked("retrieval_document") | label)


def assert_pure(corpus: DataFrame) -> None:
    if bad := impure(corpus).select("ticket_id").take(3):
        raise ValueError(f"outcomes in the index: {[r[0] for r in bad]}")


def metric_availability(cases: DataFrame, least: int = 30) -> DataFrame:
    """``(metric, n, enabled, reason)``; a disabled metric says why."""
    have = lambda c: F.count(F.col(c)) if c in cases.columns else F.lit(0).cast("long")
    fields = {"resolution_time": "resolution_time_hours", "response_time": "response_time_hours", "escalation_rate": "escalated", "sla_breach_rate": "sla_breached", "csat": "csat_score", "timeseries": "created_at"}
    counts = cases.agg(F.count(F.lit(1)).alias("ticket_volume"), *(have(c).alias(m) for m, c in fields.items()))
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in ("ticket_volume", *fields)]
    reason = F.when(F.col("n") == 0, "no row has a value").when(F.col("n") < least, f"fewer than {least} rows have a value")
    return counts.select(F.inline(F.array(*rows))).select("metric", "n", (F.col("n") >= least).alias("enabled"), reason.alias("reason"))


def risk_target(cases: DataFrame, least: int = 50, least_rows: int = 500) -> DataFrame:
    """The first outcome that can be predicted: escalation, breach, slow resolution, low rating.

    Both classes need ``least`` cases. An outcome that the status alone decides was generated, not
    observed, and is refused. Slow resolution needs ``least_rows`` durations of more than two values.
    """
    slow = cases.agg(F.percentile("resolution_time_hours", 0.75).alias("p75"), F.count("resolution_time_hours").alias("_timed"), F.count_distinct("resolution_time_hours").alias("_values"))
    decided = _decided_by_status(cases, ["escalated", "sla_breached"])
    classes = {
        "escalated": F.col("escalated"),
        "sla_breached": F.col("sla_breached"),
        "slow_resolution": F.col("resolution_time_hours") > F.col("p75"),
        "low_csat": F.col("csat_score") <= 2,
    }
    counts = cases.crossJoin(F.broadcast(slow)).agg(*(x.alias(f"{n}_{k}") for n, c in classes.items() for k, x in (("pos", F.count_if(c)), ("neg", F.count_if(~c)))), F.max("_timed").alias("_timed"), F.max("_values").alias("_values"))
    counts = counts.crossJoin(F.broadcast(decided))  # one row each
    enough = {"slow_resolution": (F.col("_timed") >= least_rows) & (F.col("_values") > 2)}
    rows = [
        F.struct(
            F.lit(i + 1).alias("rung"), F.lit(n).alias("target"), F.col(f"{n}_pos").alias("positive"), F.col(f"{n}_neg").alias("negative"),
            (F.coalesce(F.col(f"_by_{n}"), F.lit(False)) if n in ("escalated", "sla_breached") else F.lit(False)).alias("decided_by_status"),
            F.coalesce(enough.get(n, F.lit(True)), F.lit(False)).alias("_enough"),
        )
        for i, n in enumerate(classes)
    ]
    ladder = counts.select(F.inline(F.array(*rows))).withColumn("eligible", (F.col("positive") >= least) & (F.col("negative") >= least) & ~F.col("decided_by_status") & F.col("_enough"))
    chosen = ladder.filter("eligible").agg(F.min("rung").alias("first"))
    return ladder.join(F.broadcast(chosen)).select("rung", "target", "positive", "negative", "decided_by_status", "eligible", F.coalesce(F.col("rung") == F.col("first"), F.lit(False)).alias("chosen"))


def _decided_by_status(cases: DataFrame, targets: list[str]) -> DataFrame:
    """For each binary target, whether every status has one class only; NULL without a known pair."""
    if "status" not in cases.columns:
        return cases.sparkSession.range(1).select(*(F.lit(None).cast("boolean").alias(f"_by_{t}") for t in targets))
    by = cases.filter("status IS NOT NULL").groupBy("status").agg(*(x.alias(f"{t}_{k}") for t in targets for k, x in (("p", F.count_if(F.col(t))), ("n", F.count_if(~F.col(t))))))
    one = lambda t: (F.col(f"{t}_p") == 0) | (F.col(f"{t}_n") == 0)
    seen = lambda t: F.col(f"{t}_p") + F.col(f"{t}_n") > 0
    return by.agg(*(F.bool_and(F.when(seen(t), one(t))).alias(f"_by_{t}") for t in targets))


#: What a subsystem needs before it is claimed to work.
NEEDS = {"source_cases": 50, "usable_notes": 50, "action_rate": 0.05, "texts": 200, "unique_ratio": 0.05, "risk_rows": 500}
#: Fields that can be known when a case is created; a priority is set by an agent later.
AT_CREATION = ("issue_text", "product_area", "issue_type", "customer_segment", "channel", "platform", "region", "sla_plan")
_COLUMNS = {"ticket_id": "string", "issue_text": "string", "resolution_notes": "string", "is_resolved": "boolean", "status": "string", "escalated": "boolean", "sla_breached": "boolean", "resolution_time_hours": "double", "response_time_hours": "double", "csat_score": "double", "created_at": "timestamp_ntz"}


def capabilities(cases: DataFrame, needs: dict | None = None) -> DataFrame:
    """``(subsystem, enabled, reason, facts)``: what the data supports; whatever is disabled says why, with the figures behind it."""
    need = NEEDS | (needs or {})
    full = cases.select("*", *(F.lit(None).cast(t).alias(c) for c, t in _COLUMNS.items() if c not in cases.columns))
    text, note = F.trim(F.coalesce("issue_text", F.lit(""))) != "", usable_note("resolution_notes")
    norm = F.when(text, F.sha2(T.dedup_normalised(F.col("issue_text")), 256))
    n = full.agg(
        F.count(F.lit(1)).alias("n"), F.count("ticket_id").alias("ids"), F.count_distinct("ticket_id").alias("distinct_ids"), F.count_if(text).alias("texts"), F.count_if(note).alias("notes"),
        F.count("is_resolved").alias("known"), F.count_if(text & note).alias("loose"), F.count_if(text & note & F.coalesce("is_resolved", F.lit(False))).alias("strict"),
        F.count_distinct(norm).alias("distinct_texts"), *(F.count(c).alias(f"m_{c}") for c in ("resolution_time_hours", "response_time_hours", "escalated", "sla_breached", "csat_score", "created_at")),
        *(F.count(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))).alias(f"t_{c}") for c in AT_CREATION if c in full.columns),
    )
    quality = note_quality(full).select(F.col("action_rate"), F.col("verdict"))
    risk = risk_target(full).filter("chosen").agg(F.max("target").alias("target"))
    one = n.crossJoin(F.broadcast(quality)).crossJoin(F.broadcast(risk))  # one row each
    sources = F.when(F.col("known") == 0, F.col("loose")).otherwise(F.col("strict"))
    metrics = F.array_compact(F.array(F.lit("ticket_volume"), *(F.when(F.col(f"m_{c}") > 0, m) for m, c in (("resolution_time", "resolution_time_hours"), ("response_time", "response_time_hours"), ("escalation_rate", "escalated"), ("sla_breach_rate", "sla_breached"), ("csat", "csat_score"), ("timeseries", "created_at")))))
    features = F.array_compact(F.array(*(F.when(F.col(f"t_{c}") > 0, c) for c in AT_CREATION if c in full.columns)))
    few = lambda count, what, least: F.when(count < least, F.concat(F.lit("only "), count.cast("string"), F.lit(f" {what} (at least {least})")))
    retrieval = F.coalesce(
        F.when((F.col("ids") < F.col("n")) | (F.col("distinct_ids") < F.col("ids")), "ticket_id is not stable and unique"), few(F.col("texts"), "cases have a text", need["source_cases"]), few(sources, "source cases", need["source_cases"])
    )
    generation = F.coalesce(
        F.when(retrieval.isNotNull(), F.concat(F.lit("retrieval is disabled: "), retrieval)), few(F.col("notes"), "usable notes", need["usable_notes"]),
        F.when(F.col("action_rate") < need["action_rate"], "notes are correspondence, not resolutions"),
    )
    ratio = F.round(F.coalesce(F.try_divide("distinct_texts", "texts"), F.lit(0.0)), 4)
    clustering = F.coalesce(few(F.col("texts"), "cases have a text", need["texts"]), F.when(ratio < need["unique_ratio"], "texts hardly differ"))
    unpredictable = F.coalesce(
        few(F.col("n"), "cases", need["risk_rows"]), F.when(F.size(features) == 0, "no field is known when a case is created"), F.when(F.col("target").isNull(), "no outcome can be predicted")
    )
    agent = F.coalesce(F.when(retrieval.isNotNull(), F.concat(F.lit("retrieval is disabled: "), retrieval)), F.lit("needs a provider of generated text"))
    facts = lambda **x: F.map_from_arrays(F.array(*map(F.lit, x)), F.array(*(v.cast("string") for v in x.values())))
    parts = [
        ("analytics", F.lit(None).cast("string"), facts(rows=F.col("n"), metrics=F.array_join(metrics, ","))),
        ("retrieval", retrieval, facts(source_cases=sources, relaxed=F.col("known") == 0)),
        ("resolution_generation", generation, facts(usable_notes=F.col("notes"), action_rate=F.col("action_rate"), verdict=F.col("verdict"))),
        ("clustering", clustering, facts(texts=F.col("texts"), unique_ratio=ratio)),
        ("risk", unpredictable, facts(target=F.col("target"), features=F.array_join(features, ","))),
        ("analyst_agent", agent, facts(rows=F.col("n"))),
    ]
    rows = [F.struct(F.lit(name).alias("subsystem"), why.isNull().alias("enabled"), why.alias("reason"), fact.alias("facts")) for name, why, fact in parts]
    return one.select(F.inline(F.array(*rows)))


class Disabled(Exception):
    """A subsystem or metric that the manifest does not enable."""


class Manifest:
    """The manifest at run time; without one, or with one that cannot be read, everything is disabled and says so."""

    def __init__(self, rows: list[dict] | None, problem: str = "no manifest has been made") -> None:
        self.rows, self.problem = {r["subsystem"]: r for r in rows or []}, problem

    @classmethod
    def load(cls, path: str) -> Manifest:
        try:
            with open(path, encoding="utf-8") as f:
                rows = json.load(f)
            if not all({"subsystem", "enabled"} <= set(r) for r in rows):
                raise ValueError("not a manifest")
            return cls(rows)
        except FileNotFoundError:
            return cls(None)
        except (OSError, ValueError, TypeError) as e:
            return cls(None, f"the manifest cannot be read: {e}")

    @classmethod
    def of(cls, table: DataFrame) -> Manifest:
        return cls([r.asDict(recursive=True) for r in table.collect()])

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(list(self.rows.values()), f)

    def state(self, subsystem: str) -> dict:
        return self.rows.get(subsystem, {"subsystem": subsystem, "enabled": False, "reason": self.problem})

    def require(self, subsystem: str) -> dict:
        if not (state := self.state(subsystem))["enabled"]:
            raise Disabled(f"{subsystem}: {state.get('reason')}")
        return state

    def require_metric(self, metric: str) -> None:
        if metric not in self.require("analytics")["facts"]["metrics"].split(","):
            raise Disabled(f"{metric}: no row has a value")


def note_quality(cases: DataFrame) -> DataFrame:
    """Whether notes tell what was done, or only keep up a correspondence."""
    label = T.note_class(F.col("resolution_notes"))
    out = cases.filter(F.trim(F.coalesce(F.col("resolution_notes"), F.lit(""))) != "").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(label == "action").alias("action"), F.count_if(label == "info_request").alias("info_request"), F.count_if(label == "unclear").alias("unclear")
    )
    rate = F.try_divide("action", "n")
    verdict = F.when(F.col("n") == 0, "no_notes").when(rate >= 0.2, "resolutions").when(rate >= 0.05, "mixed").otherwise("correspondence")
    return out.select("n", "action", "info_request", "unclear", F.round(rate, 4).alias("action_rate"), verdict.alias("verdict"))
