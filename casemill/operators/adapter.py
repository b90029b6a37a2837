"""From a source table to the canonical one, by a declarative mapping.

The mapping stays on the driver and becomes column expressions; a ledger of what was dropped,
changed or could not be read comes from one aggregation over the source.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions import text as T
from casemill.functions import vocabulary as V
from casemill.plans.cut import checkpointed

TRAP = re.compile(V.CREATED_AT_TRAPS)


@dataclass
class Mapping:
    """What becomes what. ``order`` names the column that row order is taken from."""

    columns: dict[str, str | None]
    order: str
    filters: list[dict] = field(default_factory=list)
    status: dict[str, list[str]] = field(default_factory=dict)
    timestamp_formats: list[str] = field(default_factory=list)
    forbidden_created_at: list[str] = field(default_factory=list)
    #: A person has looked at the source of created_at; only then may its name be one of the traps.
    created_at_checked: bool = False
    csat: tuple[float, float] = (1.0, 5.0)
    csat_zero_is_null: bool = True
    customer_id: str | None = None
    id_prefix: str = "T"
    resolved_statuses: tuple[str, ...] = ("resolved", "closed")
    derive: dict[str, str] = field(default_factory=dict)


def validate(mapping: Mapping, source: list[str]) -> dict[str, str]:
    """Errors are raised; what is merely refused is returned with its reason."""
    unknown = set(mapping.columns) - set(V.CANONICAL)
    if unknown:
        raise ValueError(f"unknown target columns: {sorted(unknown)}")
    absent = {c for c in mapping.columns.values() if c is not None} - set(source)
    if absent:
        raise ValueError(f"absent source columns: {sorted(absent)}")
    for f in mapping.filters:
        if f.get("column") not in source or not f.get("keep"):
            raise ValueError(f"row filter is incomplete or its column is absent: {f}")
    refused = {}
    at = mapping.columns.get("created_at")
    forbidden = {c.strip().lower() for c in mapping.forbidden_created_at}
    if at and (at.strip().lower() in forbidden or (TRAP.search(at) and not mapping.created_at_checked)):
        refused["created_at"] = f"{at} does not say when a case was created"
    return refused


def looks_personal(column: str) -> bool:
    return any(h in column.strip().lower().replace(" ", "_") for h in V.PERSONAL_HINTS)


def suggest(columns: list[str]) -> dict[str, str]:
    """A mapping for a person to look at: the first hint that fits the first unused column."""
    used: dict[str, str] = {}
    for target, hints in V.COLUMN_HINTS.items():
        for hint in hints:
            hit = next((c for c in columns if hint in c.lower() and c not in used.values() and not (target == "created_at" and TRAP.search(c))), None)
            if hit:
                used[target] = hit
                break
    return used


def keeps(spec: dict) -> Column:
    """A row filter: the trimmed lower-case value is one of those to keep; null is not."""
    return F.coalesce(F.lower(F.trim(F.col(spec["column"]).cast("string"))).isin([str(x).strip().lower() for x in spec["keep"]]), F.lit(False))


def row_filter_ledger(df: DataFrame, filters: list[dict]) -> DataFrame:
    """``(step, column_name, before, after, dropped)`` of filters applied one after the other."""
    passed = [reduce(lambda a, b: a & b, [keeps(f) for f in filters[: k + 1]]) for k in range(len(filters))]
    counts = df.agg(F.count(F.lit(1)).alias("_0"), *(F.count_if(p).alias(f"_{k + 1}") for k, p in enumerate(passed)))
    rows = [F.struct(F.lit(k + 1).alias("step"), F.lit(f["column"]).alias("column_name"), F.col(f"_{k}").alias("before"), F.col(f"_{k + 1}").alias("after")) for k, f in enumerate(filters)]
    return counts.select(F.inline(F.array(*rows))).withColumn("dropped", F.col("before") - F.col("after"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter("_rank = 1").drop("_rank")


def dense_ids(df: DataFrame, order: str, prefix: str) -> DataFrame:
    """``ticket_id`` from the position after filtering, without a global sort in one task.

    Ranges of ``order`` are numbered by themselves; offsets come from one small count a range.
    """
    ranged = checkpointed(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))  # read twice, must not move
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    counts = ranged.groupBy("_part").count()
    offsets = counts.alias("a").join(counts.alias("b"), F.expr("b._part < a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_part").withColumn("ticket_id", F.format_string(f"{prefix}%07d", F.col("_n") + F.col("_before") - 1)).drop("_part", "_n", "_before")


def status_column(raw: Column, names: dict[str, list[str]]) -> Column:
    pairs = [F.lit(x) for canonical, raws in names.items() for r in raws for x in (r.strip().lower(), canonical)]
    return F.create_map(*pairs)[F.lower(F.trim(raw))] if pairs else F.lit(None).cast("string")


def status_ledger(df: DataFrame, raw: str, names: dict[str, list[str]]) -> DataFrame:
    """Raw values with what they became and how often."""
    return df.groupBy(F.col(raw).alias("raw_value"), status_column(F.col(raw), names).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def parsed_timestamp(raw: Column, formats: list[str]) -> Column:
    tries = [F.try_to_timestamp(raw, F.lit(f)) for f in formats] + [F.try_to_timestamp(raw)]
    return F.coalesce(*tries).cast("timestamp_ntz")


def csat(raw: Column, scale: tuple[float, float], zero_is_null: bool) -> Column:
    number = raw.try_cast("double")
    return F.when(number.between(*scale) & ~(F.lit(zero_is_null) & (number == 0)), number)


def apply_mapping(df: DataFrame, mapping: Mapping) -> DataFrame:
    """The canonical table: filters, clean values, derivations, redaction, fixed columns and order."""
    refused = validate(mapping, df.columns)
    for spec in mapping.filters:
        df = df.filter(keeps(spec))
    take = {t: s for t, s in mapping.columns.items() if s is not None and t not in refused}
    df = df.withColumns({f"_s_{t}": T.null_tokens_out(F.col(s).cast("string")) for t, s in take.items()})
    if "ticket_id" in take:
        df = df.withColumn("ticket_id", F.trim(F.col("_s_ticket_id"))).filter("ticket_id <> ''")
        df = keep_first(df, ["ticket_id"], mapping.order)
    else:
        df = dense_ids(df, mapping.order, mapping.id_prefix)
    out: dict[str, Column] = {"ticket_id": F.col("ticket_id")}
    if mapping.customer_id:
        out["customer_id_hash"] = T.hashed_id(F.col(mapping.customer_id))
    for target in take:
        raw, kind = F.col(f"_s_{target}"), V.CANONICAL[target]
        if target in ("ticket_id", "customer_id_hash"):
            continue
        if target == "status":
            out[target] = status_column(raw, mapping.status)
        elif target == "csat_score":
            out[target] = csat(raw, mapping.csat, mapping.csat_zero_is_null)
        elif kind == "timestamp_ntz":
            out[target] = parsed_timestamp(raw, mapping.timestamp_formats)
        elif kind == "boolean":
            out[target] = T.as_boolean(raw)
        elif kind == "double":
            out[target] = raw.try_cast("double")
        elif target.startswith("issue_") and target != "issue_type" or target == "resolution_notes":
            out[target] = T.redacted(T.as_text(raw))
        else:
            out[target] = raw
    df = df.select(*(c.alias(n) for n, c in out.items()))
    if "issue_text" not in df.columns:
        if not {"issue_subject", "issue_description"} & set(df.columns):
            raise ValueError("neither a subject nor a description is mapped, so a case has no text")
        subject, body = (F.col(c) if c in df.columns else F.lit("") for c in ("issue_subject", "issue_description"))
        df = df.withColumn("issue_text", F.regexp_replace(F.concat(subject, F.lit("\n\n"), body), r"^\s+|\s+$", ""))
    for target, end in (("resolution_time_hours", "resolved_at"), ("response_time_hours", "first_response_at")):
        if mapping.derive.get(target) == "from_timestamps":
            df = df.withColumn(target, T.hours_between(F.col("created_at"), F.col(end)))
    df = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in V.CANONICAL.items()))
    return with_resolved(df, mapping.resolved_statuses)


def with_resolved(df: DataFrame, statuses: tuple[str, ...] = ("resolved", "closed")) -> DataFrame:
    """``is_resolved``: by the status where any row has one, else by ``resolved_at`` where any row has that, else NULL."""
    known = df.agg((F.count("status") > 0).alias("_by_status"), (F.count("resolved_at") > 0).alias("_by_time"))
    by_status = F.when(F.col("status").isNotNull(), F.lower("status").isin(*statuses))
    rung = F.when(F.col("_by_status"), by_status).when(F.col("_by_time"), F.col("resolved_at").isNotNull())
    return df.crossJoin(F.broadcast(known)).withColumn("is_resolved", rung).drop("_by_status", "_by_time")  # one row


def ledger(df: DataFrame, mapping: Mapping) -> DataFrame:
    """``(kind, field, n)``: what applying ``mapping`` drops, changes or cannot read, from one aggregation over the source.

    Counts are over the rows that the filters keep; ``rows_out`` is after empty and repeated ids
    have gone. What is known without the rows comes with n null: refused, missing and unexpected
    columns, and personal ones, which are never taken over.
    """
    refused = validate(mapping, df.columns)
    passed = reduce(lambda a, b: a & b, map(keeps, mapping.filters), F.lit(True))
    take = {t: s for t, s in mapping.columns.items() if s is not None and t not in refused}
    value = {t: F.when(passed, T.null_tokens_out(F.col(s).cast("string"))) for t, s in take.items()}
    counts: list[tuple[str, str, Column]] = [("rows_in", "", F.count(F.lit(1))), ("rows_kept", "", F.count_if(passed))]

    def lost(kind: str, target: str, read: Column) -> None:
        counts.append((kind, target, F.count_if(value[target].isNotNull() & read.isNull())))

    if "ticket_id" in take:
        ids = F.when(F.trim(value["ticket_id"]) != "", F.trim(value["ticket_id"]))
        counts += [("empty_id", "ticket_id", F.count_if(passed) - F.count(ids)), ("repeated_id", "ticket_id", F.count(ids) - F.count_distinct(ids)), ("rows_out", "", F.count_distinct(ids))]
    for target in take:
        kind = V.CANONICAL[target]
        if target == "status":
            lost("unmapped", target, status_column(value[target], mapping.status))
        elif target == "csat_score":
            number = value[target].try_cast("double")
            lost("not_a_number", target, number)
            zero = (number == 0) & F.lit(mapping.csat_zero_is_null)
            counts += [("zero_to_null", target, F.count_if(zero)), ("out_of_range", target, F.count_if(~number.between(*mapping.csat) & ~zero))]
        elif kind == "timestamp_ntz":
            lost("unparsed", target, parsed_timestamp(value[target], mapping.timestamp_formats))
        elif kind == "boolean":
            lost("not_a_boolean", target, T.as_boolean(value[target]))
        elif kind == "double":
            lost("not_a_number", target, value[target].try_cast("double"))
    if mapping.derive.get("resolution_time_hours") == "from_timestamps" and {"created_at", "resolved_at"} <= set(take):
        start, end = (parsed_timestamp(value[c], mapping.timestamp_formats) for c in ("created_at", "resolved_at"))
        counts.append(("negative_duration", "resolution_time_hours", F.count_if(end < start)))
    used = {*take.values(), mapping.customer_id, mapping.order}
    known = [("refused", t, why) for t, why in refused.items()] + [("missing", t, "") for t in V.CANONICAL if t not in take and t not in mapping.derive]
    known += [("personal_dropped" if looks_personal(c) else "unexpected", c, "") for c in df.columns if c not in used]
    aggregates = df.agg(*(c.alias(f"_{k}") for k, (_, _, c) in enumerate(counts)))
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("field"), F.col(f"_{k}").cast("long").alias("n")) for k, (kind, name, _) in enumerate(counts)]
    rows += [F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("field"), F.lit(None).cast("long").alias("n")) for kind, name, _ in known]
    return aggregates.select(F.inline(F.array(*rows)))


def merge_tables(tables: dict[str, DataFrame], required: list[str], key: str, order: str) -> DataFrame:
    """Union by name of the tables that have the required columns, tagged, first of each key kept."""
    fit = [df.withColumn("_source", F.lit(name)) for name, df in tables.items() if set(required) <= set(df.columns)]
    if not fit:
        raise ValueError("no table has the required columns")
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fit)
    return keep_first(merged.withColumn("_order", F.struct("_source", order)), [key], "_order").drop("_order")
