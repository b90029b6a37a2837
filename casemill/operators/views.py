"""Source tables as canonical cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions import text as T

STATUS_OF = {"F": "resolved", "O": "open", "P": "pending"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bare_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the table of orders alone says of a case."""
    status = F.create_map(*(F.lit(x) for kv in STATUS_OF.items() for x in kv))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_no"), status[F.col("o_orderstatus")].alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at")
    )


def order_cases(spark: SparkSession, sf_dir: str, status_of: dict[str, str] | None = None) -> DataFrame:
    """Orders as cases: shipping answers them, returned lines escalate them, no line means no outcome."""
    status = F.create_map(*(F.lit(x) for kv in (status_of or STATUS_OF).items() for x in kv))
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_shipdate").alias("first_response_at"),
            F.max("l_shipdate").alias("resolved_at"),
            F.bool_or(F.col("l_returnflag") == "R").alias("escalated"),
            F.bool_or(F.col("l_linestatus") == "O").alias("sla_breached"),
            F.max("l_linenumber").cast("double").alias("raw_csat"),
        )
    )
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return (
        table(spark, sf_dir, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
        .select(
            F.col("o_orderkey").cast("string").alias("ticket_id"),
            F.col("o_orderkey").alias("case_no"),
            F.col("o_orderdate").alias("created_at"),
            T.hashed_id(F.col("o_custkey")).alias("customer_id_hash"),
            F.col("c_mktsegment").alias("customer_segment"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("product_area"),
            F.col("o_orderpriority").alias("priority"),
            status[F.col("o_orderstatus")].alias("status"),
            F.col("o_orderstatus").alias("raw_status"),
            "first_response_at",
            "resolved_at",
            "escalated",
            "sla_breached",
            T.hours_between(F.col("o_orderdate"), F.col("first_response_at")).alias("response_time_hours"),
            T.hours_between(F.col("o_orderdate"), F.col("resolved_at")).alias("resolution_time_hours"),
            F.when(F.col("raw_csat").between(1, 5), F.col("raw_csat")).alias("csat_score"),
            "raw_csat",
        )
        .withColumn("is_resolved", F.when(F.col("status").isNotNull(), F.col("status").isin("resolved", "closed")))
    )


def document_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cases; unlabelled ones have no outcome."""
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select(
            F.col("doc_id").cast("string").alias("ticket_id"),
            "doc_id",
            F.col("source").alias("product_area"),
            F.col("lang").alias("issue_type"),
            F.col("text").alias("issue_text"),
            (F.col("toxic") == 1).alias("escalated"),
            F.col("quality").cast("double").alias("csat_score"),
        )
    )


def conversation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user turn of each conversation with the assistant turn that follows it."""
    turns = table(spark, sf_dir, "conversations")
    # the answer is the first assistant turn after the first question: one pass over each conversation's turns in order
    asked = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    ours = turns.withColumn("_asked", asked).filter("_asked IS NOT NULL AND (turn = _asked AND role = 'user' OR turn > _asked AND role = 'assistant')")
    reply = ours.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("q"), F.min(F.when(F.col("role") == "assistant", F.struct("turn", F.col("text").alias("answer")))).alias("a")
    )
    return reply.select(
        F.col("conv_id").cast("string").alias("ticket_id"), "conv_id", T.as_text(F.col("q.text")).alias("issue_text"), T.as_text(F.col("a.answer")).alias("resolution_notes")
    )
