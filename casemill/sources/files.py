"""Readers and writers of the files that cases come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """All columns as strings. Without an encoding, UTF-8 is taken unless bytes do not fit it, then Latin-1."""
    reader = lambda enc: spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", enc)
    if encoding is None:
        broken = spark.read.format("binaryFile").load(path).filter(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count()
        encoding = "ISO-8859-1" if broken else "UTF-8"
    names = [n.lstrip("﻿") for n in reader(encoding).csv(path, inferSchema=False).columns]
    return reader(encoding).schema(StructType([StructField(n, StringType()) for n in names])).csv(path)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of a JSON-lines file with // comments, and the lines that are none (``line``)."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' AND NOT startswith(line, '//')")
    parsed = lines.withColumn("r", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.filter("r._corrupt IS NULL").select("r.*").drop("_corrupt"), parsed.filter("r._corrupt IS NOT NULL").select("line")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def corpus_digest(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One digest of a corpus, whatever the order of its rows."""
    each = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.col(text)), 256)
    return docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(each).cast("decimal(38,0)")).cast("string").alias("digest"))


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
