"""Content-addressed WARC archive, with DataFrame functions only.

The archive is two tables. ``payloads`` holds the bytes of each distinct payload once, under a
strong digest; ``records`` holds the exact header block of every record and the digest of its
payload. Payloads count as equal when SHA-256, SHA-1 and length all agree, and each read checks
the stored bytes against their digest before a record is rebuilt by a join on it. Payloads are
stored in buckets of that digest, so the join does not shuffle them.

Equal payloads meet in partial aggregates before they are shuffled, so a payload that a third of
all pages share costs a row a task. Who is the response is settled over digests alone. A reader
that wants no payload never moves one: lengths and digests are taken where the bytes lie.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.plans.cut import _remove, shared_dir

# The alphabet of base 32 and the fields of a record.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# End of fixed values.
NO_DATE = "1970-01-01T00:00:00Z"


def _base32(digest: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal: 32 letters of five bits, each inside two digits."""

    def letter(i: Column) -> Column:
        pair = F.conv(F.substring(digest, F.floor(i * 5 / 4).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
        bits = F.floor(pair / F.pow(F.lit(2), 3 - (i * 5) % 4)).cast("int")
        return F.substring(F.lit(BASE32), bits.bitwiseAND(F.lit(31)) + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _line(name: str, value: Column) -> Column:
    """A header line; line breaks inside a value become spaces; no value, no line."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\\r\\n]+", " "), F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = NO_DATE) -> None:
    """Write one record for each row of ``pages`` (page_id, url, html).

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest
    page_id is a response and the others revisit it; smaller payloads are all responses. A null
    html is an empty payload, a null url has no target line. Rows that repeat the response's
    page_id are responses too, and so are rows without a page_id where no row of the group has
    one. Other columns do not matter.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    key = F.concat_ws("-", F.sha2("payload", 256), F.sha1("payload"), size)
    heads = whole.select("page_id", "url", key.alias("content"), size.alias("size"), _base32(F.sha1("payload")).alias("sha1"))
    response = heads.filter(F.col("size") >= min_bytes).groupBy("content").agg(F.max("page_id").alias("to"))
    named = heads.join(response, "content", "left").withColumn("to", F.when(F.coalesce(F.col("page_id") != F.col("to"), F.col("to").isNotNull()), F.col("to")))
    revisit = F.col("to").isNotNull()
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("to"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    named.select(header.cast("binary").alias("header"), "content").write.parquet(f"{path}/records")
    _write_payloads(whole.select(key.alias("content"), "payload").groupBy("content").agg(F.first("payload").alias("payload")), f"{path}/payloads")


def _write_payloads(payloads: DataFrame, path: str) -> None:
    """Payloads by buckets of ``content``, as they were shuffled, so that a join on it need not shuffle them again."""
    spark = payloads.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"casemill_warc_{uuid.uuid4().hex}"
    payloads.write.bucketBy(n, "content").sortBy("content").option("path", f"{path}/buckets={n}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the archive is known by its path


def _stored_payloads(spark: SparkSession, path: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    names = [x.getPath().getName() for x in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
    buckets = [int(x.removeprefix("buckets=")) for x in names if x.startswith("buckets=")]
    if not buckets:
        return spark.read.parquet(path)
    name = f"casemill_warc_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (content STRING, payload BINARY) USING parquet CLUSTERED BY (content) SORTED BY (content) INTO {buckets[0]} BUCKETS LOCATION '{path}/buckets={buckets[0]}'")
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may have ended before the interpreter does
        pass


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record)``.

    ``record`` is the original record, byte for byte: a response's is its header joined to its
    stored payload, a revisit's its header alone, and its ``payload`` is null; ``payload_bytes`` and
    ``payload_digest`` are those of the full payload for both. Stored bytes that do not have the
    digest they are filed under, or that a header does not name, raise an error.
    """
    own = F.concat_ws("-", F.sha2("payload", 256), F.sha1("payload"), F.octet_length("payload").cast("long"))
    checked = _stored_payloads(spark, f"{path}/payloads").select("content", "payload", (own == F.col("content")).alias("sound"))

    def field(name: str) -> Column:
        return F.regexp_extract("_h", f"\\r\\n{name}: ([^\\r]*)", 1)

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract("_h", f"\\r\\n{name}: <urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("long")

    part = F.split("content", "-")
    digest = _base32(part[1])
    records = spark.read.parquet(f"{path}/records").withColumn("_h", F.col("header").cast("string")).select(
        "content", "header",
        page("WARC-Record-ID").alias("page_id"),
        F.when(F.contains("_h", F.lit("\r\nWARC-Target-URI: ")), field("WARC-Target-URI")).alias("url"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        part[2].cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest)).alias("named"),
    )
    revisit, end = F.col("record_type") == "revisit", F.lit("\r\n\r\n").cast("binary")
    whole = records.filter(~revisit).join(checked, "content", "left")
    alone = records.filter(revisit).select("*", F.lit(None).cast("binary").alias("payload"), F.lit(True).alias("sound")).select(whole.columns)
    sound = F.coalesce(F.col("sound") & F.col("named"), F.lit(False))
    return whole.unionAll(alone).select(
        "page_id",
        "url",
        "record_type",
        "refers_to",
        F.when(sound, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))).alias("payload_bytes"),
        "payload_digest",
        "payload",
        F.when(revisit, F.concat("header", end)).otherwise(F.concat("header", "payload", end)).alias("record"),
    )


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` written as an archive in the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/casemill-warc-{uuid.uuid4().hex}"
    write_archive(pages, path, min_bytes)
    atexit.register(_remove, spark, path)
    return read_archive(spark, path)
