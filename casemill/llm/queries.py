"""The queries of this folder's operators over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import classifier, decontaminate, html_blocks, pieces, pii, rules, secret_scan, simhash, substrings, warc
from casemill.plans.session import with_code

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_code(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.fit_on(docs, _table(spark, sf_dir, "labels")))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"


def _n(spans: str, kind: str):
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")


def op5_secrets(spark: SparkSession, sf_dir: str, ranks: str = TOKEN_RANKS) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), ranks)
    return found.select(
        "doc_id",
        *(_n("spans", kind) for kind in ("assign", "access", "hex")),
        F.expr(f"sha2({_listed('filter(spans, s -> s.kind <> ' + repr('random') + ')')}, 256)").alias("base_sha256"),
        F.expr(_listed("spans")).alias("spans"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(_n("spans", kind) for kind in pii.KINDS[:-1]),
        F.expr(f"sha2({_listed('filter(spans, s -> s.kind <> ' + repr('term') + ')')}, 256)").alias("base_sha256"),
        F.expr(_listed("spans")).alias("spans"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archived(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))


def op10_pieces(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    out = pieces.encode_decode(_table(spark, sf_dir, "documents"), model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_substrings": op2_substrings,
    "op3_html": op3_html,
    "op4_decontaminate": op4_decontaminate,
    "op5_secrets": op5_secrets,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_rules": op8_rules,
    "op9_warc": op9_warc,
    "op10_pieces": op10_pieces,
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

ORACLES: dict[str, str] = {
    "op2_substrings": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
s AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS g FROM d, unnest(range(0, n_bytes - 49)) AS t(p)),
f AS (SELECT md5(g) AS k, min(doc_id) AS first FROM s GROUP BY 1),
h AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prior FROM s JOIN f ON md5(g) = k WHERE first < doc_id),
r AS (SELECT doc_id, p, sum(CASE WHEN prior IS NULL OR p > prior + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM h),
c AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b, lag(max(p) + 50, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS prev_end FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
             string_agg(substr(x, 2 * prev_end + 1, 2 * (a - prev_end)), '' ORDER BY run) AS head, any_value(x) AS x
      FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.x ELSE head || substr(k.x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op4_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM s, unnest(range(1, len(w) - n + 2)) AS t(p)),
dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM iw) AS ns, unnest(range(1, len(w) - n + 2)) AS t(p)),
h AS (SELECT doc_id, p, n, item FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit
      FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) AS x GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, item FROM h) AS y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       coalesce(f.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS "to" FROM p GROUP BY h),
x AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, nullif("to", page_id) AS refers_to, url, h
      FROM p JOIN g USING (h)),
r AS (SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
           ((16 * (instr('0123456789abcdef', substr(s, 5 * i // 4 + 1, 1)) - 1)
             + instr('0123456789abcdef', substr(s, 5 * i // 4 + 2, 1)) - 1) >> (3 - 5 * i % 4)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to, url, h
FROM x)
SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, sha256(concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || record_type,
         'WARC-Record-ID: <urn:page:' || page_id || '>', 'WARC-Date: 1970-01-01T00:00:00Z', 'WARC-Target-URI: ' || url, 'WARC-Payload-Digest: sha1:' || payload_digest,
         'WARC-Refers-To: <urn:page:' || refers_to || '>',
         CASE WHEN refers_to IS NOT NULL THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END,
         'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || CASE WHEN refers_to IS NULL THEN payload_bytes ELSE 0 END, '',
         CASE WHEN refers_to IS NULL THEN h ELSE '' END) || chr(13) || chr(10) || chr(13) || chr(10)) AS record_sha256
FROM r
""",
}
