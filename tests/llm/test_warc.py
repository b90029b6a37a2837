import base64
import hashlib

import pytest

from casemill.llm import warc

ROWS = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (4, "u", None), (5, "u\r\nX: y", ""), (6, "", "é" * 5000),
    (7, "z", "x" * 300_000), (None, "n", "same"), (None, "m", "lone"), (3, "r", "twice"), (3, "r", "twice"),
]


def brute(rows, least):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        to = max(ids, default=None) if len(payload) >= least else None
        to = None if to == page else to
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, content int").repartition(3)
    warc.write_archive(df, str(tmp_path / "w"), least)
    back = warc.read_archive(spark, str(tmp_path / "w")).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]
    assert sorted(got, key=repr) == brute(ROWS, least)
    for r in back:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and rest == (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n"
    assert {(r.page_id, r.url) for r in back} == {(p, u and u.replace("\r\n", " ")) for p, u, _ in ROWS}
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == len({h or "" for _, _, h in ROWS})


def test_a_changed_payload_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path / "w"))
    kept = spark.read.parquet(str(tmp_path / "w/payloads")).collect()
    spark.createDataFrame([(kept[0].content, bytearray(b"tex!"))], "content string, payload binary").write.mode("overwrite").parquet(str(tmp_path / "w/payloads"))
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, str(tmp_path / "w")).collect()


def test_an_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
