import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from casemill.llm import pii

SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        back = [int(d) for d in reversed(digits)]
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(back)) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(SHAPES.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
    return sorted(out)


TEXTS = [
    "", None, "mail a@b.com_x@y.org and c@d", "a@b@c.com. x..y@z-1.co.uk", "1.2.3.4.5.6.7.8 999.1.1.1 0255.0.0.1", "é4111 1111-1111 1111 ü",
    "4111111111111112 41111111111111111111 4111-1111-1111-1111-", "1 -4111111111111111", "+1 (487) 555-7209 +12 +1234567890123456",
    "+1 555 123 4567 and 4111111111111111+49 (0) 30-1234567.", "1" * 5000, "a" * 20000 + "@", "x@y." + "z." * 3000 + "q", "no data here",
    "@@@ ++1 1.1.1.", "日本a@b.cd日本", "4222222222222 5.5.5.256",
]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(7)
    parts = ["1", "23", ".", "-", " ", "@", "a", "b.c", "+", "(", "4111111111111111", "+1 555 123 4567", "é", "_", "\n", "9.8.7.6"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(500)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "a@b.cd", 0), (2, TEXTS[2], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int")
    out = pii.scan(df).collect()
    assert len(out) == len(rows)
    for r in out:
        text = "a@b.cd" if r.doc_id is None else texts[r.doc_id]
        assert [tuple(s) for s in r.spans if s.kind != "term"] == brute(text), (text or "")[:200]
    assert pii.scan(df.limit(0)).count() == 0


def test_terms_match_a_direct_computation(spark):
    texts = {1: "call Zorblatt at zz@top.org for the news", 2: "the Zorblatt line is zz@top.org the", 3: "the news of other people", 4: "all the rest", 5: "zorblatted the zz@top.orgs", 6: "news only"}
    for i in range(7, 40):
        texts[i] = f"the filler {i}"
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    out = {r.doc_id: [texts[r.doc_id][s.start : s.stop].lower() for s in r.spans if s.kind == "term"] for r in pii.scan(df).collect()}
    # directly: terms beside zz@top.org in two documents are "zorblatt" and "the"
    n, words = len(texts), {i: set(re.findall(r"[^\W\d_]+", t.lower())) for i, t in texts.items()}
    df_of = Counter(w for ws in words.values() for w in ws)
    share = {w: math.log2(2 * n / (df_of[w] * 2)) / math.log2(n / 2) for w in ("zorblatt", "the")}
    assert share["zorblatt"] > pii.MAX_DISCLOSURE > share["the"]
    assert out[1] == out[2] == ["zorblatt"] and not any(out[i] for i in texts if i > 2)


def test_generalising(spark):
    df = spark.createDataFrame([(1, "mail é a@b.cd or +1 555 123 4567"), (2, ""), (3, "none")], "doc_id long, text string")
    out = df.join(pii.scan(df), "doc_id").orderBy("doc_id").select(pii.generalised(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [r.t for r in out] == ["mail é [EMAIL] or [PHONE]", "", "none"]


def test_very_many_matches_in_one_text(spark):
    """A log of 200,000 addresses, with terms beside them, takes time in proportion."""
    log = "10.1.2.3 Zorblatt " * 200_000
    rows = [(1, log), (2, "Zorblatt 10.1.2.3"), *[(i, "filler") for i in range(3, 40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    out = {r.doc_id: r for r in pii.scan(df).select("doc_id", F.size("spans").alias("n"), F.expr("try_element_at(spans, -1)").alias("last")).collect()}
    assert time.time() - began < 60
    assert out[1].n == 400_000 and (out[1].last.start, out[1].last.stop) == (len(log) - 9, len(log) - 1) and out[2].n == 2


def test_terms_far_from_the_entity_are_found_and_marked_everywhere(spark):
    gap = " filler" * 30 + ". "
    texts = {1: f"Zorblatt Qu came.{gap}mail zz@top.org{gap}zorblatt, said QU", 2: f"zz@top.org{gap}so Zorblatt and qu", 3: "a zorblattish filler"}
    for i in range(4, 40):
        texts[i] = f"the filler so and {i}"
    rows = [*texts.items(), (41, texts[1])]  # a copy counts as a document
    out = {r.doc_id: r.spans for r in pii.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    entity, n = [i for i, t in rows if "zz@top.org" in t], len(rows)
    words = {i: re.findall(r"[^\W\d_]+", t.lower()) for i, t in rows}
    df_of = Counter(w for ws in words.values() for w in set(ws))
    both = Counter(w for i in entity for w in set(words[i]))
    bad = {w for w, k in both.items() if k >= 2 and math.log2(k * n / (df_of[w] * len(entity))) / math.log2(n / len(entity)) > pii.MAX_DISCLOSURE}
    assert {"zorblatt", "qu"} <= bad and not bad & {"filler", "so", "and"}
    for i, t in rows:
        mail = [m.span() for m in re.finditer("zz@top.org", t)] if i in entity else []
        want = [m.span() for m in re.finditer(r"[^\W\d_]+", t) if i in entity and m[0].lower() in bad and not any(a < m.end() and m.start() < b for a, b in mail)]
        assert [(s.start, s.stop) for s in out[i] if s.kind == "term"] == want
    assert len([s for s in out[1] if s.kind == "term"]) > 3
