import random
import re

import pytest

from casemill.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window):
    doc = words(text)
    hit, found = set(), set()
    for name, item in items:
        own = words(item)
        if not own:
            continue
        w = min(window, len(own))
        for k in range(len(own) - w + 1):
            for i in range(len(doc) - w + 1):
                if doc[i : i + w] == own[k : k + w]:
                    hit |= set(range(i, i + w))
                    found.add(str(name))
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [10**6, 25])
def test_matches_brute_force(spark, block_words):
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "D", "é", "7"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.choice([0, 1, 2, 4, 5, 9, 14]))) for i in range(3, 12)] + [(20, None), (21, "a b c d a b"), (22, "a b c d a b")]
    texts = [say(rng.randrange(60)) for _ in range(40)] + ["", None, "--", "A-B, c!D a\tb x", "zz " * 3000 + items[5][1]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    for window in (4, 5):
        out = D.contamination(docs, bench, window, block_words).collect()
        assert len(out) == len(texts)
        for r in out:
            assert (r.n_words, r.n_hit, list(r.items)) == brute(texts[r.doc_id], items, window), texts[r.doc_id]
            raw = (texts[r.doc_id] or "").encode()
            assert sum(len(words(raw[s.start : s.stop].decode())) for s in r.spans) == r.n_hit
    assert {r.n_hit for r in D.contamination(docs, bench.limit(0), 4).collect()} == {0}
    assert D.contamination(docs.limit(0), bench, 4).count() == 0


@pytest.mark.parametrize("block_words", [10**6, 30, 12, 5, 1])
def test_results_do_not_depend_on_blocks(spark, block_words):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [
        (1, f"before, {item}. after " + "z " * 40, 5, 1), (2, item, 5, 1), (3, "clean text", 10, 1), (None, item, 5, 1), (None, "clean too", 9, 1),
        (5, item, 5, 1), (5, item, 5, 1), (5, "other text", 5, 1), (6, None, 0, 1), (7, "q r s " + "y " * 9, 5, 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _goes int").selectExpr("*", "1 AS _id", "'s' AS _spans")
    bench = spark.createDataFrame([(1, item), (2, item), (None, "clean text"), (3, "q r s"), (2, "r s"), (4, "-")], "item_id int, text string")
    found = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items)) for r in D.contamination(docs, bench, block_words=block_words).collect()), key=repr)
    assert found == sorted(((i, *brute(t, [x for x in ((1, item), (2, item), (3, "q r s"), (2, "r s"))], 10)) for i, t, _, _ in rows), key=repr)
    out = D.decontaminate(docs, bench, block_words=block_words)
    assert out.schema == docs.schema
    kept = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    assert kept == sorted(
        [(1, "before, . after " + "z " * 40, 96), (3, "clean text", 10), (None, "clean too", 9), (5, "other text", 5), (6, None, 0), (7, " " + "y " * 9, 19)], key=repr
    )


def test_few_blocks_are_out_at_a_time(spark, monkeypatch):
    """The driver holds a bounded part of the benchmark, however large; what several passes find is what one finds."""
    from pyspark import Broadcast, SparkContext

    rng = random.Random(3)
    items = [(i, " ".join(rng.choices("abcdefgh", k=6))) for i in range(40)]
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(30))) + " x" * 9 for _ in range(60)] + [items[0][1] + " y, " + items[39][1] + " z" * 30, None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _found int").repartition(3)
    bench = spark.createDataFrame(items, "item_id int, text string")
    once = {r.doc_id: r for r in D.contamination(docs, bench, 4).collect()}
    whole = sorted(map(tuple, D.decontaminate(docs, bench, 4).collect()), key=repr)
    out, most = set(), [0]

    def sent(self, value, f=SparkContext.broadcast):
        b = f(self, value)
        out.add(id(b))
        kept.append(b)
        most[0] = max(most[0], len(out))
        return b

    def gone(self, *a, f=Broadcast.destroy, **b):
        out.discard(id(self))
        f(self, *a, **b)

    kept = []
    monkeypatch.setattr(SparkContext, "broadcast", sent)
    monkeypatch.setattr(Broadcast, "destroy", gone)
    monkeypatch.setattr(D, "PASS_BLOCKS", 3, raising=False)
    monkeypatch.setattr(D, "READ_BYTES", 100, raising=False)
    assert {r.doc_id: r for r in D.contamination(docs, bench, 4, block_words=18).collect()} == once
    assert len(kept) >= 10 and most[0] <= 3
    out.clear()
    got = D.decontaminate(docs, bench, 4, block_words=18)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect()), key=repr) == whole
    assert most[0] <= 3 and whole != sorted(map(tuple, docs.collect()), key=repr)
    assert sum(r.n_hit > 0 for r in once.values()) > 5
