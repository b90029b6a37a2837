import math
import random
import zlib

import numpy as np
import pytest
from test_crf import brute as brute_marginals

from casemill.llm import classifier as C

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = C.score(docs, C.fit_on(docs, labels)).join(labels, "doc_id").toPandas()
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == h for d, h in zip(out.doc_id, out.held_out, strict=True))
    unseen = out[out.held_out]
    assert len(unseen) > 1000 and (unseen.predicted == unseen.quality).mean() > 0.98
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()


def test_lines_count_everything():
    texts = [b"", b"a b a\n\na b a", b"x", b"\n", "é É\r\n q".encode()]
    x, lengths, weight = C.lines_of(texts)
    assert lengths.tolist() == [0, 3, 1, 2, 2] and weight.tolist() == [5, 0, 5, 1, 0, 0, 6, 2]
    names = list(C.EDGES)
    at = sum(len(C.EDGES[k]) + 1 for k in names[: names.index("again")])
    assert (x[:, names.index("again")] - at).tolist() == [0, 0, 1, 0, 0, 0, 0, 0]
    assert C.lines_of([])[0].shape[0] == 0


def test_odd_rows(spark):
    rows = [(1, "", 0), (2, None, 0), (None, "some text here.", 1), (4, "w " * 100000, 0), (4, "w " * 100000, 0), (5, "\n" * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (4, None), (4, 1), (4, 1), (9, 0)], "doc_id long, quality int")
    model = C.fit_on(docs, labels)
    out = C.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 4}) == 1 and not [r for r in out if r.doc_id is None][0].held_out
    assert {r.score for r in C.score(docs, C.fit_on(docs, labels.limit(0))).collect()} == {0.5}
    assert C.score(docs.limit(0), model).count() == 0
    assert np.isfinite(C.fit([b"a", b"b"], [1, 1]).score([b"a"])).all()


def brute_lines(text):
    """Features of each line of a text and the line's bytes, one line after the other."""
    lines = text.split(b"\n") if text else []
    count = lambda line, chars: sum(b in chars for b in line)
    every = [w for line in lines for w in line.split()]
    grams = [tuple(every[i : i + 3]) for i in range(len(every) - 2)]
    seen_w = [w in every[:i] for i, w in enumerate(every)]
    seen_g = [g in grams[:i] for i, g in enumerate(grams)] + [False, False]
    at, own = 0, []
    for k, line in enumerate(lines):
        n = len(line.split())
        letters = {c: count(line, s) for c, s in {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&<>{}[]^~@\\=_", "punct": b".,;:?'\"()-", "space": b" \t\n\r\x0b\x0c", "wide": range(192, 256), "bar": b"|", "shout": b"!"}.items()}
        share = {c: v / max(len(line), 1) for c, v in letters.items()}
        own.append(
            {**share, "bytes": len(line), "words": n, "word_bytes": (len(line) - letters["space"]) / max(n, 1), "same_words": sum(seen_w[at : at + n]) / max(n, 1),
             "same_grams": sum(seen_g[at : at + n]) / max(n, 1), "again": float(n > 0 and line.split() in [x.split() for x in lines[:k]]), "doc_words": len(every), "doc_same_grams": sum(seen_g) / max(len(every), 1)}
        )
        at += n
    bins = [{k: sum(e <= m[k] for e in edges) for k, edges in C.EDGES.items()} for m in own]
    rows = []
    for k in range(len(lines)):
        x, at = [], 0
        for name, edges in C.EDGES.items():
            x.append(at + bins[k][name])
            at += len(edges) + 1
        for other in (k - 1, k + 1):
            there = 0 <= other < len(lines)
            missing, at = at, at + 1
            for name in C._NEAR:
                x.append(at + bins[other][name] if there else missing)
                at += len(C.EDGES[name]) + 1
        rows.append(x)
    return np.array(rows, np.int64), [len(line) for line in lines]


def test_scores_match_brute_force(spark):
    """Scores of the query's operator, from the features of each line to the document's, by plain loops and enumeration."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = C.fit_on(docs, labels)
    rng = random.Random(1)
    words = "the cat's hat, and The dog! ran || over #12 %% être straße Ärger 日本 x=1 A.B.".split()
    line = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 14)))
    texts = ["\n".join(rng.choice([line, line, lambda: "the cat and dog", lambda: ""])() for _ in range(rng.randrange(1, 8))) for _ in range(60)] + ["", "x", "a b a b a b a b a b"]
    texts += [r.text for r in docs.filter("n_chars < 600").limit(40).collect() if r.text.count("\n") < 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in C.score(df, model).collect():
        raw = texts[r.doc_id].encode()
        x, sizes = brute_lines(raw)
        if not len(x):
            assert r.score == model.empty
            continue
        p = np.clip(brute_marginals(model.field, x, [len(x)])[0][:, 1], 1e-6, 1 - 1e-6)
        good = sum((n + 1e-3) * q for n, q in zip(sizes, p, strict=True)) / sum(n + 1e-3 for n in sizes)
        good = min(max(good, 1e-6), 1 - 1e-6)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.slope * math.log(good / (1 - good)) + model.middle))), abs=1e-9), texts[r.doc_id]
    assert C.fit_on(docs, labels, max_bytes=100) is None and C.fit_on(docs, labels, max_docs=50) is not None
