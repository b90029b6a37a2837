import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from casemill.llm import rules as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), failed


TEXTS = ["", None, " \n\t", "one", "a b c a b c", "a a a a", "x y\nx y\n\n \nx y\nz\r", "é\xa0ü 日本 #|<>", "w " * 60, "q\x85r\x1cs t"]


def test_counters_match_brute_force(spark):
    rng = random.Random(2)
    say = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(n))
    prose = [say("abcdeé", rng.choice([70, 200])) for _ in range(60)]
    junk = ["#%& " * 30 + "JUNKJUNK " * 5 + " ".join(f"Q{i}%%ZZXX" for i in range(80)), say("жзийклмнопрст", 150), say("漢字仮名交文", 150)]
    texts = TEXTS + prose + junk
    rows = [(i, t, "en" if i % 7 or i >= len(texts) - 3 else None, 1.0) for i, t in enumerate(texts)] + [(None, "a b", "en", 1.0), (0, "", "en", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _log_sum double")
    out = R.assess(df, least_docs=5).collect()
    assert len(out) == len(rows)
    for r in out:
        text = "a b" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
        assert not (r.base_failed and r.kept)
        assert (r.log_perplexity is None) == (r.n_words == 0)
    kept = {r.doc_id for r in out if r.kept}
    assert len(kept) > 50 and not kept & set(range(len(texts) - 3, len(texts)))
    good = R.keep_good(df, least_docs=5)
    assert good.schema == df.schema and {r.doc_id for r in good.collect()} == kept
    assert R.assess(df.limit(0)).count() == 0 and R.keep_good(df.limit(0)).count() == 0


def test_repeated_words_of_very_many_kinds(monkeypatch):
    assert R.repeated([b"%d" % x for x in (5, 6, 2**21 + 9, 5, 7, 9, 1, 2)]) == 0
    many = [b"%d" % i for i in range(2_100_000)]
    assert R.repeated(many) == 0 and R.repeated([*many, *many[-3:]]) == 6
    rng = random.Random(3)
    for wide in (2_000_000, 1):
        monkeypatch.setattr(R, "WIDE", wide)
        for _ in range(200):
            words = rng.choices("abc", k=rng.randrange(12))
            assert R.repeated([w.encode() for w in words]) == brute(" ".join(words))[4]


def test_rare_languages_share_a_model(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choices("abcde", k=4)) for _ in range(60)), "xx" if i < 50 else f"y{i}") for i in range(90)]
    rows.append((90, " ".join("".join(rng.choices("αβγδεζηθικλμνξοπ", k=9)) for _ in range(60)), "yy"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert R.frequent(df) == ["xx"]
    kept = {r.doc_id for r in R.keep_good(df).collect()}
    assert 90 not in kept and len(kept) > 80 and len([i for i in kept if i >= 50]) > 30
    few = df.filter("doc_id < 50 OR doc_id > 80")  # too few to know anything about them
    assert {i for i in range(81, 91)} <= {r.doc_id for r in R.keep_good(few).collect()}


def direct(texts):
    """Log probabilities with one occurrence left out, straight from the definition; and the probabilities."""
    counts = Counter()
    for text in texts:
        s = " " * 4 + "".join(w + " " for w in text.split())
        counts.update(s[i : i + 5] for i in range(len(s) - 4))
    levels = {5: counts}
    for k in (4, 3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    size = len(levels[1])
    discounts = {}
    for k, level in levels.items():
        n1, n2, n3, n4 = (sum(n == j for n in level.values()) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3] if n1 and n2 and n3 and n4 else [0.5, 0.75, 1.0]
        discounts[k] = [0, *(max(x, R.LEAST_DISCOUNT) for x in d)] if n1 and n2 and n3 and n4 else [0, *d]

    def p(gram, out):
        k = len(gram)
        if k == 0:
            return 1 / (size + 1)
        own = {g: n for g, n in levels[k].items() if g[:-1] == gram[:-1]}
        gone = out and own[gram] == 1
        if out:
            own[gram] -= 1
        total, d = sum(own.values()), discounts[k]
        low = p(gram[1:], gone)
        if total == 0:
            return low
        n = own.get(gram, 0)
        return (n - d[min(n, 3)]) / total + sum(d[min(x, 3)] for x in own.values()) / total * low

    return counts, p


def test_model_matches_a_direct_computation(spark, monkeypatch):
    texts = ["abba abab cab bad a dada Abe b2b", "a-a rare daba caba abba", "привет мир, привет", "漢字 𝒜𝒷 漢字漢", "abba abab\tcab"]
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    monkeypatch.setattr(R, "LEAST_DOCS", 1)
    counts, p = direct(texts)
    rows = {r.gram: r for r in R.kneser_ney(R.count_grams(df)).collect()}
    assert set(rows) == set(counts)
    for g, r in rows.items():
        assert (r.p, r.q) == pytest.approx((p(g, False), p(g, True)), rel=1e-9), g
    whole = {r.doc_id: r.log_perplexity for r in R.assess(df, least_docs=1).collect()}
    for i, text in enumerate(texts):
        s = " " * 4 + "".join(w + " " for w in text.split())
        assert whole[i] == pytest.approx(-sum(math.log(p(s[k : k + 5], True)) for k in range(len(s) - 4)) / (len(s) - 4), rel=1e-5)
    monkeypatch.setattr(R, "BLOCK_BYTES", 300)
    assert len(R.Model(df)) > 2 and {r.doc_id: r.log_perplexity for r in R.assess(df, least_docs=1).collect()} == pytest.approx(whole, rel=1e-5)


@pytest.mark.parametrize("tallied", [10**6, 50])
def test_tallies(tallied, monkeypatch):
    monkeypatch.setattr(R, "TALLIED", tallied)
    rng, tally, got, want = random.Random(1), R.Tally(), Counter(), Counter()
    blocks = [[[chr(0x4E00 + (7 * i * i) % 9000).encode() for i in range(9000)]], [[], [b"ab", b"ab"]], [], [[]]]
    blocks += [[["".join(rng.choices("abcя漢", k=5)).encode() for _ in range(40)]] for _ in range(5)] + [[[chr(0x3000 + i).encode() for i in range(4090)]]]
    for k, words in enumerate(blocks):
        for lang, grams, n in tally.add("xy"[k % 2], *R.streams(words)):
            got.update({(lang, g): c for g, c in zip(grams, n.tolist(), strict=True)})
        for w in filter(None, words):
            s = "    " + "".join(x.decode() + " " for x in w)
            want.update(("xy"[k % 2], s[i : i + 5]) for i in range(len(s) - 4))
    for lang, grams, n in tally.flush():
        got.update({(lang, g): c for g, c in zip(grams, n.tolist(), strict=True)})
    assert got == want


def test_the_model_is_worked_out_in_small_plans(spark):
    """The driver keeps each plan and describes it again after every stage; in one piece this one had 33 exchanges."""
    counts = R.stored(spark.createDataFrame([("en", "abcde", 2), ("en", "bcdea", 1)], "lang string, gram string, n long"), "grams")
    lower = R.lower_orders(counts)
    assert [sorted(r.gram for r in level.collect()) for level in lower] == [["bcde", "cdea"], ["cde", "dea"], ["de", "ea"], ["a", "e"]]
    plan = R.kneser_ney(counts, lower)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 20
