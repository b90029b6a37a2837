import random

import numpy as np
import pytest

from casemill.llm import substrings as S
from casemill.llm.suffix_sort import BlindTrie, deep_shallow_sort


def brute(rows):
    """rows: (doc_id or None, text); removed bytes of each."""
    first = {}
    for doc, text in rows:
        raw, doc = (text or "").encode(), S.NO_ID if doc is None else doc
        for i in range(len(raw) - 49):
            s = raw[i : i + 50]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < (S.NO_ID if doc is None else doc):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shallow", [8, 16, 40])
def test_sorting_matches_python(shallow):
    rng = random.Random(3)
    raw = ("".join(rng.choices("ab", k=300)) + "a" * 400 + "".join(rng.choices("abc", k=300)) + "xyz" * 150).encode() * 2
    text = np.frombuffer(raw, np.uint8)
    groups = np.array([rng.randrange(6) for _ in range(3000)])
    lengths = np.array([3, 8, 13, 17, 50, 79])[groups]
    starts = np.array([rng.randrange(len(raw) - 79) for _ in range(3000)])
    order, run = deep_shallow_sort(text, starts, lengths, groups, shallow)
    assert sorted(order.tolist()) == list(range(3000))
    strings = [(groups[i], raw[starts[i] : starts[i] + lengths[i]]) for i in order]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(strings, strings[1:])] == (run[1:] == run[:-1]).tolist()  # noqa: B905
    none = np.zeros(0, np.int64)
    assert len(deep_shallow_sort(text, none, none, none)[0]) == 0


def test_blind_trie():
    rng = random.Random(1)
    words = ["".join(rng.choices("ab", k=9)).encode() for _ in range(300)]
    trie = BlindTrie()
    for i, w in enumerate(words):
        trie.insert(w, i)
    leaves = trie.leaves()
    assert [x[0] for x in leaves] == sorted(set(words))
    assert all(words[i] == x[0] for x in leaves for i in x[1:]) and sum(len(x) - 1 for x in leaves) == 300


def test_stretches_hold_every_start_once():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcd ", k=n)).encode() for n in (0, 10, 49, 50, 51, 400, 3000)]
    doc, h, u, start, n, anchor = S.stretches(texts)
    for d, text in enumerate(texts):
        covered = sorted(s + k for s, c in zip(start[doc == d], n[doc == d], strict=True) for k in range(c))
        assert covered == list(range(max(0, len(text) - 49)))
    assert n.max() <= S.SPAN


def test_packing():
    arrays = [np.arange(5, dtype=np.int64) - 2, np.zeros(0, np.uint8), np.array([7], np.uint32), np.array([2**63], np.uint64)]
    for a, b in zip(arrays, S._unpacked(S._packed(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


@pytest.mark.parametrize("hot,block", [(20_000, 60_000), (2, 3), (0, 60_000)])
def test_matches_brute_force(spark, hot, block, monkeypatch):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    shared = [say(70), say(50), say(49), say(400), "=" * 120]
    rows = [(i, say(rng.randrange(200)) + rng.choice(shared) + say(rng.randrange(60)) + rng.choice(shared) + say(rng.randrange(9))) for i in rng.sample(range(1000), 60)]
    base = say(900)
    for i in range(2000, 2012):
        k = rng.randrange(850)
        rows.append((i, base[:k] + "#" + base[k + 1 :]))
    rows += [(1500, base), (1501, base), (None, base), (None, base + "tail"), (7000, ""), (7001, None), (7002, "x" * 300), (6000, "x" * 99)]
    rows += [(1500, base), (5000, say(100)), (5000, base[:200]), *[(8000, base)] * 9]
    df = spark.createDataFrame([(*r, "e", "p") for r in rows], "doc_id long, text string, kept string, pack string").repartition(4)
    got = sorted((tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r) for r in S.dedup(df, hot).collect()), key=repr)
    assert got == sorted([(None if r[0] == S.NO_ID else r[0], *r[1:]) for r in brute(rows)], key=repr)


def test_strings_round_one_phrase_are_told_apart(spark):
    """Different strings with a common anchor, whatever their hashes, have nothing removed."""
    rows = [(1, "abzmrkjjcmshruykjtioqenuxnbyztcnbiswhskeofdvjkuzsp"), (2, "iuzldgvjyjtrwikkjtioqenuxnbyztcnbisdzfrnfissyvvwfz")]
    assert [r.n_removed for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0]
    # many contexts of one phrase, in one sort: bytes decide, so nothing is found but the planted pair
    rng = np.random.default_rng(1)
    n, phrase = 300_000, np.frombuffer(b"kjtioqenuxnbyztcnbis", np.uint8)
    text = rng.integers(97, 123, (n, 50)).astype(np.uint8)
    text[:, 15:35] = phrase
    text[n - 1] = text[5]
    lo, ones = np.arange(n), np.ones(n, np.int64)
    mask = S._masks(text.ravel(), np.arange(n) * 50, np.zeros(n, np.uint64), lo, ones, 15 * ones, np.zeros(n, bool))
    assert np.flatnonzero(mask).tolist() == [n - 1]


def test_long_texts_and_empty_tables(spark):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefgh ", k=2_300_000))
    rows = [(1, text), (2, text[1_000_000:1_200_000] + "!" + text[2_000_000:2_000_060])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in S.dedup(df).collect()}
    assert out[1].n_removed == 0 and (out[2].n_removed, out[2].n_spans, bytes(out[2].kept)) == (200_060, 2, b"!")
    assert S.dedup(df.limit(0)).count() == 0
