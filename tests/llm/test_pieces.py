import random

import public_tokenizers
import pytest
import sentencepiece

from casemill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "  a  b ", "▁x", "a▁▁b", "a\n b", "\t", "日本𠀀x", "<s>hi</s><unk><0x0A>", "\x00a", "x" * 5000, "ab" * 2500,
    "the quick brown fox " * 20, "É è ß ñ œ     end", "   lead", "trail   ", "=" * 300 + " " * 70 + "-" * 90, "𝒳" * 3000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(spark, library):
    rng = random.Random(3)
    letters = list("etaoin shrdlu.,\n") + ["é", "▁", "the", "ing", "  ", "日", "́", "0", "\U0001f600"]
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randrange(120))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "same", 1)] * 2, "doc_id long, text string, ids int")
    out = pieces.encode_decode(df, PATH).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = "same" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.ids == library.encode(text), text[:80]
        assert r.decoded == library.decode(r.ids), text[:80]
    assert pieces.encode_decode(df.limit(0), PATH).count() == 0


def test_decode_of_any_ids(library):
    model = pieces.PieceModel(open(PATH, "rb").read())
    assert model.decode([]) == ""
    assert model.decode(library.encode("a b")) == "a b"


def test_rounds_and_heap_agree(monkeypatch):
    model, rng = pieces.PieceModel(open(PATH, "rb").read()), random.Random(4)
    words = ["▁" + "".join(rng.choices("etaoinshrdl0é日=", k=rng.choice([1, 5, 40, 700]))) for _ in range(200)]
    by_rounds = model.encode_words(words)
    monkeypatch.setattr(pieces, "LONG", 0)
    assert model.encode_words(words) == by_rounds


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceModel(b"")
