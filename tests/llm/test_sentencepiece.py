import os
import random

import pytest

from cairn.llm import sentencepiece_bpe as S
from cairn.llm.queries import PIECE_MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no model here")


@pytest.fixture(scope="module")
def model():
    return S.Model(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def samples():
    rng = random.Random(3)
    alphabet = "abcdefghij  .,\n\t▁éü中文字😀€-_0129ABC'\""
    fixed = ["", " ", "  a  b ", "Hello world", "aaaaaaaaaaaaaaaaaaaaaaaaa", "\n\n x", "▁▁", "don't stop", "été 中文 mixed 😀😀", "a" * 300, "word " * 200, "\u0000\u0001", "𝔘nicode"]
    return fixed + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(800)] + [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 14))) for _ in range(30)) for _ in range(200)]


def test_ids_equal_the_library(model, library):
    for t in samples():
        assert model.encode(t) == library.encode(t), t


def test_decoding_equals_the_library_and_gives_the_text_back(model, library):
    for t in samples():
        ids = model.encode(t)
        got = model.decode(ids)
        assert got == library.decode(ids), t
        if S.MARK not in t:
            assert got == t


def test_prefix_table_against_plain_merging(model):
    rng = random.Random(5)
    rank = {model.pieces[i]: r for r, i in enumerate(model.ids)}
    for _ in range(400):
        w = "".join(rng.choices("etaoinshr▁", k=rng.randint(1, 16)))
        parts = [rank[c] for c in w]
        while len(parts) > 1:
            best = min(((m, k) for k in range(len(parts) - 1) if (m := model.merged.get(parts[k] * model.span + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        assert model.encode_word(w) == [model.ids[p] for p in parts], w


def test_frames(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    out = S.encode_texts(docs, PIECE_MODEL)
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert (r["ids"] is None) == (r["tokens"] is None) and (r["ids"] is None or len(r["ids"]) == r["tokens"])
    back = S.decode_ids(out, PIECE_MODEL)
    assert sorted(repr((r["doc_id"], r["text"])) for r in back.collect()) == sorted(repr(x) for x in odd_rows)
    assert S.encode_texts(docs_of([]), PIECE_MODEL).count() == 0
