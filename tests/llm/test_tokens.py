import random

import pytest
from tokenizers import Tokenizer, models

from llm_helpers import documents, odd_rows, prose
from panelspark.llm.tokens import SPACE, PieceCounter, count_tokens, read_vocabulary

BYTES = [(f"<0x{i:02X}>", -50_000.0) for i in range(256)]


def reference(vocabulary):
    """The public tokenizer over the same pieces."""
    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *BYTES, *vocabulary], unk_id=0, byte_fallback=True))
    return lambda text: len(tokenizer.encode(SPACE + text.replace(" ", SPACE)).tokens) if text else 0


def brute(vocabulary, text):
    """Best score, and the pieces of the segmentation that the tie rule picks, by trying every last piece."""
    known, floor = dict(vocabulary), min(s for _, s in vocabulary) - 10
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(end):
            piece = text[start:end]
            if piece in known:
                options.append((best[start][0] + known[piece], -start, best[start][1] + 1))
            elif end - start == 1:
                options.append((best[start][0] + floor, -start, best[start][1] + len(piece.encode())))
        score, _, n = max(options)
        best.append((score, n))
    return best[-1][1]


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary()


def test_like_the_public_tokenizer(vocabulary):
    counter, count = PieceCounter(vocabulary), reference(vocabulary)
    rng = random.Random(2)
    texts = [prose(i, 40) for i in range(20)] + ["", " ", "   a  b ", "\n\t x", "été 漢字 🎈🎈 нет", "▁▁a▁b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts += ["".join(rng.choice("aeinrst éñß漢🎈\n.,▁ ") for _ in range(300)) for _ in range(40)]
    for text in texts:
        assert counter.total(text) == count(text), text


@pytest.mark.parametrize("seed", range(6))
def test_ties(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choice("ab" + SPACE * (seed % 2)) for _ in range(rng.randrange(1, 5))) for _ in range(12)}
    vocabulary = [(p, float(-rng.randrange(1, 4))) for p in sorted(pieces)]
    counter = PieceCounter(vocabulary)
    for _ in range(200):
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14)))
        assert counter.total(text) == brute(vocabulary, SPACE + text.replace(" ", SPACE))


def test_table(spark, odd, none, vocabulary, monkeypatch):
    monkeypatch.setattr("panelspark.llm.tokens._CACHED_WORDS", 5)
    counter = PieceCounter(vocabulary)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_chars"]) for r in count_tokens(odd, vocabulary).collect())
    assert got == sorted((d or 0, counter.total(t or ""), len(t or "")) for d, t, *_ in odd_rows())
    assert count_tokens(none, vocabulary).count() == 0
    assert {r["n_tokens"] for r in count_tokens(documents(spark, [(1, "é", None, None)]), []).collect()} == {5}
