import random

import numpy as np
import pyarrow as pa

from panelspark.llm import textkit
from panelspark.llm.textkit import mix64, text_bytes, word_hashes


def test_word_hashes_are_sums_over_the_words_bytes(monkeypatch):
    step, place, pick = int(textkit._STEP), int(textkit._PLACE[0]), random.Random(1)
    for block in (1, 7, 1 << 17):
        monkeypatch.setattr(textkit, "_BLOCK_BYTES", block)
        for _ in range(100):
            texts = ["".join(pick.choice("aBc \n\té") for _ in range(pick.randrange(30))) for _ in range(pick.randrange(6))]
            words, bounds = word_hashes(*text_bytes(pa.array(texts, pa.string())))
            expected = []
            for w in (w for t in texts for w in t.lower().encode().split()):
                total = sum(int(textkit._BYTE[c]) * pow(step, i + 1, 1 << 64) for i, c in enumerate(w)) + len(w) * place
                expected.append(total % (1 << 64))
            assert words.tolist() == mix64(np.array(expected, np.uint64)).tolist()
            assert np.diff(bounds).tolist() == [len(t.split()) for t in texts]
