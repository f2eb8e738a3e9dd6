"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces in a text; dynamic programming over the matches carries
the best score and its number of pieces. Ties and unknown characters follow the public unigram tokenizers: of
equal scores the one whose last piece starts first stays, and a character without a piece of its own may be
passed at ten under the least score and is then counted as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.textkit import slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_UNKNOWN_PENALTY = 10.0
_CACHED_WORDS = 300_000  # per task; the cache is emptied when it is full
_CACHED_CHARS = 64

Vocabulary = Sequence[tuple[str, float]]


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file with their scores, read on the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size()) if not any(f(i) for f in odd)]


class PieceCounter(dict):
    """Number of pieces of each word; looks a word up or counts it."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - _UNKNOWN_PENALTY
        # Unless a piece runs over the start of a word, the best path breaks there, and words count separately.
        self.words = re.compile(
            rf"{SPACE}+[^{SPACE}]*" if all(SPACE not in p.lstrip(SPACE) for p, _ in vocabulary) else r"(?s).+")

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= _CACHED_CHARS:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = n
        return n

    def count(self, word: str) -> int:
        scores, counts = [0.0], [0]
        found = self.automaton.iter(word) if len(self.automaton) else iter(())
        match = next(found, None)
        for end, letter in enumerate(word):
            best, pieces, single = None, 0, False
            while match is not None and match[0] == end:  # longer matches, which start first, come first
                size, score = match[1]
                score += scores[end + 1 - size]
                if best is None or score > best:
                    best, pieces = score, counts[end + 1 - size] + 1
                single = single or size == 1
                match = next(found, None)
            if not single:
                score = scores[end] + self.unknown
                if best is None or score > best:
                    best, pieces = score, counts[end] + len(letter.encode())
            scores.append(best)
            counts.append(pieces)
        return counts[-1]

    def total(self, text: str) -> int:
        return sum(map(self.__getitem__, self.words.findall(SPACE + text.replace(" ", SPACE)))) if text else 0


def count_tokens(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, n_chars) for every row of ``docs``: pieces and code points of the whole text.

    Spaces are written as the vocabulary's space mark and one is put in front; nothing else is normalised. Null and
    empty texts have 0; without a vocabulary every character counts its bytes; equal texts get equal counts; other
    columns are not read; an empty table gives an empty one. The vocabulary is small and goes to every task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(vocabulary))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shared.value)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([counter.total(t) for t in texts], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64())], schema.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
