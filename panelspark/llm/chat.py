"""Conversations as token sequences with a loss mask, and their way back.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Its segments are encoded separately and the marks are spliced in
as reserved ids, so no text can make a mark; in the written form control strings in texts are escaped, which
unescaping undoes. Prefix sums over the segments' lengths give the places of the loss mask: the tokens of
assistant texts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
PART_TOKENS = 1 << 16  # a longer conversation continues in further rows
_ENCODED_CHARS = 1 << 16  # a longer segment is encoded in pieces, cut where the pattern splits whatever is around
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


class Codec:
    def __init__(self, ranks: bytes):
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.start = max(merges.values()) + 2  # the first id after the vocabulary ends texts
        self.end = self.start + 1

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + _ENCODED_CHARS)
            end = cut.start() if cut else len(text)
            out += self.encoding.encode_ordinary(text[at:end])
            at = end
        return out

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode()

    def turn(self, role: str, text: str) -> tuple[list[int], tuple[int, int]]:
        """Ids of a turn, and the range of its text in them."""
        segments = [[self.start], self.encode(escape_role(role) + "\n"), self.encode(escape(text)), [self.end], self.encode("\n")]
        ends = list(accumulate(map(len, segments)))
        return [i for s in segments for i in s], (ends[1], ends[2])


def _types(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


def format_conversations(
    rows: DataFrame, ranks: bytes, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv, part, input_ids, loss_mask, text): every conversation as token ids, their mask and the written form.

    Turns go in the order of ``turn_col``, equal ones by role and text, null first; null roles and texts are empty,
    and rows with a null conversation make one of their own; repeated rows are repeated turns; other columns are
    not read; an empty table gives an empty one. A conversation is one row, or several parts in order (cut between
    turns) where it has more than PART_TOKENS tokens, so that no task holds a long one. Rows of a conversation come out
    together.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    kind = rows.schema[conv_col].dataType
    schema = _types([(conv_col, kind), ("part", T.LongType()), ("input_ids", T.ArrayType(T.IntegerType())),
                     ("loss_mask", T.ArrayType(T.ByteType())), ("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        codec, types = Codec(shared.value), to_arrow_schema(schema)
        held: list = []  # conversation, part, ids, mask, written
        ready: list[list] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*ready), types.types)]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, schema=types)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if not held or held[0] != conv or len(held[2]) >= PART_TOKENS:
                    part = held[1] + 1 if held and held[0] == conv else 0
                    if held:
                        ready.append(held[:4] + ["".join(held[4])])
                    held = [conv, part, [], [], []]
                    if sum(len(r[2]) for r in ready) >= PART_TOKENS:
                        yield out()
                ids, (a, b) = codec.turn(role, text)
                held[2] += ids
                learned = role == LEARNED_ROLE
                held[3] += [int(learned and a <= i < b) for i in range(len(ids))]
                held[4].append(f"{START}{escape_role(role)}\n{escape(text)}{END}\n")
        if held:
            ready.append(held[:4] + ["".join(held[4])])
        if ready:
            yield out()

    turns = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = turns.repartition(F.col("conv")).sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.select("conv", "role", "text").mapInArrow(run, schema)


class _Digest:
    """What a formatted conversation says, read back part by part."""

    def __init__(self, codec: Codec):
        self.codec, self.turns, self.loss = codec, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, ids: list[int], mask: list[int], written: str) -> None:
        at = 0
        while at < len(ids):
            assert ids[at] == self.codec.start
            end = ids.index(self.codec.end, at)
            role, _, text = self.codec.decode(ids[at + 1 : end]).partition("\n")
            self.turns.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
            learned = [i for i, m in zip(ids[at:end], mask[at:end]) if m]
            if learned:
                said = unescape(self.codec.decode(learned))
                self.loss.update(said.encode())
                self.loss_chars += len(said)
            self.n_turns += 1
            at = end + 1
            while at < len(ids) and ids[at] != self.codec.start:  # the line feed between turns
                at += 1
        self.formatted_chars += len(written)

    def row(self) -> tuple:
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)


def read_back(formatted: DataFrame, ranks: bytes, conv_col: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from format_conversations' rows.

    Everything is decoded from the ids and the mask; the rows of a conversation have to come together and in order,
    as format_conversations gives them. One conversation's digests are held at a time.
    """
    shared = formatted.sparkSession.sparkContext.broadcast(ranks)
    schema = _types([(conv_col, formatted.schema[conv_col].dataType), ("n_turns", T.LongType()), ("turns_sha256", T.StringType()),
                     ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        codec, types = Codec(shared.value), to_arrow_schema(schema)
        held = None
        for batch in batches:
            done: list[tuple] = []
            for i in range(batch.num_rows):
                conv, part, ids, mask, written = (c[i].as_py() for c in batch.columns)
                if part == 0:
                    if held:
                        done.append((held[0], *held[1].row()))
                    held = conv, _Digest(codec)
                held[1].add(ids, mask, written)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types.types)], schema=types)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], t) for c, t in zip((held[0], *held[1].row()), types.types)], schema=types)

    return formatted.mapInArrow(run, schema)


def read_ranks(path: str = VOCABULARY) -> bytes:
    """A vocabulary file, read on the driver; it is sent to the tasks."""
    with open(path, "rb") as file:
        return file.read()
