"""Secrets in source text and configuration, by lexing assignments.

Besides three fixed patterns, a text is lexed into (name, value) pairs: assignments, keyword arguments, mapping
entries and settings. A value is a chain of string literals and names; names stand for what was last assigned to
them, so a literal is followed through constants and concatenation to the name that it ends up under. A literal
is reported if that name is sensitive and the whole value looks like a secret.
"""

from __future__ import annotations

import hashlib
import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.textkit import slices

KINDS = ["assign", "access", "hex", "literal"]  # order of spans that start together
EDGE = 4096  # characters of both ends of a part that are kept to see what runs over from part to part; a longer word is no name
THRESHOLD = 0.5  # least product of the name's and the value's score

Span = tuple[int, int, int]  # start, number of its kind, end

_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_STRING = (
    r'(?:[rbufRBUF]{1,2}(?=["\']))?'
    r'(?:"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*+\'\'\''
    r'|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`(?:[^`\\]|\\.)*+`)'
)
_PATH = r"[A-Za-z_$][\w$]*+(?:(?:\.|->|::)[A-Za-z_$][\w$]*+)*+"
_PAIR = re.compile(
    r"""(?<![\w$.\-])(?:(?P<name>[A-Za-z_$][\w$.\-]*+)(?:\[(?P<key>"[^"\n]{1,99}"|'[^'\n]{1,99}')\])?"""
    r"""|(?P<quoted>"[^"\n\\]{1,99}"|'[^'\n\\]{1,99}'))"""
    r"""(?:[ \t]*+:[ \t]*+[A-Za-z_][\w.<>\[\]?]{0,40}+(?=[ \t]*+=(?!=)))?"""  # a declared type
    r"""[ \t]*+(?::=|=>|=(?![=~>])|:(?![:/]))[ \t]*+(?P<open>\()?""", re.S)
_OPERAND = re.compile(rf"(?P<string>{_STRING})|(?P<path>{_PATH})(?![\w(\[])|(?P<bare>[^\s,;#\"'`(){{}}\[\]<>]{{1,4097}}+)", re.S)
_JOIN = re.compile(r"[ \t]*+(?:\+|\.\.?(?=[ \t]*+[\"'$A-Za-z_])|\|\||\\\n|)[ \t]*+(?:\\?\r?\n[ \t]*+(?=[\"'+]))?(?:\+[ \t]*+)?")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

# Parts of names that hold secrets, with their weight.
NAME_WORDS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.6, "salt": 0.6, "pin": 0.5,
}
NAME_PAIRS = {
    ("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("account", "key"): 0.9,
    ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("auth", "key"): 0.9, ("master", "key"): 0.9, ("conn", "str"): 0.6,
    ("connection", "string"): 0.6,
}
HARMLESS_ENDS = {"name", "id", "file", "path", "url", "uri", "type", "length", "len", "size", "count", "field", "label", "policy", "hint"}
_FILLED = re.compile(  # a placeholder wherever it stands
    r"(?i)change.?me|example|placeholder|your[_\- ]|dummy|redacted|x{4,}|\*{3,}|\.{3}|\$\{|\{\{")
_UNSET = re.compile(  # a placeholder as a whole
    r"(?i)^\W*$|^(?:none|null|nil|true|false|undefined|todo)$|^\$|^%\w*%$|^<.*>$|^(.)\1*$")

_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.{0,400}?[A-Za-z0-9+/=]{16}", re.S)


def name_score(name: str) -> float:
    """How sensitive a name is, from 0 to 1."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    if not parts or parts[-1] in HARMLESS_ENDS:
        return 0.0
    single = max(NAME_WORDS.get(w, NAME_WORDS.get(w.rstrip("s"), 0.0)) for w in parts)
    return max([single, *(NAME_PAIRS.get(pair, 0.0) for pair in zip(parts, parts[1:]))])


def value_score(value: str, quoted: bool) -> float:
    """How much a value looks like a secret, from 0 to 1: by length, kinds of characters and entropy."""
    return Traits.of(value).score(quoted)


class Traits:
    """All that a text's score depends on. It adds up: a value made of earlier ones is scored whole without being spelled out.

    ``words`` is None without white space, else the first word's traits, the last one's (both may go on outside and be
    empty), and of the words between their number, their best score and whether one is a sensitive name. ``end`` is the
    last character that is no white space.
    """

    __slots__ = ("size", "counts", "head", "tail", "end", "key", "filled", "words")

    def __init__(self, size: int, counts: Counter, head: str, tail: str, end: str, key: bool, filled: bool, words: tuple | None):
        self.size, self.counts, self.head, self.tail, self.end = size, counts, head, tail, end
        self.key, self.filled, self.words = key, filled, words

    @classmethod
    def of(cls, text: str) -> Traits:
        counts, words = Counter(text), None
        if any(map(str.isspace, counts)):
            first, *inner, last = re.split(r"\s+", text)
            words = (cls.of(first), cls.of(last), len(inner), max((value_score(w, False) for w in inner), default=0.0),
                     any(map(_is_name, inner)))
        return cls(len(text), counts, text[:EDGE], text[-EDGE:], text.rstrip()[-1:], _PEM.search(text) is not None,
                   _FILLED.search(text) is not None, words)

    def __add__(self, other: Traits) -> Traits:
        if not self.size or not other.size:
            return self if self.size else other
        seam = self.tail + other.head
        near = seam[max(0, len(self.tail) - 16) : len(self.tail) + 16]  # no placeholder is longer
        words = None
        if self.words and other.words:
            whole = self.words[1] + other.words[0]
            words = (self.words[0], other.words[1], self.words[2] + other.words[2] + (whole.size > 0),
                     max(self.words[3], other.words[3], whole.score(False)), self.words[4] or other.words[4] or whole.is_name())
        elif self.words:
            words = (self.words[0], self.words[1] + other, *self.words[2:])
        elif other.words:
            words = (self + other.words[0], *other.words[1:])
        return Traits(
            self.size + other.size, self.counts + other.counts, (self.head + other.head)[:EDGE], (self.tail + other.tail)[-EDGE:],
            other.end or self.end, self.key or other.key or ("-----" in seam and _PEM.search(seam) is not None),
            self.filled or other.filled or _FILLED.search(near) is not None, words)

    def is_name(self) -> bool:
        return self.size <= EDGE and _is_name(self.head)

    def unset(self) -> bool:
        """Whether the whole text is a placeholder: that depends on its ends and on which characters lie between."""
        if self.size <= EDGE:
            return _UNSET.search(self.head) is not None
        ends = Counter(self.head[:1] + self.tail[-2:])
        between = [c * 9 for c, n in self.counts.items() if n > ends[c]]
        return _UNSET.search("".join([self.head[:1], *between, self.tail[-2:]])) is not None

    def score(self, quoted: bool) -> float:
        if self.key:
            return 1.0
        if self.size < 6 or self.filled or self.unset():
            return 0.0
        if self.words:
            return self.spaced_score() if quoted else 0.0
        kinds = sum(any(map(test, self.counts)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        digits = all(map(str.isdigit, self.counts))
        entropy = -math.fsum(n / self.size * math.log2(n / self.size) for n in self.counts.values())
        if kinds == 1 and not digits:
            strong = entropy >= 3.5 and self.size >= 16
            return 0.8 if strong else 0.6 if quoted and self.size >= 8 else 0.0
        if not quoted and not (any(map(str.isdigit, self.counts)) and any(map(str.isalpha, self.counts))):
            return 0.0
        return min(1.0, 0.35 + 0.1 * kinds + 0.1 * entropy)

    def spaced_score(self) -> float:
        """The score of a value of several words: that of its best word, or of a passphrase.

        A passphrase has three words and 16 letters or more and is no message: no word is itself a sensitive name, nothing is
        filled in, and it ends without a mark.
        """
        first, last, between, best, named = self.words
        best = max(best, first.score(False), last.score(False))
        letters = [c for c in self.counts if not c.isspace()]
        size = sum(self.counts[c] for c in letters)
        message = self.end in ".?!:,;" or any(c in "%{}<>()$/" for c in letters) or named or first.is_name() or last.is_name()
        many = between + (first.size > 0) + (last.size > 0) >= 3
        return max(best, 0.6 if many and size >= 16 and len(letters) >= 8 and not message else 0.0)


def _is_name(word: str) -> bool:
    return len(word) <= EDGE and name_score(word) > 0


class Run:
    """Traits of the ends of one bare word (without white space), from starts that move on: its characters are counted once."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.counts = Counter(text[start:end])
        self.filled = self.next_filled(start)

    def next_filled(self, start: int) -> int:
        found = _FILLED.search(self.text, start, self.end)
        return found.start() if found else self.end

    def traits(self, start: int) -> Traits:
        if start > self.start:
            self.counts -= Counter(self.text[self.start : start])
            self.start = start
        if self.filled < start:
            self.filled = self.next_filled(start)
        tail = self.text[max(start, self.end - EDGE) : self.end]
        return Traits(self.end - start, self.counts, self.text[start : min(self.end, start + EDGE)], tail, tail[-1:], False,
                      self.filled < self.end, None)


def _content(token: str) -> tuple[int, int]:
    """Range of a string literal's content in it."""
    first = next(i for i, c in enumerate(token) if c in "\"'`")
    width = 3 if token[first : first + 3] in ('"""', "'''") and len(token) >= first + 6 else 1
    return first + width, len(token) - width


def literal_spans(text: str) -> set[tuple[int, int]]:
    """Spans of literals that end up under a sensitive name."""
    constants: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    at = run_end = 0
    run = None
    while pair := _PAIR.search(text, at):
        at = pair.end()
        name = pair["name"] or pair["quoted"][1:-1]
        if pair["key"]:
            name += "." + pair["key"][1:-1]
        pieces: list[tuple[int, int] | Value] = []
        quoted, place = False, at
        while operand := _OPERAND.match(text, place):
            if operand["string"] is not None:
                a, b = _content(operand["string"])
                pieces.append((operand.start() + a, operand.start() + b))
                quoted, at = True, operand.end()
            elif operand["path"] is not None and operand["path"] in constants:
                pieces.append(constants[operand["path"]])
                quoted, at = True, operand.end()
            else:
                bare = operand["path"] or operand["bare"]
                if pieces or "=" in text[operand.end() : operand.end() + 1]:
                    break
                # a bare value goes on to the end of its word; the search continues at it, as it may be a name
                if operand.start() >= run_end:
                    word, run = _BARE.match(text, operand.start()), None
                    run_end = word.end() if word else run_end
                if bare and operand.start() < run_end:
                    pieces = [(operand.start(), run_end)]
                break
            join = _JOIN.match(text, operand.end())
            if join.end() == operand.end() or join.end() >= len(text):
                break
            if text[join.end()] not in "\"'`" and not re.search(r"[+|.]", join[0]):
                break  # juxtaposed names are not a chain
            place = join.end()
        if not pieces:
            continue
        weight = name_score(name)
        if not quoted and not weight:
            continue
        if not quoted:
            run = run or Run(text, *pieces[0])
            if weight * run.traits(pieces[0][0]).score(False) >= THRESHOLD:
                found.update(pieces)
            continue
        value = Value(pieces, text)
        constants[name] = constants[name.rsplit(".", 1)[-1]] = value
        if weight and weight * value.traits.score(True) >= THRESHOLD:
            found.update(p for p in value.chain.literals() if p[0] < p[1])
    return found


class Value:
    """A chain of literals' spans and of earlier values, with what it is scored by."""

    def __init__(self, pieces: list[tuple[int, int] | Value], text: str):
        self.chain = Chain([p.chain if isinstance(p, Value) else p for p in pieces])
        self.text = text
        if any(isinstance(p, Value) for p in pieces):
            parts = [p.traits if isinstance(p, Value) else Traits.of(text[p[0] : p[1]]) for p in pieces]
            self.traits = reduce(operator.add, parts)

    @cached_property
    def traits(self) -> Traits:
        return Traits.of("".join(self.text[a:b] for a, b in self.chain.pieces))


class Chain:
    """Spans of literals and earlier chains, which are shared."""

    def __init__(self, pieces: list[tuple[int, int] | Chain]):
        self.pieces, self.reported = pieces, False

    def literals(self) -> Iterator[tuple[int, int]]:
        """Spans of all literals; a chain that has given its own gives none again, which keeps x = x + x linear."""
        todo: list[tuple[int, int] | Chain] = [self]
        while todo:
            chain = todo.pop()
            if not isinstance(chain, Chain):
                yield chain
            elif not chain.reported:
                chain.reported = True
                todo += chain.pieces


_BARE = re.compile(r"[^\s,;#\"'`(){}\[\]<>]++")


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, in order of place and kind."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The fixed patterns' spans, and these with the lexer's."""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base, base
    return base, sorted(base + [(a, 3, b) for a, b in literal_spans(text)])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, mark: str) -> str:
    """``text`` with every stretch that spans cover replaced by ``mark``."""
    out, at, end = [], 0, -1
    for start, _, stop in all_spans(text)[1]:
        if start >= end:
            out += [text[max(at, end) : start], mark]
        end = max(end, stop)
    return "".join(out) + text[max(at, end) :] if end >= 0 else text


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_literal) for every row of ``docs``.

    spans lists kind:start:end in code points (end exclusive) by start, then kind; base_sha256 is the digest of such
    a list without the lexer's ``literal`` spans. Null and empty texts have none; equal rows give equal results; a
    null id stays null; other columns are not read; an empty table gives an empty one. A row is scanned on its
    own, in time linear in its text.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [
        T.StructField(c, t) for c, t in (
            ("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()),
            ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_literal", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text or "")
                counts = Counter(kind for _, kind, _ in spans)
                values = (counts[0], counts[1], counts[2], hashlib.sha256(written(base).encode()).hexdigest(),
                          written(spans), counts[3])
                for column, value in zip(columns, values):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, t) for c, t in zip(columns, types)]], schema.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mark``; all other columns and null texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else redacted(t, mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
