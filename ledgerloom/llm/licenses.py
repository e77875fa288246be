"""License scan: one Aho-Corasick automaton over a text's words finds identifier tags and notice phrases; the
expression after a tag is read by a shunting-yard parser and evaluated.

A word is a run of ASCII letters, ASCII digits and non-ASCII characters, lower-cased for A to Z. Phrases match at
consecutive words, so ``CC BY-NC`` and ``cc by nc`` are the same. Base phrases name a license each; further
phrases and tags (``SPDX-License-Identifier:`` and the like) are the method's own and only add labels.

An expression's operators are OR, AND and WITH, in rising order of binding, with parentheses. Its labels are all
licenses named; WITH ties an exception to its license. It is satisfied if some alternative holds permissive licenses
only, which is so if either side of an OR, both of an AND, and the left of a WITH are. A text's score is the part of
its evidence (notices and expressions) that is permissive, shrunk by one: p / (n + 1); so 0 without evidence.

Defined results: a null text is empty; without a place first_word and last_word are null; no label is the empty
string. Unbalanced parentheses and stray operators end an expression at what was read well. After a tag without a colon only
known identifiers count, so that prose gives no label. Repeated places and rows all count. Very long texts are read whole, in time
linear in their length and tags. An empty table gives an empty result. Extra columns are kept only when named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, strings, table

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The method's own notices.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "cc by sa": "cc-by-sa",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "proprietary",
}
#: Words of tags that an expression follows.
TAGS = ("spdx license identifier", "license expression")
#: SPDX identifiers, lower-cased, whose label is not the identifier itself.
LABEL_OF = {"apache-2.0": "apache-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd", "mpl-2.0": "mpl", "cc-by-nc-4.0": "cc-by-nc", "cc-by-sa-4.0": "cc-by-sa"}
#: Further identifiers that stand for themselves.
KNOWN = frozenset({"mit", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "0bsd", "artistic-2.0", "bsl-1.0", "epl-2.0", "eupl-1.2", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "postgresql", "wtfpl"} | set(LABEL_OF))
PERMISSIVE = frozenset({"mit", "apache-2", "bsd", "isc", "zlib", "cc0-1.0", "unlicense", "cc-by-4.0"})

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_BINDING = {"OR": 1, "AND": 2, "WITH": 3}


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: identifiers and operators of an expression in postfix order; stops at the first misplaced token."""
    out, stack, operand_next = [], [], True
    for token in (x.rstrip(".-") for x in _TOKEN.findall(expression)):
        op = token.upper()
        if operand_next:
            if token == "(":
                stack.append(token)
                continue
            if token == ")" or op in _BINDING:
                break
            out.append(token)
            operand_next = False
        elif op in _BINDING:
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[op]:
                out.append(stack.pop())
            stack.append(op)
            operand_next = True
        elif token == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            break
    if operand_next and stack and stack[-1] != "(":
        stack.pop()  # an operator that its right side never followed
    return out + [x for x in reversed(stack) if x != "("]


def evaluate(expression: str) -> tuple[set[str], bool]:
    """Labels of all licenses in an expression, and whether some alternative is permissive throughout."""
    labels: set[str] = set()
    stack: list[tuple[set[str], bool]] = []  # an operand's licenses, and whether some alternative of it is permissive
    for token in to_postfix(expression):
        if token not in _BINDING:
            label = LABEL_OF.get(token.lower(), token.lower())
            labels.add(label)
            stack.append(({label}, label in PERMISSIVE))
            continue
        if len(stack) < 2:
            break
        (right, right_ok), (left, left_ok) = stack.pop(), stack.pop()
        if token == "WITH":
            labels -= right - left  # an exception is no license
            stack.append((left, left_ok))
        else:
            few, many = sorted((left, right), key=len)
            many |= few
            stack.append((many, left_ok or right_ok if token == "OR" else left_ok and right_ok))
    return labels, bool(stack) and stack[-1][1]


def _automaton():
    found = ahocorasick.Automaton()
    for phrase, label in BASE.items():
        found.add_word(f" {phrase} ", ("base", label, phrase.count(" ") + 1, len(phrase)))
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", ("notice", label, phrase.count(" ") + 1, len(phrase)))
    for phrase in TAGS:
        found.add_word(f" {phrase} ", ("tag", "", phrase.count(" ") + 1, len(phrase)))
    found.make_automaton()
    return found


_automata: list = []


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of a whole text."""
    if not _automata:
        _automata.append(_automaton())
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    at, base, more, permissive, evidence = [], set(), set(), 0, 0
    tags = _Tags(text or "")
    word = seen = 0  # line[:seen] holds word blanks
    for end, (kind, label, n, length) in _automata[0].iter(line):
        start = end - length  # of the first word
        word, seen = word + line.count(" ", seen, start) if start >= seen else line.count(" ", 0, start), start
        if kind == "tag":
            colon, rest = tags.after(word + n - 1)
            labels, ok = evaluate(rest)
            if labels and (colon or _said(rest)):
                more |= labels
                evidence, permissive = evidence + 1, permissive + ok
            continue
        evidence, permissive = evidence + 1, permissive + (label in PERMISSIVE)
        (base if kind == "base" else more).add(label)
        if kind == "base":
            at.append(word - 1)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), permissive / (evidence + 1)


def _said(rest: str) -> bool:
    """True if an expression begins with a known identifier, in parentheses or not."""
    return next((x.lower().rstrip(".-") in KNOWN for x in _TOKEN.findall(rest) if x != "("), False)


class _Tags:
    """What follows tags of one text, asked for in rising order: the text is read once."""

    def __init__(self, text: str):
        self.text, self.words, self.n, self.end = text, _RAW_WORD.finditer(text), 0, 0

    def after(self, n: int) -> tuple[bool, str]:
        """What follows the first n words on the last one's line, and whether a colon comes first; it is left out."""
        while self.n < n and (m := next(self.words, None)):
            self.n, self.end = self.n + 1, m.end()
        rest = self.text[self.end : (self.text.find("\n", self.end) + 1 or len(self.text) + 1) - 1].lstrip()
        return rest.startswith(":"), rest.removeprefix(":")


_OUT = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()))


def scan_licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Result: keep..., then what ``scan`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            got = [scan(t) for t in strings(batch.column(len(keep)))]
            columns = zip(*got, strict=True) if got else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, kind) for c, (_, kind) in zip(columns, _OUT, strict=True))], [*keep, *(n for n, _ in _OUT)])

    kinds = {"int64": T.LongType(), "string": T.StringType(), "double": T.DoubleType()}
    part = df.select(*keep, F.col(text).cast("string").alias("text to read"))
    return part.mapInArrow(run, T.StructType([*part.schema.fields[: len(keep)], *(T.StructField(n, kinds[str(k)]) for n, k in _OUT)]))


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the scan of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
