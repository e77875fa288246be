"""Quality rules: counts over words and lines, and divergence from language references.

A word is a run of characters other than space and the controls 9 to 13. ``counts`` gives the plain rules'
figures. The method proper compares two histograms of a text, of its characters' classes (code points by Unicode category) and of the language's
common words, with those of each language's documents by Jensen-Shannon distance (base 2, so from 0 to 1); a text
is kept if some language is within both limits. Texts with too few characters or words for a stable histogram
are not judged by it: the minimum-length guards.

References count all documents of every language that has LEAST_REFERENCE_WORDS words, whatever its share of the
rows. The common words of a language are those that make up LEAST_WORD_SHARE of its words. They are found exactly in
two passes: each batch names the words that reach a quarter of the share there, so what other batches left out is less
than a quarter of the share overall; of the words named, those counted to three quarters of it (at most 4/3 of
1/share a language) are candidates, and the second pass counts these in all texts.

Defined results: a null text has no words; every count is 0 and base_failed is true. Rows without a language
don't make references but are judged; those of a language without a reference are not judged by it, as other languages'
references say nothing about them. Without any reference nothing is rejected by the method. Repeated rows each
count and are each judged. Very long texts are read whole. An empty table gives an empty result. Extra columns are kept only when named in ``keep``.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, slices, strings, table

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Word characters and words below which a histogram isn't compared.
LEAST_CHARS_JUDGED, LEAST_WORDS_JUDGED = 300, 50
#: Largest Jensen-Shannon distances from a language's reference.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.45
#: Share of a language's words from which on a word counts as common.
LEAST_WORD_SHARE = 1 / 500
#: Words that a language needs for a stable reference: a count, so rows of other languages don't matter.
LEAST_REFERENCE_WORDS = 2000

SYMBOLS = b"#*$%&|<>"
CLASSES = ("upper", "lower", "digit", "space", "stop", "quote", "symbol", "mark", "other")
_CLASS = np.full(128, 1, dtype=np.int64)
for _k, _chars in ((0, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" \t\n\r\x0b\x0c"), (4, b".,;:?"), (5, b"'\"()-"), (6, SYMBOLS), (7, b"!"), (8, bytes(range(9)) + bytes(range(14, 32)) + b"@^~=+\\/{}[]_`\x7f")):
    _CLASS[list(_chars)] = _k
#: Classes of the other characters by Unicode category; letters without case, and marks on letters, count as lower case, and what is not named as other.
_OF_CATEGORY = {"Lu": 0, "Lt": 0, "Ll": 1, "Lm": 1, "Lo": 1, "Mn": 1, "Mc": 1, "Me": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Zl": 3, "Zp": 3, "Po": 4, "Pi": 5, "Pf": 5, "Ps": 5, "Pe": 5, "Pd": 5, "Pc": 5}


@cache
def _class_of_points() -> np.ndarray:
    """The class of every code point."""
    every = np.fromiter((_OF_CATEGORY.get(unicodedata.category(chr(c)), 8) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    every[:128] = _CLASS
    return every


@dataclass
class References:
    languages: list[str]
    classes: np.ndarray  # one row of class shares a language
    words: list[dict[bytes, int]]  # common word -> place in the word histogram; place 0 is every other word
    shares: list[np.ndarray]

    @cached_property
    def holders(self) -> dict[bytes, tuple[list[int], list[float]]]:
        """The languages of each common word, and its share there."""
        out: dict[bytes, tuple[list[int], list[float]]] = {}
        for i, (words, shares) in enumerate(zip(self.words, self.shares, strict=True)):
            for w, at in words.items():
                langs, parts = out.setdefault(w, ([], []))
                langs.append(i)
                parts.append(float(shares[at]))
        return out

    @cached_property
    def others(self) -> np.ndarray:
        """Each language's share of words that are not common."""
        return np.array([x[0] for x in self.shares])

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.languages)


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that add up to 1: the root of the divergence in bits."""
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _bytes(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)


def _class_counts(text: str | None, histogram: np.ndarray) -> np.ndarray:
    """Characters of each class in a text, whose bytes are counted already."""
    if not histogram[128:].any():
        return np.bincount(_CLASS, weights=histogram[:128], minlength=len(CLASSES))
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(_class_of_points()[points], minlength=len(CLASSES)).astype(float)


def _numbered(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Each word's number, and the numbers of the distinct words by first place."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)), number


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words, given by number, that stand in a window of three words that the text holds twice or more."""
    if len(ids) < 4 or distinct == len(ids):
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:  # three numbers would not fit one integer
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


_SYMBOLS, _BLANKS = list(SYMBOLS), list(b" \t\n\r\x0b\x0c")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    return _count(text)[0]


def _count(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray, dict[bytes, int]]:
    """The counts, the histogram of character classes, and the words' numbers with their dictionary."""
    raw = _raw(text)
    words, histogram = raw.split(), _bytes(raw)  # bytes.split() cuts at exactly the six ASCII blanks
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    ids, number = _numbered(words)
    chars = len(text or "") - int(histogram[_BLANKS].sum())
    return (len(words), chars, int(histogram[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated(ids, len(number))), _class_counts(text, histogram), ids, number


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch and language: the class counts (word null), the number of words, and words that reach a quarter of the share here."""
    for batch in batches:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        for part in slices(iter([batch]), 0):
            for t, lang in zip(strings(part.column(0)), part.column(1).to_pylist(), strict=True):
                raw = _raw(t)
                words.setdefault(lang, Counter()).update(raw.split())
                classes[lang] = classes.get(lang, 0) + _class_counts(t, _bytes(raw))
        for lang, found in words.items():
            n = sum(found.values())
            common = [w for w, k in found.items() if k >= n * LEAST_WORD_SHARE / 4]
            kinds = [*range(len(CLASSES)), -1, *[-2] * len(common)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(kinds), pa.string()), pa.array(kinds, pa.int32()), pa.array([*[None] * (len(CLASSES) + 1), *common], pa.binary()), pa.array([*classes[lang].astype(int).tolist(), n, *[found[w] for w in common]], pa.int64())], ["lang", "kind", "word", "n"]
            )


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """References of the languages of all documents."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    first = materialise(rows.mapInArrow(_candidates, "lang string, kind int, word binary, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "words")
    totals = first.where((F.col("kind") == -1) & (F.col("n") >= LEAST_REFERENCE_WORDS)).select("lang", F.col("n").alias("total"))
    named = first.join(totals, "lang").where((F.col("kind") > -2) | (F.col("n") >= 0.75 * LEAST_WORD_SHARE * F.col("total"))).select("lang", "kind", "word", "n").toPandas()
    discard(first)
    # what came back: of each language a row for each class, its number of words, and at most 4/3 of 1/share words
    n_words = {a: int(n) for a, n in named.loc[named.kind == -1, ["lang", "n"]].itertuples(index=False)}
    names = sorted(n_words)
    if not names:
        return References([], np.zeros((0, len(CLASSES))), [], [])
    place = {a: i for i, a in enumerate(names)}
    classes = np.zeros((len(names), len(CLASSES)))
    for a, k, n in named.loc[named.kind >= 0, ["lang", "kind", "n"]].itertuples(index=False):
        classes[place[a], k] = n
    candidates: dict[str, set[bytes]] = {a: set() for a in names}
    for a, w in named.loc[named.kind == -2, ["lang", "word"]].itertuples(index=False):
        candidates[a].add(bytes(w))
    shipped = rows.sparkSession.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for part in slices(iter([batch]), 0):
                for t, name in zip(strings(part.column(0)), part.column(1).to_pylist(), strict=True):
                    if name not in shipped.value:
                        continue
                    here = Counter(_raw(t).split())
                    for w in shipped.value[name]:
                        if n := here.get(w):
                            found[name, w] += n
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([w for _, w in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    exact = rows.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    counted: dict[str, list[tuple[bytes, int]]] = {a: [] for a in names}
    for a, w, n in exact.itertuples(index=False):
        if n >= n_words[a] * LEAST_WORD_SHARE:
            counted[a].append((bytes(w), int(n)))
    words, shares = [], []
    for name in names:
        got = sorted(counted[name])
        words.append({w: i for i, (w, _) in enumerate(got, 1)})
        share = np.array([0, *(n for _, n in got)], dtype=float) / n_words[name]
        share[0] = 1 - share.sum()
        shares.append(share)
    return References(names, classes / np.maximum(1, classes.sum(1, keepdims=True)), words, shares)


def _information(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The terms p log2(p / m), 0 where p is 0."""
    return p * np.log2(np.maximum(p, 1e-300) / np.maximum(m, 1e-300))


def distances(refs: References, classes: np.ndarray, found: dict[bytes, int], n_words: int) -> tuple[int, float, float]:
    """The nearest language by the larger of both distances, each as a part of its limit, and these distances."""
    p = classes / max(1.0, classes.sum())
    m = (p + refs.classes) / 2
    by_class = np.sqrt(np.maximum(0, (_information(p, m) + _information(refs.classes, m)).sum(1) / 2))
    # a common word that the text lacks adds half its share; only those that it holds are looked at
    size, holders = len(refs.languages), refs.holders
    held = [(k, *holders[w]) for w, k in found.items() if w in holders]
    at = np.array([i for _, langs, _ in held for i in langs], dtype=np.int64)
    q = np.array([x for _, _, parts in held for x in parts])
    own = np.repeat(np.array([k for k, _, _ in held], dtype=float), [len(langs) for _, langs, _ in held]) / max(1, n_words)
    m = (own + q) / 2
    total = (1 - refs.others) / 2 + np.bincount(at, (_information(own, m) + _information(q, m) - q) / 2, size)
    rest = np.maximum(0, 1 - np.bincount(at, own, size))
    m = (rest + refs.others) / 2
    by_word = np.sqrt(np.maximum(0, total + (_information(rest, m) + _information(refs.others, m)) / 2))
    best = int(np.maximum(by_class / MOST_CLASS_DISTANCE, by_word / MOST_WORD_DISTANCE).argmin())
    return best, float(by_class[best]), float(by_word[best])


_OUT = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("nearest", pa.string()), ("class_distance", pa.float64()), ("word_distance", pa.float64()))


def judge(df: DataFrame, refs: References, text: str = "text", keep: tuple[str, ...] = ("doc_id",), lang: str = "lang") -> DataFrame:
    """Result: keep..., the counts, base_failed, kept, and the nearest language with its two distances (null where not judged)."""
    shipped = df.sparkSession.sparkContext.broadcast(refs)  # at most 1/share words for each language of LEAST_REFERENCE_WORDS words

    def one(t: str | None, given: str | None) -> tuple:
        figures, classes, ids, number = _count(t)
        n = figures[0]
        failed = n < LEAST_WORDS or 100 * figures[4] > MOST_REPEATED_PERCENT * n
        unknown = not shipped.value.languages or (given is not None and given not in shipped.value.known)
        if unknown or n < LEAST_WORDS_JUDGED or figures[1] < LEAST_CHARS_JUDGED:
            return (*figures, failed, not failed, None, None, None)
        found = dict(zip(number, np.bincount(ids).tolist(), strict=True))
        i, a, b = distances(shipped.value, classes, found, n)
        return (*figures, failed, not failed and a <= MOST_CLASS_DISTANCE and b <= MOST_WORD_DISTANCE, shipped.value.languages[i], a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            got = [one(*x) for x in zip(strings(batch.column(len(keep))), batch.column(len(keep) + 1).to_pylist(), strict=True)]
            columns = zip(*got, strict=True) if got else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, kind) for c, (_, kind) in zip(columns, _OUT, strict=True))], [*keep, *(n for n, _ in _OUT)])

    kinds = {"int64": T.LongType(), "bool": T.BooleanType(), "string": T.StringType(), "double": T.DoubleType()}
    part = df.select(*keep, F.col(text).cast("string").alias("text to read"), (F.col(lang) if lang in df.columns else F.lit(None)).cast("string").alias("language to read"))
    return part.mapInArrow(run, T.StructType([*part.schema.fields[: len(keep)], *(T.StructField(n, kinds[str(k)]) for n, k in _OUT)]))


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs))
