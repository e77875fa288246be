"""Language identification by bit-sliced Bloom filters over character n-grams.

Learning keeps, for each language, the n-grams that make up a fair share of its text and are not far more
common elsewhere. One Bloom filter per language is stored bit-sliced: cell i holds bit l of language l's filter,
so one lookup of an n-gram (the AND of its cells) gives the mask of all languages that hold it. A text's
n-grams are looked up, set bits are counted by language, and each count is corrected for its filter's
false-positive rate; the largest corrected count decides.

Defined results: a null text or one without a letter is ``und`` with score 0; a text whose n-grams no language
holds gets the language most common in training with score 0; of equal counts the first language by name wins.
Repeated texts of a language teach once, though all count for LEAST_GRAMS. An empty table gives an empty result.
Rows without a language don't teach. Every language whose rows hold LEAST_GRAMS n-grams is learned, however small its
share of the rows. With no teaching row at all every text is ``und``. Texts are read whole,
very long ones in parts that end between words, which gives the same n-grams. Extra columns are kept only when named in ``keep``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, held_out, materialise, slices, strings, table

#: Length of an n-gram in characters.
NGRAM = 3
#: Expected number of different texts of each language that teach: a sample by hash of the text, so it depends on no order.
ROWS_PER_LANGUAGE = 1500
#: N-grams that a language's sample needs to be learned: a count, so rows of other languages don't matter.
LEAST_GRAMS = 1000
#: An n-gram is kept for a language if it makes up this share of its n-grams, so at most 1/share are kept,
LEAST_SHARE = 1 / 8192
#: and if its share is at least this part of its largest share in any language.
LEAST_PART = 0.5
#: Bloom filter cells and hashes.
CELL_BITS, HASHES = 16, 3

_LETTER = regex.compile(r"\p{L}")
_NO_LETTER = regex.compile(r"[\s,;!?。、，！？；]")  # none is part of a word, nor changes how its neighbours are lower-cased
#: Characters whose n-grams a task holds at once.
PART_CHARS = 250_000
_GAP = " " * NGRAM
_M = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    languages: list[str]
    slices: list[np.ndarray]  # one array of 64-bit cells for each 64 languages
    false_positive: np.ndarray
    default: str


def _letters() -> np.ndarray:
    """Marks code points that can stand in a word: all but what is plainly not a letter."""
    ok = np.zeros(sys.maxunicode + 2, dtype=bool)
    for m in _LETTER.finditer("".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))):
        ok[ord(m[0])] = True
    return ok


_letter_table: list[np.ndarray] = []


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and for each the index of its text."""
    if not _letter_table:
        _letter_table.append(_letters())
    joined = _GAP + _GAP.join(texts) + _GAP
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + NGRAM for t in texts]) + NGRAM
    word = _letter_table[0][c]
    c = np.where(word, c, np.uint32(32)).astype(np.uint64)
    n = len(c) - NGRAM + 1
    h = c[:n].copy()
    for k in range(1, NGRAM):
        h = h * np.uint64(0x100000001B3) ^ c[k : n + k]
    valid = np.ones(n, dtype=bool)
    for k in range(1, NGRAM - 1):
        valid &= word[k : n + k]  # none that spans two words
    at = np.flatnonzero(valid)
    h = h[at] * _M
    return h ^ (h >> np.uint64(29)), np.searchsorted(ends, at, side="right")


def _cells(h: np.ndarray) -> list[np.ndarray]:
    step = (h >> np.uint64(7)) | np.uint64(1)
    return [((h + np.uint64(k) * step) >> np.uint64(64 - CELL_BITS)).astype(np.int64) for k in range(HASHES)]


def _parts(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Lower-cased texts in parts of a bounded total size, with each part's row; a long text is cut where no word goes on."""
    part, rows, total = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            cut = _NO_LETTER.search(t, at + PART_CHARS) if at + PART_CHARS < len(t) else None
            end = cut.start() if cut else len(t)
            part.append(t[at:end].lower())
            rows.append(i)
            total += len(part[-1])
            at = end
            if total >= PART_CHARS:
                yield part, rows
                part, rows, total = [], [], 0
    if part:
        yield part, rows


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram hash, count, count with all copies) of each batch of (text, lang, copies)."""
    for batch in slices(batches, 0):
        langs, copies = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        for part, rows in _parts(strings(batch.column(0))):
            h, at = _grams(part)
            names = sorted({langs[r] for r in rows})
            number = np.array([names.index(langs[r]) for r in rows])[at]
            for k, name in enumerate(names):
                own = number == k
                gram, place, n = np.unique(h[own], return_inverse=True, return_counts=True)
                every = np.bincount(place, weights=copies[np.array(rows)[at[own]]], minlength=len(gram)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n), pa.array(every)], ["lang", "gram", "n", "every"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learns from (text, lang) rows: a hash sample of about ROWS_PER_LANGUAGE different texts of each language."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    sizes = materialise(rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("h").alias("texts")), "sizes")  # one row a language
    sampled = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(float(ROWS_PER_LANGUAGE)) / F.col("texts")) * (1 << 20))
    sampled = sampled.groupBy("lang", "h").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    counts = materialise(sampled.select("text", "lang", "copies").mapInArrow(_count_grams, "lang string, gram long, n long, every long").groupBy("gram", "lang").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("every").alias("every")).where(F.col("every") >= LEAST_GRAMS)
    kept = {r["lang"]: (r["rows"], r["total"]) for r in totals.join(sizes, "lang").collect()}
    names = sorted(kept)
    if not names:
        discard(counts, sizes)
        return Model([], [], np.zeros(0), "und")
    numbered = rows.sparkSession.createDataFrame([(name, i, kept[name][1]) for i, name in enumerate(names)], "lang string, number int, total long")
    shares = counts.join(F.broadcast(numbered), "lang").select("gram", "number", (F.col("n") / F.col("total")).alias("share"))
    most = F.max("share").over(Window.partitionBy("gram"))  # at most a row for each language
    chosen = materialise(shares.withColumn("most", most).where((F.col("share") >= LEAST_SHARE) & (F.col("share") >= LEAST_PART * F.col("most"))).select("number", "gram"), "chosen")
    slices, rates = [], []
    for base in range(0, len(names), 64):  # at most 64 / LEAST_SHARE rows at once
        found = chosen.where(F.col("number").between(base, base + 63)).toPandas()
        number, grams = found["number"].to_numpy(), found["gram"].to_numpy(dtype=np.int64).view(np.uint64)
        cells = np.zeros(1 << CELL_BITS, dtype=np.uint64)
        for i in range(base, min(base + 64, len(names))):
            bit = np.uint64(1 << (i - base))
            for at in _cells(grams[number == i]):
                cells[at] |= bit
            rates.append(float(((cells & bit) != 0).mean()) ** HASHES)
        slices.append(cells)
    discard(counts, chosen, sizes)
    return Model(names, slices, np.array(rates), max(names, key=lambda n: (kept[n][0], n)))


def predict_batch(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    counts = np.zeros((len(texts), max(1, len(model.languages))))
    seen = np.zeros(len(texts))
    for part, rows in _parts(texts):
        h, at = _grams(part)
        if not len(h) or not model.languages:
            continue
        rows = np.array(rows)
        cells = _cells(h)
        np.add.at(seen, rows, np.bincount(at, minlength=len(rows)))
        for base, table_ in zip(range(0, len(model.languages), 64), model.slices, strict=True):
            mask = table_[cells[0]]
            for x in cells[1:]:
                mask = mask & table_[x]
            for i in range(base, min(base + 64, len(model.languages))):
                held = at[(mask & np.uint64(1 << (i - base))) != 0]
                np.add.at(counts[:, i], rows, np.bincount(held, minlength=len(rows)))
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    f = model.false_positive[None, :]
    counts = np.maximum(0, (counts - seen[:, None] * f) / np.maximum(1 - f, 1e-9))
    best, total = counts.argmax(1), counts.sum(1)
    score = np.where(total > 0, counts[np.arange(len(texts)), best] / np.maximum(total, 1e-12), 0.0)
    out = []
    for t, b, n in zip(texts, best, total, strict=True):
        if not t or not _LETTER.search(t):
            out.append("und")
        else:
            out.append(model.languages[b] if n > 0 else model.default)
    score[[x == "und" for x in out]] = 0.0
    return out, np.clip(score, 0.0, 1.0)


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Result: keep..., lang_pred string, score double."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # 8 bytes a cell for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            langs, score = predict_batch(shipped.value, strings(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    part = df.select(*keep, F.col(text).cast("string").alias("text to read"))
    return part.mapInArrow(run, T.StructType([*part.schema.fields[: len(keep)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's language; only rows that are not held out teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
