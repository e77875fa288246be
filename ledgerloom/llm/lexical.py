"""Ranked lexical search: postings in term buckets, joined with the items' terms, scored in whole numbers, summed by item and document.

A term is a run of ASCII letters, ASCII digits and non-ASCII characters, lower-cased for A to Z. ``postings`` gives a row for
each different term of a document with how often it stands there and how long the document is. They are written in buckets
by hash of term and document, so a term that stands in every document fills many buckets, and the rows of one term lie together in each.
The number of documents and of terms comes along as rows without a term, one for each task, so texts are read once.

A search asks for the items' terms only: the join that keeps their postings runs before these are shuffled (Spark sends the
items' terms to all tasks while they are below its own broadcast limit, measured, and shuffles by term otherwise). Weights are one row a term.
Scored postings then move once, by document; what an item gains from a document is summed where the document lies, and each task keeps
its best TOP of an item before these meet, so neither a common term nor a large item gathers rows anywhere.

Defined results: every row of documents with a term is a document of its own, repeated rows too; a null or wordless text has
no term and counts nowhere. Rows of equal score come by doc_id, nulls last, then in the order in which they were read. A null or wordless
item has no rows, and an item_id that stands in several rows is one item with the terms of all. An empty table on either side gives an empty result.
Very long texts are read whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, slices, strings, table

TOP = 20
#: Postings of a document lie in one of so many parts of a term's bucket.
SHARDS = 16
#: Rows in a file of the tables of items' terms and weights.
FILE_ROWS = 1_000_000
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_POSTING = "term string, doc_id long, place long, n long, tf long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _POSTING. place numbers the documents of the table; a row without a term has the task's terms in n and its documents in tf."""
    names = [x.split()[0] for x in _POSTING.split(", ")]
    first = place = TaskContext.get().partitionId() << 33
    n_terms = n_docs = 0
    for batch in slices(batches, 1):
        words, ids, places, lengths, often = [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            if found := terms(text):
                counted = Counter(found)
                words.extend(counted)
                often.extend(counted.values())
                ids.append((key, len(counted)))
                places.append(place)
                lengths.append(len(found))
            place += 1
        each = np.array([k for _, k in ids], dtype=np.int64)
        column = lambda values: np.repeat(np.array(values, dtype=np.int64), each)  # noqa: B023, E731
        keys = pa.array([k for k, _ in ids], pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), each)))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), keys, pa.array(column(places)), pa.array(column(lengths)), pa.array(often, pa.int64())], names)
        n_terms, n_docs = n_terms + sum(lengths), n_docs + len(lengths)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([first]), pa.array([n_terms]), pa.array([n_docs])], names)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """Postings of documents in term buckets, written to the shared folder; of the terms in wanted (term, different ones) only, if it is given."""
    every = docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(_postings, _POSTING)
    if wanted is not None:
        every = every.join(wanted.select("term", F.lit(True).alias("asked")), "term", "left").where("asked or term is null").drop("asked")
    shard = F.pmod(F.xxhash64("place"), F.lit(SHARDS))
    return materialise(every.withColumn("shard", shard).repartition("term", "shard").sortWithinPartitions("term", "place").drop("shard"), "postings")


def terms_of(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times) of all items."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.translate(F.col(text).cast("string"), upper, lower), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)
    return items.select(F.col(key).alias("item_id"), F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _compact(df: DataFrame, name: str) -> DataFrame:
    """A table written in files of about FILE_ROWS rows, so that Spark sees the size of its rows, not of many small files, when it chooses a join."""
    many = materialise(df, name)
    few = materialise(many.coalesce(many.count() // FILE_ROWS + 1), name)
    discard(many)
    return few


def search(index: DataFrame, asked: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item in asked (item_id, term, times) the documents of postings that score highest, above 0."""
    n_terms, n_docs = index.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tf"), F.lit(0))).first()
    own = index.where("term is not null")
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.count("*") + 1))).cast("long")
    weights = _compact(own.groupBy("term").agg(weight.alias("w")), "weights")
    mass = F.expr(f"75L + (25L * n * {n_docs}L) div {max(1, n_terms)}L")
    gain = own.join(weights, "term").withColumn("m", mass).select("term", "doc_id", "place", F.expr("w * ((1000000000L * tf) div (1000L * tf + 12L * m))").alias("gain"))
    # by document, so that the sums by item and document need no further shuffle
    met = gain.repartition("place").join(asked, "term")
    sums = met.groupBy("item_id", "place", "doc_id").agg(F.sum(F.col("gain") * F.col("times")).alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place"))
    ranked = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
    found = materialise(ranked, "ranked")
    discard(weights)
    return found


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """search() of all items over all documents."""
    asked = _compact(terms_of(items), "asked")
    wanted = _compact(asked.select("term").distinct(), "wanted")
    index = postings(docs, wanted=wanted)
    found = search(index, asked, top)
    discard(asked, wanted, index)
    return found


def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the documents ranked for every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""with words as (select doc_id, row_number() over () place, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
  docs as (select doc_id, place, cast(len(t) as bigint) n, t from words where len(t) > 0),
  totals as (select cast(count(*) as bigint) nn, cast(sum(n) as bigint) ll from docs),
  posted as (select place, doc_id, n, term, cast(count(*) as bigint) tf from (select place, doc_id, n, unnest(t) term from docs) group by all),
  asked as (select item_id, term, cast(count(*) as bigint) times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark) group by all),
  weights as (select term, cast(floor(1000 * ln((2.0::double * nn + 2) / (2.0::double * count(*) + 1))) as bigint) w from posted, totals group by term, nn),
  scores as (select item_id, place, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) as bigint) score from asked join posted using (term) join weights using (term), totals group by all)
select item_id, cast(rank as integer) rank, doc_id, score from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) rank from scores where score > 0) where rank <= 20"""
