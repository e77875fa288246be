"""Ranks against the database's published values, and the trigram index against comparing each name with each query."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import search, text, trigrams

DOC = "doc array<struct<lexeme:string,pos:int,weight:double>>, q array<string>"
W = text.WEIGHTS


@pytest.mark.parametrize(
    ("doc", "query", "rank"),
    [
        ([("a", 1, "D"), ("s", 2, "C")], ["a", "s"], 0.14015312),  # published: ts_rank(' a:1 s:2C d g', 'a & s')
        ([("a", 1, "D"), ("s", 2, "B")], ["a", "s"], 0.19820644),
        ([("a", 1, "D"), ("s", 2, "D")], ["a", "s"], 0.09910322),
        ([("a", 1, "D")], ["a"], 0.06079271),
        ([("a", 1, "A")], ["a"], 0.6079271),
        ([("a", 1, "D"), ("b", 1, "D")], ["a", "b"], 1e-20),  # at one place they are no pair
        ([("a", 1, "D"), ("b", 500, "D")], ["a", "b"], 1e-16),
        ([], ["a"], 0.0),
    ],
)
def test_ranks_are_the_published_ones(spark, doc, query, rank):
    df = spark.createDataFrame([([(x, p, W[w]) for x, p, w in doc], query)], DOC)
    assert df.select(text.rank_of(F.col("doc"), F.col("q")).alias("r")).first().r == pytest.approx(rank, rel=1e-6)


def plain_rank(doc, query):
    """The two rank rules as loops."""
    if len(query) == 1:
        own = [w for x, _, w in doc if x == query[0]]
        best = max(range(len(own)), key=lambda j: (own[j], -j))
        return (own[best] + sum(w / (j + 1) ** 2 for j, w in enumerate(own)) - own[best] / (best + 1) ** 2) / 1.64493406685
    import math

    res = -1.0
    for i, a in enumerate(sorted(query)):
        for b in sorted(query)[:i]:
            for pa, wa in ((p, w) for x, p, w in doc if x == a):
                for pb, wb in ((p, w) for x, p, w in doc if x == b):
                    if d := abs(pa - pb):
                        cur = math.sqrt(wa * wb * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
                        res = cur if res < 0 else 1 - (1 - res) * (1 - cur)
    return 1e-20 if res < 0 else res


def test_ranks_equal_loops(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        doc = sorted(((rng.choice("abcde"), rng.randrange(1, 150), rng.choice(list(W.values()))) for _ in range(rng.randrange(5, 30))), key=lambda x: x[1])
        query = sorted(set(rng.choices([x for x, *_ in doc], k=rng.randrange(1, 5))))
        rows.append((doc, query))
    got = spark.createDataFrame(rows, DOC).select("doc", "q", text.rank_of(F.col("doc"), F.col("q")).alias("r")).collect()
    for r in got:
        assert r.r == pytest.approx(plain_rank([tuple(x) for x in r.doc], r.q), rel=1e-9)


def test_places_of_a_document(spark):
    df = spark.createDataFrame([("The Running of the Cafés", None, "dogs and cats", "")], "a string, b string, c string, d string")
    doc = df.select(text.document([("A", F.col("a")), ("B", F.col("b")), ("C", F.col("c")), ("D", F.col("d"))]).alias("doc"))
    assert [tuple(x) for x in doc.first().doc] == [("run", 2, 1.0), ("café", 5, 1.0), ("dog", 6, 0.2), ("cat", 8, 0.2)]
    assert [r.rank for r in text.ranked(doc, "doc", "cat dogs").collect()] == [pytest.approx(plain_rank([("dog", 6, 0.2), ("cat", 8, 0.2)], ["cat", "dog"]))]
    assert text.matches(doc, "doc", "cats birds").count() == text.matches(doc, "doc", "the of").count() == text.matches(doc, "doc", "").count() == 0


NAMES = ["Blue Cafe", "BLUE CAFÉ", "the blue cafe & bar", "Café", None, "", "...", "Red Widget", "red widgets", "Zoë's Bar", "aa", "aaa aaa", "bb"]


def test_resembling_names_equal_a_comparison_with_each(spark):
    rng = random.Random(4)
    words = ["blue", "cafe", "café", "bar", "grill", "red", "widget", "the", "of", "aa"]
    names = NAMES + [" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(150)]
    asks = ["blue caffe", "widgt", "CAFÉ", "nothing like it", "", None, "aa", "zoe", *(" ".join(rng.choices(words, k=2)) + "x" for _ in range(20))]
    n, q = spark.createDataFrame(list(enumerate(names)), "id long, name string"), spark.createDataFrame(list(enumerate(asks)), "query_id long, query string")
    for limit in (0.3, 0.5, 0.9, 1.0):
        got = {(r.query_id, r.id): r.similarity for r in trigrams.resembling(n, q, limit).collect()}
        each = n.join(q, F.lit(True)).select("query_id", "id", S.trigram_similarity(S.trigrams(F.col("name")), S.trigrams(F.col("query"))).alias("s")).where(F.col("s") >= limit)
        assert got == {(r.query_id, r.id): r.s for r in each.collect()}
    assert (2, NAMES.index("Café")) in got and trigrams.resembling(n.limit(0), q).count() == 0


def test_a_lookup_reads_only_the_buckets_of_its_trigrams(spark, tmp_path):
    rows = [(i, f"{a} {i}", b) for i, (a, b) in enumerate([("Blue Cafe", "JOHN DOE"), ("Red Widget", "ACME"), ("Bar", None), ("John's Grill", "")] * 20)]
    names = spark.createDataFrame(rows, "id long, business_name string, applicants string")
    trigrams.write(trigrams.postings(names, "id", "business_name", "applicants"), f"{tmp_path}/index", 16)
    found = trigrams.lookup(spark, f"{tmp_path}/index", "jon doe", buckets=16)
    plain = names.where((S.trigram_similarity(S.trigrams(F.col("business_name")), S.trigrams(F.lit("jon doe"))) >= 0.3) | (S.trigram_similarity(S.trigrams(F.col("applicants")), S.trigrams(F.lit("jon doe"))) >= 0.3))
    assert {r.id for r in found.collect()} == {r.id for r in plain.collect()} and found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan.replace("cast(", "")
    assert "In(trigram" in plan.replace(" ", "") and "business_name" not in plan
    assert trigrams.lookup(spark, f"{tmp_path}/index", "...", buckets=16).count() == 0
    doc = text.document([("A", F.col("business_name"))])
    by_index = search.said(names, "jon doe", doc, resembling=found)
    assert sorted(map(tuple, by_index.collect())) == sorted(map(tuple, search.said(names, "jon doe", doc).collect()))
