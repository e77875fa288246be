"""Names that resemble a query by trigrams, from an index instead of a scan.

Postings are (trigram, id, n): a row for each different trigram of a name, with how many the name has. A name of n trigrams that shares c
with a query of q has similarity c / (n + q - c), so postings alone give it. At a limit, c is at least limit * q: a name must hold one of any
q - ceil(limit * q) + 1 trigrams, and n lies between limit * q and q / limit. A lookup of one query reads the buckets of its trigrams.
A search of many queries joins only as many trigrams of each as that bound leaves, the rarest ones, so a common trigram brings nothing
together on its own; what is found is measured exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import trigram_similarity, trigrams

LIMIT, BUCKETS = 0.3, 64


def postings(names: DataFrame, key: str, *texts: str) -> DataFrame:
    """(trigram, id, place, n) of the columns of names; place tells several columns of one row apart. Names without a letter or digit have none."""
    each = names.select(F.col(key).alias("id"), F.posexplode(F.array(*[F.col(t) for t in texts])).alias("place", "text"))
    return each.select("id", "place", trigrams(F.col("text")).alias("t")).select(F.explode("t").alias("trigram"), "id", "place", F.size("t").alias("n"))


def _bucket(trigram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(buckets)).cast("int")


def write(index: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Writes postings in buckets by trigram, each in the order of trigrams."""
    placed = index.withColumn("bucket", _bucket(F.col("trigram"), buckets))
    # a trigram of very many names is dealt over several files of its bucket
    dealt = placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "trigram")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def lookup(spark: SparkSession, folder: str, query: str, limit: float = LIMIT, buckets: int = BUCKETS) -> DataFrame:
    """(id, place, similarity) of the names of a written index that resemble one query: only its trigrams' buckets are read."""
    row = spark.range(1).select(trigrams(F.lit(query)).alias("t")).select("t", F.transform("t", lambda x: _bucket(x, buckets)).alias("b")).first()
    found, places = list(row.t), sorted(set(row.b))
    if not found:
        return spark.createDataFrame([], "id long, place int, similarity double")
    own = spark.read.parquet(folder).where(F.col("bucket").isin(places) & F.col("trigram").isin(found))
    return _similar(own.groupBy("id", "place").agg(F.count("*").alias("c"), F.first("n").alias("n")), F.lit(len(found)), limit)


def _similar(counted: DataFrame, q: Column, limit: float) -> DataFrame:
    similarity = F.col("c") / (F.col("n") + q - F.col("c"))
    return counted.withColumn("similarity", similarity).where(F.col("similarity") >= limit).drop("c", "n")


def resembling(names: DataFrame, queries: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(query_id, id, similarity) of all names (id, name) that resemble a query (query_id, query): equal to comparing each with each."""
    given = names.select("id", trigrams(F.col("name")).alias("t")).where("size(t) > 0")
    index = given.select(F.explode("t").alias("trigram"), "id", F.size("t").alias("n"))
    often = index.groupBy("trigram").agg(F.count("*").alias("often"))
    asked = queries.select("query_id", trigrams(F.col("query")).alias("q")).where("size(q) > 0")
    ranked = asked.select("query_id", F.size("q").alias("size"), F.explode("q").alias("trigram")).join(often, "trigram")
    # trigrams that no name has are the rarest of all: they take places of the bound, too
    ordered = ranked.groupBy("query_id", "size").agg(F.array_sort(F.collect_list(F.struct("often", "trigram"))).alias("o"))
    missing = F.col("size") - F.size("o")
    left = (F.col("size") - F.ceil(F.col("size") * limit - 1e-9) + 1 - missing).cast("int")
    first = ordered.where(left > 0).select("query_id", "size", F.explode(F.slice("o", F.lit(1), left)).alias("x")).select("query_id", "size", "x.trigram")
    # names are never broadcast: their files are far smaller than their trigrams, which Spark's estimate cannot tell. The asked trigrams are few.
    near = index.join(F.broadcast(first.select("trigram").distinct()), "trigram", "left_semi").hint("merge")
    pairs = first.join(near, "trigram").where((F.col("n") >= F.col("size") * limit - 1e-9) & (F.col("n") * limit <= F.col("size") + 1e-9)).select("query_id", "id").distinct()
    both = pairs.join(asked, "query_id").join(given.hint("merge"), "id")
    return both.select("query_id", "id", trigram_similarity(F.col("t"), F.col("q")).alias("similarity")).where(F.col("similarity") >= limit)
