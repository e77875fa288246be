"""Mixing sources to target weights by temperature, with DataFrame operations only.

A source's weight is its share of all tokens to the power of an exponent, normalised: 1 keeps the shares, 0 makes all
sources equal. The exponent is bisected, several halvings in one pass over the table of sources, until the weights' entropy
meets a target or until no source is repeated more often than a limit. Each source then gets weight * budget tokens.

A source's documents lie in blocks by hash of their key, about BLOCK_ROWS to a block, so a source of any size is many
small groups. An epoch is a permutation of its blocks and, within each, of its documents. As many whole epochs are
taken as the quota holds, and of one more epoch the first blocks in permuted order; of the block where the quota ends,
documents while their running total is within the quota. Nothing is ordered or summed over a whole source in one
task: block totals are aggregated first, and the running total over blocks reads one row a block.

All is decided on narrow rows (source, tokens, hashes), written once; the documents themselves are read a second time only, to be met by what
was decided for their block: how often it is read, and up to which place. Documents stand in the order of a hash of their key, then the key, then
a hash of the whole row, so which of a key's rows are read does not depend on the order of the input.

Tokens: the number of words by white space unless a column is named; a text without words counts 1, so it can be drawn.

Defined results: a null source is a source of its own; null texts count 1 token; rows of a null key are drawn like
others, all in one block; repeated rows each count, and are read together or not at all. Very long texts are counted whole. An empty table gives an empty result.
The input's columns all stay, whatever their names; the columns epoch, block and mix_tokens are added (and replace
columns of these names). Names that begin with "mix " are the operator's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table

BLOCK_ROWS = 2_000
#: Interior points of the exponent's interval looked at in one pass, and passes: four halvings each.
POINTS, PASSES = 15, 8
REPETITION_LIMIT = 2.0


def tokens_of(text: str = "text") -> Column:
    """Words by white space, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0))).cast("long")


def _sources(df: DataFrame) -> DataFrame:
    return df.groupBy("mix source").agg(F.sum("mix_tokens").alias("t"), F.count("*").alias("rows"))


def _bisected(sources: DataFrame, total: float, enough) -> float:
    """The largest exponent in [0, 1] at which enough(sums) holds; it holds at 0 and below whatever it holds at.

    sums has, at an exponent x, s0 = sum of p ** x, s1 = sum of p ** x * ln p ** x, and least = the smallest p.
    """
    low, high = 0.0, 1.0
    p = F.col("t") / F.lit(float(total))

    def at(points: list[float]) -> list[bool]:
        sums = sources.agg(F.min(p).alias("least"), F.max(p).alias("most"), *[c for i, x in enumerate(points) for c in (F.sum(F.pow(p, F.lit(x))).alias(f"a{i}"), F.sum(F.pow(p, F.lit(x)) * F.log(p) * x).alias(f"b{i}"))]).first()
        return [enough(x, sums[f"a{i}"], sums[f"b{i}"], sums["least"], sums["most"]) for i, x in enumerate(points)]

    if at([1.0])[0]:
        return 1.0
    for _ in range(PASSES):
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        held = at(points)
        k = sum(1 for i in range(POINTS) if all(held[: i + 1]))
        low, high = (points[k - 1] if k else low), (points[k] if k < POINTS else high)
    return low


def exponent_for_entropy(sources: DataFrame, total: float, entropy: float) -> float:
    """The largest exponent whose weights have at least this entropy (in nats); 0, equal weights, if none has."""
    return _bisected(sources, total, lambda x, s0, s1, least, most: math.log(s0) - s1 / s0 >= entropy - 1e-12)


def exponent_for_repetition(sources: DataFrame, total: float, limit: float) -> float:
    """The smallest exponent at which the most repeated source is read at most limit times as often as the least repeated.

    How often a source is read goes with p ** (x - 1), so the smallest source is read (most / least) ** (1 - x) times as often as the largest.
    """
    flipped = lambda x, s0, s1, least, most: (1 - (1 - x)) * math.log(most / least) <= math.log(limit) + 1e-12
    return 1.0 - _bisected(sources, total, flipped)


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", tokens: Column | None = None, entropy: float | None = None, repetition_limit: float | None = REPETITION_LIMIT, budget: int | None = None, seed: int = 11) -> DataFrame:
    """Documents drawn to the mixture's weights, a row for each time one is read.

    Either entropy or repetition_limit sets the exponent. Without a budget it is the least by which every source
    is read in full at least once.
    """
    kept = [c for c in df.columns if c not in ("epoch", "block", "mix_tokens")]
    count = tokens if tokens is not None else tokens_of()
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    place = F.struct(F.xxhash64(F.col(key), F.lit(seed + 2)).alias("h"), F.col(key).alias("k"), F.xxhash64(*plain).alias("r"))
    narrow = materialise(df.select(named.alias("mix source"), count.alias("mix_tokens"), F.xxhash64(F.col(key), F.lit(seed)).alias("mix hash"), place.alias("mix place")), "mix-rows")
    sources = materialise(_sources(narrow), "mix-sources")  # one row a source
    total = sources.agg(F.sum("t")).first()[0]
    if not total:
        return df.withColumns({"mix_tokens": F.lit(1).cast("long"), "epoch": F.lit(0), "block": F.lit(0).cast("long")}).where(F.lit(False)).select(*kept, "epoch", "block", "mix_tokens")
    x = exponent_for_entropy(sources, total, entropy) if entropy is not None else exponent_for_repetition(sources, total, repetition_limit)
    power = F.pow(F.col("t") / F.lit(float(total)), F.lit(x))
    norm, least = sources.agg(F.sum(power), F.max(F.col("t") / power)).first()
    amount = float(budget) if budget is not None else norm * least
    plan = sources.select("mix source", "t", F.round(power / norm * amount).cast("long").alias("quota"), F.ceil(F.col("rows") / BLOCK_ROWS).cast("long").alias("mix blocks"))
    plan = plan.withColumn("mix whole", F.floor(F.col("quota") / F.col("t")).cast("int")).withColumn("mix rest", F.col("quota") - F.col("mix whole") * F.col("t"))

    # the plan has one row a source: Spark broadcasts it if it is small and splits hot sources if it is not
    in_block = F.pmod(F.col("mix hash"), F.col("mix blocks"))
    placed = narrow.join(plan.select("mix source", "mix blocks"), "mix source").select("mix source", in_block.alias("block"), "mix_tokens", "mix place")
    # the last, partial epoch: blocks in permuted order, the boundary block by its documents
    sizes = placed.groupBy("mix source", "block").agg(F.sum("mix_tokens").alias("mix block t"))
    order = Window.partitionBy("mix source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block").rowsBetween(Window.unboundedPreceding, -1)
    begun = sizes.withColumn("mix before", F.coalesce(F.sum("mix block t").over(order), F.lit(0))).join(plan.select("mix source", "mix rest"), "mix source").where("`mix before` < `mix rest`")
    begun = begun.select("mix source", "block", "mix before", "mix rest", (F.col("mix before") + F.col("mix block t") <= F.col("mix rest")).alias("mix entire"))
    edge = placed.join(begun.where("not `mix entire`"), ["mix source", "block"])
    upto = F.sum("mix_tokens").over(Window.partitionBy("mix source", "block").orderBy("mix place"))  # with all rows of one place
    ends = edge.withColumn("mix sum", upto).where(F.col("mix before") + F.col("mix sum") <= F.col("mix rest")).groupBy("mix source", "block").agg(F.max("mix place").alias("mix end"))
    decided = begun.join(ends, ["mix source", "block"], "left").select("mix source", "block", "mix entire", "mix end")
    decided = materialise(decided, "mix-blocks")
    discard(narrow)

    rows = df.select(*kept, count.alias("mix_tokens"), named.alias("mix source"), F.xxhash64(F.col(key), F.lit(seed)).alias("mix hash"), place.alias("mix place"))
    met = rows.join(plan.select("mix source", "mix blocks", "mix whole"), "mix source").withColumn("block", in_block).join(decided, ["mix source", "block"], "left")
    more = F.coalesce(F.col("mix entire") | F.coalesce(F.col("mix place") <= F.col("mix end"), F.lit(False)), F.lit(False))
    times = F.col("mix whole") + more.cast("int")
    return met.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)))).select(*kept, "epoch", "block", "mix_tokens")


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every reading of every document in the mixture."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", tokens_of().alias("tokens")), tokens=F.col("tokens")).select("doc_id", "source", "epoch", "block", F.col("mix_tokens").alias("n_tokens"))
