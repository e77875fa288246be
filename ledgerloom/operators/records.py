"""Search, hydration, statistics, quality checks, dimensions and aliases: one function for each query shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import similarity_features


def all_of(conditions: list[Column]) -> Column:
    """Optional conditions joined by AND; true without any."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


#: Tasks that rows are dealt to, and the session's partitions up to which it is so many. Spark makes tasks by bytes on disk, where rows of
#: like keys and names are far smaller than in a task's memory; each task of an aggregate takes some 100 MB at once, so they are not more.
TASKS, PARTITIONS = 64, 200


def dealt(df: DataFrame, *by, tasks: int = TASKS) -> DataFrame:
    """Rows dealt out by a key, or in turn, to so many tasks that are not joined again, however small they look on disk. With more shuffle partitions than
    Spark's own number, tasks are more in proportion."""
    return df.repartition(tasks * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS), *by)


def filtered(records: DataFrame, equal: dict[str, object] | None = None, between: tuple[str, object, object] | None = None, linked: tuple[DataFrame, str] | None = None, contains: tuple[str, str] | None = None) -> DataFrame:
    """Faceted filter: equalities, an inclusive range, membership in a bridge (a semi join), a case-insensitive pattern. Empty facets don't filter."""
    conditions = [F.col(c) == F.lit(v) for c, v in (equal or {}).items() if v not in (None, "")]
    if between:
        column, low, high = between
        conditions += [F.col(column) >= F.lit(low)] * (low is not None) + [F.col(column) <= F.lit(high)] * (high is not None)
    if contains and contains[1]:
        conditions.append(F.col(contains[0]).ilike(f"%{contains[1]}%"))
    out = records.where(all_of(conditions))
    return out.join(linked[0], linked[1], "left_semi") if linked else out


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of an ordered result: a top-k, never a full sort to the driver."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def hydrated(rows: DataFrame, bridge: DataFrame, dimension: DataFrame, key: str, dim_key: str, name: str, into: str) -> DataFrame:
    """Adds the names of a many-to-many dimension as one ordered '; ' list, '' if there are none. Only the rows' own keys are aggregated."""
    names = bridge.join(rows.select(key).distinct(), key, "left_semi").join(dimension.select(dim_key, name), dim_key)
    lists = names.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(name)), "; ").alias(into))
    return rows.join(lists, key, "left").withColumn(into, F.coalesce(into, F.lit("")))


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a natural key: the first by order."""
    return df.withColumn("place in key", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place in key") == 1).drop("place in key")


def latest(df: DataFrame, by: str) -> DataFrame:
    """The row with the greatest value; no sort."""
    return df.agg(F.max_by(F.struct(*df.columns), F.col(by)).alias("r")).select("r.*")


def new_rows(candidates: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Idempotent insert: candidates whose key, nulls counting as equal, is not there yet."""
    same = all_of([F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key])
    return candidates.dropDuplicates(key).alias("a").join(existing.select(*key).distinct().alias("b"), same, "left_anti")


#: Hash buckets of new keys: one row each is summed in one task, and 10^11 rows are still under two million to a bucket.
BUCKETS = 65_536


def with_surrogate_keys(fresh: DataFrame, existing: DataFrame, id_: str, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Ids that follow the greatest one there is, the same on every run: rows are numbered within hash buckets of their
    key, and buckets follow each other by a running total over one row a bucket. The greatest id is fetched when this is called."""
    start = existing.agg(F.max(id_)).first()[0] or 0
    placed = fresh.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("c"))
    before = sizes.select("bucket", F.coalesce(F.sum("c").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy(*key))
    return placed.withColumn("n", n).join(before, "bucket").select((F.lit(start) + F.col("before") + F.col("n")).alias(id_), *[c for c in fresh.columns if c != id_])


def orphans(dimension: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Dimension rows that none of the one-column reference frames names."""
    used = reduce(lambda a, b: a.union(b), references).toDF(key)
    return dimension.join(used, key, "left_anti")


def duplicates(df: DataFrame, name: Column, id_: str) -> DataFrame:
    """Names that more than one row has, with their number and least id."""
    return df.groupBy(name.alias("name")).agg(F.count("*").alias("cnt"), F.min(id_).alias("canonical_id")).where("cnt > 1")


def canonical(edges: DataFrame, nodes: DataFrame, hops: int = 5) -> DataFrame:
    """(id, canonical): the end of each node's alias chain, followed at most hops times by joins."""
    out = nodes.select(F.col("id"), F.col("id").alias("canonical"))
    step = edges.select(F.col("variant").alias("canonical"), F.col("target"))
    for _ in range(hops):
        out = out.join(step, "canonical", "left").select("id", F.coalesce("target", "canonical").alias("canonical"))
    return out


def alias_upsert(aliases: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (variant, target) replace a variant's row; a variant of itself is skipped."""
    valid = changes.where("variant <> target")
    return aliases.join(valid, "variant", "left_anti").unionByName(valid)


def regrouped(bridge: DataFrame, mapping: DataFrame, node: str, keep: list[str], least: str) -> DataFrame:
    """A bridge after merging nodes by (node, canonical): of rows that coincide the least position stays."""
    moved = bridge.join(mapping.withColumnRenamed("id", node), node, "left").withColumn(node, F.coalesce("canonical", node)).drop("canonical")
    return dealt(moved, *keep).groupBy(*keep, node).agg(F.min(least).alias(least))


def least_of_name(nodes: DataFrame, name: Column) -> DataFrame:
    """(id, canonical): every node and the least id of its name. Names are aggregated before they are joined, so a common one is one row."""
    named = nodes.select("id", name.alias("n"))
    return named.join(named.groupBy("n").agg(F.min("id").alias("canonical")), "n").select("id", "canonical")


def similar_pairs(names: DataFrame, tokens: Column, score, threshold: float, apart: DataFrame | None = None) -> DataFrame:
    """(a, b, score), a < b, of names (id) that score at least threshold, without the pairs of apart (a, b).

    With a score of w * Jaccard(features) + (1 - w) * containment(words), w = 0.7, a pair at the threshold has at least
    (threshold - 1 + w) / w of the smaller side's features in common. Features are sorted rarest first, and a name is
    placed under as many of the first ones as that leaves, so a common word brings no names together on its own.
    """
    w = 0.7
    least = max(0.0, (threshold - 1 + w) / w)
    # outer, as Spark would else read tokens a second time, before they are dealt out, to drop empty lists; those make no features
    base = dealt(names, "id").select("id", tokens.alias("t"))
    features = base.select("id", F.explode_outer(F.array_distinct(similarity_features(F.col("t")))).alias("f")).where("f is not null")
    often = dealt(features, "f").groupBy("f").agg(F.count("*").alias("c"))
    ordered = dealt(features.join(often.hint("merge"), "f"), "id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "f"))), lambda x: x["f"]).alias("fs"))
    first = F.slice("fs", F.lit(1), (F.size("fs") - F.ceil(F.size("fs") * least - 1e-9) + 1).cast("int"))
    words = dealt(ordered.select("id", F.explode_outer(first).alias("f")).where("f is not null"), "f")
    pairs = words.alias("x").join(words.alias("y").hint("merge"), "f").where(F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    pairs = dealt(pairs, "a").distinct()
    if apart is not None:
        pairs = pairs.join(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    # never broadcast: the names' file is far smaller than their words, which Spark's estimate cannot tell
    of = lambda side: base.select(F.col("id").alias(side), F.col("t").alias(f"t{side}")).hint("merge")
    both = dealt(pairs.join(of("a"), "a"), "b").join(of("b"), "b")
    return both.select("a", "b", score(F.col("ta"), F.col("tb")).alias("score")).where(F.col("score") >= threshold)


def learned_codes(coded: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """(code, name): names that stand in every joined row of a code, as rows coded (key, code) and named (key, names array)."""
    joined = coded.join(named, key)
    totals = joined.groupBy("code").agg(F.count("*").alias("rows"))
    each = joined.select("code", F.explode("names").alias("name")).groupBy("code", "name").agg(F.count("*").alias("n"))
    return each.join(totals, "code").where("n = rows").select("code", "name")


def provenance(sources: DataFrame, record: str = "record_id") -> DataFrame:
    """By record and source type: number, best source (role rank, snapshot first, newest), first and last date."""
    rank = F.when(F.col("role") == "first_seen", 0).when(F.col("role") == "repaired", 1).otherwise(2)
    best = F.struct(rank.alias("r"), F.col("snapshot_path").isNull().alias("s"), (-F.unix_timestamp("captured_at")).alias("t"), F.col("source_id"))
    return sources.groupBy(record, "source_type").agg(F.count("*").alias("n"), F.min_by("source_id", best).alias("best_source_id"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"), F.bool_or(F.col("role") == "repaired").alias("repaired"))
