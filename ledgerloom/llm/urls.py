"""URL rules by a cascade of Bloom filters: exact membership of rule keys without joins, by SQL expressions only.

A rule is a host and a path prefix, written together (``example.com/de/``). It fits a url whose host is the rule's or
a subdomain of it and whose path starts with the rule's path. So a url has few candidate keys: each suffix of its
host, of at most as many labels as a rule has, with each prefix of its path of a length that a rule's path has.

For a list of keys, level 1 is a Bloom filter of the list. Level 2 holds the keys of the corpus that level 1 takes by
mistake, level 3 the listed keys that level 2 takes, and so on until a level takes nothing by mistake. A key of the
corpus is listed if the first level that denies it is an even one. This is exact for all keys of the corpus the
cascade was built on (its complete key universe), and its size depends on the list: level 1's error rate is set
from the number of corpus keys so that about as few of these pass by mistake as there are listed keys. Filters are
arrays in the plan, of some bits for each listed key; the list itself is the caller's.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; path: from there up to
``?``, ``#`` or the end. Defined results: a null url, or one without ``://``, has an empty host and path and no rule.
Of fitting rules the longest wins, of equally long ones that with the longer host. A url that no rule fits has a
null rule and the verdict that the cascade's "not listed" stands for: allow. Repeated and extra rows and columns stay; columns
host, path, rule and verdict are replaced. Urls of any length are read whole. An empty table gives an empty result.
The filters, some bits for each rule, are literals of the plan, which suits lists of up to some ten thousand rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rules and verdicts.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Error rate of the levels after the first.
LATER_RATE = 0.5


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: bits as an array of longs."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int


def _hashes(key: Column, level: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)  # the number first: it seeds the hash of the key


def _shape(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits + -bits % 64, max(1, round(-math.log2(rate)))


def _places(h1: int, h2: int, bits: int, hashes: int) -> list[int]:
    return [(h1 % bits + i * (h2 % bits)) % bits for i in range(hashes)]


def _filter(pairs: list[tuple[int, int]], rate: float, seed: int) -> Level:
    bits, hashes = _shape(len(pairs), rate)
    words = [0] * (bits // 64)
    for h1, h2 in pairs:
        for p in _places(h1, h2, bits, hashes):
            words[p // 64] |= 1 << p % 64
    return Level(tuple(w - (1 << 64) if w >> 63 else w for w in words), bits, hashes, seed)


def _takes(level: Level, h1: int, h2: int) -> bool:
    return all(level.words[p // 64] >> p % 64 & 1 for p in _places(h1, h2, level.bits, level.hashes))


def may_contain(key: Column, level: Level) -> Column:
    """True where the level's filter takes the key."""
    h1, h2 = (F.pmod(h, F.lit(level.bits)) for h in _hashes(key, level.seed))
    words = F.array(*[F.lit(w).cast("long") for w in level.words])  # folded to one constant
    out = F.lit(True)
    for i in range(level.hashes):
        p = (h1 + i * h2) % level.bits
        out = out & (F.getbit(F.element_at(words, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1)
    return out


def listed(key: Column, cascade: list[Level]) -> Column:
    """Exact membership of a key of the corpus in the list that the cascade was built from."""
    out = F.lit(len(cascade) % 2 == 1)  # what every level takes belongs to the last level's set
    for k in reversed(range(len(cascade))):
        out = F.when(may_contain(key, cascade[k]), out).otherwise(F.lit(k % 2 == 1))
    return out


def candidate_keys(rules: list[str]) -> Column:
    """All keys of a row's host and path that could be rules, each with the length of its host."""
    labels = max((r.split("/", 1)[0].count(".") + 1 for r in rules), default=0)
    sizes = sorted({len(r) - r.find("/") for r in rules})
    host, path = F.col("host"), F.col("path")
    parts = []
    for n in range(1, labels + 1):
        suffix = F.substring_index(host, ".", -n)
        new = F.lit(True) if n == 1 else F.length(suffix) > F.length(F.substring_index(host, ".", -(n - 1)))
        for size in sizes:
            fits = new & (F.length(host) > 0) & (F.length(path) >= size)
            parts.append(F.when(fits, F.struct(F.concat(suffix, F.substring(path, 1, size)).alias("key"), F.length(suffix).alias("host_length"))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def build_cascade(keys: DataFrame, rules: list[str], key: str = "key") -> list[Level]:
    """The cascade of a list over the corpus's keys (column key; repeated ones do no harm)."""
    rules = sorted(set(rules))
    if not rules:
        return []
    spark = keys.sparkSession
    n = keys.count()
    hashed = lambda df, k: [(r["key"], (r["a"], r["b"])) for r in df.select("key", *(h.alias(c) for h, c in zip(_hashes(F.col("key"), k), "ab", strict=True))).collect()]
    listed_rows = spark.createDataFrame([(r,) for r in rules], "key string")
    first = _filter([h for _, h in hashed(listed_rows, 0)], min(LATER_RATE, len(rules) / (math.sqrt(2) * max(1, n))), 0)
    # of the corpus's keys about as many as there are rules pass the first level by mistake
    passing = keys.select(F.col(key).alias("key")).where(may_contain(F.col("key"), first)).distinct().join(listed_rows, "key", "left_anti")
    mistaken = [r["key"] for r in passing.collect()]
    levels, inside, outside = [first], mistaken, rules
    while inside:
        k = len(levels)
        both = dict(hashed(spark.createDataFrame([(x,) for x in sorted({*inside, *outside})], "key string"), k))
        level = _filter([both[x] for x in inside], LATER_RATE, k)
        levels.append(level)
        inside, outside = [x for x in outside if _takes(level, *both[x])], inside
    return levels


def judge(urls: DataFrame, rules: dict[str, str], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict."""
    names = sorted(rules)
    if not names:
        return with_host_and_path(urls, url).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    df = with_host_and_path(urls, url).withColumn("candidate keys", candidate_keys(names))
    keys = df.select(F.explode("candidate keys").alias("c")).select(F.col("c.key").alias("key"))
    verdicts = sorted(set(rules.values()) - {default})
    every = build_cascade(keys, names)
    own = urls.sparkSession.createDataFrame([(r,) for r in names], "key string")  # the universe of keys that are rules, so urls are not read again
    by_verdict = {v: build_cascade(own, [r for r in names if rules[r] == v]) for v in verdicts}
    found = F.filter("candidate keys", lambda c: listed(c["key"], every))
    best = F.array_max(F.transform(found, lambda c: F.struct(F.length(c["key"]).alias("l"), c["host_length"].alias("h"), c["key"].alias("key"))))["key"]
    df = df.withColumn("rule", best).drop("candidate keys")
    verdict = F.lit(default)
    for v, cascade in by_verdict.items():
        verdict = F.when(listed(F.col("rule"), cascade), F.lit(v)).otherwise(verdict)
    return df.withColumn("verdict", F.when(F.col("rule").isNull(), F.lit(default)).otherwise(verdict))


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: host, path, deciding rule and verdict of every page's url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
with p as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
q as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from p),
r as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, x, v)),
m as (select page_id, arg_max(h || x, length(h || x)) rule, arg_max(v, length(h || x)) v from q join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, x) group by page_id)
select q.page_id, host, path, rule, coalesce(v, 'allow') verdict from q left join m using (page_id)
"""
