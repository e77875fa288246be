"""Backfills from archives: records of all snapshots and diffs with their evidence, extracts, and clean-up of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import clean_list, clean_name, normalise_nbsp, slug, valid_record
from ..sources import diffs, html
from .ingest import NATURAL_KEY

#: The identifiers of source types.
SOURCE_TYPES = {"live_scrape": 1, "co_archive": 2, "internet_archive": 3, "co_diff_archive": 4, "manual": 5, "co_replay": 6}


def _valid(records: DataFrame) -> DataFrame:
    return records.where(valid_record(*[F.col(c) for c in NATURAL_KEY]))


def first_evidence(found: DataFrame, order: list[Column]) -> DataFrame:
    """One row a natural key, the first by order, with role first_seen; the others that show it have the role confirmed. Result adds role."""
    place = F.row_number().over(Window.partitionBy(*NATURAL_KEY).orderBy(*order))
    return found.withColumn("role", F.when(place == 1, "first_seen").otherwise("confirmed"))


def of_snapshots(pages: DataFrame) -> DataFrame:
    """Valid records of all snapshots (path, html) with captured_at, and the role of each snapshot: the earliest saw it first."""
    found = _valid(html.records_of_pages(pages, "path", "html")).withColumn("captured_at", html.snapshot_date(F.col("path")))
    return first_evidence(found.dropDuplicates(["path", *NATURAL_KEY]), [F.asc_nulls_last("captured_at"), F.asc("path")])


def snapshot_backfill(pages: DataFrame, existing: DataFrame) -> dict[str, DataFrame]:
    """All snapshots (path, html) ingested and repaired in the order of their paths, over records that exist (natural key, business_name, applicants, previous_location: an address).

    A natural key that is new is inserted as its first row says. An ASSUMPTION without a business name takes name and applicants of the
    earliest row that has one, a CHANGE OF LOCATION without a previous location that of the earliest row of its section, day and license that has one.
    A page is read once, within its row; a key's rows meet in one window, which needs no order, and each row tells its own evidence.

    Tables: records (natural key, business_name, applicants, previous_location, inserted, repaired), evidence (path, natural key, role: first_seen,
    confirmed or repaired), counts (path, inserted, skipped, repaired) of every readable page, and bad (path, error): pages that are null or have no section.
    """
    sections = html.tables(pages, "path", "html").select("path").distinct()
    bad = pages.join(sections, "path", "left_anti").select("path", F.when(F.col("html").isNull(), "not readable").otherwise("no section").alias("error"))
    rows = _valid(html.records(html.tables(pages, "path", "html"), ["path", "section", "table_no"], "body"))
    order = F.struct("path", "table_no", "pos")
    name, people = clean_name(F.col("business_name")), clean_list(F.col("applicants"))
    rows = rows.select(*NATURAL_KEY, order.alias("order"), F.coalesce(name, F.lit("")).alias("business_name"), F.coalesce(people, F.lit("")).alias("applicants"), F.nullif(F.trim(normalise_nbsp(F.col("previous_business_location"))), F.lit("")).alias("previous_location"))
    there = existing.select(*NATURAL_KEY, F.struct(F.coalesce("business_name", F.lit("")).alias("business_name"), F.coalesce("applicants", F.lit("")).alias("applicants"), "previous_location").alias("old"))
    own = F.struct("business_name", "applicants", "previous_location")
    named = (F.col("application_type") == "ASSUMPTION") & (F.col("business_name") != "")
    moved = (F.col("application_type") == "CHANGE OF LOCATION") & F.col("previous_location").isNotNull()
    key = Window.partitionBy(*NATURAL_KEY)
    # the rows of a section, day and license that may tell a previous location are those of one natural key
    pick = lambda when: F.min(F.when(when, F.struct("order", own.alias("x")))).over(key)
    picked = rows.withColumns({"first": F.min(F.struct("order", own.alias("x"))).over(key), "name": pick(named), "place": pick(moved)})
    # a key that only exists has no row of its own
    met = picked.join(there, NATURAL_KEY, "full")
    fills_name = (F.col("application_type") == "ASSUMPTION") & (F.col("base.business_name") == "") & F.col("name").isNotNull()
    fills_place = (F.col("application_type") == "CHANGE OF LOCATION") & F.col("base.previous_location").isNull() & F.col("place").isNotNull()
    taken = lambda c: F.when(fills_name, F.col(f"name.x.{c}")).otherwise(F.col(f"base.{c}")).alias(c)
    met = met.select(*NATURAL_KEY, "order", "first", "name", "place", F.coalesce("old", "first.x").alias("base"), F.col("old").isNull().alias("inserted"))
    by = F.when(fills_name, F.col("name.order")).when(fills_place, F.col("place.order"))
    leads = F.col("order").isNull() | (F.col("order") == F.col("first.order"))
    full = met.where(leads).select(*NATURAL_KEY, taken("business_name"), taken("applicants"), F.when(fills_place, F.col("place.x.previous_location")).otherwise(F.col("base.previous_location")).alias("previous_location"), "inserted", by.isNotNull().alias("repaired"))
    saw = F.when(F.col("inserted") & leads, "first_seen").otherwise("confirmed")
    roles = F.when(F.coalesce(by == F.col("order"), F.lit(False)), F.array(saw, F.lit("repaired"))).otherwise(F.array(saw))
    every = met.where("order is not null").select(F.col("order.path").alias("path"), *NATURAL_KEY, F.explode(roles).alias("role"))
    number = lambda role: F.count_if(F.col("role") == role)
    counted = every.groupBy("path").agg(number("first_seen").alias("inserted"), number("confirmed").alias("skipped"), number("repaired").alias("repaired"))
    counts = sections.join(counted, "path", "left").na.fill(0)
    return {"records": full, "evidence": every.distinct(), "counts": counts, "bad": bad}


def of_diffs(files: DataFrame) -> DataFrame:
    """Valid records of diff files (path, text), each with the file that shows it first, in the order of file names."""
    given = diffs.work(files, F.col("path")).select("path", "section", F.col("text").alias("content"))
    return _valid(diffs.records_of_diffs(given, ["path", "section"]))


def by_file(records: DataFrame) -> DataFrame:
    """(path, records): what each evidencing file adds; a dry run's report."""
    return records.groupBy("path").agg(F.count("*").alias("records"))


def folders(spark: SparkSession, root: str, sections: dict[str, str], section: str | None = None) -> list[str]:
    """The archive folders of sections (folder -> section) that exist below root, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = [f"{root}/{name}" for name, s in sections.items() if section in (None, s)]
    return [f for f in found if path(f).getFileSystem(conf).exists(path(f))]


def extract_path() -> Column:
    """Where a record's extract lies: its natural key in lower-case letters, digits and hyphens."""
    return F.concat(F.concat_ws("/", *[slug(F.coalesce(c, F.lit(""))) for c in NATURAL_KEY]), F.lit(".html"))


def extracts(found: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, path, html) of found records (natural key, html) that the table of records has; of those that share a path the first key wins."""
    own = records.groupBy(*NATURAL_KEY).agg(F.min("id").alias("record_id"))
    paths = found.join(own, NATURAL_KEY).withColumn("path", extract_path())
    return paths.groupBy("path").agg(F.min_by(F.struct("record_id", "html"), F.struct(*NATURAL_KEY)).alias("x")).select("x.record_id", "path", "x.html")


def extract_counts(found: DataFrame, records: DataFrame) -> DataFrame:
    """(matched, unmatched, collisions) of extracts()."""
    own = records.select(*NATURAL_KEY).distinct().withColumn("known", F.lit(True))
    each = found.select(*NATURAL_KEY).distinct().join(own, NATURAL_KEY, "left").withColumn("path", F.when(F.col("known"), extract_path()))
    return each.agg(F.count("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("unmatched"), (F.count("known") - F.countDistinct("path")).alias("collisions"))


#: Buckets of an archive; the same in all its runs.
BUCKETS = 256


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _archive(spark: SparkSession, folder: str) -> DataFrame:
    schema = "path string, record_id long, " + ", ".join(f"{k} string" for k in NATURAL_KEY) + ", html string, bucket int"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def archive_changes(found: DataFrame, records: DataFrame, old: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(path, record_id, natural key, html, bucket, change) of found records (natural key, html) against an archive: change is new, changed,
    unchanged, collision (the path belongs to another key, here or in the archive: the first one keeps it) or unmatched (no such record; no path)."""
    own = records.groupBy(*NATURAL_KEY).agg(F.min("id").cast("long").alias("record_id"))
    once = found.groupBy(*NATURAL_KEY).agg(F.min("html").alias("html"))
    met = once.join(own, NATURAL_KEY, "left").withColumn("path", F.when(F.col("record_id").isNotNull(), extract_path()))
    key = F.struct(*NATURAL_KEY)
    heads = met.where("path is not null").groupBy("path").agg(F.min(key).alias("head"))
    known = old.select("path", key.alias("held"), F.xxhash64("html").alias("h1"), F.crc32("html").alias("h2"))
    both = met.join(heads, "path", "left").join(known, "path", "left")
    same = (F.col("h1") == F.xxhash64("html")) & (F.col("h2") == F.crc32("html"))
    owner = F.coalesce("held", "head")
    change = F.when(F.col("path").isNull(), "unmatched").when(~owner.eqNullSafe(key), "collision").when(F.col("held").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return both.select("path", "record_id", *NATURAL_KEY, "html", _bucket(F.col("path"), buckets).alias("bucket"), change.alias("change"))


def archive_extracts(found: DataFrame, records: DataFrame, folder: str, scratch: str, buckets: int = BUCKETS) -> DataFrame:
    """Brings an archive of extracts up to date and returns (change, n), how many found records changed what.

    The archive is Parquet in buckets by hash of path, each one file in the order of paths with a Bloom filter of them. Only buckets that get a new
    or changed extract are written again: first below scratch, then in the place of the old ones, so a run that dies between repeats with the same result.
    """
    spark = found.sparkSession
    old = _archive(spark, folder)
    at = f"{scratch}/changes"
    archive_changes(found, records, old, buckets).write.mode("overwrite").parquet(at)
    changes = spark.read.parquet(at)
    put = changes.where("change in ('new', 'changed')")
    columns = ["path", "record_id", *NATURAL_KEY, "html", "bucket"]
    touched = put.select("bucket").distinct()
    kept = old.join(touched, "bucket", "left_semi").join(put.select("path"), "path", "left_anti")
    merged = f"{scratch}/merged"
    kept.select(*columns).unionByName(put.select(*columns)).write.mode("overwrite").parquet(merged)
    fresh = spark.read.parquet(merged)
    if not put.isEmpty():
        ordered = fresh.repartition("bucket").sortWithinPartitions("bucket", "path")
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#path", "true").partitionBy("bucket").parquet(folder)
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def archived(spark: SparkSession, folder: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """(html) of one extract, from its bucket alone; no row if there is none."""
    place = spark.range(1).select(_bucket(F.lit(path), buckets)).first()[0]
    return _archive(spark, folder).where((F.col("bucket") == place) & (F.col("path") == path)).select("html")


def write_extracts(table: DataFrame, folder: str) -> None:
    """Writes extracts as gzip text by path, each with a closing line end: a folder a record, for small exports. Archives are archive_extracts()."""
    table.select("path", F.col("html").alias("value")).write.mode("overwrite").partitionBy("path").option("compression", "gzip").text(folder)


def read_extract(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """(html) of one extract; no row if there is none."""
    return spark.read.option("basePath", folder).text(folder, wholetext=True).where(F.col("path") == path).select(F.col("value").alias("html"))


def without_redundant_runs(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """The log without runs that found the page unchanged and that no source names."""
    idle = runs.where("status = 'unchanged'").join(sources.select(F.col("scrape_log_id").alias("id")).where("id is not null"), "id", "left_anti").select("id")
    return runs.join(idle, "id", "left_anti")
