"""Incremental ingestion: new records once, confirmations of known ones, provenance, change detection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import valid_record
from ..operators.records import first_wins, new_rows, with_surrogate_keys

NATURAL_KEY = ["section_type", "record_date", "license_number", "application_type"]


def first_seen_with_confirmations(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each key's first row and how often it was seen; partially aggregated, so a hot key is one row a task."""
    return rows.groupBy(*key).agg(F.min(order).alias("first_id"), F.count("*").alias("seen"))


def ingest_batch(batch: DataFrame, existing: DataFrame, order: str = "scraped_at") -> tuple[DataFrame, DataFrame]:
    """(new records with ids, provenance roles by natural key): duplicates of known records only confirm them."""
    once = first_wins(batch, NATURAL_KEY, [F.asc(order)])
    fresh = new_rows(once, existing, NATURAL_KEY)
    roles = once.join(existing.select(*NATURAL_KEY).distinct().withColumn("known", F.lit(True)), NATURAL_KEY, "left").select(*NATURAL_KEY, F.when(F.col("known"), "confirmed").otherwise("first_seen").alias("role"))
    return with_surrogate_keys(fresh, existing, "id", NATURAL_KEY), roles


def outcome_of(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(inserted, skipped, errors) of a batch: new natural keys, rows of known or repeated ones, and rows that are no valid records."""
    valid = F.coalesce(valid_record(*[F.col(c) for c in NATURAL_KEY]), F.lit(False))
    fresh = new_rows(batch.where(valid), existing, NATURAL_KEY).agg(F.count("*").alias("inserted"))
    return batch.agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("errors")).join(F.broadcast(fresh)).select("inserted", (F.col("valid") - F.col("inserted")).alias("skipped"), "errors")  # two single rows


def stamped(done: DataFrame, records: DataFrame, step: str, version: int, at) -> DataFrame:
    """The ledger of steps (record_id, step, version, done_at) after a step ran for records (id): one row each, the newest version."""
    fresh = records.select(F.col("id").alias("record_id"), F.lit(step).alias("step"), F.lit(version).alias("version"), at.alias("done_at"))
    return done.join(fresh, ["record_id", "step"], "left_anti").unionByName(fresh)


def enriched(records: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], folder: str | None = None) -> dict[str, tuple[DataFrame | None, str]]:
    """Each step's table, or None and what failed: a step that fails takes no other with it.

    With a folder each table is computed once, written below it and read back; without, it is run to see that it can be, and again when it is read.
    Steps over several tables that must count together are batches.run_batch().
    """
    out: dict[str, tuple[DataFrame | None, str]] = {}
    for name, step in steps.items():
        try:
            table = step(records)
            if folder is None:
                table.write.format("noop").mode("overwrite").save()
            else:
                table.write.mode("overwrite").parquet(f"{folder}/{name}")
                table = records.sparkSession.read.schema(table.schema).parquet(f"{folder}/{name}")
            out[name] = (table, "")
        except Exception as e:  # noqa: BLE001  # whatever a step raises is its result
            out[name] = (None, f"{type(e).__name__}: {e}".splitlines()[0])
    return out


def unchanged(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Pages whose content hash is not in the log of earlier runs."""
    return pages.withColumn("content_hash", F.sha2("html", 256)).join(log.select("content_hash").distinct(), "content_hash", "left_anti")


def due_for_renewal(locations: DataFrame, as_of: str, days: int = 180, budget: int = 5_000) -> DataFrame:
    """The renewal queue: never attempted first, then the oldest attempts older than days, up to the day's budget."""
    stale = F.col("attempted_at").isNull() | (F.col("attempted_at") < F.date_sub(F.lit(as_of).cast("date"), days))
    return locations.where(stale).orderBy(F.col("attempted_at").asc_nulls_first(), "id").limit(budget)


def stale_steps(records: DataFrame, done: DataFrame, step: str, version: int) -> DataFrame:
    """Records whose enrichment step has not run at this version."""
    current = done.where((F.col("step") == step) & (F.col("version") >= version)).select(F.col("record_id").alias("id"))
    return records.join(current, "id", "left_anti")
