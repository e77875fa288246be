"""Micro-batches that write several tables exactly once, step by step, with bad rows set aside.

A store is a folder with a folder for each table, and in it one for each batch: a batch's part of a table is written as a whole and
replaces what an earlier, broken try at the batch has left. A batch counts once its line stands in the ledger of batches, which is
written last; readers see the parts of those batches only. So a batch that dies between two tables leaves nothing that anyone
sees, and runs again under its number, as Structured Streaming does after a failure; a batch that is in the ledger is not run again.

Steps enrich the new records, each by itself: one that fails takes no other with it. A step's table is computed once, where it is
written. If that fails, its records are halved by hash until those that fail stand alone (or SPLITS halvings are made): these are set aside
with the error, the others' rows are kept, and the ledger of steps says which records are done. A batch that catches up takes
the records that a step at its version lacks, too: those set aside, and all of them when a step has a new version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import valid_record
from .ingest import NATURAL_KEY, ingest_batch, stale_steps

#: A step over new records (and the store, to read what is known) gives the rows that it adds.
Step = Callable[[DataFrame, "Store"], DataFrame]
SPLITS = 20
BATCHES = "batch long, inserted long, skipped long, errors long"
DONE = "record_id long, step string, version int"
FAILED = "record_id long, step string, error string"


@dataclass
class Store:
    """Tables of committed batches below one folder, which all executors reach. schemas are those of the tables, batch left out."""

    spark: SparkSession
    folder: str
    schemas: dict[str, T.StructType]

    def _path(self, name: str, batch: int | None = None) -> str:
        return f"{self.folder}/{name}" + ("" if batch is None else f"/batch={batch}")

    def _there(self, path: str) -> bool:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def batches(self) -> DataFrame:
        """(batch, inserted, skipped, errors) of the batches that count."""
        return self.spark.read.schema(BATCHES).parquet(self._path("batches")).select("batch", "inserted", "skipped", "errors") if self._there(self._path("batches")) else self.spark.createDataFrame([], BATCHES)

    def committed(self, batch: int) -> bool:
        return self._there(f"{self._path('batches', batch)}/_SUCCESS")

    def read(self, name: str) -> DataFrame:
        """One table, with batch."""
        schema = T.StructType([*self.schemas[name].fields, T.StructField("batch", T.LongType())])
        if not self._there(self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name)).join(self.batches().select("batch"), "batch", "left_semi").select(*schema.names)

    def write(self, name: str, batch: int, rows: DataFrame, part: str = "") -> DataFrame:
        """Replaces a batch's part of a table and gives it back as it was written. Parts of a part lie in folders of their own."""
        path = self._path(name, batch) + (f"/part={part}" if part else "")
        rows.select(*self.schemas[name].names).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    def clear(self, name: str, batch: int) -> None:
        """Removes what a broken try has left of a batch's part."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name, batch))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def commit(self, batch: int, counts: DataFrame) -> None:
        """Makes the batch count: its line in the ledger, one file."""
        counts.select("inserted", "skipped", "errors").coalesce(1).write.mode("overwrite").parquet(self._path("batches", batch))


def store(spark: SparkSession, folder: str, records: T.StructType, steps: dict[str, T.StructType]) -> Store:
    """A store of records (with id and the natural key), of the rows set aside, of sources and of a table for each step."""
    rejected = T.StructType([f for f in records.fields if f.name != "id"] + [T.StructField("error", T.StringType())])
    of = T.StructType.fromDDL
    return Store(spark, folder, {"records": records, "rejected": rejected, "record_sources": of("record_id long, source_id long, role string"), "done": of(DONE), "failed": of(FAILED), **steps})


def isolated(records: DataFrame, write: Callable[[DataFrame, str], None], key: str = "id") -> list[tuple[str, str]]:
    """Runs write(rows, part) over all records, or, where that fails, over halves by hash of the key, and so on. Returns (condition, error) of what still fails alone.

    write must either write all of a part or count as failed; parts have names of their own. A batch with b bad rows of n takes about 2 b log2(n) runs, one without takes one.
    """
    bad: list[tuple[str, str]] = []
    place = F.xxhash64(F.col(key)).alias("place")

    def attempt(bits: int, value: int) -> None:
        mine = records if not bits else records.where(F.pmod(place, F.lit(1 << bits)) == value)
        try:
            write(mine, f"{bits}-{value}")
        except Exception as e:  # noqa: BLE001  # whatever a step raises is its result
            if bits < SPLITS and mine.select(key).limit(2).count() > 1:
                attempt(bits + 1, value)
                attempt(bits + 1, value + (1 << bits))
            else:
                bad.append((f"pmod(xxhash64({key}), {1 << bits}L) = {value}L" if bits else "true", f"{type(e).__name__}: {e}".splitlines()[0][:500]))

    attempt(0, 0)
    return bad


def run_batch(batch: DataFrame, number: int, into: Store, steps: dict[str, tuple[int, Step]], source_id: int | None = None, order: str = "scraped_at", catch_up: bool = False) -> bool:
    """One batch of parsed records: new ones inserted once, known ones confirmed, rows that are no records set aside, steps (version, step) run.

    Every table's part is written before the batch counts. False if the batch counts already: nothing is done then.
    """
    if into.committed(number):
        return False
    for name in into.schemas:
        into.clear(name, number)
    valid = F.coalesce(valid_record(*[F.col(c) for c in NATURAL_KEY]), F.lit(False))
    into.write("rejected", number, batch.where(~valid).withColumn("error", F.lit("no valid record")))
    known = into.read("records").drop("batch")
    fresh, roles = ingest_batch(batch.where(valid), known, order)
    records = into.write("records", number, fresh)
    if source_id is not None:
        every = known.select("id", *NATURAL_KEY).unionByName(records.select("id", *NATURAL_KEY))
        linked = roles.join(every, NATURAL_KEY).select(F.col("id").cast("long").alias("record_id"), F.lit(source_id).cast("long").alias("source_id"), "role")
        into.write("record_sources", number, linked.join(into.read("record_sources"), ["record_id", "source_id", "role"], "left_anti"))
    everything = known.unionByName(records)
    for name, (version, step) in steps.items():
        todo = stale_steps(everything, into.read("done").drop("batch"), name, version) if catch_up else records
        bad = isolated(todo, lambda rows, part, name=name, step=step: into.write(name, number, step(rows, into), part))
        failing = F.lit(False)
        for condition, _ in bad:
            failing = failing | F.expr(condition)
        into.write("done", number, todo.where(~failing).select(F.col("id").cast("long").alias("record_id"), F.lit(name).alias("step"), F.lit(version).alias("version")), name)
        error = F.coalesce(*[F.when(F.expr(c), F.lit(e)) for c, e in bad], F.lit("")) if bad else F.lit("")
        into.write("failed", number, todo.where(failing).select(F.col("id").cast("long").alias("record_id"), F.lit(name).alias("step"), error.alias("error")), name)
    counts = batch.agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("errors")).withColumn("inserted", F.lit(records.count()))
    into.commit(number, counts.select("inserted", (F.col("valid") - F.col("inserted")).alias("skipped"), "errors"))
    return True


def versions(into: Store, name: str, key: list[str]) -> DataFrame:
    """A step's table with the rows of each key's newest batch, as a step that ran again replaces what it gave before."""
    rows = into.read(name)
    newest = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*key, "batch"], "left_semi").drop("batch")
