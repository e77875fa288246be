"""Sinks: flat export, statistics envelope, gzip archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Columns of the flat export.
EXPORT_COLUMNS = "section_type record_date business_name business_location std_address_line_1 std_address_line_2 applicants license_type endorsements application_type license_number contact_phone city state zip_code std_city std_region std_postal_code std_country previous_business_name previous_applicants previous_business_location prev_std_address_line_1 prev_std_address_line_2 prev_std_city prev_std_region prev_std_postal_code outcome_status outcome_date days_to_outcome".split()


def export_rows(df: DataFrame) -> DataFrame:
    """EXPORT_COLUMNS as text, those that the frame lacks empty; null, zero and false are empty, too."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        filled = F.col(c) if kinds[c] == "boolean" else F.col(c) != 0 if kinds[c] in ("int", "bigint", "double") else F.col(c).isNotNull()
        return F.when(filled, F.col(c).cast("string")).otherwise("")

    return df.select(*[cell(c).alias(c) for c in EXPORT_COLUMNS])


def versioned(pages: DataFrame, archived: DataFrame, day: str = "day", order: str = "captured_at") -> DataFrame:
    """Pages with version, which goes on from the highest one that is archived (date, version) for their day."""
    have = archived.groupBy("date").agg(F.max("version").alias("have"))
    place = F.row_number().over(Window.partitionBy("date").orderBy(order))
    return pages.withColumn("date", F.col(day).cast("string")).join(have, "date", "left").withColumn("version", F.coalesce("have", F.lit(0)) + place).drop("have")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header, in as many files as there are partitions; null and numeric zero are written empty, as the reference exports them."""
    numeric = {n for n, kind in df.dtypes if kind in ("int", "bigint", "double")}
    df.select(*[F.when((F.col(c) != 0) if c in numeric else F.col(c).isNotNull(), F.col(c)).cast("string").alias(c) for c in df.columns]).write.option("header", True).option("emptyValue", "").csv(path)


def stats_envelope(stats: DataFrame) -> DataFrame:
    """One JSON text {ok, message, data} of a one-row frame."""
    return stats.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.lit("").alias("message"), F.struct(*stats.columns).alias("data"))).alias("json"))


def archive_pages(pages: DataFrame, path: str, day: str = "day") -> None:
    """Gzip text by year and day."""
    pages.select(F.year(day).alias("year"), F.col(day).cast("string").alias("date"), F.col("html").alias("value")).write.mode("append").partitionBy("year", "date").option("compression", "gzip").text(path)
