"""Statistics, integrity checks and filter options over license tables; the tables are those of ``search``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linking
from .records import duplicates, orphans

#: Codes of states that a filter offers.
STATES = ("AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY").split()


def totals(records: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: records by section, first and last date, different businesses and licenses, entities. One pass over records."""
    of = lambda s: F.count_if(F.col("section_type") == s)
    out = records.agg(F.count("*").alias("total_records"), of("new_application").alias("new_application_count"), of("approved").alias("approved_count"), of("discontinued").alias("discontinued_count"), F.min("record_date").alias("min_date"), F.max("record_date").alias("max_date"), F.countDistinct("business_name").alias("unique_businesses"), F.countDistinct("license_number").alias("unique_licenses"))
    return out.withColumn("unique_entities", entities.agg(F.count("*")).scalar())


def funnel(records: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """One row: linkable applications, and all applications by outcome. Links are reduced to flags before they are joined."""
    ends = records.select(F.col("id").alias("outcome_id"), F.col("section_type").alias("ended"))
    flags = links.join(ends, "outcome_id").groupBy(F.col("new_app_id").alias("id")).agg(F.bool_or(F.col("ended") == "approved").alias("approved"), F.bool_or(F.col("ended") == "discontinued").alias("discontinued"))
    rows = records.join(flags, "id", "left")
    kind, day = F.col("application_type"), F.to_date("record_date")
    new = F.col("section_type") == "new_application"
    free, gap, recent = new & kind.isin(*linking.LINKABLE) & F.col("approved").isNull(), linking.not_published(kind, day), day >= F.date_sub(as_of, linking.PENDING_DAYS)
    return rows.agg(
        F.count_if(new & kind.isin(*linking.LINKABLE)).alias("total"),
        F.count_if("approved").alias("approved"),
        F.count_if("discontinued").alias("discontinued"),
        F.count_if(free & recent & ~gap).alias("pending"),
        F.count_if(new & gap & F.col("approved").isNull()).alias("data_gap"),
        F.count_if(free & ~recent & ~gap).alias("unknown"),
    )


def _shown(std: str, raw: str) -> Column:
    return F.coalesce(F.nullif(F.col(std), F.lit("")), F.col(raw))


def used_locations(records: DataFrame, locations: DataFrame) -> DataFrame:
    """Locations that some record names, as current or previous one."""
    used = records.select(F.col("location_id").alias("id")).union(records.select("previous_location_id")).where("id is not null").distinct()
    return locations.join(used, "id", "left_semi")


def state_options(records: DataFrame, locations: DataFrame) -> DataFrame:
    """(state) of used locations, as shown, of those that are states."""
    return used_locations(records, locations).select(_shown("std_region", "state").alias("state")).where(F.col("state").isin(*STATES)).distinct()


def cities(records: DataFrame, locations: DataFrame, state: str) -> DataFrame:
    """(city) of used locations in a state, as shown; none for what is no state."""
    own = used_locations(records, locations).where((_shown("std_region", "state") == state) & F.lit(state).isin(*STATES))
    return own.select(_shown("std_city", "city").alias("city")).where("city <> ''").distinct()


def value_options(records: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): different filled values of columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns]))
    return records.select(pairs.alias("p")).select("p.*").where("value <> ''").distinct()


def broken_keys(records: DataFrame, locations: DataFrame) -> DataFrame:
    """(record_id, column, bad_id): location keys of records that lead nowhere."""
    own = locations.select(F.col("id").alias("bad_id"))
    of = lambda c: records.select(F.col("id").alias("record_id"), F.lit(c).alias("column"), F.col(c).alias("bad_id")).where("bad_id is not null").join(own, "bad_id", "left_anti")
    return of("location_id").unionByName(of("previous_location_id")).select("record_id", "column", "bad_id")


def integrity(tables: dict[str, DataFrame], enrichments: DataFrame) -> DataFrame:
    """(check_name, issues): orphans, broken keys, records that lack what should have been derived, anomalies, duplicates."""
    records, ids = tables["records"], lambda df, c="record_id": df.select(F.col(c).alias("id")).distinct()
    lacks = lambda rows, df: rows.join(ids(df), "id", "left_anti")
    found = {
        "orphaned_locations": orphans(tables["locations"], "id", records.select("location_id").where("location_id is not null"), records.select("previous_location_id").where("previous_location_id is not null")),
        "broken_keys": broken_keys(records, tables["locations"]),
        "no_endorsements": lacks(records.where("license_type <> ''"), tables["record_endorsements"]),
        "no_entities": lacks(records.where(F.contains("applicants", F.lit(";"))), tables["record_entities"]),
        "no_provenance": lacks(records, tables["record_sources"]),
        "no_enrichment_tracking": lacks(records, enrichments.where("step = 'endorsements'")),
        "unresolved_codes": lacks(records.where(F.col("license_type").rlike(r"^\d")), tables["record_endorsements"]),
        "placeholder_endorsements": tables["endorsements"].where(F.col("name").rlike(r"^\d+$")),
        "duplicate_entities": duplicates(tables["entities"], F.upper("name"), "id"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("check_name"), F.count("*").alias("issues")) for name, df in found.items()])


def endorsement_list(endorsements: DataFrame, codes: DataFrame, aliases: DataFrame, bridge: DataFrame) -> DataFrame:
    """(id, name, record_count, is_canonical, is_variant, canonical_name, codes): all endorsements; codes by value, then as text."""
    counts = bridge.groupBy(F.col("endorsement_id").alias("id")).agg(F.count("*").alias("record_count"))
    order = F.struct(F.col("code").try_cast("int").isNull().alias("text"), F.col("code").try_cast("int").alias("value"), "code")
    listed = codes.groupBy(F.col("endorsement_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set(order)), lambda x: x["code"]), ",").alias("codes"))
    heads = aliases.select(F.col("canonical_endorsement_id").alias("id"), F.lit(True).alias("is_canonical")).distinct()
    canon = aliases.join(endorsements.select(F.col("id").alias("canonical_endorsement_id"), F.col("name").alias("canonical_name")), "canonical_endorsement_id").select(F.col("endorsement_id").alias("id"), "canonical_name")
    out = endorsements.select("id", "name").join(counts, "id", "left").join(listed, "id", "left").join(heads, "id", "left").join(canon, "id", "left")
    return out.select("id", "name", F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("is_canonical", F.lit(False)).alias("is_canonical"), F.col("canonical_name").isNotNull().alias("is_variant"), "canonical_name", F.coalesce("codes", F.lit("")).alias("codes"))


def code_counts(codes: DataFrame, bridge: DataFrame) -> DataFrame:
    """(code, records): different records of each code's endorsements."""
    return codes.join(bridge, "endorsement_id", "left").groupBy("code").agg(F.countDistinct("record_id").alias("records"))
