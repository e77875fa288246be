"""Faceted search over license records: filters, count, page, export and the record page.

Tables: records (id, section_type, record_date, license_number, application_type, business_name, ..., location_id,
previous_location_id), locations (id, raw_address, city, state, zip_code, std_*), endorsements (id, name), aliases
(endorsement_id, canonical_endorsement_id), record_endorsements (record_id, endorsement_id), links (new_app_id,
outcome_id, confidence, days_gap), entities (id, name, entity_type), record_entities (record_id, entity_id, role, position).
Empty and null facets filter nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_filled, trigram_similarity, trigrams
from . import linking, text
from .records import dealt, filtered, page

#: Columns of a location, and what stands for null in the two roles.
_PLACE = ("raw_address", "city", "state", "zip_code", "std_address_line_1", "std_address_line_2", "std_city", "std_region", "std_postal_code", "std_country")
_TIMES = ("address_standardized_at", "address_validated_at")
TRIGRAM_LIMIT = 0.3
MOST_EXPORTED = 100_000


def endorsement_ids(endorsements: DataFrame, aliases: DataFrame, names: list[str]) -> DataFrame:
    """(endorsement_id) of the named endorsements and their variants, one step; none for unknown names."""
    own = endorsements.where(F.col("name").isin(names)).select(F.col("id").alias("endorsement_id"))
    variants = aliases.join(own.withColumnRenamed("endorsement_id", "canonical_endorsement_id"), "canonical_endorsement_id", "left_semi").select("endorsement_id")
    return own.union(variants).distinct()


def with_endorsements(records: DataFrame, bridge: DataFrame, endorsements: DataFrame, aliases: DataFrame, names: list[str]) -> DataFrame:
    """Records that have one of the named endorsements; nothing if no name is known."""
    ids = bridge.join(endorsement_ids(endorsements, aliases, names), "endorsement_id", "left_semi").select(F.col("record_id").alias("id"))
    return records.join(ids, "id", "left_semi") if names else records


def in_place(records: DataFrame, locations: DataFrame, state: str = "", city: str = "") -> DataFrame:
    """Records whose current or previous location lies in the state, and one of them in the city; the standardised name counts
    where there is one. A city alone filters nothing, as its name is not unique. Locations are joined only if they are asked for."""
    if not state:
        return records
    shown = lambda std, raw: F.coalesce(F.nullif(F.col(std), F.lit("")), F.col(raw))
    flags = locations.select("id", F.coalesce(shown("std_region", "state") == state, F.lit(False)).alias("s"), F.coalesce(shown("std_city", "city") == city, F.lit(False)).alias("c") if city else F.lit(True).alias("c"))
    hits = flags.where("s or c")
    now, before = (hits.select(F.col("id").cast("string").alias(f"{k} k"), F.col("s").alias(f"{k} s"), F.col("c").alias(f"{k} c")) for k in ("location_id", "previous_location_id"))
    # most records have no previous location: those without one take a key of their own, so that they do not meet in one task
    keys = {f"{k} k": F.coalesce(F.col(k).cast("string"), F.concat(F.lit("none "), F.col("id").cast("string"))) for k in ("location_id", "previous_location_id")}
    either = lambda f: F.coalesce(F.col(f"location_id {f}"), F.lit(False)) | F.coalesce(F.col(f"previous_location_id {f}"), F.lit(False))
    out = records.withColumns(keys).join(now, "location_id k", "left").join(before, "previous_location_id k", "left")
    return out.where(either("s") & either("c") if city else either("s")).select(*records.columns)


def said(records: DataFrame, query: str, document: Column, fuzzy: tuple[str, ...] = ("business_name", "applicants"), resembling: DataFrame | None = None) -> DataFrame:
    """Records that hold all words of the query, or resemble it in a fuzzy column by trigrams; adds rank. An empty query keeps all.

    With resembling (id), from trigrams.lookup() over an index of the fuzzy columns, no column is compared row by row.
    """
    if not query:
        return records.withColumn("rank", F.lit(0.0))
    doc, q = F.col("searched document"), text.lexemes(F.lit(query))
    lexemes = F.transform(doc, lambda x: x["lexeme"])
    whole = (F.size(q) > 0) & (F.size(F.array_except(q, lexemes)) == 0)
    out, near = records, F.lit(False)
    if resembling is not None:
        out = records.join(resembling.select("id").distinct().withColumn("it resembles", F.lit(True)), "id", "left")
        near = F.coalesce("it resembles", F.lit(False))
    else:
        for c in fuzzy:
            near = near | F.coalesce(trigram_similarity(trigrams(F.col(c)), trigrams(F.lit(query))) >= TRIGRAM_LIMIT, F.lit(False))
    return dealt(out).select("*", F.explode(F.array(document)).alias("searched document")).where(whole | near).withColumn("rank", text.rank_of(doc, q)).select(*records.columns, "rank")


def search(records: DataFrame, tables: dict[str, DataFrame], *, section_type: str = "", application_type: str = "", endorsements: list[str] | None = None, state: str = "", city: str = "", date_from: str = "", date_to: str = "", outcome_status: str = "", as_of: Column | None = None, query: str = "", document: Column | None = None) -> DataFrame:
    """Records that meet all facets that are given. Its count needs no join but those that a facet asks for."""
    out = filtered(records, {"section_type": section_type, "application_type": application_type}, ("record_date", date_from or None, date_to or None))
    out = with_endorsements(out, tables["record_endorsements"], tables["endorsements"], tables["aliases"], endorsements) if endorsements else out
    out = in_place(out, tables["locations"], state, city) if state else out
    out = linking.with_status(out, tables["links"], outcome_status, as_of, records) if outcome_status else out
    return said(out, query, document) if query else out


def result_page(found: DataFrame, number: int, size: int) -> DataFrame:
    """A page by rank if there is one, then newest first."""
    return page(found, [*([F.desc("rank")] if "rank" in found.columns else []), F.desc("record_date"), F.desc("id")], number, size)


def with_locations(records: DataFrame, locations: DataFrame) -> DataFrame:
    """Adds the columns of the current and the previous location, '' for null but state, which is WA for the current one, and display_* names."""
    have = [c for c in _PLACE if c in locations.columns]
    times = [c for c in _TIMES if c in locations.columns]

    def role(key: str, name, empty_state: str) -> tuple[DataFrame, list[Column]]:
        side = locations.select(F.col("id").alias(key), *[F.col(c).alias(f"{key} {c}") for c in (*have, *times)])
        return side, [*(F.coalesce(F.col(f"{key} {c}"), F.lit(empty_state if c == "state" else "")).alias(name(c)) for c in have), *(F.col(f"{key} {c}").alias(name(c)) for c in times)]

    now, now_columns = role("location_id", lambda c: "business_location" if c == "raw_address" else c, "WA")
    before, before_columns = role("previous_location_id", lambda c: "previous_business_location" if c == "raw_address" else f"prev_{c}" if c.startswith(("std_", "address_")) else f"previous_{c}", "")
    out = records.join(now, "location_id", "left").join(before, "previous_location_id", "left").select(*records.columns, *now_columns, *before_columns)
    for shown, std, raw in (("display_city", "std_city", "city"), ("display_zip", "std_postal_code", "zip_code"), ("display_previous_city", "prev_std_city", "previous_city"), ("display_previous_zip", "prev_std_postal_code", "previous_zip_code")):
        if std in out.columns:
            out = out.withColumn(shown, first_filled(F.col(std), F.col(raw)))
    return out


def shown_endorsements(bridge: DataFrame, endorsements: DataFrame, aliases: DataFrame, by_variant: bool = False) -> DataFrame:
    """(record_id, endorsements): canonical names as one '; ' list in their order, or in that of the names they stand for; repeated names stay."""
    canon = endorsements.select(F.col("id").alias("canonical_endorsement_id"), F.col("name").alias("canonical"))
    named = endorsements.select(F.col("id").alias("endorsement_id"), "name").join(aliases.select("endorsement_id", "canonical_endorsement_id"), "endorsement_id", "left").join(canon, "canonical_endorsement_id", "left")
    each = bridge.join(named.select("endorsement_id", F.coalesce("canonical", "name").alias("shown"), "name"), "endorsement_id")
    order = F.struct("name", "shown") if by_variant else F.struct("shown")
    return each.groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["shown"]), "; ").alias("endorsements"))


def shown_entities(bridge: DataFrame, entities: DataFrame) -> DataFrame:
    """(record_id, applicant, previous_applicant): arrays of (position, id, name, entity_type) in order; both are there, empty or not."""
    each = bridge.join(entities.select(F.col("id").alias("entity_id"), "name", "entity_type"), "entity_id")
    of = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("position", F.col("entity_id").alias("id"), "name", "entity_type")))).alias(role)
    return each.groupBy("record_id").agg(of("applicant"), of("previous_applicant"))


def hydrate(rows: DataFrame, tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Rows with locations, endorsements, entities and outcome; only what belongs to the rows is aggregated."""
    own = rows.select(F.col("id").alias("record_id"))
    near = lambda name: tables[name].join(own, "record_id", "left_semi")
    names = shown_endorsements(near("record_endorsements"), tables["endorsements"], tables["aliases"])
    people = shown_entities(near("record_entities"), tables["entities"])
    out = with_locations(rows, tables["locations"]).join(names.withColumnRenamed("record_id", "id"), "id", "left").join(people.withColumnRenamed("record_id", "id"), "id", "left")
    none = F.array().cast(people.schema["applicant"].dataType)
    out = out.withColumns({"endorsements": F.coalesce("endorsements", F.lit("")), "applicant": F.coalesce("applicant", none), "previous_applicant": F.coalesce("previous_applicant", none)})
    links = tables["links"].join(rows.select(F.col("id").alias("new_app_id")), "new_app_id", "left_semi")
    best = linking.best_link(links).join(tables["records"].select(F.col("id").alias("outcome_id"), F.col("record_date").alias("outcome_date"), F.col("section_type").alias("outcome_section")), "outcome_id")
    out = out.join(best.withColumnRenamed("new_app_id", "id"), "id", "left")
    return out.withColumn("outcome_status", linking.outcome_status(F.col("section_type"), F.col("application_type"), F.col("outcome_section"), F.col("record_date"), as_of))


def record(records: DataFrame, id_: int, tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """The record page: one hydrated row, or none."""
    return hydrate(records.where(F.col("id") == id_), tables, as_of)


def find(records: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (section_type, record_date, license_number, application_type) with the id of their record, null if there is none."""
    natural = ["section_type", "record_date", "license_number", "application_type"]
    return keys.join(records.groupBy(*natural).agg(F.min("id").alias("id")), natural, "left")


def export(found: DataFrame, tables: dict[str, DataFrame], as_of: Column, limit: int = MOST_EXPORTED) -> DataFrame:
    """The flat export: the newest rows, capped, with locations, endorsements, best link and status; nulls stay null for the sink."""
    top = found.orderBy(F.desc("record_date"), F.desc("id")).limit(limit)
    own = top.select(F.col("id").alias("record_id"))
    names = shown_endorsements(tables["record_endorsements"].join(own, "record_id", "left_semi"), tables["endorsements"], tables["aliases"])
    out = with_locations(top, tables["locations"]).join(names.withColumnRenamed("record_id", "id"), "id", "left")
    best = linking.best_link(tables["links"]).join(tables["records"].select(F.col("id").alias("outcome_id"), F.col("record_date").alias("outcome_date"), F.col("section_type").alias("outcome_section")), "outcome_id")
    out = out.join(best.select(F.col("new_app_id").alias("id"), F.col("days_gap").alias("days_to_outcome"), "outcome_date", "outcome_section"), "id", "left")
    status = linking.outcome_status(F.col("section_type"), F.col("application_type"), F.col("outcome_section"), F.col("record_date"), as_of)
    return out.withColumn("outcome_status", status).drop("outcome_section")


def entity_licenses(bridge: DataFrame, records: DataFrame) -> DataFrame:
    """(entity_id, records, licenses): records of each entity over all roles, and their different licenses."""
    own = bridge.select("entity_id", "record_id").distinct().join(records.select(F.col("id").alias("record_id"), "license_number"), "record_id")
    return own.groupBy("entity_id").agg(F.count("*").alias("records"), F.countDistinct("license_number").alias("licenses"))


def provenance_of(record_sources: DataFrame, sources: DataFrame, source_types: DataFrame, record_id: int) -> DataFrame:
    """Sources of one record, newest first, those without a time before all."""
    own = record_sources.where(F.col("record_id") == record_id)
    joined = own.join(sources.select(F.col("id").alias("source_id"), "source_type_id", "snapshot_path", "captured_at", "metadata"), "source_id").join(source_types.select(F.col("id").alias("source_type_id"), "slug", "label"), "source_type_id")
    return joined.withColumn("metadata", F.from_json("metadata", "map<string,string>")).orderBy(F.col("captured_at").desc_nulls_first(), "source_id")


def has_source(record_sources: DataFrame, source_id: int) -> DataFrame:
    """(record_id, linked): whether each record is linked with the source."""
    return record_sources.groupBy("record_id").agg(F.bool_or(F.col("source_id") == source_id).alias("linked"))


def by_name(dimension: DataFrame, name: str) -> DataFrame:
    """Rows of a name, whatever its case."""
    return dimension.where(F.lower("name") == name.lower())
