"""Dimensions and their administration: get-or-create, bridges rebuilt from records, codes, aliases, merges, substances.

Every function gives the table as it is after the change; Parquet has no update, so the caller overwrites or versions it.
Tables as in ``search``; codes is (code, endorsement_id), substances (id, name, display_order), substance_endorsements (substance_id, endorsement_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import applicants, clean_name, code_of, entity_type, license_types, normalise_nbsp
from .records import alias_upsert, dealt, first_wins, new_rows, regrouped, with_surrogate_keys

#: What names of digits only and "CODE, NAME" look like, the statuses that confirm an address, and the version of the endorsement step.
NUMERIC = r"^\d+$"
CODE_NAME = r"^(\d+),\s+(.+)$"
CONFIRMED = ("confirmed", "confirmed_missing_secondary", "confirmed_bad_secondary")
REPROCESS_VERSION = 2


def _added(dimension: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The dimension with a new id for every wanted row whose key, nulls counting as equal, it lacks."""
    fresh = with_surrogate_keys(new_rows(wanted, dimension, key), dimension, "id", key)
    return dimension.unionByName(fresh, allowMissingColumns=True)


def add_locations(locations: DataFrame, seen: DataFrame) -> DataFrame:
    """Locations of seen (raw_address, city, state, zip_code; order says which row came first) that are not there yet, by address
    with even blanks. What the first writer said stays; blank addresses make no location."""
    rows = seen.withColumn("raw_address", normalise_nbsp(F.col("raw_address"))).where(F.trim("raw_address") != "")
    return _added(locations, first_wins(rows, ["raw_address"], [F.asc("order")]).drop("order"), ["raw_address"])


def add_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities by cleaned name, with their kind; empty names make none."""
    wanted = names.select(clean_name(F.col("name")).alias("name")).where("name <> ''").distinct().withColumn("entity_type", entity_type(F.col("name")))
    return _added(entities, wanted, ["name"])


def add_endorsements(endorsements: DataFrame, names: DataFrame) -> DataFrame:
    """Endorsements by name in capitals."""
    return _added(endorsements, names.select(F.upper(F.trim("name")).alias("name")).where("name <> ''").distinct(), ["name"])


def add_sources(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources by type and path; those without a path by type and scrape_log_id."""
    return _added(sources, wanted, ["source_type_id", "snapshot_path"] + (["scrape_log_id"] if "scrape_log_id" in sources.columns else []))


def upsert_sources(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Like add_sources for sources with a path, but a known one takes the captured_at and metadata given."""
    news = wanted.select("source_type_id", "snapshot_path", F.col("captured_at").alias("new time"), F.col("metadata").alias("new data"), F.lit(True).alias("given"))
    kept = sources.join(news, ["source_type_id", "snapshot_path"], "left")
    kept = kept.withColumn("captured_at", F.when(F.col("given"), F.col("new time")).otherwise(F.col("captured_at"))).withColumn("metadata", F.when(F.col("given"), F.col("new data")).otherwise(F.col("metadata")))
    return _added(kept.select(*sources.columns), wanted, ["source_type_id", "snapshot_path"])


def linked_sources(record_sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Provenance with the wanted rows, each once."""
    return dealt(record_sources.unionByName(wanted.select(*record_sources.columns)), "record_id").dropDuplicates(["record_id", "source_id", "role"])


def entity_bridge(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(record_id, entity_id, role, position) of all records: names of both lists, numbered from 0 in order."""
    of = lambda column, role: records.where(F.contains(F.col(column), F.lit(";"))).select(F.col("id").alias("record_id"), F.lit(role).alias("role"), F.posexplode(applicants(F.col(column))).alias("position", "name"))
    names = of("applicants", "applicant").unionByName(of("previous_applicants", "previous_applicant"))
    return names.join(entities.select(F.col("id").alias("entity_id"), "name"), "name").select("record_id", "entity_id", "role", "position")


def missing_entities(records: DataFrame, bridge: DataFrame) -> DataFrame:
    """Records with several applicants that the bridge lacks: what a backfill has to do."""
    return records.where(F.contains("applicants", F.lit(";"))).join(bridge.select(F.col("record_id").alias("id")), "id", "left_anti")


def _meant(records: DataFrame) -> DataFrame:
    """(record_id, code, name) that license types say."""
    return records.select(F.col("id").alias("record_id"), F.explode(license_types(F.col("license_type"))).alias("x")).select("record_id", "x.code", "x.name")


def registered(records: DataFrame, codes: DataFrame, endorsements: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """Endorsements and codes after records came one by one, by order: an unknown code is registered by the first record that
    bears it, with the name beside it, or as a placeholder named like the code; later ones, bare or with another name, resolve to that.
    """
    meant = records.select(F.col(order).alias("order"), F.explode(license_types(F.col("license_type"))).alias("x")).select("order", "x.code", "x.name")
    free = meant.where("code is not null").join(codes.select("code").distinct(), "code", "left_anti")
    # of one record two entries of a code cannot be: a license type has one code at most
    first = free.groupBy("code").agg(F.min_by(F.upper(F.trim(F.coalesce("name", "code"))), "order").alias("name"))
    more = add_endorsements(endorsements, meant.where("code is null").select("name").union(first.select("name")))
    named = first.join(more.select("name", F.col("id").alias("endorsement_id")), "name")
    return more, codes.unionByName(named.select("code", "endorsement_id"))


def endorsement_bridge(records: DataFrame, codes: DataFrame, endorsements: DataFrame) -> DataFrame:
    """(record_id, endorsement_id) of all records: a code stands for all its endorsements, other names for themselves. Codes and names
    that are not there yet give nothing: registered() brings them in."""
    meant = _meant(records)
    coded = meant.join(codes, "code").select("record_id", "endorsement_id")
    free = meant.where("code is null").select("record_id", F.upper(F.trim("name")).alias("name"))
    return coded.union(free.join(endorsements.select(F.col("id").alias("endorsement_id"), "name"), "name").select("record_id", "endorsement_id")).distinct()


def reprocessed(records: DataFrame, bridge: DataFrame, codes: DataFrame, endorsements: DataFrame, aliases: DataFrame, done: DataFrame, at: Column, of: DataFrame | None = None) -> dict[str, DataFrame]:
    """Endorsements of records (all, or of (id)) made anew from their license types: tables bridge, codes, endorsements, resolved
    (record_id, endorsements) of the records that were processed, and done, the step ledger. Records without a license type stay as they are."""
    from ..plans.ingest import stamped
    from .search import shown_endorsements

    own = records if of is None else records.join(of.select("id").distinct(), "id", "left_semi")
    own = own.where(F.coalesce("license_type", F.lit("")) != "")
    more, all_codes = registered(own, codes, endorsements)
    again = rebuilt(bridge, own, endorsement_bridge(own, all_codes, more))
    mine = again.join(own.select(F.col("id").alias("record_id")), "record_id", "left_semi")
    names = shown_endorsements(mine, more, aliases, by_variant=True)
    shown = own.select(F.col("id").alias("record_id")).join(names, "record_id", "left").select("record_id", F.coalesce("endorsements", F.lit("")).alias("endorsements"))
    return {"bridge": again, "codes": all_codes, "endorsements": more, "resolved": shown, "done": stamped(done, own, "endorsements", REPROCESS_VERSION, at)}


def unaliased(records: DataFrame, bridge: DataFrame, codes: DataFrame, endorsements: DataFrame, aliases: DataFrame, done: DataFrame, log: DataFrame, endorsement_id: int, email: str, at: Column) -> dict[str, DataFrame]:
    """A variant made an endorsement of its own: tables aliases, those of reprocessed() for the records that have it, and log with the action.

    An error if it is none or no variant.
    """
    known = aliases.where(F.col("endorsement_id") == endorsement_id)
    names = endorsements.select(F.col("id").alias("canonical_endorsement_id"), F.col("name").alias("canonical_name"))
    own = endorsements.where(F.col("id") == endorsement_id).select(F.col("id").alias("endorsement_id"), F.col("name").alias("variant_name"))
    if own.isEmpty():
        raise ValueError(f"endorsement {endorsement_id} is not there")
    left = remove_alias(aliases, endorsement_id)
    affected = bridge.where(F.col("endorsement_id") == endorsement_id).select(F.col("record_id").alias("id"))
    tables = reprocessed(records, bridge, codes, endorsements, left, done, at, affected)
    told = known.join(own, "endorsement_id").join(names, "canonical_endorsement_id", "left").withColumn("n", F.lit(affected.count()))
    details = F.create_map(F.lit("variant_name"), F.col("variant_name"), F.lit("canonical_id"), F.col("canonical_endorsement_id").cast("string"), F.lit("canonical_name"), F.coalesce("canonical_name", F.col("canonical_endorsement_id").cast("string")), F.lit("records_reprocessed"), F.col("n").cast("string"))
    action = told.select(F.lit(email).alias("email"), F.lit("endorsement.remove_alias").alias("action"), F.lit("endorsement").alias("target_type"), F.lit(endorsement_id).cast("long").alias("target_id"), details.alias("details"))
    return {**tables, "aliases": left, "log": audited(log, action)}


def code_changed(records: DataFrame, bridge: DataFrame, codes: DataFrame, endorsements: DataFrame, aliases: DataFrame, done: DataFrame, log: DataFrame, code: str, email: str, at: Column, add: tuple[int, ...] = (), remove: tuple[int, ...] = ()) -> dict[str, DataFrame]:
    """Endorsements added to or taken from a code's expansion, and its records made anew: tables of reprocessed() and log with an action for
    each endorsement that made a change. A change that is none leaves everything as it is. An empty code is an error."""
    if not (code := code.strip()):
        raise ValueError("code must not be empty")
    spark = codes.sparkSession
    asked = spark.createDataFrame([(code, e, "endorsement.code_add") for e in dict.fromkeys(add)] + [(code, e, "endorsement.code_remove") for e in dict.fromkeys(remove)], "code string, endorsement_id long, action string")
    there = codes.withColumn("there", F.lit(True))
    real = asked.join(there, ["code", "endorsement_id"], "left").where(F.coalesce("there", F.lit(False)) == (F.col("action") == "endorsement.code_remove")).drop("there")
    now = codes.join(real.where("action = 'endorsement.code_remove'"), ["code", "endorsement_id"], "left_anti").unionByName(real.where("action = 'endorsement.code_add'").select("code", "endorsement_id"))
    affected = with_code(records, code).withColumn("code", F.lit(code)).join(real.select("code").distinct(), "code", "left_semi").select("id")
    tables = reprocessed(records, bridge, now, endorsements, aliases, done, at, affected)
    action = real.withColumn("n", F.lit(tables["resolved"].count())).select(F.lit(email).alias("email"), "action", F.lit("endorsement").alias("target_type"), F.col("endorsement_id").alias("target_id"), F.create_map(F.lit("code"), F.col("code"), F.lit("reprocessed_records"), F.col("n").cast("string")).alias("details"))
    return {**tables, "log": audited(log, action)}


def learned_merge(bridge: DataFrame, codes: DataFrame, endorsements: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bridge, codes, endorsements) after codes were learned (code, name, place: the order of a code's names): names become
    endorsements, codes map to them, and a placeholder named like the code goes into its first name; then all records of that one get the other names, too."""
    named = learned.withColumn("name", F.upper(F.trim("name"))).where("name <> ''")
    more = add_endorsements(endorsements, named.select("name"))
    each = named.join(more.select("name", F.col("id").alias("endorsement_id")), "name")
    mapped = codes.unionByName(each.select("code", "endorsement_id")).distinct()
    heads = each.groupBy("code").agg(F.min_by("endorsement_id", "place").alias("first"))
    holders = more.select(F.col("name").alias("code"), F.col("id").alias("id")).join(heads, "code")
    to = holders.where("id <> first").select("id", F.col("first").alias("canonical"))
    links, kept = moved(bridge, mapped, to)
    rest = each.join(holders.select("code", "first"), "code").where("endorsement_id <> first").select("first", F.col("endorsement_id").alias("other"))
    fan = links.join(rest, links["endorsement_id"] == rest["first"]).select("record_id", F.col("other").alias("endorsement_id"))
    return links.select("record_id", "endorsement_id").union(fan).distinct(), kept, more.join(to.select("id"), "id", "left_anti")


#: What a confirmed result overlays: column of the location, and field of the result.
_OVERLAID = {"std_address_line_1": "address_line_1", "std_address_line_2": "address_line_2", "std_city": "city", "std_region": "region", "std_postal_code": "postal_code", "std_country": "country"}


def merged_validations(locations: DataFrame, results: DataFrame) -> DataFrame:
    """Locations after results of an address service (location_id, at, mode, status, dpv_match_code, address_line_1, address_line_2, city, region,
    postal_code, country, validated, latitude, longitude) came in the order of at.

    A validation that confirms overlays the standardised address, place and all three times; any other leaves these alone and
    sets status, match code and the time of the attempt. A standardisation (mode 'standardize'; validated is the string it gave) sets the address,
    the status 'standardized' and its time, but no attempt. Of several results each column has what the last one that sets it
    said, so a result merged again changes nothing. A null status is a service that failed: nothing is set. Locations without an address take nothing.
    """
    raw = F.coalesce(F.trim("raw_address"), F.lit("")) != ""
    only = F.coalesce(F.col("mode"), F.lit("validate")) == "standardize"
    confirmed = ~only & F.col("status").isin(*CONFIRMED)
    field = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(""))
    country_ = F.when(field("country").rlike("^[A-Za-z]{2}$"), field("country")).otherwise("")
    said = {c: country_ if f == "country" else field(f) for c, f in _OVERLAID.items()}
    given = results.where(F.col("status").isNotNull() | only).select(
        F.col("location_id").alias("id"),
        F.col("at").alias("result at"),
        F.when(only, "standardized").otherwise(F.col("status")).alias("validation_status"),
        F.col("dpv_match_code").alias("dpv_match_code"),
        only.alias("only"),
        confirmed.alias("confirmed"),
        F.struct(*[v.alias(c) for c, v in said.items()], F.col("validated").alias("std_address_string")).alias("address"),
        F.struct("latitude", "longitude").alias("place"),
    )
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.struct("result at", F.xxhash64("address", "validation_status"))))
    every, at = F.lit(True), F.col("result at")
    merged = given.groupBy("id").agg(
        last(F.struct("validation_status"), every).alias("s"),
        last(F.struct("dpv_match_code"), ~F.col("only")).alias("m"),
        last(F.col("address"), F.col("confirmed") | F.col("only")).alias("a"),
        last(F.col("place"), F.col("confirmed")).alias("p"),
        F.max(F.when(F.col("confirmed") | F.col("only"), at)).alias("t1"),
        F.max(F.when(F.col("confirmed"), at)).alias("t2"),
        F.max(F.when(~F.col("only"), at)).alias("t3"),
    )
    both = locations.join(merged, "id", "left")
    over = lambda group, column: F.when(raw & F.col(group).isNotNull(), F.col(f"{group}.{column}")).otherwise(F.col(column)).alias(column)
    time = lambda t, column: F.when(raw & F.col(t).isNotNull(), F.col(t)).otherwise(F.col(column)).alias(column)
    new = {"validation_status": over("s", "validation_status"), "dpv_match_code": over("m", "dpv_match_code"), **{c: over("a", c) for c in (*_OVERLAID, "std_address_string")}, **{c: over("p", c) for c in ("latitude", "longitude")}}
    new |= {"address_standardized_at": time("t1", "address_standardized_at"), "address_validated_at": time("t2", "address_validated_at"), "address_validation_attempted_at": time("t3", "address_validation_attempted_at")}
    return both.select(*[new.get(c, F.col(c)) for c in locations.columns])


def rebuilt(bridge: DataFrame, records: DataFrame, again: DataFrame, key: str = "record_id") -> DataFrame:
    """A bridge in which the rows of records (id) are replaced by again; the rest stays."""
    return bridge.join(records.select(F.col("id").alias(key)), key, "left_anti").unionByName(again.select(*bridge.columns))


def with_code(records: DataFrame, code: str) -> DataFrame:
    """Records whose license type is a code, alone or before a name."""
    return records.where(code_of(F.col("license_type")) == code)


def resolved(records: DataFrame, names: DataFrame) -> DataFrame:
    """Records with resolved_endorsements, from names (record_id, endorsements); '' if there are none."""
    return records.drop("resolved_endorsements").join(names.select(F.col("record_id").alias("id"), F.col("endorsements").alias("resolved_endorsements")), "id", "left").withColumn("resolved_endorsements", F.coalesce("resolved_endorsements", F.lit("")))


def moved(bridge: DataFrame, codes: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bridge and codes after endorsements moved by mapping (id, canonical; several rows fan out); repeated rows go."""
    m = mapping.select(F.col("id").alias("endorsement_id"), F.col("canonical"))
    to = lambda df: df.join(m, "endorsement_id", "left").withColumn("endorsement_id", F.coalesce("canonical", "endorsement_id")).drop("canonical").distinct()
    return to(bridge), to(codes)


def mixed_case(endorsements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endorsements with names in capitals only, and the (id, canonical) of those that an upper-case one already stood for.

    Of several mixed spellings without one in capitals the lowest id takes the name.
    """
    capital = F.upper("name")
    keeper = F.min_by("id", F.struct(F.col("name") != capital, "id"))
    heads = endorsements.groupBy(capital.alias("u")).agg(keeper.alias("canonical"))
    each = endorsements.withColumn("u", capital).join(heads, "u")
    mapping = each.where("id <> canonical").select("id", "canonical")
    return each.where("id = canonical").drop("name").withColumnRenamed("u", "name").select(*endorsements.columns), mapping


def code_name_repair(endorsements: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Endorsements named "CODE, NAME": (endorsements with their plain names, codes with new mappings, (id, canonical)).

    A code that maps to endorsements already leads there, to all of them; else to the plain name, and the code is mapped to it.
    """
    bogus = endorsements.where(F.col("name").rlike(r"^\d+,\s*.+$")).select("id", F.regexp_extract("name", CODE_NAME, 1).alias("code"), F.upper(F.trim(F.regexp_extract("name", CODE_NAME, 2))).alias("plain")).where("code <> ''")
    known = codes.join(bogus.select(F.col("id").alias("endorsement_id")), "endorsement_id", "left_anti")
    mapped = bogus.join(known, "code").select("id", F.col("endorsement_id").alias("canonical"))
    free = bogus.join(known.select("code").distinct(), "code", "left_anti")
    more = add_endorsements(endorsements, free.select(F.col("plain").alias("name")))
    plain = free.join(more.select(F.col("id").alias("canonical"), F.col("name").alias("plain")), "plain")
    return more.join(bogus.select("id"), "id", "left_anti"), without_spaces(known.unionByName(plain.select("code", F.col("canonical").alias("endorsement_id"))).distinct()), mapped.union(plain.select("id", "canonical"))


def without_spaces(codes: DataFrame) -> DataFrame:
    return codes.where(~F.contains("code", F.lit(" ")))


def seeded(endorsements: DataFrame, codes: DataFrame, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Endorsements and codes with those of seed (code, name) that are missing."""
    more = add_endorsements(endorsements, seed.select("name"))
    wanted = seed.select("code", F.upper(F.trim("name")).alias("name")).join(more.select("name", F.col("id").alias("endorsement_id")), "name").select("code", "endorsement_id")
    return more, codes.unionByName(wanted).distinct()


def seed_codes(spark, path: str) -> DataFrame:
    """(code, name) of a JSON object of code -> list of names."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("code", "names")).select("code", F.explode("names").alias("name"))


def placeholders(endorsements: DataFrame, codes: DataFrame) -> DataFrame:
    """(id, canonical): endorsements that are named like a code, and all endorsements that the code really stands for."""
    numeric = endorsements.where(F.col("name").rlike(NUMERIC)).select("id", F.col("name").alias("code"))
    real = codes.join(endorsements.select(F.col("id").alias("endorsement_id"), "name"), "endorsement_id").where("name <> code").select("code", F.col("endorsement_id").alias("canonical"))
    return numeric.join(real, "code").select("id", "canonical")


def add_code(codes: DataFrame, code: str, endorsement_id: int) -> DataFrame:
    spark = codes.sparkSession
    return codes.unionByName(spark.createDataFrame([(code, endorsement_id)], "code string, endorsement_id long")).distinct()


def remove_code(codes: DataFrame, code: str, endorsement_id: int) -> DataFrame:
    return codes.where(~((F.col("code") == code) & (F.col("endorsement_id") == endorsement_id)))


def remove_alias(aliases: DataFrame, endorsement_id: int) -> DataFrame:
    """Aliases without one variant; an error if it has none."""
    if aliases.where(F.col("endorsement_id") == endorsement_id).isEmpty():
        raise ValueError(f"endorsement {endorsement_id} has no alias")
    return aliases.where(F.col("endorsement_id") != endorsement_id)


def renamed(endorsements: DataFrame, aliases: DataFrame, endorsement_id: int, name: str) -> tuple[DataFrame, DataFrame]:
    """A new name as a canonical endorsement, and the old one as its variant."""
    spark = endorsements.sparkSession
    more = add_endorsements(endorsements, spark.createDataFrame([(name,)], "name string"))
    change = more.where(F.col("name") == name.strip().upper()).select(F.lit(endorsement_id).cast("long").alias("variant"), F.col("id").alias("target"))
    now = alias_upsert(aliases.select(F.col("endorsement_id").alias("variant"), F.col("canonical_endorsement_id").alias("target")), change)
    return more, now.select(F.col("variant").alias("endorsement_id"), F.col("target").alias("canonical_endorsement_id"))


def dismissed(pairs: DataFrame, a: int, b: int) -> DataFrame:
    """Dismissed suggestions with one more, as an ordered pair, once."""
    return pairs.unionByName(pairs.sparkSession.createDataFrame([(min(a, b), max(a, b))], "a long, b long")).distinct()


def suggestions(endorsements: DataFrame, aliases: DataFrame, pairs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """(a, b, score) of endorsements that may be the same: no variants, not dismissed; score to three places, best first."""
    from ..functions.scalars import blended_similarity, similarity_tokens
    from .records import similar_pairs

    free = endorsements.join(aliases.select(F.col("endorsement_id").alias("id")), "id", "left_anti")
    found = similar_pairs(free, similarity_tokens(F.col("name")), blended_similarity, threshold, pairs)
    return found.select("a", "b", F.round("score", 3).alias("score")).orderBy(F.desc("score"), "a", "b")


def code_groups(endorsements: DataFrame, codes: DataFrame, bridge: DataFrame) -> DataFrame:
    """(code, records, names): endorsements by code with how many records have any of them; those without a code under null."""
    own = endorsements.join(codes.withColumnRenamed("endorsement_id", "id"), "id", "left")
    names = own.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))
    counted = own.select("code", F.col("id").alias("endorsement_id")).join(bridge, "endorsement_id").groupBy("code").agg(F.countDistinct("record_id").alias("records"))
    return names.join(counted, names["code"].eqNullSafe(counted["code"]), "left").select(names["code"], F.coalesce("records", F.lit(0)).alias("records"), "names")


def options(endorsements: DataFrame, aliases: DataFrame, bridge: DataFrame) -> DataFrame:
    """(name): canonical names that some record has."""
    used = endorsements.join(bridge.select(F.col("endorsement_id").alias("id")), "id", "left_semi")
    canon = endorsements.select(F.col("id").alias("canonical_endorsement_id"), F.col("name").alias("canonical"))
    both = used.join(aliases.withColumnRenamed("endorsement_id", "id"), "id", "left").join(canon, "canonical_endorsement_id", "left")
    return both.select(F.coalesce("canonical", "name").alias("name")).distinct()


def substance_list(substances: DataFrame, members: DataFrame, endorsements: DataFrame) -> DataFrame:
    """(id, name, display_order, endorsements): every substance with its endorsements in order, also without any."""
    names = members.join(endorsements.select(F.col("id").alias("endorsement_id"), F.col("name").alias("n")), "endorsement_id").groupBy("substance_id").agg(F.array_join(F.array_sort(F.collect_list("n")), "; ").alias("endorsements"))
    return substances.join(names.withColumnRenamed("substance_id", "id"), "id", "left").withColumn("endorsements", F.coalesce("endorsements", F.lit("")))


def next_order(substances: DataFrame) -> DataFrame:
    """(display_order) that follows the last one."""
    return substances.agg((F.coalesce(F.max("display_order"), F.lit(0)) + 1).alias("display_order"))


def set_members(members: DataFrame, substance_id: int, endorsement_ids: list[int]) -> DataFrame:
    """The substance's endorsements replaced."""
    mine = members.sparkSession.createDataFrame([(substance_id, e) for e in sorted(set(endorsement_ids))], "substance_id long, endorsement_id long")
    return members.where(F.col("substance_id") != substance_id).unionByName(mine)


def without_orphans(dimension: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Dimension rows that some reference names."""
    used = references[0].toDF(key)
    for r in references[1:]:
        used = used.union(r.toDF(key))
    return dimension.join(used, key, "left_semi")


def merged_entities(entities: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities whose names differ in case only as the one with the lowest id; of bridge rows that coincide the least position stays."""
    heads = entities.groupBy(F.lower("name").alias("n")).agg(F.min("id").alias("canonical"))
    mapping = entities.withColumn("n", F.lower("name")).join(heads, "n").select("id", "canonical")
    kept = entities.join(mapping.where("id = canonical").select("id"), "id", "left_semi")
    return kept, regrouped(bridge, mapping, "entity_id", ["record_id", "role"], "position")


def repaired_assumptions(records: DataFrame, snapshot: DataFrame) -> DataFrame:
    """ASSUMPTION applications without a business_name take name and applicants of a snapshot's row of the same natural key that has one; repaired says which.
    Applicants are never filled on their own."""
    natural = ["section_type", "record_date", "license_number", "application_type"]
    blank = F.coalesce(F.trim("business_name"), F.lit("")) == ""
    given = snapshot.where((F.col("application_type") == "ASSUMPTION") & ~blank).groupBy(*natural).agg(F.max(F.struct("business_name", "applicants")).alias("given"))
    both = records.join(given, natural, "left").withColumn("repaired", blank & F.col("given").isNotNull())
    fill = lambda c: F.when(F.col("repaired"), F.col("given")[c]).otherwise(F.col(c))
    return both.withColumns({c: fill(c) for c in ("business_name", "applicants")}).select(*records.columns, "repaired")


def repaired_moves(records: DataFrame, snapshot: DataFrame, locations: DataFrame) -> DataFrame:
    """CHANGE OF LOCATION records without a previous location take that of a snapshot's row of the same section, date and license."""
    key = ["section_type", "record_date", "license_number"]
    given = snapshot.where((F.col("application_type") == "CHANGE OF LOCATION") & (F.col("previous_business_location") != "")).select(*key, normalise_nbsp(F.col("previous_business_location")).alias("raw_address"))
    given = given.join(locations.select("raw_address", F.col("id").alias("given")), "raw_address").groupBy(*key).agg(F.min("given").alias("given"))
    both = records.join(given, key, "left")
    filled = F.when(F.col("application_type") == "CHANGE OF LOCATION", F.coalesce("previous_location_id", "given")).otherwise(F.col("previous_location_id"))
    return both.withColumn("repaired", ~filled.eqNullSafe(F.col("previous_location_id"))).withColumn("previous_location_id", filled).select(*records.columns, "repaired")


def durations(runs: DataFrame, number: int = 5) -> DataFrame:
    """(id, status, seconds) of the last runs."""
    seconds = F.round(F.unix_micros(F.col("finished_at").cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6).cast("long")
    return runs.orderBy(F.desc("id")).limit(number).select("id", "status", seconds.alias("seconds"))


def budget(attempts: DataFrame, now: Column, limit: int, at: str = "attempted_at") -> DataFrame:
    """(used, left) of a day's budget since midnight."""
    used = F.count_if(F.col(at) >= F.date_trunc("day", now))
    return attempts.agg(used.alias("used"), F.greatest(F.lit(0), F.lit(limit) - used).alias("left"))


def audit_page(log: DataFrame, filters: dict[str, str], since: str = "", until: str = "", number: int = 1, size: int = 50) -> DataFrame:
    """A page of the audit log, newest first, with its details read as a map; dates count whole days."""
    out = log
    for c, v in filters.items():
        out = out.where(F.col(c) == v) if v else out
    out = out.where(F.to_date("created_at") >= F.lit(since).cast("date")) if since else out
    out = out.where(F.to_date("created_at") <= F.lit(until).cast("date")) if until else out
    return out.withColumn("details", F.from_json("details", "map<string,string>")).orderBy(F.desc("id")).offset((number - 1) * size).limit(size)


def audited(log: DataFrame, action: DataFrame) -> DataFrame:
    """The log with actions (email, action, target_type, target_id, details map) appended as JSON, with ids that follow."""
    fresh = action.withColumn("details", F.to_json("details"))
    return log.unionByName(with_surrogate_keys(fresh, log, "id", [c for c in fresh.columns if c != "details"]), allowMissingColumns=True)


def latest_position(bridge: DataFrame) -> DataFrame:
    """Positions without gaps: rows of each record and role numbered from 0 in their order."""
    order = Window.partitionBy("record_id", "role").orderBy("position", "entity_id")
    return bridge.withColumn("position", F.row_number().over(order) - 1)


def members_of(members: DataFrame, substance_id: int) -> DataFrame:
    """(endorsement_id) of one substance."""
    return members.where(F.col("substance_id") == substance_id).select("endorsement_id")
