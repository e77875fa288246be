"""Linking applications to outcomes by a bidirectional nearest-in-time match.

An application's forward match is the earliest outcome of the same key that is at most TOLERANCE_DAYS before it (no upper
bound; ties: lowest id); an outcome's backward match is the latest application at most TOLERANCE_DAYS after it (ties:
highest id). Mutual matches are ``high``, forward-only ones ``medium``. Both conditions are the same inequality, so
neither direction needs the pairs of a key: one union of both sides, partitioned by key and ordered by day, gives each
row its match from a running window, and a key's rows are read once, not squared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE_DAYS = 7


@dataclass(frozen=True)
class Mode:
    """Which sections and application types are linked: the outcome's section and the types' names on the other side."""

    outcome: str
    types: tuple[str, ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()


#: Application types by the outcome that ends them.
APPROVAL = Mode("approved", ("RENEWAL", "NEW APPLICATION", "ASSUMPTION", "ADDED/CHANGE OF CLASS", "CHANGE OF CORPORATE OFFICER", "CHANGE OF LOCATION", "RESUME BUSINESS", "IN LIEU"))
DISCONTINUANCE = Mode("discontinued", ("DISC. LIQUOR SALES",), (("DISC. LIQUOR SALES", "DISCONTINUED"),))

LINKABLE = APPROVAL.types + DISCONTINUANCE.types
#: What an application shares with its outcome.
KEYS = ["license_number", "kind"]
#: Days for which an application without outcome is pending, and from when on outcomes of which type are not published.
PENDING_DAYS, DATA_GAP, GAP_TYPE = 180, "2025-05-12", "NEW APPLICATION"


def link(applications: DataFrame, outcomes: DataFrame, keys: list[str], day: str = "day", id_: str = "id", tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """(new_app_id, outcome_id, confidence, days_gap) of two frames that share keys, an id and a date. Null keys link with nothing."""
    side = lambda df, app: df.select(*keys, F.col(id_).cast("long").alias("id"), F.col(day).alias("day"), F.lit(app).alias("app")).dropna(subset=[*keys, "day"])
    # an application is placed tolerance days early, so that "outcome >= application - tolerance" is an order of rows
    both = side(applications, True).unionByName(side(outcomes, False)).withColumn("at", F.when(F.col("app"), F.date_sub("day", tolerance)).otherwise(F.to_date("day")))
    # backward: the last application at or before the place; equal places: the highest id comes last
    behind = Window.partitionBy(*keys).orderBy(F.col("at").asc(), F.col("app").desc(), F.col("id").asc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("back", F.last(F.when(F.col("app"), F.col("id")), ignorenulls=True).over(behind))
    # forward: the first outcome at or after the place, with its own backward match; equal places: applications come first. The
    # order is read backwards, so that both windows run from the start of a key to the row before and grow by one row at a time
    ahead = Window.partitionBy(*keys).orderBy(F.col("at").desc(), F.col("app").asc(), F.col("id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("forward", F.last(F.when(~F.col("app"), F.struct("id", "day", "back")), ignorenulls=True).over(ahead))
    return seen.where(F.col("app") & F.col("forward").isNotNull()).select(
        F.col("id").alias("new_app_id"),
        F.col("forward.id").alias("outcome_id"),
        F.when(F.col("forward.back") == F.col("id"), "high").otherwise("medium").alias("confidence"),
        F.datediff("forward.day", "day").cast("long").alias("days_gap"),
    )


def sides(records: DataFrame, modes: tuple[Mode, ...] = (APPROVAL, DISCONTINUANCE)) -> DataFrame:
    """(license_number, kind, id, day, app) of records that can be linked: an application and its outcome have the same kind, the outcome's
    section and type, so all modes are one table. Rows without a license or date are left out, as they link with nothing."""
    section, type_ = F.col("section_type"), F.col("application_type")
    app = kind = F.lit(None)
    for mode in modes:
        names = dict(mode.renamed)
        for given in mode.types:
            ends = names.get(given, given)
            said = F.lit(f"{mode.outcome}:{ends}")
            kind = F.when((section == "new_application") & (type_ == given), said).when((section == mode.outcome) & (type_ == ends), said).otherwise(kind)
    app = section == "new_application"
    return records.select("license_number", kind.cast("string").alias("kind"), F.col("id").cast("long").alias("id"), F.to_date("record_date").alias("day"), app.alias("app")).dropna()


def link_records(records: DataFrame, *modes: Mode) -> DataFrame:
    """Links over licensing records (id, section_type, record_date, license_number, application_type) of some modes, or of all."""
    rows = sides(records, modes or (APPROVAL, DISCONTINUANCE))
    return link(rows.where("app"), rows.where("not app"), KEYS)


def build_all_links(records: DataFrame) -> DataFrame:
    """Both modes, as a full rebuild, in one pass over records."""
    return link_records(records)


def relink_touched(records: DataFrame, links: DataFrame, touched: DataFrame) -> DataFrame:
    """Incremental linking: links of the licenses in touched (license_number) are recomputed, the rest stay."""
    again = build_all_links(records.join(touched.select("license_number").distinct(), "license_number", "left_semi"))
    stale = records.join(touched.select("license_number").distinct(), "license_number", "left_semi").select(F.col("id").alias("new_app_id"))
    return links.join(stale, "new_app_id", "left_anti").unionByName(again)


def match_by_arrival(providers: DataFrame, queries: DataFrame, keys: list[str], ahead: bool) -> DataFrame:
    """queries (keys, arrival, at, ...) with found, a struct of day and id, or null: of the providers (keys, arrival, id, day) of the same key that
    arrived before, the first at or after ``at`` (ties: lowest id), or the last at or before it (ties: highest id). A null arrival is before all.

    Two orders meet here, of arrival and of time, so one running window does not do. Rows that arrive are numbered within
    their key; at each binary digit of these numbers blocks halve, and a query in a right half meets the providers of its left half: each
    earlier provider at exactly one digit. Within a half the order of time is a running window. A key with n arrivals has log2(n) digits.
    Providers without an arrival meet all queries at a step of their own.
    """
    fields = [c for c in queries.columns if c not in keys]
    mine = queries.withColumn("query", F.struct(*fields)).select(*keys, "arrival", "at", F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), "query")
    given = providers.select(*keys, "arrival", F.col("day").alias("at"), F.lit(0).alias("side"), F.col("id").cast("long").alias("id"))
    both = mine.unionByName(given, allowMissingColumns=True)
    # only rows that arrive are numbered; a row of a query stands before those that arrive with it
    numbered = both.where("arrival is not null").withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("arrival", F.desc("side"), "id")) - 1)
    numbered = numbered.withColumn("digits", F.length(F.bin(F.count("*").over(Window.partitionBy(*keys)) - 1)))
    steps = numbered.withColumn("digit", F.explode(F.expr("filter(sequence(0, digits - 1), k -> getbit(r, k) = side)"))).withColumn("block", F.expr("shiftright(r, digit + 1)"))
    old = both.where("arrival is null or side = 1").withColumns({"digit": F.lit(-1), "block": F.lit(0)})
    rows = steps.select(*keys, "digit", "block", "at", "side", "id", "query").unionByName(old.select(*keys, "digit", "block", "at", "side", "id", "query"))
    order = (F.col("at").desc(), F.col("side").asc(), F.col("id").desc()) if ahead else (F.col("at").asc(), F.col("side").asc(), F.col("id").asc())
    run = Window.partitionBy(*keys, "digit", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("found", F.last(F.when(F.col("side") == 0, F.struct(F.col("at").alias("day"), "id")), ignorenulls=True).over(run)).where("side = 1")
    best = F.min("found") if ahead else F.max("found")
    return seen.groupBy(*keys, "query").agg(best.alias("found")).select(*keys, "query.*", "found")


def link_new(records: DataFrame, links: DataFrame, fresh: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """Links that fresh records (id, and order if they did not arrive by id) add as they arrive one after the other; records has them, too.

    Each sees what was there and what arrived before it. An application takes its earliest outcome, an outcome its latest
    application; the link is high if the other side, at that time, would choose the same, else medium. Older links are not
    revised, and a pair that is linked already stays as it is. Only licenses of fresh records are read.
    """
    came = fresh.select(F.col("id").cast("long").alias("id"), (F.col("order") if "order" in fresh.columns else F.col("id")).cast("long").alias("arrival")).groupBy("id").agg(F.min("arrival").alias("arrival"))
    every = sides(records).join(came, "id", "left")
    touched = every.where("arrival is not null").select("license_number").distinct()
    every = every.join(touched, "license_number", "left_semi")
    apps, outcomes = every.where("app"), every.where("not app")
    shifted = lambda c, days: F.date_add(c, days)

    def found(side: DataFrame, other: DataFrame, ahead: bool) -> DataFrame:
        """Each arriving row of a side with the row of the other that it takes, and the row of its own side that this one would have taken before."""
        asked = side.where("arrival is not null").select(*KEYS, "arrival", shifted(F.col("day"), -tolerance if ahead else tolerance).alias("at"), F.struct("day", "id").alias("me"))
        taken = match_by_arrival(other, asked, KEYS, ahead).where("found is not null")
        back = taken.select(*KEYS, "arrival", shifted(F.col("found.day"), tolerance if ahead else -tolerance).alias("at"), "me", F.col("found").alias("it"))
        return match_by_arrival(side, back, KEYS, not ahead)

    forward, backward = found(apps, outcomes, True), found(outcomes, apps, False)
    high = lambda wins: F.when(F.col("found").isNull() | wins, "high").otherwise("medium").alias("confidence")
    gap = lambda app, outcome: F.datediff(F.col(f"{outcome}.day"), F.col(f"{app}.day")).cast("long").alias("days_gap")
    added = forward.select(F.col("me.id").alias("new_app_id"), F.col("it.id").alias("outcome_id"), high(F.col("found") < F.col("me")), gap("me", "it"))
    added = added.unionByName(backward.select(F.col("it.id").alias("new_app_id"), F.col("me.id").alias("outcome_id"), high(F.col("found") > F.col("me")), gap("it", "me")))
    return added.join(links.select("new_app_id", "outcome_id"), ["new_app_id", "outcome_id"], "left_anti")


def best_link(links: DataFrame, order: str = "outcome_id") -> DataFrame:
    """One link an application: the last one that is high, by order, else the first one."""
    row, high = F.struct("outcome_id", "confidence", "days_gap"), F.col("confidence") == "high"
    best = F.coalesce(F.max_by(F.when(high, row), F.when(high, F.col(order))), F.min_by(row, order))
    return links.groupBy("new_app_id").agg(best.alias("b")).select("new_app_id", "b.*")


def reverse_link(links: DataFrame) -> DataFrame:
    """One application an outcome: the lowest id."""
    return links.groupBy("outcome_id").agg(F.min("new_app_id").alias("new_app_id"))


def reverse_link_details(records: DataFrame, links: DataFrame) -> DataFrame:
    """(outcome_id, new_app_id, confidence, days_gap, new_app_date, new_app_business_name, new_app_type) of approved and discontinued
    records that some application led to; of several the lowest id."""
    ends = records.where(F.col("section_type").isin("approved", "discontinued")).select(F.col("id").alias("outcome_id"))
    first = links.join(ends, "outcome_id", "left_semi").groupBy("outcome_id").agg(F.min(F.struct("new_app_id", "confidence", "days_gap")).alias("l")).select("outcome_id", "l.*")
    apps = records.select(F.col("id").alias("new_app_id"), F.col("record_date").alias("new_app_date"), F.col("business_name").alias("new_app_business_name"), F.col("application_type").alias("new_app_type"))
    return first.join(apps, "new_app_id").select("outcome_id", "new_app_id", "confidence", "days_gap", "new_app_date", "new_app_business_name", "new_app_type")


def with_previous_location(records: DataFrame, links: DataFrame) -> DataFrame:
    """Copies an application's previous_location_id to its CHANGE OF LOCATION outcome where that is null."""
    given = links.join(records.select(F.col("id").alias("new_app_id"), F.col("previous_location_id").alias("p")), "new_app_id").where("p is not null").groupBy("outcome_id").agg(F.min("p").alias("p"))
    joined = records.join(given, records["id"] == given["outcome_id"], "left")
    filled = F.when(F.col("application_type") == "CHANGE OF LOCATION", F.coalesce("previous_location_id", "p")).otherwise(F.col("previous_location_id"))
    return joined.withColumn("previous_location_id", filled).select(*records.columns)


def not_published(kind: Column, day: Column) -> Column:
    """Outcomes that the source stopped to publish: of new applications after DATA_GAP."""
    return (kind == GAP_TYPE) & (F.to_date(day) > F.lit(DATA_GAP).cast("date"))


def outcome_status(section: Column, kind: Column, link_section: Column, day: Column, as_of: Column) -> Column:
    """approved, discontinued, data_gap, pending or unknown; null for what is no linkable application."""
    return (
        F.when((section != "new_application") | ~kind.isin(*LINKABLE), F.lit(None).cast("string"))
        .when(link_section.isin("approved", "discontinued"), link_section)
        .when(not_published(kind, day), "data_gap")
        .when(F.datediff(as_of, F.try_to_date(day.cast("string"), "yyyy-MM-dd")) <= PENDING_DAYS, "pending")
        .otherwise("unknown")
    )


def with_outcome(records: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """Adds the best link's outcome_id, confidence, days_gap, outcome_date and outcome_section, and outcome_status."""
    best = best_link(links).join(records.select(F.col("id").alias("outcome_id"), F.col("record_date").alias("outcome_date"), F.col("section_type").alias("outcome_section")), "outcome_id")
    out = records.join(best.withColumnRenamed("new_app_id", "id"), "id", "left")
    return out.withColumn("outcome_status", outcome_status(F.col("section_type"), F.col("application_type"), F.col("outcome_section"), F.col("record_date"), as_of))


def with_status(records: DataFrame, links: DataFrame, status: str, as_of: Column, outcomes: DataFrame | None = None) -> DataFrame:
    """Records of one outcome status; any other word filters nothing. Links are joined by id only. outcomes are all records, if these are but some."""
    new, day = F.col("section_type") == "new_application", F.to_date("record_date")
    if status in ("approved", "discontinued"):
        ends = (outcomes if outcomes is not None else records).where(F.col("section_type") == status).select(F.col("id").alias("outcome_id"))
        return records.join(links.join(ends, "outcome_id", "left_semi").select(F.col("new_app_id").alias("id")), "id", "left_semi")
    if status not in ("pending", "data_gap", "unknown"):
        return records
    free = records.where(new & F.col("application_type").isin(*LINKABLE)).join(links.select(F.col("new_app_id").alias("id")), "id", "left_anti")
    gap, recent = not_published(F.col("application_type"), day), day >= F.date_sub(as_of, PENDING_DAYS)
    return free.where({"pending": recent & ~gap, "data_gap": gap, "unknown": ~recent & ~gap}[status])
