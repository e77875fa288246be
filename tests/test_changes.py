"""Operations that change several tables: code registration, address results, batches, the archive of extracts, the repairing backfill."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import dimensions as D
from ledgerloom.plans import backfill, batches

NATURAL = "section_type string, record_date string, license_number string, application_type string"


def tables(spark, records, endorsements=(), codes=()):
    return (
        spark.createDataFrame(list(records), "id long, license_type string"),
        spark.createDataFrame(list(endorsements), "id long, name string"),
        spark.createDataFrame(list(codes), "code string, endorsement_id long"),
    )


def named(bridge, endorsements):
    return sorted((r.record_id, r.name) for r in bridge.join(endorsements.withColumnRenamed("id", "endorsement_id"), "endorsement_id").select("record_id", "name").collect())


def test_the_first_record_names_a_code(spark):
    r, e, c = tables(spark, [(1, "777, First Name"), (2, "777,"), (3, "777, OTHER NAME"), (4, "888,"), (5, "888, LATE NAME"), (6, "450, X"), (7, "snack bar; Cafe;"), (8, None), (9, ""), (10, "999")], [(1, "ONE"), (2, "TWO")], [("450", 1), ("450", 2)])
    more, codes = D.registered(r, c, e)
    assert named(D.endorsement_bridge(r, codes, more), more) == [(1, "FIRST NAME"), (2, "FIRST NAME"), (3, "FIRST NAME"), (4, "888"), (5, "888"), (6, "ONE"), (6, "TWO"), (7, "CAFE"), (7, "SNACK BAR"), (10, "999")]
    again, codes2 = D.registered(r.where("id > 1"), codes, more)  # a later batch resolves to what is there
    assert again.count() == more.count() and codes2.count() == codes.count()
    none, no_codes = D.registered(r.limit(0), c, e)
    assert none.count() == 2 and no_codes.count() == 2


def test_codes_change_with_their_records(spark):
    r, e, c = tables(spark, [(1, "450,"), (2, "450, X"), (3, "460,"), (4, "CAFE")], [(1, "ONE"), (2, "TWO"), (3, "CAFE")], [("450", 1), ("460", 2)])
    bridge = D.endorsement_bridge(r, c, e)
    aliases = spark.createDataFrame([(1, 3)], "endorsement_id long, canonical_endorsement_id long")
    done = spark.createDataFrame([(1, "endorsements", 1, "t1"), (3, "endorsements", 1, "t1")], "record_id long, step string, version int, done_at string")
    log = spark.createDataFrame([(7, "x", "old", "t", 1, "{}")], "id long, email string, action string, target_type string, target_id long, details string")
    got = D.code_changed(r, bridge, c, e, aliases, done, log, " 450 ", "me@x.org", F.lit("t2"), add=(2, 1), remove=(3,))
    assert named(got["bridge"], got["endorsements"]) == [(1, "ONE"), (1, "TWO"), (2, "ONE"), (2, "TWO"), (3, "TWO"), (4, "CAFE")]
    assert sorted(map(tuple, got["resolved"].collect())) == [(1, "CAFE; TWO"), (2, "CAFE; TWO")]
    assert sorted(map(tuple, got["done"].collect())) == [(1, "endorsements", 2, "t2"), (2, "endorsements", 2, "t2"), (3, "endorsements", 1, "t1")]
    assert [tuple(x)[:5] for x in got["log"].where("id > 7").collect()] == [(8, "me@x.org", "endorsement.code_add", "endorsement", 2)]
    less = D.code_changed(r, got["bridge"], got["codes"], e, aliases, got["done"], log, "450", "me@x.org", F.lit("t3"), remove=(1,))
    assert named(less["bridge"], e) == [(1, "TWO"), (2, "TWO"), (3, "TWO"), (4, "CAFE")]
    same = D.code_changed(r, bridge, c, e, aliases, done, log, "450", "me@x.org", F.lit("t2"), add=(1,))
    assert sorted(map(tuple, same["bridge"].collect())) == sorted(map(tuple, bridge.collect())) and same["log"].count() == 1 and same["resolved"].count() == 0
    with pytest.raises(ValueError):
        D.code_changed(r, bridge, c, e, aliases, done, log, "  ", "me", F.lit("t"))

    free = D.unaliased(r, bridge, c, e, aliases, done, log, 1, "me@x.org", F.lit("t4"))
    assert free["aliases"].count() == 0 and sorted(map(tuple, free["resolved"].collect())) == [(1, "ONE"), (2, "ONE")]
    (entry,) = free["log"].where("id = 8").collect()
    assert entry.action == "endorsement.remove_alias" and '"records_reprocessed":"2"' in entry.details and '"canonical_name":"CAFE"' in entry.details
    for unknown in (2, 99):
        with pytest.raises(ValueError):
            D.unaliased(r, bridge, c, e, aliases, done, log, unknown, "me", F.lit("t"))


def test_learned_names_take_a_placeholder(spark):
    bridge = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "record_id long, endorsement_id long")
    codes = spark.createDataFrame([("450", 1)], "code string, endorsement_id long")
    e = spark.createDataFrame([(1, "450"), (2, "GROCERY")], "id long, name string")
    learned = spark.createDataFrame([("450", "Grocery", 0), ("450", "Tobacco", 1), ("460", "Cafe", 0)], "code string, name string, place int")
    links, all_codes, more = D.learned_merge(bridge, codes, e, learned)
    assert named(links, more) == [(1, "GROCERY"), (1, "TOBACCO"), (2, "GROCERY"), (2, "TOBACCO"), (3, "GROCERY"), (3, "TOBACCO")]
    assert sorted((x.code, x.name) for x in all_codes.join(more.withColumnRenamed("id", "endorsement_id"), "endorsement_id").collect()) == [("450", "GROCERY"), ("450", "TOBACCO"), ("460", "CAFE")]
    assert "450" not in {x.name for x in more.collect()}


RESULT = "location_id long, at timestamp_ntz, mode string, status string, dpv_match_code string, address_line_1 string, address_line_2 string, city string, region string, postal_code string, country string, validated string, latitude double, longitude double"
PLACE = "id long, raw_address string, std_address_line_1 string, std_address_line_2 string, std_city string, std_region string, std_postal_code string, std_country string, std_address_string string, validation_status string, dpv_match_code string, latitude double, longitude double, address_standardized_at timestamp_ntz, address_validated_at timestamp_ntz, address_validation_attempted_at timestamp_ntz"


def test_address_results_overlay_only_what_they_confirm(spark):
    day = lambda d: datetime.datetime(2025, 1, d)
    result = lambda k, d, status, city=None, mode="validate": (k, day(d), mode, status, f"D{d}", "1 MAIN", None, city, "WA", "98101", "us" if city else "USA", f"all {city}", 1.5, 2.5)
    place = lambda k, raw="1 Main St": (k, raw, *["old"] * 7, "pending", None, None, None, None, None, None)
    locations = spark.createDataFrame([place(1), place(2), place(3, " "), place(4), place(5), place(6, None), place(7)], PLACE)
    results = spark.createDataFrame([result(1, 1, "confirmed", "A"), result(1, 2, "not_confirmed", "B"), result(2, 1, "unavailable", "C"), result(3, 1, "confirmed", "D"), result(4, 3, "confirmed_bad_secondary", "E"), result(4, 2, "confirmed", "F"), result(5, 1, None, "G"), result(6, 1, "confirmed", "H"), result(7, 1, "whatever", "I", "standardize"), result(99, 1, "confirmed", "J")], RESULT)
    merged = D.merged_validations(locations, results)
    got = {r.id: r for r in merged.collect()}
    shown = lambda r: (r.std_city, r.validation_status, r.dpv_match_code, r.address_standardized_at and r.address_standardized_at.day, r.address_validated_at and r.address_validated_at.day, r.address_validation_attempted_at and r.address_validation_attempted_at.day, r.latitude)
    assert shown(got[1]) == ("A", "not_confirmed", "D2", 1, 1, 2, 1.5)  # what was confirmed stays, the attempt is recorded
    assert shown(got[2]) == ("old", "unavailable", "D1", None, None, 1, None)
    assert shown(got[4]) == ("E", "confirmed_bad_secondary", "D3", 3, 3, 3, 1.5)
    for k in (3, 5, 6):
        assert shown(got[k]) == ("old", "pending", None, None, None, None, None)
    assert shown(got[7]) == ("I", "standardized", None, 1, None, None, None)
    assert (got[1].std_address_line_2, got[1].std_country, got[1].std_address_string) == ("", "us", "all A") and len(got) == 7
    assert sorted(map(tuple, D.merged_validations(merged, results).collect()), key=str) == sorted(map(tuple, merged.collect()), key=str)


RECORDS = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("section_type", "record_date", "license_number", "application_type", "license_type", "scraped_at"))])


def parsed(spark, *numbers, license_type="CAFE"):
    return spark.createDataFrame([("approved", "2025-01-01" if n is not None else "someday", str(n), "RENEWAL", license_type, f"t{k}") for k, n in enumerate(numbers)], f"{NATURAL}, license_type string, scraped_at string")


def test_a_batch_that_dies_between_two_tables_runs_again(spark, tmp_path):
    into = batches.store(spark, f"{tmp_path}/s", RECORDS, {"names": T.StructType.fromDDL("record_id long, name string"), "lengths": T.StructType.fromDDL("record_id long, n int")})
    names = lambda rows, _: rows.select(F.col("id").alias("record_id"), F.col("license_type").alias("name"))
    lengths = lambda rows, _: rows.select(F.col("id").alias("record_id"), F.length("license_number").alias("n"))
    steps = {"names": (1, names), "lengths": (1, lengths)}
    assert batches.run_batch(parsed(spark, 1, 2, 2, None), 0, into, steps, source_id=5)
    assert [tuple(r) for r in into.batches().collect()] == [(0, 2, 1, 1)] and into.read("rejected").count() == 1

    class Killed(BaseException):
        pass

    def killed(rows, store):
        rows.count()
        raise Killed

    with pytest.raises(Killed):  # the first step's table is written, the second is not
        batches.run_batch(parsed(spark, 2, 3), 1, into, {"names": (1, names), "lengths": (1, killed)}, source_id=6)
    assert into.read("records").count() == into.read("names").count() == 2 and into.batches().count() == 1
    assert batches.run_batch(parsed(spark, 2, 3), 1, into, steps, source_id=6)
    assert not batches.run_batch(parsed(spark, 2, 3), 1, into, steps, source_id=6)  # it counts already
    assert sorted((r.license_number, r.id) for r in into.read("records").collect())[2][1] == 3 and into.read("records").count() == 3
    assert into.read("names").count() == into.read("lengths").count() == 3 and into.read("done").count() == 6 and into.read("failed").count() == 0
    assert sorted((r.source_id, r.role) for r in into.read("record_sources").collect()) == [(5, "first_seen"), (5, "first_seen"), (6, "confirmed"), (6, "first_seen")]


def test_bad_rows_of_a_step_are_set_aside_and_done_later(spark, tmp_path):
    into = batches.store(spark, f"{tmp_path}/s", RECORDS, {"numbers": T.StructType.fromDDL("record_id long, n int")})
    strict = lambda rows, _: rows.select(F.col("id").alias("record_id"), F.when(F.col("license_number").isin("7", "13"), F.raise_error(F.lit("unlucky"))).otherwise(F.length("license_number")).cast("int").alias("n"))
    broken = lambda rows, _: rows.select("nothing of this name")
    batches.run_batch(parsed(spark, *range(20)), 0, into, {"numbers": (1, strict)})
    assert into.read("numbers").count() == 18 and into.read("done").count() == 18
    failed = {r.record_id: r.error for r in into.read("failed").collect()}
    bad = {r.id for r in into.read("records").where("license_number in ('7', '13')").collect()}
    assert set(failed) == bad and all("unlucky" in e for e in failed.values())
    batches.run_batch(parsed(spark, 50), 1, into, {"numbers": (1, broken)})
    assert into.read("records").count() == 21 and into.read("failed").where("batch = 1").count() == 1
    mended = lambda rows, _: rows.select(F.col("id").alias("record_id"), F.length("license_number").alias("n"))
    batches.run_batch(parsed(spark), 2, into, {"numbers": (1, mended)}, catch_up=True)
    assert into.read("numbers").count() == 21 == into.read("done").count()
    batches.run_batch(parsed(spark), 3, into, {"numbers": (2, lambda rows, _: mended(rows, _).withColumn("n", F.lit(0)))}, catch_up=True)
    assert batches.versions(into, "numbers", ["record_id"]).where("n = 0").count() == 21 == batches.versions(into, "numbers", ["record_id"]).count()


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    from ledgerloom.streaming import jobs

    schema = f"{NATURAL}, license_type string, scraped_at string"
    parsed(spark, 1, 2, 2).write.parquet(f"{tmp_path}/in")
    into = batches.store(spark, f"{tmp_path}/s", RECORDS, {})
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    jobs.run_batches(stream(), lambda df, n: batches.run_batch(df, n, into, {}), f"{tmp_path}/c").awaitTermination()
    parsed(spark, 2, 3).write.mode("append").parquet(f"{tmp_path}/in")
    jobs.run_batches(stream(), lambda df, n: batches.run_batch(df, n, into, {}), f"{tmp_path}/c").awaitTermination()
    jobs.run_batches(stream(), lambda df, n: batches.run_batch(df, n, into, {}), f"{tmp_path}/c2").awaitTermination()  # a lost checkpoint: its numbers count already
    assert sorted(tuple(r) for r in into.batches().collect()) == [(0, 2, 1, 0), (1, 1, 1, 0)] and into.read("records").count() == 3


def test_the_archive_writes_only_buckets_that_change(spark, tmp_path):
    from pathlib import Path

    found = lambda pairs: spark.createDataFrame([("approved", "2025-01-01", n, "RENEWAL", h) for n, h in pairs], f"{NATURAL}, html string")
    records = spark.createDataFrame([(k, "approved", "2025-01-01", n, "RENEWAL") for k, n in enumerate(["a b", "a-b", *map(str, range(40))])], f"id long, {NATURAL}")
    folder = f"{tmp_path}/archive"
    run = lambda pairs, k: dict(map(tuple, backfill.archive_extracts(found(pairs), records, folder, f"{tmp_path}/scratch{k}", 16).collect()))
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}
    first = [(str(i), f"x{i}") for i in range(40)]
    assert run([*first, ("a-b", "second"), ("none", "?")], 1) == {"new": 41, "unmatched": 1}
    before = files()
    assert run(first, 2) == {"unchanged": 40} and files() == before
    assert run([*first[1:], ("0", "changed"), ("a b", "late")], 3) == {"unchanged": 39, "changed": 1, "collision": 1}
    after = files()
    assert len(set(before) - set(after)) == 1 and len(after) == len(before)
    assert spark.read.parquet(folder).count() == 41
    get = lambda n: [r.html for r in backfill.archived(spark, folder, f"approved/2025-01-01/{n}/renewal.html", 16).collect()]
    assert (get("0"), get("1"), get("a-b"), get("99")) == (["changed"], ["x1"], ["second"], [])


def snapshot(*blocks):
    rows = "".join("<tbody>" + "".join(f"<tr><td>{a}:</td><td>{b}</td></tr>" for a, b in block) + "</tbody>" for block in blocks)
    return f"<table><tr><th>STATEWIDE NEW LICENSE APPLICATIONS</th></tr>{rows}</table>"


def test_the_backfill_repairs_from_the_earliest_later_snapshot(spark):
    block = lambda number, kind, name="", before="", day="6/5/2025": [("Notification Date", day), ("New Business Name", name), ("New Applicant(s)", f"{name}; JO"), ("Current Business Location", before), ("Application Type", kind), ("License Number", number)]
    pages = [
        ("p1", snapshot(block("1", "ASSUMPTION"), block("2", "CHANGE OF LOCATION", "B"), block("3", "RENEWAL", ""), block("9", "RENEWAL", "Z", day="some day"))),
        ("p2", snapshot(block("1", "ASSUMPTION"), block("1", "ASSUMPTION", "late name."), block("4", "RENEWAL", "D"))),
        ("p3", snapshot(block("1", "ASSUMPTION", "LATER"), block("2", "CHANGE OF LOCATION", "B", "1 OLD ST"), block("3", "RENEWAL", "C"), block("5", "ASSUMPTION", "GIVEN"))),
        ("p4", None),
        ("p5", "<table><tr><th>OTHER</th></tr></table>"),
    ]
    old = spark.createDataFrame([("new_application", "2025-06-05", "5", "ASSUMPTION", "", None, None), ("new_application", "2025-06-05", "4", "RENEWAL", "D", "", None), ("approved", "2025-01-01", "8", "ASSUMPTION", "", "", None)], f"{NATURAL}, business_name string, applicants string, previous_location string")
    got = backfill.snapshot_backfill(spark.createDataFrame(pages, "path string, html string"), old)
    records = {r.license_number: (r.business_name, r.applicants, r.previous_location, r.inserted, r.repaired) for r in got["records"].collect()}
    assert records == {"1": ("LATE NAME", "LATE NAME; JO", None, True, True), "2": ("B", "B; JO", "1 OLD ST", True, True), "3": ("", "JO", None, True, False), "4": ("D", "", None, False, False), "5": ("GIVEN", "GIVEN; JO", None, False, True), "8": ("", "", None, False, False)}
    assert sorted((r.path, r.license_number, r.role) for r in got["evidence"].collect()) == sorted([("p1", "1", "first_seen"), ("p1", "2", "first_seen"), ("p1", "3", "first_seen"), ("p2", "1", "confirmed"), ("p2", "1", "repaired"), ("p2", "4", "confirmed"), ("p3", "1", "confirmed"), ("p3", "2", "confirmed"), ("p3", "2", "repaired"), ("p3", "3", "confirmed"), ("p3", "5", "confirmed"), ("p3", "5", "repaired")])
    assert sorted(map(tuple, got["counts"].collect())) == [("p1", 3, 0, 0), ("p2", 0, 3, 1), ("p3", 0, 4, 2)]
    assert sorted(map(tuple, got["bad"].collect())) == [("p4", "not readable"), ("p5", "no section")]
