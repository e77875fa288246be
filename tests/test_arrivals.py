"""Links of records that arrive one after the other: the batch form and the stream against a plain replay."""

import random
from datetime import date, timedelta

import pytest

from ledgerloom.operators import linking
from ledgerloom.streaming import jobs

RECORD = "id long, section_type string, record_date string, license_number string, application_type string"
LINK = "new_app_id long, outcome_id long, confidence string, days_gap long"


def replay(base: list[tuple], fresh: list[tuple]) -> list[tuple]:
    """Each fresh record looks for its link among all that came before."""
    day = lambda r: date.fromisoformat(r[2])
    week, there, out = timedelta(days=7), list(base), []

    def same(app, o):
        kind = ("discontinued", "DISCONTINUED") if app[4] == "DISC. LIQUOR SALES" else ("approved", app[4])
        return app[1] == "new_application" and app[4] in linking.LINKABLE and app[3] == o[3] and (o[1], o[4]) == kind

    for me in fresh:
        there.append(me)
        outcomes = lambda app: sorted((day(o), o[0], o) for o in there if same(app, o) and day(o) >= day(app) - week)
        apps = lambda o: sorted((day(a), a[0], a) for a in there if same(a, o) and day(a) <= day(o) + week)
        if me[1] == "new_application":
            if found := outcomes(me):
                o = found[0][2]
                out.append((me[0], o[0], "high" if apps(o)[-1][2] == me else "medium", (day(o) - day(me)).days))
        elif found := apps(me):
            a = found[-1][2]
            out.append((a[0], me[0], "high" if outcomes(a)[0][2] == me else "medium", (day(me) - day(a)).days))
    return sorted(out)


def cases(seed: int, n: int, licenses: int) -> list[tuple]:
    rng = random.Random(seed)
    kinds = [("new_application", "RENEWAL"), ("approved", "RENEWAL"), ("new_application", "DISC. LIQUOR SALES"), ("discontinued", "DISCONTINUED"), ("new_application", "OTHER"), ("approved", "DISCONTINUED"), ("new_application", "IN LIEU"), ("approved", "IN LIEU")]
    rows = []
    for i in range(n):
        section, kind = rng.choice(kinds)
        rows.append((i, section, str(date(2025, 1, 1) + timedelta(days=rng.randrange(40))), f"L{rng.randrange(licenses)}", kind))
    return rows


@pytest.mark.parametrize(("seed", "licenses"), [(1, 1), (2, 6), (3, 40)])
def test_links_equal_a_replay(spark, seed, licenses):
    rows = cases(seed, 240, licenses)
    base, fresh = rows[:120], rows[120:]
    records, none = spark.createDataFrame(rows, RECORD), spark.createDataFrame([], LINK)
    got = linking.link_new(records, none, spark.createDataFrame([(r[0],) for r in fresh], "id long"))
    assert sorted(map(tuple, got.collect())) == replay(base, fresh)
    shuffled = list(fresh)
    random.Random(seed).shuffle(shuffled)  # an order of arrival that is not that of ids
    order = spark.createDataFrame([(r[0], k) for k, r in enumerate(shuffled)], "id long, order long")
    assert sorted(map(tuple, linking.link_new(records, none, order).collect())) == replay(base, shuffled)


def test_a_late_outcome_gets_a_medium_link_and_old_links_stay(spark):
    rows = [(1, "new_application", "2025-01-10", "7", "RENEWAL"), (2, "approved", "2025-02-01", "7", "RENEWAL"), (3, "approved", "2025-03-01", "7", "RENEWAL")]
    records = spark.createDataFrame(rows, RECORD)
    links = linking.link_records(records.where("id < 3"))
    assert [tuple(r) for r in links.collect()] == [(1, 2, "high", 22)]
    fresh = spark.createDataFrame([(3,)], "id long")
    assert [tuple(r) for r in linking.link_new(records, links, fresh).collect()] == [(1, 3, "medium", 50)]
    again = links.unionByName(linking.link_new(records, links, fresh))
    assert linking.link_new(records, again, fresh).count() == 0  # a pair that is there stays as it is
    assert linking.link_new(records, links, fresh.limit(0)).count() == 0


def test_records_without_license_date_or_kind_link_with_nothing(spark):
    rows = [(1, "new_application", None, "7", "RENEWAL"), (2, "approved", "2025-02-01", None, "RENEWAL"), (3, "approved", "2025-02-01", "7", None), (4, None, "2025-02-01", "7", "RENEWAL")]
    records = spark.createDataFrame(rows, RECORD)
    assert linking.link_new(records, spark.createDataFrame([], LINK), records.select("id")).count() == 0 and linking.build_all_links(records).count() == 0


def test_many_arrivals_of_one_license(spark):
    """Forty thousand arrivals of one key: each row stands at 16 digits, no pairs are formed."""
    n = 40_000
    rows = spark.range(n).selectExpr("id", "case when id % 2 = 0 then 'new_application' else 'approved' end section_type", "cast(date_add(date'2000-01-01', cast(id * 7919 % 9000 as int)) as string) record_date", "'L' license_number", "'RENEWAL' application_type")
    got = linking.link_new(rows, spark.createDataFrame([], LINK), rows.select("id"))
    assert got.count() > n // 2


def test_the_stream_equals_the_batches(spark, tmp_path):
    rows = cases(5, 200, 12)
    parts = [rows[:50], rows[50:51], rows[51:130], rows[130:]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={k}")
        stream = spark.readStream.schema(RECORD).parquet(f"{tmp_path}/in/part=*")
        run = jobs.linked(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("new_app_id", "outcome_id", "confidence", "days_gap").collect()))
    assert got == replay([], rows)
