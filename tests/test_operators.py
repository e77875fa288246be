"""Reference operators: linking edges, scalars, parsing, ingestion, streaming."""

import difflib

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import linking, records as R
from ledgerloom.plans import ingest
from ledgerloom.sources import diffs, html
from ledgerloom.streaming import jobs

RECORD = "id long, section_type string, record_date string, license_number string, application_type string"


def links_of(spark, rows, mode=linking.APPROVAL):
    got = linking.link_records(spark.createDataFrame(rows, RECORD), mode).collect()
    return sorted((r.new_app_id, r.outcome_id, r.confidence, r.days_gap) for r in got)


def app(i, day, kind="RENEWAL", number="1"):
    return (i, "new_application", day, number, kind)


def out(i, day, kind="RENEWAL", number="1", section="approved"):
    return (i, section, day, number, kind)


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([app(1, "2025-06-10"), out(2, "2025-06-03")], [(1, 2, "high", -7)]),
        ([app(1, "2025-06-10"), out(2, "2025-06-02")], []),
        ([app(1, "2025-06-10"), app(2, "2025-06-10"), out(3, "2025-06-12"), out(4, "2025-06-12")], [(1, 3, "medium", 2), (2, 3, "high", 2)]),
        ([app(1, "2025-01-01"), app(2, "2025-02-01"), out(3, "2025-03-01")], [(1, 3, "medium", 59), (2, 3, "high", 28)]),
        ([app(1, "2020-01-01"), out(2, "2025-01-01")], [(1, 2, "high", 1827)]),
        ([app(1, "2025-01-01", "ASSUMPTION"), out(2, "2025-01-02", "RENEWAL")], []),
        ([app(1, "2025-01-01", "SOMETHING"), out(2, "2025-01-02", "SOMETHING")], []),
        ([app(1, None), (2, "approved", "2025-01-01", None, "RENEWAL")], []),
    ],
)
def test_link_edges(spark, rows, expected):
    assert links_of(spark, rows) == expected


def test_link_discontinuance(spark):
    rows = [app(1, "2025-01-01", "DISC. LIQUOR SALES"), out(2, "2025-01-20", "DISCONTINUED", section="discontinued")]
    assert links_of(spark, rows, linking.DISCONTINUANCE) == [(1, 2, "high", 19)]


def test_scalars(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("o")).first().o
    assert one(S.clean_name, "  acme\u00a0 widgets , inc. ") == "ACME WIDGETS , INC."
    assert one(S.clean_name, "acme co.,") == "ACME CO."
    assert one(S.clean_name, "jane doe.") == "JANE DOE"
    assert one(S.clean_list, "A; a ;;B.") == "A; B"
    assert one(S.clean_list, None) is None
    assert one(S.applicants, "ACME; JOHN DOE; JOHN DOE; ") == ["JOHN DOE"]
    assert one(S.iso_date, "6/5/2025") == "2025-06-05"
    assert one(S.iso_date, " no date ") == "no date"
    assert one(S.phone, "2065550100") == "(206) 555-0100"
    assert one(S.slug, " A & B, Co. ") == "a-b-co"
    assert tuple(one(S.city_state_zip, "1 MAIN ST, SEATTLE, WA 98101")) == ("SEATTLE", "WA", "98101")
    assert tuple(one(S.city_state_zip, "1 MAIN ST, STE 2, ST. JOHN, WA 99171-1234 USA")) == ("ST. JOHN", "WA", "99171-1234")
    assert tuple(one(S.city_state_zip, "1 MAIN ST, SEATTLE, WA")) == ("SEATTLE", "WA", "")
    assert tuple(one(S.city_state_zip, "nowhere")) == ("", "WA", "")
    assert [tuple(x) for x in one(S.license_types, "349,")] == [("349", None)]
    assert [tuple(x) for x in one(S.license_types, "450, Grocery")] == [("450", "GROCERY")]
    assert [tuple(x) for x in one(S.license_types, "a; b")] == [(None, "A"), (None, "B")]
    assert one(S.entity_type, "ACME LLC") == "organization" and one(S.entity_type, "JOHN DOE") == "person"
    assert one(S.entity_type, "GREEN PARTNERS") == one(S.entity_type, "A LIMITED") == "organization" and one(S.entity_type, "acme llc") == "person"
    assert one(S.has_additional_names, "A; ADDTIONAL NAMES ON FILE") and not one(S.has_additional_names, "AND ADDITIONAL NAMES") and not one(S.has_additional_names, None)
    assert one(S.clean_name, "F.O.E.") == "F.O.E." and one(S.clean_name, "A INC..") == "A INC." and one(S.clean_name, "BERAKI .,") == "BERAKI"
    assert one(S.section_label, "approved") == "Approved" and one(S.section_label, "x") == "x" and one(S.section_of_file, "2022-approvals-diff.txt") == "approved"
    assert one(S.code_of, "450,") == one(S.code_of, "450, GROCERY") == "450" and one(S.code_of, "GROCERY") is None
    assert one(S.similarity_tokens, "Take Out - Beer+Wine Endorsement, to-go") == ["TAKEOUT", "MINUS", "BEER", "PLUS", "WINE", "TO-GO"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("ADAM (DUPLICATE) BENTON", "ADAM BENTON"),
        ("NEALY DUPLICATE EVANS", "NEALY EVANS"),
        ("KATIE (DUPLICATE 2) DAVIS", "KATIE DAVIS"),
        ("PAUL *DUPLICATE* SONG", "PAUL SONG"),
        ("DUPLICATE ITALIAN SUPPLY, LLC", "ITALIAN SUPPLY, LLC"),
        ("JAY WON (DUPLICATE)", "JAY WON"),
        ("ELIZABETH (DUPLICATE A MATTHEWS", "ELIZABETH A MATTHEWS"),
    ],
)
def test_duplicate_marks(spark, given, expected):
    assert spark.createDataFrame([(given,)], "v string").select(S.strip_duplicate_marker(F.col("v")).alias("o")).first().o == expected


def test_outcomes_not_published_any_more(spark):
    rows = [(1, "new_application", "2025-05-12", "1", "NEW APPLICATION"), (2, "new_application", "2025-05-13", "2", "NEW APPLICATION"), (3, "new_application", "2025-05-13", "3", "RESUME BUSINESS"), (4, "new_application", "2024-01-01", "4", "DISC. LIQUOR SALES"), (5, "approved", "2024-01-01", "5", "RENEWAL"), (6, "new_application", "2025-05-13", "6", "OTHER")]
    records = spark.createDataFrame(rows, RECORD)
    day = F.lit("2025-06-01").cast("date")
    links = linking.build_all_links(records)
    got = {r.id: r.outcome_status for r in linking.with_outcome(records, links, day).collect()}
    assert got == {1: "pending", 2: "data_gap", 3: "pending", 4: "unknown", 5: None, 6: None}
    for status in ("pending", "data_gap", "unknown"):
        assert {r.id for r in linking.with_status(records, links, status, day).collect()} == {i for i, s in got.items() if s == status}
    assert linking.with_status(records, links, "no such status", day).count() == 6


def test_a_hot_key_links_in_linear_time(spark):
    import time

    n = 40_000
    rows = spark.range(n).select(F.col("id"), F.when(F.col("id") % 2 == 0, "new_application").otherwise("approved").alias("section_type"), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 9000).cast("int")), "yyyy-MM-dd").alias("record_date"), F.lit("1").alias("license_number"), F.lit("RENEWAL").alias("application_type"))
    began = time.time()
    assert linking.link_records(rows).count() > n // 4
    assert time.time() - began < 30


def test_incremental_links_leave_older_ones(spark):
    rows = [app(1, "2025-01-01"), out(3, "2025-02-01"), app(2, "2025-01-20")]
    records = spark.createDataFrame(rows, RECORD)
    old = linking.link_records(records.where("id <> 2"))
    assert [tuple(r) for r in old.select("new_app_id", "outcome_id", "confidence").collect()] == [(1, 3, "high")]
    added = linking.link_new(records, old, records.where("id = 2").select("id")).collect()
    assert [(r.new_app_id, r.outcome_id, r.confidence) for r in added] == [(2, 3, "high")]


def page(*records, heading="STATEWIDE&nbsp;NEW LICENSE APPLICATIONS"):
    rows = "".join(f"<tbody>{''.join(f'<tr><td>{a}:</td><td>{b}</td></tr>' for a, b in r)}</tbody>" for r in records)
    return f"<table><tr><th>{heading}</th></tr>{rows}</table><table><tr><th>Other</th></tr><tr><td>x</td><td>y</td></tr></table>"


def test_html_records(spark):
    first = [("Notification Date", "6/5/2025"), ("Business Name", "<b>ACME &amp; CO</b>"), (r"\Application Type", "RENEWAL"), ("License Number", "080123")]
    second = [("Notification Date", "6/6/2025"), ("Business Name", "NO NUMBER")]
    got = html.records_of_pages(spark.createDataFrame([(1, page(first, second)), (2, None), (3, ""), (4, page(first, heading="NEW LICENSE APPLICATIONS"))], "k int, html string"), "k", "html").collect()
    assert [(r.k, r.section_type, r.record_date, r.business_name, r.application_type, r.license_number, r.state, r.previous_state) for r in got] == [(1, "new_application", "2025-06-05", "ACME & CO", "RENEWAL", "080123", "WA", "")]


def test_a_record_begins_where_a_field_changes(spark):
    undated = [("License Number", "1"), ("Business Name", "A"), ("New Business Location", "1 MAIN ST, SEATTLE, WA 98101"), ("Current Business Location", "2 MAIN ST, TACOMA, WA")]
    hybrid = [("Notification Date", "6/5/2025"), ("Business Name", "B"), ("License Number", "2"), ("License Number", "2"), ("Business Name", "C"), ("License Number", "3"), ("Contact Phone", "1")]
    got = html.records_of_pages(spark.createDataFrame([(1, page(undated, hybrid))], "k int, html string"), "k", "html").orderBy("license_number").collect()
    assert [(r.license_number, r.business_name, r.record_date, r.city, r.previous_city, r.contact_phone) for r in got] == [("1", "A", "", "SEATTLE", "TACOMA", ""), ("2", "B", "2025-06-05", "", "", ""), ("3", "C", "", "", "", "1")]


def test_packed_files_shadow_plain_ones(spark, tmp_path):
    import gzip

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "2025_06_05-a.html").write_bytes("plain é".encode())
    (tmp_path / "d" / "2025_06_05-a.html.gz").write_bytes(gzip.compress("packed é\nline".encode("latin-1")))
    (tmp_path / "d" / "b.html").write_bytes("caf\xe9".encode("latin-1"))
    got = {r.path.rsplit("/", 1)[1]: (r.html, r.day) for r in html.read_pages(spark, str(tmp_path)).withColumn("day", html.snapshot_date(F.col("path")).cast("date").cast("string")).collect()}
    assert got == {"2025_06_05-a.html.gz": ("packed é\nline", "2025-06-05"), "b.html": ("café", None)}
    assert html.read_files(spark, str(tmp_path), "b.html", strict=True).first().text is None


def chain(states):
    """Diffs of three lines of context between pages that are lists of (number, name); a page is a list of blocks."""
    block = lambda number, name: ["<tbody>", "<tr><td>Notification Date:</td><td>6/5/2025</td></tr>", f"<tr><td>Business Name:</td><td>{name}</td></tr>", "<tr><td>Contact Phone:</td><td>1</td></tr>", "<tr><td>Application Type:</td><td>RENEWAL</td></tr>", f"<tr><td>License Number:</td><td>{number}</td></tr>", "</tbody>"]
    pages = [[x for r in state for x in block(*r)] for state in states]
    return ["\n".join(["--- @\tTue, 06 Sep 2022 10:00:00 +0000", "+++ @\tTue, 06 Sep 2022 10:00:00 +0000", *list(difflib.unified_diff(x, y, lineterm=""))[2:]]) for x, y in zip(pages, pages[1:])]


def test_diff_replay(spark):
    start = [(i, f"N{i}") for i in range(12)]
    states = [start]
    states.append([(100, "NEW"), *states[-1]])  # an entry
    states.append([r if r[0] != 5 else (5, "RENAMED") for r in states[-1]])  # a change in place
    states.append([r for r in states[-1] if r[0] != 7])  # an exit
    rows = [("new_application", k, c) for k, c in enumerate(chain(states))]
    rows += [("approved", 0, "error page"), ("approved", 1, None), ("discontinued", 0, chain(states)[0][:-30])]
    replayed = diffs.replay(spark.createDataFrame(rows, "section string, seq long, content string")).cache()
    files = {(r.section, r.seq): r for r in replayed.where("origin = 'file'").collect()}
    assert len(files) == 6 and not any(r.reset or r.mismatches for r in files.values()) and files["approved", 1].n_lines == 0
    assert 0 < files["new_application", 2].n_known < files["new_application", 2].n_lines <= 12 * 7
    found = {(r.license_number, r.business_name): r.origin for r in diffs.records_of_replay(replayed).collect()}
    assert found["100", "NEW"] == "entry" and ("5", "RENAMED") not in found  # its block is never shown whole
    cut = diffs.lines(spark.createDataFrame(rows, "section string, seq long, content string"), ["section", "seq"])
    assert any("<tr><td>License Number:</td><td>7</td></tr>" in r.lines for r in diffs.runs(cut, ["section", "seq"]).collect())


def test_replay_knows_earlier_what_a_later_file_shows():
    import pandas as pd

    start = [(i, f"N{i}") for i in range(4)]
    rename = lambda state, number, name: [r if r[0] != number else (number, name) for r in state]
    states = [start, rename(start, 1, "A"), [r for r in rename(start, 1, "A") if r[0] != 1], [(9, "N"), *[r for r in rename(start, 1, "A") if r[0] != 1]]]
    got = diffs._replay(pd.DataFrame([("s", k, c) for k, c in enumerate(chain(states))], columns=["section", "seq", "content"]))
    shown = [(o, "".join(x)) for o, x in zip(got["origin"], got["lines"]) if o != "file"]
    assert any(o in ("state", "mutation") and "<td>N1</td>" in x and "License Number:</td><td>1<" in x for o, x in shown)  # the exit shows the lines that the rename left out
    assert any("<td>A</td>" in x for _, x in shown) and any(o == "entry" and "<td>9<" in x for o, x in shown)


def test_replay_starts_anew_where_a_chain_breaks():
    import pandas as pd

    a, b = [(i, f"N{i}") for i in range(40)], [(1000 + i, f"M{i}") for i in range(40)]
    remove = lambda state: [[], state, state[:-1]]
    rows = [("s", k, c) for k, c in enumerate([*chain(remove(a)), *chain([b, [(r[0], r[1] + "x") for r in b]])])]
    got = diffs._replay(pd.DataFrame(rows, columns=["section", "seq", "content"]))
    files = got[got["origin"] == "file"]
    assert files["reset"].tolist() == [False, False, True]
    assert sum("M" in "".join(x) for x in got.loc[got["origin"] != "file", "lines"]) >= 39


def test_records_of_diffs(spark):
    block = lambda day, number: ["<tbody>", f"<tr><td>Approved Date:</td><td>{day}</td></tr>", "<tr><td>Application Type:</td><td>RENEWAL</td></tr>", f"<tr><td>License Number:</td><td>{number}</td></tr>", "</tbody>"]
    old, new = block("6/5/2025", 1) + ["tail"], block("6/6/2025", 2) + block("6/7/2025", 3) + ["tail"]
    head = ["--- @\tTue, 06 Sep 2022 10:00:00 +0000", "+++ @\tWed, 07 Sep 2022 10:00:00 +0000"]
    text = "\n".join([*head, *list(difflib.unified_diff(old, new, lineterm="", n=0))[2:]])
    cut = "\n".join([*head, "@@ -1,3 +1,9 @@", " x"])
    df = spark.createDataFrame([("f1", "approved", text), ("f2", "approved", text), ("f3", "approved", "error page"), ("f4", "approved", cut), ("f5", "approved", None)], "path string, section string, content string")
    assert {(r.path, r.hunks, r.truncated) for r in diffs.truncated(df, ["path"]).collect()} >= {("f4", 0, True)}
    assert {r.path: (r.old_ts.day, r.new_ts.day) for r in diffs.headers(df, ["path"]).collect()} == {k: (6, 7) for k in ("f1", "f2", "f4")}
    got = diffs.records_of_diffs(df, ["path", "section"]).collect()
    assert {(r.path, r.license_number) for r in got} <= {("f1", "1"), ("f1", "2"), ("f1", "3")} and all("</tbody>" in r.html for r in got)


def test_ingest_is_idempotent(spark):
    schema = "section_type string, record_date string, license_number string, application_type string, scraped_at string"
    batch = spark.createDataFrame([("approved", "2025-01-01", str(i % 3), None, f"t{i}") for i in range(6)], schema)
    none = batch.limit(0).withColumn("id", F.lit(0).cast("long"))
    fresh, roles = ingest.ingest_batch(batch, none)
    assert sorted(r.id for r in fresh.collect()) == [1, 2, 3] and roles.where("role = 'first_seen'").count() == 3
    again, _ = ingest.ingest_batch(batch, fresh)
    assert again.count() == 0


def test_alias_upsert_and_chain(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2)], "variant int, target int")
    changed = R.alias_upsert(edges, spark.createDataFrame([(3, 1), (1, 1)], "variant int, target int"))
    assert sorted(map(tuple, changed.collect())) == [(2, 1), (3, 1)]
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert sorted(map(tuple, R.canonical(edges, nodes).collect())) == [(1, 1), (2, 1), (3, 1)]


def test_stream_takes_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (1, "2025-01-02 00:00:00"), (2, "2025-01-01 00:00:00")], "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = jobs.first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "t")
    jobs.run_batches(stream, lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_backfills(spark, tmp_path):
    import gzip

    from ledgerloom.plans import backfill

    record = lambda day, number: [("Notification Date", day), ("Business Name", "A"), ("Application Type", "RENEWAL"), ("License Number", number)]
    for name, records in (("2025_06_06-v1", [record("6/5/2025", "1"), record("6/5/2025", "2")]), ("2025_06_05-v1", [record("6/5/2025", "1"), record("no date", "9")])):
        (tmp_path / "pages" / name).mkdir(parents=True)
        (tmp_path / "pages" / name / f"{name}.html.gz").write_bytes(gzip.compress(page(*records).encode()))
    seen = backfill.of_snapshots(html.read_pages(spark, str(tmp_path / "pages"))).collect()
    assert sorted((r.license_number, str(r.captured_at.date()), r.role) for r in seen) == [("1", "2025-06-05", "first_seen"), ("1", "2025-06-06", "confirmed"), ("2", "2025-06-06", "first_seen")]

    block = [x for r in (record("6/7/2025", "7"),) for x in ["<tbody>", *[f"<tr><td>{a}:</td><td>{b}</td></tr>" for a, b in r], "</tbody>"]]
    text = "\n".join(["--- @\tTue, 06 Sep 2022 10:00:00 +0000", "+++ @\tWed, 07 Sep 2022 10:00:00 +0000", f"@@ -0,0 +1,{len(block)} @@", *["+" + x for x in block]])
    (tmp_path / "archive" / "notifications").mkdir(parents=True)
    for name in ("2022_09_07-00_15_00-notifications-diff.txt", "2022_09_06-00_15_00-notifications-diff.txt", "2022_09_06-00_15_00-other.txt"):
        (tmp_path / "archive" / "notifications" / name).write_text(text)
    found = backfill.folders(spark, str(tmp_path / "archive"), S.SECTION_FOLDERS)
    assert [f.rsplit("/", 1)[1] for f in found] == ["notifications"] and backfill.folders(spark, str(tmp_path / "archive"), S.SECTION_FOLDERS, "approved") == []
    files = html.read_files(spark, found[0], "*.txt", strict=True)
    got = backfill.of_diffs(files)
    assert [(r.license_number, r.record_date, r.path.rsplit("/", 1)[1][:10]) for r in got.collect()] == [("7", "2025-06-07", "2022_09_06")]
    assert [r.records for r in backfill.by_file(got).collect()] == [1] and diffs.work(files, F.col("path"), limit=1).count() == 1

    records = got.select("section_type", "record_date", "license_number", "application_type").withColumn("id", F.lit(5))
    made = backfill.extracts(got, records)
    assert [(r.record_id, r.path) for r in made.collect()] == [(5, "new-application/2025-06-07/7/renewal.html")]
    assert tuple(backfill.extract_counts(got, records.limit(0)).first()) == (0, 1, 0)
    backfill.write_extracts(made, str(tmp_path / "extracts"))
    assert backfill.read_extract(spark, str(tmp_path / "extracts"), "new-application/2025-06-07/7/renewal.html").first().html == "\n".join(block) + "\n"
    assert backfill.read_extract(spark, str(tmp_path / "extracts"), "none").count() == 0


def test_steps_fail_alone(spark):
    df = spark.range(3)
    got = ingest.enriched(df, {"good": lambda d: d.where("id > 0"), "bad": lambda d: d.select(F.raise_error(F.lit("no"))), "worse": lambda d: d.select("missing")})
    assert got["good"][0].count() == 2 and got["bad"][0] is None and got["bad"][1] and got["worse"][0] is None


def test_similar_names_without_common_words(spark):
    from ledgerloom.functions import scalars

    names = ["BEER + WINE", "BEER - WINE", "BEER WINE SHOP", "WINE BEER SHOP", "THE SHOP ENDORSEMENT", "SHOP", "TAKE OUT", "TAKEOUT", "A", ""]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {(r.a, r.b): r.score for r in R.similar_pairs(df, S.similarity_tokens(F.col("name")), S.blended_similarity, 0.7).collect()}
    every = df.alias("x").join(df.alias("y"), F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), scalars.blended_similarity(S.similarity_tokens(F.col("x.name")), S.similarity_tokens(F.col("y.name"))).alias("score")).where("score >= 0.7")
    assert got == {(r.a, r.b): r.score for r in every.collect()} and (4, 5) in got and (0, 1) not in got


def test_english_stems(spark):
    from ledgerloom.operators import text

    pairs = "caresses caress ponies poni ties tie cats cat gas gas this this agreed agre feed feed plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi cry cri by by say say relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal hopefulness hope callousness callous triplicate triplic formative format electrical electr goodness good revival reviv allowance allow inference infer adjustment adjust adoption adopt probate probat rate rate cease ceas controlling control roll roll generously generous knightly knight consigned consign dying die news news inning inning succeed succeed skies sky communication communic widgets widget beautiful beauti analogy analog easily easili".split()
    words, expected = pairs[::2], pairs[1::2]
    df = spark.createDataFrame([([w],) for w in words], "w array<string>").select("w", text.stems(F.col("w")).alias("s"))
    assert {r.w[0]: r.s[0] for r in df.collect()} == dict(zip(words, expected, strict=True))
    assert text.lexemes(F.lit("the and of")) is not None and spark.range(1).select(text.lexemes(F.lit("The Widgets and widget")).alias("x")).first().x == ["widget"]


def test_export_rows_and_versions(spark):
    from ledgerloom.sources import sinks

    got = sinks.export_rows(spark.createDataFrame([("approved", None, 0), ("x", "A", 3)], "section_type string, business_name string, days_to_outcome int"))
    assert got.columns == sinks.EXPORT_COLUMNS and len(got.columns) == 30
    assert [(r.section_type, r.business_name, r.days_to_outcome, r.city) for r in got.collect()] == [("approved", "", "", ""), ("x", "A", "3", "")]
    pages = spark.createDataFrame([("2025-01-01", 2), ("2025-01-01", 1), ("2025-01-02", 3)], "day string, captured_at int")
    assert sorted((r.day, r.captured_at, r.version) for r in sinks.versioned(pages, spark.createDataFrame([("2025-01-01", 4)], "date string, version int")).collect()) == [("2025-01-01", 1, 5), ("2025-01-01", 2, 6), ("2025-01-02", 3, 1)]
