"""Pages and diffs as they come: character references, missing end tags, bare rows, records cut by hunks."""

import html as stdlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.sources import diffs, html

HEAD = "<table border='1'><tr><th colspan=2>STATEWIDE&nbsp;NEW LICENSE APPLICATIONS</th></tr>"


def records(spark, page):
    rows = html.records_of_pages(spark.createDataFrame([(1, page)], "k int, html string"), "k", "html").collect()
    return sorted(rows, key=lambda r: r.license_number)


def test_character_references_are_read_once(spark):
    cases = ["O&#39;BRIEN &quot;CAF&Eacute;&quot;", "&amp;lt;", "&lt;b&gt;", "A &amp B", "&#x1F600;&#8364", "&unknown; &", "&#0; &#xD800; &#99999999;", "&nbsp;x&nbsp;y", "&apos;", "&&amp;&", ""]
    want = ["O'BRIEN \"CAFÉ\"", "&lt;", "<b>", "A &amp B", "😀€", "&unknown; &", "&#0; &#xD800; &#99999999;", " x y", "'", "&&&", ""]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", S.unescaped(F.col("t")).alias("u"))
    assert [r.u for r in sorted(df.collect())] == want
    rng = random.Random(1)
    pieces = ["&amp;", "&eacute;", "&#233;", "&#xe9;", "a", " ", ";", "#", "&lt;", "é"]
    texts = ["".join(rng.choices(pieces, k=8)) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.unescaped(F.col("t")).alias("u")).collect()
    assert [r.u for r in sorted(got)] == [stdlib.unescape(t) for t in texts]


def test_text_is_that_of_trimmed_nodes(spark):
    cases = ["<b> A </b> &amp; <i>B</i>", "A  B\n C ", "&nbsp;A&nbsp;B&nbsp;", "x<br>y", '<a title="a > b">t</a>', "a < b", "<span title='\">'>q</span>", '<a href="open>z</a>']
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", html.text_of(F.col("t")).alias("u")).collect()
    assert [r.u for r in sorted(got)] == ["A&B", "A  B\n C", "A B", "xy", "t", "a < b", "q", "z"]


def test_records_of_pages_without_end_tags(spark):
    page = HEAD + "<tr><td><b>Notification Date:</b><td>6/5/2025<tr><td>Business Name:<td>O&#39;BRIEN &quot;CAF&Eacute;&quot;<TR><TD>License Number:<TD>080123<tr><td>Application Type:<td>RENEWAL</table><table><tr><th>OTHER<tr><td>License Number:<td>9</table>"
    (r,) = records(spark, page)
    assert (r.section_type, r.record_date, r.business_name, r.license_number, r.application_type) == ("new_application", "2025-06-05", "O'BRIEN \"CAFÉ\"", "080123", "RENEWAL")
    whole = page.replace("<tr>", "</td></tr>\n<tr>")
    assert [tuple(x) for x in records(spark, whole)] == [tuple(r)]


def test_rows_of_other_than_two_cells_and_comments_say_nothing(spark):
    page = HEAD + "<tbody><tr><td>Notification Date:</td><td>6/5/2025</td></tr><!-- <tr><td>License Number:</td><td>1</td></tr> --><tr><td>License Number:</td><td>2</td><td>x</td></tr><tr><td>License Number:</td></tr><tr><th>h</th><td>License Number:</td><td>3</td></tr><tr><td>Business Name:</td><td>A&nbsp;B</td></tr></tbody></table>"
    (r,) = records(spark, page)
    assert (r.license_number, r.business_name) == ("3", "A B")
    assert records(spark, None) == records(spark, "") == records(spark, "<table>") == records(spark, HEAD) == []


def test_a_long_page_is_read(spark):
    rows = "".join(f"<tr><td>Notification Date:</td><td>6/5/2025</td></tr><tr><td>License Number:</td><td>{i}</td></tr><tr><td a='{'x' * 50}'>Business Name:<td>N{i}" for i in range(3000))
    got = html.records_of_pages(spark.createDataFrame([(1, HEAD + rows)], "k int, html string"), "k", "html")
    assert got.count() == 3000 and got.where("business_name = 'N2999'").count() == 1
    assert html.records_of_pages(spark.createDataFrame([(1, HEAD + "<tr><td>" + '"' * 200_000 + "<td>x" + "<" * 200_000 + "&" * 200_000)], "k int, html string"), "k", "html").count() == 0


def diff(*lines, old="Tue, 06 Sep 2022 10:00:00 +0000", new="Wed, 07 Sep 2022 10:00:00 +0000"):
    return "\n".join([f"--- @\t{old}", f"+++ @\t{new}", "@@ -1,9 +1,9 @@", *lines])


ROW = "<tr><td>{}</td><td>{}</td></tr>"
DIFF = "path string, section string, content string"


def extracted(spark, *texts):
    df = spark.createDataFrame([(f"f{k}", "new_application", t) for k, t in enumerate(texts)], DIFF)
    got = diffs.extract_records(df, ["path", "section"], now=F.lit("2030-01-01").cast("timestamp"))
    return sorted((r.path, r.license_number, r.record_date, r.business_name, r.scraped_at.day) for r in got.collect())


def rows(op, day, number, name="A", kind="RENEWAL"):
    return [op + ROW.format("Notification Date:", day), op + ROW.format("Business Name:", name), op + ROW.format("Application Type:", kind), op + ROW.format("License Number:", number)]


def test_bare_rows_of_a_diff(spark):
    got = extracted(spark, diff(*rows("+", "6/5/2025", "1"), *rows("-", "6/4/2025", "2"), *rows("-", "6/5/2025", "1", "OLD")), None, "", "no diff at all")
    assert got == [("f0", "1", "2025-06-05", "A", 7), ("f0", "2", "2025-06-04", "A", 6)]  # the added side wins its natural key


def test_a_record_cut_by_a_hunk_is_read_with_what_stands_around(spark):
    cut = rows("+", "6/6/2025", "3", "B")
    cut[0] = " " + cut[0][1:]  # the date's row was there before
    got = extracted(spark, diff(*cut, "@@ -5 +5 @@", *rows("+", "6/5/2025", "1")), diff(*rows(" ", "6/7/2025", "4"), *rows("+", "6/5/2025", "5")))
    # the first diff is read again with context; the second is whole, so what did not change is no record of it
    assert got == [("f0", "1", "2025-06-05", "A", 7), ("f0", "3", "2025-06-06", "B", 7), ("f1", "5", "2025-06-05", "A", 7)]
    exits = rows("-", "6/6/2025", "3", "B")
    exits[2] = " " + exits[2][1:]
    assert extracted(spark, diff(*exits)) == [("f0", "3", "2025-06-06", "B", 6)]  # the new side has one of its rows only
    assert extracted(spark, diff(*cut[1:])) == []  # its date is nowhere


def test_a_time_that_cannot_be_read_is_that_of_reading(spark):
    assert extracted(spark, diff(*rows("+", "6/5/2025", "1"), new="yesterday")) == [("f0", "1", "2025-06-05", "A", 1)]


def test_the_viewer_groups_bare_and_wrapped_rows(spark):
    wrapped = ["+<tbody>", *rows("+", "6/5/2025", "1"), "+</tbody>", "+<tr><td>stray</td></tr>", "+</tbody>", "+<TBODY class=x>", *rows("+", "6/6/2025", "2"), "+</TBODY> <tbody>", "+<tbody>", *rows("+", "6/7/2025", "3")]
    bare = [*rows("-", "6/4/2025", "7"), *rows("-", "6/3/2025", "8", "Notification Date: in a name"), "-<tr><td><b>Notification Date:</b></td><td>6/2/2025</td></tr>", "-" + ROW.format("License Number:", "9"), "-" + ROW.format("Application Type:", "RENEWAL")]
    df = spark.createDataFrame([("f0", "new_application", diff(*wrapped, *bare)), ("f1", "new_application", diff("-before", *bare)), ("f2", "new_application", None)], DIFF)
    blocks = diffs.viewer_blocks(df, ["path", "section"]).orderBy("path", "side", "block_no").collect()
    numbers = lambda path, side: ["".join(n for n in "123789" if f"<td>License Number:</td><td>{n}</td>" in b.body) for b in blocks if (b.path, b.side) == (path, side)]
    assert numbers("f0", 0) == ["1", "2"] and numbers("f0", 1) == numbers("f1", 1) == ["7", "8", "9"]
    assert all(b.body.lower().startswith("<tbody") and b.body.lower().rstrip().split("</tbody>")[0] for b in blocks)
    wanted = spark.createDataFrame([("new_application", "2025-06-05", "1", "RENEWAL"), ("new_application", "2025-06-02", "9", "RENEWAL"), ("new_application", "2025-06-07", "3", "RENEWAL")], "section_type string, record_date string, license_number string, application_type string")
    got = sorted((r.path, r.license_number) for r in diffs.source_blocks_of_diffs(df, ["path", "section"], wanted).collect())
    assert got == [("f0", "1"), ("f0", "9"), ("f1", "9")]


@pytest.mark.parametrize("unclosed", [False, True])
def test_source_blocks_of_pages(spark, unclosed):
    block = lambda n: "<tbody><tr><td>Notification Date:</td><td>6/5/2025</td></tr><tr><td>License Number:</td><td>1</td></tr><tr><td>License Number:</td><td>%s</td></tr><tr><td>\\Application Type:</td><td>RENEWAL</td></tr></tbody>" % n
    page = HEAD + block(5) + block(6) + "</table>"
    page = page.replace("</tbody>", "").replace("</tr>", "") if unclosed else page
    parts = html.tables(spark.createDataFrame([(1, page), (2, page)], "k int, html string"), "k", "html").drop("table_no")
    wanted = spark.createDataFrame([("new_application", "2025-06-05", "6", "RENEWAL"), ("new_application", "2025-06-05", "1", "RENEWAL")], "section_type string, record_date string, license_number string, application_type string")
    got = html.source_blocks(parts, ["k", "section"], wanted).collect()
    assert [r.license_number for r in got] == ["6"] and got[0].html.endswith("</tbody>") and "<td>5</td>" not in got[0].html  # of a label twice the last counts
