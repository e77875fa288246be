"""Faults that a reviewer found on larger tables and odd rows, each as a small case."""

import re

from pyspark.sql import functions as F

from ledgerloom import catalog, licensing
from ledgerloom.functions import scalars as S
from ledgerloom.operators import dimensions as D
from ledgerloom.operators import records as R
from ledgerloom.operators import search, text, trigrams
from ledgerloom.plans import backfill
from ledgerloom.sources import diffs, html

NATURAL = "section_type string, record_date string, license_number string, application_type string"


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k: plan.count(k) for k in ("BroadcastHashJoin", "SortMergeJoin")}


def test_names_to_search_are_not_broadcast(spark, tmp_path):
    """A file of names may be small where their trigrams are not."""
    spark.createDataFrame([(1, "red widget"), (2, "blue ring")], "id long, name string").write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")  # with the size of its file, as Spark takes other frames for large
    queries = spark.createDataFrame([(7, "red widgets")], "query_id long, query string")
    found = trigrams.resembling(names, queries)
    assert joins(found)["SortMergeJoin"] >= 2, joins(found)
    assert [(r.query_id, r.id) for r in found.collect()] == [(7, 1)]


def test_address_parts_of_numbers_with_more_digits_than_a_zip(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (0, 1, 2, 89997, 90000, 1200003)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: (r.city, r.state, r.zip) for r in catalog.queries()["address_parts"](spark, str(tmp_path)).collect()}
    walla = "WALLA WALLA", "OR"
    assert got == {0: (*walla, "10000"), 1: (*walla, ""), 2: ("", "WA", ""), 89997: (*walla, "99997"), 90000: (*walla, "100000"), 1200003: (*walla, "1210003")}


def test_applicants_alone_are_no_repair(spark):
    key = ("new_application", "2025-06-05", "1", "ASSUMPTION")
    schema = f"id long, {NATURAL}, business_name string, applicants string"
    records = spark.createDataFrame([(1, *key, "OWN", ""), (2, *key, "", "X"), (3, *key, None, None), (4, *key[:2], "2", key[3], "", "")], schema)
    snapshot = spark.createDataFrame([(1, *key, "A", "A; JO"), (2, *key, "", "Z; LAST"), (3, *key[:2], "2", key[3], " ", "B")], schema)
    got = {r.id: (r.business_name, r.applicants, r.repaired) for r in D.repaired_assumptions(records, snapshot).collect()}
    assert got == {1: ("OWN", "", False), 2: ("A", "A; JO", True), 3: ("A", "A; JO", True), 4: ("", "", False)}


def steps(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(f"{name} ")


def test_pages_and_diffs_are_read_within_their_rows(spark):
    """No cell or line of them is shuffled; records of diffs meet once, by key."""
    pages = spark.createDataFrame([(1, "<table>")], "k int, html string")
    assert steps(html.records_of_pages(pages, "k", "html"), "Exchange") == 0
    files = spark.createDataFrame([("f", "approved", "x")], "path string, section string, content string")
    assert steps(diffs.records_of_diffs(files, ["path", "section"]), "Exchange") == 1
    assert steps(diffs.extract_records(files, ["path", "section"]), "Exchange") == 1


def test_a_backfill_reads_its_pages_once(spark):
    pages = spark.createDataFrame([("p", "<table>")], "path string, html string")
    old = spark.createDataFrame([], f"{NATURAL}, business_name string, applicants string, previous_location string")
    got = backfill.snapshot_backfill(pages, old)
    # the key's window and the rows that exist; the counts ask for sections, too
    assert steps(got["records"], "Generate") == 2 and steps(got["counts"], "Generate") == 4


def tasks(df):
    """In how many tasks the rows come out; a session's own number of partitions, here 4, bounds what is not dealt out."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_linked_sources_are_dealt_out(spark):
    sources = spark.range(2000).select(F.col("id").alias("record_id"), F.lit(1).alias("source_id"), F.lit("confirmed").alias("role"))
    both = D.linked_sources(sources, sources.withColumn("source_id", F.lit(0)).union(sources))
    assert both.count() == 4000 and tasks(both) > 50


def test_order_tables_are_dealt_out(spark):
    licenses = licensing.Licensing(spark, "/root/testdata/sf0.001")
    for name in ("record_sources", "record_entities", "record_endorsements"):
        assert tasks(licenses[name]) > 50, name


def test_merged_bridges_are_dealt_out(spark):
    bridge = spark.range(2000).select(F.col("id").alias("record_id"), (F.col("id") % 5).alias("entity_id"), F.lit("applicant").alias("role"), F.lit(3).alias("position"))
    entities = spark.createDataFrame([(k, f"{'abcdd'[k]}") for k in range(4)] + [(4, "D")], "id long, name string")
    merged = D.merged_entities(entities, bridge.union(bridge.withColumn("position", F.lit(2))))[1]
    assert merged.where("position = 2").count() == 2000 and merged.where("entity_id = 4").count() == 0 and tasks(merged) > 50


def test_words_of_similar_names_are_dealt_out_and_not_broadcast(spark, tmp_path):
    spark.range(2000).select("id", F.concat(F.lit("SHOP "), (F.col("id") / 2).cast("int"), F.lit(" AT HOME"), F.col("id")).alias("name")).coalesce(1).write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")
    found = R.similar_pairs(names, S.similarity_tokens(F.col("name")), S.blended_similarity, 0.2)
    assert joins(found)["BroadcastHashJoin"] == 0, joins(found)
    assert tasks(found) > 50


def test_records_without_a_previous_location_do_not_meet_in_one_task(spark):
    records = spark.range(2000).select("id", (F.col("id") % 50).alias("location_id"), F.when(F.col("id") < 2, F.col("id") + 50).alias("previous_location_id"))
    places = spark.range(52).select("id", F.when(F.col("id") == 51, "OR").otherwise("WA").alias("state"), F.lit("X").alias("city"), F.lit("").alias("std_region"), F.lit("").alias("std_city"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = search.in_place(records, places, "WA", "X")
        assert found.count() == 2000 and tasks(found) == 4
        assert [r.id for r in search.in_place(records, places, "OR").collect()] == [1]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_documents_are_dealt_out_and_filtered_after(spark, tmp_path):
    spark.range(2000).select("id", F.lit("the red widgets").alias("name")).coalesce(1).write.parquet(f"{tmp_path}/names")
    found = text.ranked(text.with_document(spark.read.parquet(f"{tmp_path}/names"), [("A", F.col("name"))]), "doc", "widget red")
    assert found.count() == 2000 and tasks(found) > 50


def largest_method(spark, df):
    """Bytes of the largest generated method; the JVM leaves methods over 8,000 bytes to its interpreter."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode)))


def test_records_of_pages_are_compiled_by_the_jvm(spark):
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        pages = spark.range(1).select("id", F.concat(F.lit("<table>"), "id").alias("html"))
        assert largest_method(spark, html.records_of_pages(pages, "id", "html")) < 7500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_a_fragments_rows_are_cut_at_single_characters(spark):
    """A split compiles its pattern for every text, so none may stand where rows and cells are cut."""
    df = spark.createDataFrame([("x",)], "b string").select(html._rows_of(F.col("b")).alias("r"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r", (\S*), -1\)", plan) and not [x for x in re.findall(r", (\S*), -1\)", plan) if len(x) > 1]


def test_marks_in_a_text_stay_as_they_are(spark):
    text = "a\x01b\x02c\x03d\x04e\x04a<i>\x03x</i>&#1;\x04<b\x01>"
    body = f"<tr><td\x01><td>{text}<td title='\x02<tr'>v\x01</td\x02></tr\x04></td>\x01<tr\x01>n"
    (r,) = spark.createDataFrame([(body,)], "b string").select(html._rows_of(F.col("b")).alias("r"), html.text_of(F.col("b")).alias("t")).collect()
    said = text.replace("<i>", "").replace("</i>", "").replace("<b\x01>", "").replace("&#1;", "\x01")
    assert [tuple(x) for x in r.r] == [(0, said, "v\x01")], r.r
    assert r.t == said + "v\x01\x01n"
