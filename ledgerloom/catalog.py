"""Every reference query bound to the test tables, with the SQL that states its result.

Orders stand for license records (O an application, F approved, P discontinued), customers and nations for locations,
line items for bridges to parts (endorsements) and suppliers (entities), events for natural-key duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import linking, records as R
from .operators import text as X
from .operators import trigrams
from .plans import ingest
from .registry import QUERIES, SQL, Query, Tables, query as _query

AS_OF = "2001-01-01"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_KEYS = ["o_custkey", "o_orderpriority"]


def _links(t: Tables, outcome: str = "F") -> DataFrame:
    side = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(*_KEYS, F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"))
    return linking.link(side("O"), side(outcome), _KEYS)


def _link_sql(outcome: str = "F") -> str:
    return f"""with fwd as (select na, oid from (select n.o_orderkey na, o.o_orderkey oid, row_number() over (partition by n.o_orderkey order by o.o_orderdate, o.o_orderkey) rn from orders n join orders o on o.o_custkey = n.o_custkey and o.o_orderpriority = n.o_orderpriority and o.o_orderdate >= n.o_orderdate - interval 7 days where n.o_orderstatus = 'O' and o.o_orderstatus = '{outcome}') where rn = 1),
bwd as (select oid, bna from (select o.o_orderkey oid, n.o_orderkey bna, row_number() over (partition by o.o_orderkey order by n.o_orderdate desc, n.o_orderkey desc) rn from orders n join orders o on o.o_custkey = n.o_custkey and o.o_orderpriority = n.o_orderpriority and n.o_orderdate <= o.o_orderdate + interval 7 days where n.o_orderstatus = 'O' and o.o_orderstatus = '{outcome}') where rn = 1),
links as (select fwd.na new_app_id, fwd.oid outcome_id, case when bna = fwd.na then 'high' else 'medium' end confidence, date_diff('day', n.o_orderdate, o.o_orderdate) days_gap from fwd join bwd using (oid) join orders n on n.o_orderkey = fwd.na join orders o on o.o_orderkey = fwd.oid) """


_query("link_bidirectional", _link_sql() + "select * from links")(_links)
_query("link_discontinuance", _link_sql("P") + "select * from links")(lambda t: _links(t, "P"))


@_query("link_gap_histogram", _link_sql() + "select confidence, least(greatest(days_gap // 30, -1), 24) bucket, count(*) n from links group by all")
def _(t: Tables) -> DataFrame:
    bucket = F.least(F.greatest(F.floor((F.col("days_gap") - F.pmod("days_gap", F.lit(30))) / 30 + F.when((F.col("days_gap") < 0) & (F.pmod("days_gap", F.lit(30)) != 0), 1).otherwise(0)), F.lit(-1)), F.lit(24))
    return _links(t).groupBy("confidence", bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@_query("best_link", _link_sql() + "select new_app_id, outcome_id, confidence, days_gap from links qualify row_number() over (partition by new_app_id order by confidence, outcome_id) = 1")
def _(t: Tables) -> DataFrame:
    return linking.best_link(_links(t))


@_query("reverse_link", _link_sql() + "select outcome_id, min(new_app_id) new_app_id from links group by outcome_id")
def _(t: Tables) -> DataFrame:
    return linking.reverse_link(_links(t))


@_query("funnel", _link_sql() + "select count(*) filter (o_orderstatus = 'O') total, count(l.new_app_id) approved, count(*) filter (o_orderstatus = 'O' and l.new_app_id is null and o_orderdate >= timestamp '1998-01-01') pending, count(*) filter (o_orderstatus = 'O' and l.new_app_id is null and o_orderdate < timestamp '1998-01-01') unknown_ from orders o left join links l on l.new_app_id = o.o_orderkey")
def _(t: Tables) -> DataFrame:
    o = t.orders.join(_links(t).select("new_app_id"), F.col("o_orderkey") == F.col("new_app_id"), "left")
    app, free, late = F.col("o_orderstatus") == "O", F.col("new_app_id").isNull(), F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return o.agg(F.count_if(app).alias("total"), F.count("new_app_id").alias("approved"), F.count_if(app & free & late).alias("pending"), F.count_if(app & free & ~late).alias("unknown_"))


@_query("stats_conditional", "select count(*) total, count(*) filter (o_orderstatus = 'O') n_new, count(*) filter (o_orderstatus = 'F') n_approved, count(*) filter (o_orderstatus = 'P') n_discontinued, min(o_orderdate) mn, max(o_orderdate) mx, count(distinct o_custkey) licenses, (select count(*) from supplier) entities from orders")
def _(t: Tables) -> DataFrame:
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    entities = t.supplier.agg(F.count("*")).scalar()
    return t.orders.agg(F.count("*").alias("total"), status("O").alias("n_new"), status("F").alias("n_approved"), status("P").alias("n_discontinued"), F.min("o_orderdate").alias("mn"), F.max("o_orderdate").alias("mx"), F.countDistinct("o_custkey").alias("licenses")).withColumn("entities", entities)


@_query("search_facets_page", "select o.o_orderkey, o.o_orderdate, c.c_name, coalesce(n.n_name, '') city from orders o left join customer c on c.c_custkey = o.o_custkey left join nation n on n.n_nationkey = c.c_nationkey where o.o_orderstatus = 'O' and o.o_orderkey in (select l_orderkey from lineitem where l_partkey between 5 and 10) and o.o_orderdate >= timestamp '1996-01-01' order by o.o_orderdate desc, o.o_orderkey desc limit 20 offset 20")
def _(t: Tables) -> DataFrame:
    wanted = t.lineitem.where(F.col("l_partkey").between(5, 10)).select(F.col("l_orderkey").alias("o_orderkey"))
    hits = R.filtered(t.orders, {"o_orderstatus": "O"}, ("o_orderdate", "1996-01-01", None), (wanted, "o_orderkey"))
    top = R.page(hits, [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, 20)  # the page first, then the joins
    places = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return top.join(places, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "o_orderdate", "c_name", F.coalesce("n_name", F.lit("")).alias("city"))


@_query("search_count", "select count(*) total from orders where o_orderstatus = 'O' and o_orderkey in (select l_orderkey from lineitem where l_partkey between 5 and 10)")
def _(t: Tables) -> DataFrame:
    wanted = t.lineitem.where(F.col("l_partkey").between(5, 10)).select(F.col("l_orderkey").alias("o_orderkey"))
    return R.filtered(t.orders, {"o_orderstatus": "O"}, linked=(wanted, "o_orderkey")).agg(F.count("*").alias("total"))


@_query("hydrate_page", "with p as (select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 50) select o_orderkey, o_orderdate, coalesce((select string_agg(p_name, '; ' order by p_name) from lineitem join part on p_partkey = l_partkey where l_orderkey = o_orderkey), '') endorsements from p")
def _(t: Tables) -> DataFrame:
    top = R.page(t.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 1, 50)
    return R.hydrated(top, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")), t.part, "o_orderkey", "p_partkey", "p_name", "endorsements")


@_query("export_flat", _link_sql() + ", e as (select l_orderkey, string_agg(p_name, '; ' order by p_name) names from lineitem join part on p_partkey = l_partkey group by l_orderkey) select o_orderkey, o_orderstatus, c_name, coalesce(n_name, '') city, coalesce(names, '') endorsements, days_gap, outcome_id from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join e on l_orderkey = o_orderkey left join links on new_app_id = o_orderkey")
def _(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    names = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy("l_orderkey").agg(F.expr("listagg(p_name, '; ') within group (order by p_name)").alias("names"))
    out = rows.join(names, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(linking.best_link(_links(t)), F.col("new_app_id") == F.col("o_orderkey"), "left")
    return out.select("o_orderkey", "o_orderstatus", "c_name", F.coalesce("n_name", F.lit("")).alias("city"), F.coalesce("names", F.lit("")).alias("endorsements"), "days_gap", "outcome_id")


@_query("state_city_filter", "select o_orderkey from orders where exists (select 1 from customer join nation on n_nationkey = c_nationkey where c_custkey = o_custkey and n_regionkey = 1) or exists (select 1 from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey where l_orderkey = o_orderkey and l_linenumber = 1 and n_regionkey = 1)")
def _(t: Tables) -> DataFrame:
    near = t.nation.where("n_regionkey = 1").select("n_nationkey")
    current = t.orders.join(t.customer.join(near, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")
    previous = t.lineitem.where("l_linenumber = 1").join(t.supplier.join(near, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(current.union(previous).distinct(), "o_orderkey", "left_semi")


_query("anti_not_exists", "select count(*) n from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)")(lambda t: t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("n")))
_query("orphans", "select n_nationkey from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9800 union select s_nationkey from supplier where s_acctbal > 9000)")(
    lambda t: R.orphans(t.nation, "n_nationkey", t.customer.where("c_acctbal > 9800").select("c_nationkey"), t.supplier.where("s_acctbal > 9000").select("s_nationkey")).select("n_nationkey")
)
_query("broken_fks", "select 'customer' fk, count(*) n from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0) union all select 'part', count(*) from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_size > 5)")(
    lambda t: t.orders.join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.lit("customer").alias("fk"), F.count("*").alias("n")).unionByName(t.lineitem.join(t.part.where("p_size > 5"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").agg(F.lit("part").alias("fk"), F.count("*").alias("n")))
)
_query("having_duplicates", "select upper(p_name) name, count(*) cnt, min(p_partkey) canonical_id from part group by upper(p_name) having count(*) > 1")(lambda t: R.duplicates(t.part, F.upper("p_name"), "p_partkey"))
_query("entity_counts", "select s_suppkey, s_name, count(l_orderkey) record_count from supplier left join (select * from lineitem where l_quantity > 45) l on l_suppkey = s_suppkey group by s_suppkey, s_name")(
    lambda t: t.supplier.join(t.lineitem.where("l_quantity > 45").groupBy("l_suppkey").agg(F.count("*").alias("c")), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "s_name", F.coalesce("c", F.lit(0)).alias("record_count"))
)
_query("entity_page", "select s_suppkey, s_name, count(l_orderkey) record_count from supplier left join lineitem on l_suppkey = s_suppkey where s_name ilike '%1%' group by all order by record_count desc, s_name limit 10")(
    lambda t: R.page(R.filtered(t.supplier, contains=("s_name", "1")).join(t.lineitem, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("s_suppkey", "s_name").agg(F.count("l_orderkey").alias("record_count")), [F.desc("record_count"), F.asc("s_name")], 1, 10)
)
_query("entity_records", "select distinct o_orderkey, o_orderdate from orders join lineitem on l_orderkey = o_orderkey where l_suppkey = 7")(lambda t: t.orders.join(t.lineitem.where("l_suppkey = 7"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_orderdate"))
_query("related_records", "select o_orderkey, o_orderdate from orders where o_custkey = (select o_custkey from orders where o_orderkey = (select min(o_orderkey) from orders)) and o_orderkey <> (select min(o_orderkey) from orders)")(
    lambda t: (lambda first: t.orders.join(t.orders.where(F.col("o_orderkey") == first).select("o_custkey"), "o_custkey", "left_semi").where(F.col("o_orderkey") != first).select("o_orderkey", "o_orderdate"))(t.orders.agg(F.min("o_orderkey")).scalar())
)
_query("best_source", "select l_orderkey, l_linenumber, l_returnflag from lineitem qualify row_number() over (partition by l_orderkey order by case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end, l_shipdate desc, l_linenumber, l_partkey) = 1")(
    lambda t: R.first_wins(t.lineitem, ["l_orderkey"], [F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).asc(), F.col("l_shipdate").desc_nulls_first(), F.col("l_linenumber").asc(), F.col("l_partkey").asc()]).select("l_orderkey", "l_linenumber", "l_returnflag")
)
_query("dedup_first_wins", "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type, cast(ts as date) order by event_id) = 1")(
    lambda t: R.first_wins(t.events.withColumn("d", F.to_date("ts")), ["user_id", "event_type", "d"], [F.asc("event_id")]).select("event_id", "user_id", "event_type")
)
_query("idempotent_insert", "select user_id, event_type, event_hour, min(event_id) event_id from (select *, hour(ts) event_hour from events) a where event_id % 2 = 0 and not exists (select 1 from events b where b.event_id % 2 = 1 and b.user_id = a.user_id and b.event_type = a.event_type and hour(b.ts) = a.event_hour) group by all")(
    lambda t: (lambda e: R.new_rows(e.where("event_id % 2 = 0").groupBy("user_id", "event_type", "event_hour").agg(F.min("event_id").alias("event_id")), e.where("event_id % 2 = 1"), ["user_id", "event_type", "event_hour"]))(t.events.select("*", F.hour("ts").cast("long").alias("event_hour")))
)
_query("provenance_summary", "select l_orderkey record_id, l_linestatus source_type, count(*) n, arg_min(l_linenumber, (case l_returnflag when 'A' then 0 when 'R' then 1 else 2 end, -epoch(l_shipdate), l_linenumber)) best_source_id, min(l_shipdate) first_at, max(l_shipdate) last_at, bool_or(l_returnflag = 'R') repaired from lineitem group by all")(
    lambda t: R.provenance(t.lineitem.select(F.col("l_orderkey").alias("record_id"), F.col("l_linestatus").alias("source_type"), F.when(F.col("l_returnflag") == "A", "first_seen").when(F.col("l_returnflag") == "R", "repaired").otherwise("confirmed").alias("role"), F.lit("x").alias("snapshot_path"), F.col("l_shipdate").cast("timestamp").alias("captured_at"), F.col("l_linenumber").alias("source_id"))).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})
)
_query("alias_chain", "with recursive r(id, cur, d) as (select n_nationkey, n_nationkey, 0 from nation union all select id, cur - 5, d + 1 from r where d < 5 and cur >= 5) select id, arg_max(cur, d) canonical from r group by id")(
    lambda t: R.canonical(t.nation.where("n_nationkey >= 5").select(F.col("n_nationkey").alias("variant"), (F.col("n_nationkey") - 5).alias("target")), t.nation.select(F.col("n_nationkey").alias("id")))
)
_query("alias_expansion", "select n_nationkey from nation where n_nationkey = 3 or n_nationkey - 5 = 3")(lambda t: t.nation.where("n_nationkey = 3").select("n_nationkey").union(t.nation.where(F.col("n_nationkey") - 5 == 3).select("n_nationkey")).distinct())
_query("merge_entities", "with c as (select p_partkey, min(p_partkey) over (partition by lower(p_name)) canon from part) select l_orderkey, canon l_partkey, min(l_linenumber) l_linenumber from lineitem join c on p_partkey = l_partkey group by all")(
    lambda t: R.regrouped(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), R.least_of_name(t.part.select(F.col("p_partkey").alias("id"), "p_name"), F.lower("p_name")), "l_partkey", ["l_orderkey"], "l_linenumber")
)
_query("endorsement_counts", "select p_name, count(distinct l_orderkey) records, string_agg(distinct p_brand, ',' order by p_brand) codes from part left join lineitem on l_partkey = p_partkey group by p_name")(
    lambda t: t.part.join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("p_name").agg(F.countDistinct("l_orderkey").alias("records"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("codes"))
)
_query("learned_codes", "with j as (select a.o_orderpriority code, b.names from (select * from orders where o_orderstatus = 'F') a join (select o_custkey, list_distinct(list(o_orderpriority)) || ['ANY'] names from orders where o_orderstatus = 'O' group by o_custkey) b using (o_custkey)), t as (select code, count(*) rows_ from j group by code), e as (select code, unnest(names) name from j) select code, name from (select code, name, count(*) n from e group by all) join t using (code) where n = rows_")(
    lambda t: R.learned_codes(t.orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderpriority").alias("code")), t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.concat(F.collect_set("o_orderpriority"), F.array(F.lit("ANY"))).alias("names")), "o_custkey")
)
_query("filter_options", "select 'segment' facet, c_mktsegment v from customer where c_mktsegment <> '' group by all union all select 'status', o_orderstatus from orders group by all")(
    lambda t: t.customer.where("c_mktsegment <> ''").select(F.lit("segment").alias("facet"), F.col("c_mktsegment").alias("v")).distinct().union(t.orders.select(F.lit("status"), "o_orderstatus").distinct())
)
_query("dependent_options", "select distinct n_name from nation join customer on c_nationkey = n_nationkey where n_regionkey = 2")(lambda t: t.nation.where("n_regionkey = 2").join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("n_name").distinct())
_query("latest_row", "select event_id, event_type, content_hash from (select event_id, event_type, sha256(props) content_hash from events where event_type in ('click', 'view') or true order by event_id desc limit 1)")(lambda t: R.latest(t.events.select("event_id", "event_type", F.sha2("props", 256).alias("content_hash")), "event_id"))
_query("content_hash", "select page_id, sha256(html) content_hash from pages")(lambda t: t.pages.select("page_id", F.sha2("html", 256).alias("content_hash")))
_query("unchanged_pages", "select count(*) n, count(distinct sha256(html)) distinct_pages from pages")(lambda t: t.pages.agg(F.count("*").alias("n"), F.countDistinct(F.sha2("html", 256)).alias("distinct_pages")))
_query("html_links", r"select page_id, len(regexp_extract_all(html, '(?i)<a\s[^>]*>')) n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages")(
    lambda t: t.pages.select("page_id", F.regexp_count("html", F.lit(r"(?i)<a\s[^>]*>")).cast("long").alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
)
_query("strip_anchors", r"select page_id, length(regexp_replace(html, '(?i)</?a(\s[^>]*)?>', '', 'g')) n from pages")(lambda t: t.pages.select("page_id", F.length(S.strip_anchors(F.col("html"))).cast("long").alias("n")))
_query("audit_filter", "select event_id, json_extract_string(props, '$.k') detail from events where event_type = (select min(event_type) from events) and cast(ts as date) between date '1970-01-01' and date '2100-01-01'")(
    lambda t: t.events.where((F.col("event_type") == t.events.agg(F.min("event_type")).scalar()) & F.to_date("ts").between("1970-01-01", "2100-01-01")).select("event_id", F.get_json_object("props", "$.k").alias("detail"))
)
_query("recency_counts", "select count(*) total, count(*) filter (ts >= m - interval 1 day) day_1, count(*) filter (ts >= m - interval 7 day) day_7 from events, (select max(ts) m from events)")(
    lambda t: (lambda m: t.events.agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= m - F.expr("interval 1 day")).alias("day_1"), F.count_if(F.col("ts") >= m - F.expr("interval 7 day")).alias("day_7")))(t.events.agg(F.max("ts")).scalar())
)
_query("priority_queue", "select event_id from events order by case when event_type = (select min(event_type) from events) then null else ts end asc nulls first, event_id limit 100")(
    lambda t: t.events.orderBy(F.when(F.col("event_type") == t.events.agg(F.min("event_type")).scalar(), None).otherwise(F.col("ts")).asc_nulls_first(), "event_id").limit(100).select("event_id")
)
_query("trigram_search", "select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) sim from (select p_partkey, list_distinct(flatten(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) a, list_distinct(flatten(list_transform(regexp_extract_all(lower('red widgt'), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) b from part) where len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.3")(
    lambda t: t.part.select("p_partkey", S.trigram_similarity(S.trigrams(F.col("p_name")), S.trigrams(F.lit("red widgt"))).alias("s")).where("s >= 0.3").select("p_partkey", F.round("s", 6).alias("sim"))
)
_query("quality_report", "select 'no_items' check_name, count(*) n from orders where o_orderkey not in (select l_orderkey from lineitem) union all select 'duplicate_names', count(*) from (select upper(p_name) from part group by 1 having count(*) > 1) union all select 'idle_suppliers', count(*) from supplier where s_suppkey not in (select l_suppkey from lineitem)")(
    lambda t: t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.lit("no_items").alias("check_name"), F.count("*").alias("n"))
    .unionByName(R.duplicates(t.part, F.upper("p_name"), "p_partkey").agg(F.lit("duplicate_names").alias("check_name"), F.count("*").alias("n")))
    .unionByName(t.supplier.join(t.lineitem, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").agg(F.lit("idle_suppliers").alias("check_name"), F.count("*").alias("n")))
)
_query("scalar_functions", r"""select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) slug, '(' || '206' || ') ' || '555' || '-' || lpad(cast(p_partkey % 10000 as varchar), 4, '0') phone, strftime(date '1995-01-01' + cast(p_size as integer), '%Y-%m-%d') AS "day", case when p_brand = '' or p_brand is null then p_type else p_brand end filled from part""")(
    lambda t: t.part.select("p_partkey", S.slug(F.col("p_name")).alias("slug"), S.phone(F.concat(F.lit("206555"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))).alias("phone"), S.iso_date(F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.col("p_size")), "M/d/yyyy")).alias("day"), S.first_filled(F.col("p_brand"), F.col("p_type")).alias("filled"))
)
_query("text_match", "select p_partkey from part where list_has_all(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ['red'])")(lambda t: X.matches(X.with_document(t.part.select("p_partkey", "p_name"), [("A", F.col("p_name"))]), "doc", "red").select("p_partkey"))
_RANKED = """with d as (select p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') a, regexp_extract_all(lower(p_type), '[a-z0-9]+') b from part),
  places as (select p_partkey, unnest(a) w, generate_subscripts(a, 1) pos, 1.0::double weight from d union all select p_partkey, unnest(b), generate_subscripts(b, 1) + len(a), 0.4::double from d)"""
_query("text_rank", _RANKED + """, own as (select *, row_number() over (partition by p_partkey order by pos) j from places where w = 'red')
  select p_partkey, round((max(weight) + sum(weight / (j * j)) - max(weight) / pow(arg_max(j, (weight, -j)), 2)) / 1.64493406685, 6) rank from own group by 1""")(
    lambda t: X.ranked(X.with_document(t.part.select("p_partkey", "p_name", "p_type"), [("A", F.col("p_name")), ("B", F.col("p_type"))]), "doc", "red").select("p_partkey", F.round("rank", 6).alias("rank"))
)
_query("text_rank_of_words", _RANKED + """ select x.p_partkey, round(1 - product(1 - sqrt(x.weight * y.weight * case when abs(x.pos - y.pos) > 100 then 1e-30 else 1 / (1.005 + 0.05 * exp(abs(x.pos - y.pos) / 1.5 - 2)) end)), 6) rank
  from places x join places y on x.p_partkey = y.p_partkey and x.w = 'red' and y.w = 'widget' and x.pos <> y.pos group by 1""")(
    lambda t: X.ranked(X.with_document(t.part.select("p_partkey", "p_name", "p_type"), [("A", F.col("p_name")), ("B", F.col("p_type"))]), "doc", "the widgets are red").select("p_partkey", F.round("rank", 6).alias("rank"))
)
_TRIGRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_query("trigram_matches", f"with n as (select p_partkey id, {_TRIGRAMS.format("p_name || ' ' || p_type")} t from part), q as (select n_nationkey query_id, {_TRIGRAMS.format("replace(p_name, 'e', '') || ' ' || p_type")} q from nation join part on p_partkey = n_nationkey), s as (select query_id, id, len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))) s from n, q) select query_id, id, round(s, 6) similarity from s where s >= 0.3")(
    lambda t: trigrams.resembling(t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name")), t.nation.join(t.part, F.col("p_partkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("query_id"), F.concat_ws(" ", F.replace("p_name", F.lit("e"), F.lit("")), "p_type").alias("query"))).withColumn("similarity", F.round("similarity", 6))
)

from . import licensing  # noqa: E402, F401  # registers its queries
