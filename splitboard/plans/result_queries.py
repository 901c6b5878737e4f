"""Directories, profiles, lists, relays and progressions over the given tables.

Roles: events are performances (user_id is the athlete, value the mark; a tenth part is disqualified by
its id), orders with lineitem are relays with legs, customer, supplier, part and nation are dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.functions import marks
from splitboard.operators import analytics as a
from splitboard.operators import filters as f
from splitboard.operators.entries import combined, combined_order, one_row
from splitboard.operators.paging import ordered, rows_of_page
from splitboard.plans.base import query
from splitboard.sources import load


def performances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rows.withColumns({"is_dq": F.col("event_id") % 11 == 0, "date": F.date_format("ts", "yyyy-MM-dd"), "seconds": F.round("value", 2)})


PERFORMANCES = "perf AS (SELECT event_id, ts, user_id, event_type, event_id % 11 = 0 AS is_dq, strftime(ts, '%Y-%m-%d') AS date, round(value, 2) AS seconds FROM events)"


@query(f"""
WITH {PERFORMANCES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seconds, date, event_id) AS n FROM perf WHERE NOT is_dq)
SELECT user_id, event_type, seconds, date, event_id FROM ranked WHERE n = 1
""")
def personal_bests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best mark of each athlete in each event."""
    rows = f.valid_marks(performances(spark, sf_dir), "is_dq", "seconds")
    return a.best_marks(rows, ["user_id", "event_type"], "seconds", "date", "event_id", [])


@query("""
SELECT c_custkey, c_name, count(o_orderkey) AS result_count, count(DISTINCT o_orderpriority) AS event_count,
       strftime(max(o_orderdate), '%Y-%m-%d') AS latest_date
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_name ILIKE '%1%' GROUP BY c_custkey, c_name
ORDER BY c_name, c_custkey LIMIT 100 OFFSET 100
""")
def athlete_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of a directory: searched names with counts and the latest date."""
    who = f.like(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "1")
    counts = {"result_count": F.count("*"), "event_count": F.count_distinct("o_orderpriority"), "latest_date": F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")}
    counted = a.with_counts(who, load(spark, sf_dir, "orders"), "c_custkey", "o_custkey", counts)
    return rows_of_page(counted, [ordered({"name": "c_name"}, "name", False, "name"), F.col("c_custkey")], 2, 100)


@query("""
SELECT user_id, count(*) AS results, count(DISTINCT event_type) AS events, count(DISTINCT strftime(ts, '%Y-%m')) AS meets,
       count(*) FILTER (WHERE event_id % 11 = 0) AS dqs, strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS latest_date
FROM events GROUP BY user_id
""")
def athlete_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = performances(spark, sf_dir)
    return rows.groupBy("user_id").agg(
        F.count("*").alias("results"), F.count_distinct("event_type").alias("events"), F.count_distinct(F.date_format("ts", "yyyy-MM")).alias("meets"),
        F.count_if("is_dq").alias("dqs"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("latest_date"),
    )


@query("""
WITH ranked AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth FROM events)
SELECT * FROM ranked WHERE nth <= 20
""")
def recent_results_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 latest performances of each athlete."""
    return a.top_per_key(performances(spark, sf_dir).select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.col("event_id")], 20).drop("ts")


@query(f"""
WITH {PERFORMANCES}
SELECT user_id, event_type, event_id, date, seconds, row_number() OVER w AS nth, round(seconds - lag(seconds) OVER w, 6) AS change,
       min(seconds) OVER (w ROWS UNBOUNDED PRECEDING) AS best_so_far
FROM perf WHERE NOT is_dq WINDOW w AS (PARTITION BY user_id, event_type ORDER BY date, event_id)
""")
def progression_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.valid_marks(performances(spark, sf_dir), "is_dq", "seconds").select("user_id", "event_type", "event_id", "date", "seconds")
    return a.series(rows, ["user_id", "event_type"], "seconds", "date", "event_id").withColumn("change", F.round("change", 6))


@query(f"""
WITH {PERFORMANCES}, s AS (
  SELECT *, first_value(seconds) OVER (PARTITION BY user_id, event_type ORDER BY date, event_id) AS f,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY seconds, date, event_id) AS n,
         count(*) OVER (PARTITION BY user_id, event_type) AS points
  FROM perf WHERE NOT is_dq)
SELECT user_id, event_type, points, seconds AS best, date AS best_date, f AS first,
       CASE WHEN points >= 2 THEN round(f - seconds, 6) END AS improvement,
       CASE WHEN points >= 2 AND f <> 0 THEN round((f - seconds) / f * 100, 2) END AS improvement_percent
FROM s WHERE n = 1
""")
def progression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.valid_marks(performances(spark, sf_dir), "is_dq", "seconds")
    return a.series_summary(rows, ["user_id", "event_type"], "seconds", "date", "event_id").withColumn("improvement", F.round("improvement", 6))


@query("""
WITH m AS (SELECT o_custkey, count(*) AS relays, count(DISTINCT o_orderpriority) AS kinds, count(DISTINCT o_orderstatus) AS rounds, max(o_totalprice) AS most FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, n_name, coalesce(relays, 0) AS relays, coalesce(kinds, 0) AS kinds, coalesce(rounds, 0) AS rounds, most
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN m ON o_custkey = c_custkey
""")
def meet_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every competition with its counts, those without results too; the nation is a dimension of 25 rows by its standard."""
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    meets = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    counts = {"relays": F.count("*"), "kinds": F.count_distinct("o_orderpriority"), "rounds": F.count_distinct("o_orderstatus"), "most": F.max("o_totalprice")}
    counted = a.with_counts(meets.select("c_custkey", "c_name", "n_name"), load(spark, sf_dir, "orders"), "c_custkey", "o_custkey", counts)
    return counted


@query("""
WITH r AS (
  SELECT o_orderpriority AS event, CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Prelim' ELSE o_orderstatus END AS round, o_orderkey,
         row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice, o_orderkey) AS placement, o_orderkey % 7 = 0 AS is_dq
  FROM orders)
SELECT event, round, CASE round WHEN 'Final' THEN 1 WHEN 'Prelim' THEN 2 ELSE 0 END AS round_rank, count(*) AS results, count(*) FILTER (WHERE is_dq) AS dqs,
       string_agg(o_orderkey::VARCHAR || ':' || CASE placement WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' ELSE 'bronze' END, ',' ORDER BY placement) FILTER (WHERE placement <= 3 AND NOT is_dq) AS medals
FROM r GROUP BY event, round
""")
def meet_page_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by round with medals and DQs: plain counts, and the first three of each by a limited rank, which tasks cut before anything is sent."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    label = F.when(F.col("o_orderstatus") == "F", "Final").when(F.col("o_orderstatus") == "O", "Prelim").otherwise(F.col("o_orderstatus"))
    rows = rows.withColumns({"event": F.col("o_orderpriority"), "round": label, "is_dq": F.col("o_orderkey") % 7 == 0})
    counts = rows.groupBy("event", "round").agg(F.count("*").alias("results"), F.count_if("is_dq").alias("dqs"))
    first = a.top_per_key(rows, ["event", "round"], [F.col("o_totalprice"), F.col("o_orderkey")], 3, "placement")
    badge = marks.medal(F.col("placement"), F.col("is_dq"))
    given = F.array_sort(F.collect_list(F.when(badge.isNotNull(), F.struct("placement", F.concat_ws(":", F.col("o_orderkey"), badge).alias("text")))))
    medals = first.groupBy("event", "round").agg(F.nullif(F.array_join(F.transform(given, lambda x: x["text"]), ","), F.lit("")).alias("medals"))
    rank = F.coalesce(F.array_position(F.array(F.lit("Final"), F.lit("Prelim"), F.lit("Results")), F.col("round")), F.lit(0))
    return counts.join(medals, ["event", "round"]).select("event", "round", rank.alias("round_rank"), "results", "dqs", "medals")


@query("""
SELECT l_orderkey, l_linenumber, p_name, l_returnflag, l_quantity, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE p_brand = 'Brand#17' AND p_name ILIKE '%R%' AND l_returnflag = 'R' ORDER BY o_orderdate DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 50
""")
def results_filtered_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of filtered results, the latest first."""
    parts = f.like(f.equal(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_brand", "Brand#17"), "p_name", "R")
    rows = f.equal(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity"), "l_returnflag", "R")
    rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    by = ordered({"date": "o_orderdate"}, "date", True, "date")
    return rows_of_page(rows, [by, F.col("l_orderkey"), F.col("l_linenumber")], 2, 50).select("l_orderkey", "l_linenumber", "p_name", "l_returnflag", "l_quantity", "o_orderdate")


@query("""
SELECT 'individual' AS type, c_mktsegment AS event, c_custkey AS key, (c_custkey % 9)::INTEGER AS placement, c_acctbal AS mark, NULL AS relay_letter FROM customer
UNION ALL SELECT 'relay', 'RELAY', s_suppkey, NULL, NULL, chr(65 + (s_suppkey % 4)::INTEGER) FROM supplier
ORDER BY event, CASE WHEN coalesce(placement, 0) = 0 THEN 9999 ELSE placement END, type, key LIMIT 500 OFFSET 500
""")
def combined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individual and relay results in one list, second page of 500."""
    one = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("event"), F.col("c_custkey").alias("key"), (F.col("c_custkey") % 9).cast("int").alias("placement"), F.col("c_acctbal").alias("mark"))
    team = load(spark, sf_dir, "supplier").select(F.lit("RELAY").alias("event"), F.col("s_suppkey").alias("key"), F.char(F.lit(65) + F.col("s_suppkey") % 4).alias("relay_letter"))
    return rows_of_page(combined(one, team), combined_order("key"), 2, 500)


@query("SELECT DISTINCT event FROM (SELECT c_mktsegment AS event FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier)")
def distinct_event_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [load(spark, sf_dir, t).select(F.col(c).alias("event")) for t, c in (("customer", "c_mktsegment"), ("nation", "n_name"), ("supplier", "s_name"))]
    return names[0].union(names[1]).union(names[2]).distinct()


@query("""
SELECT o_orderkey, o_orderpriority, coalesce(legs, 0) AS n_legs, members FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS legs, string_agg(l_linenumber::VARCHAR || '/' || l_suppkey::VARCHAR, ' ' ORDER BY l_linenumber, l_suppkey) AS members FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
""")
def relays_with_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every relay with its legs in order."""
    legs = a.nested(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", ["l_linenumber", "l_suppkey"], "legs")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(legs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    told = F.array_join(F.transform("legs", lambda x: F.concat_ws("/", x["l_linenumber"], x["l_suppkey"])), " ")
    return rows.select("o_orderkey", "o_orderpriority", F.coalesce(F.size("legs"), F.lit(0)).cast("long").alias("n_legs"), told.alias("members"))


@query("""
SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (
  SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = o_orderkey AND s_name ILIKE '%7' AND l_linenumber = 1)
""")
def relays_semi_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relays whose first leg was swum by a searched member; each relay once."""
    who = load(spark, sf_dir, "supplier").where(F.col("s_name").ilike("%7")).select("s_suppkey")
    legs = f.equal(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_linenumber", 1)
    legs = legs.join(who, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(legs, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("""
WITH own AS (SELECT l_orderkey, l_linenumber AS own_leg FROM lineitem WHERE l_suppkey = 3)
SELECT own_leg, o_orderkey, n_legs, members FROM own JOIN orders ON l_orderkey = o_orderkey JOIN (
  SELECT l_orderkey AS k, count(*) AS n_legs, string_agg(l_suppkey::VARCHAR, ' ' ORDER BY l_linenumber, l_suppkey) AS members FROM lineitem GROUP BY l_orderkey) ON k = o_orderkey
""")
def member_relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relays of one member, one row per own leg, with all members."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    own = lines.where(F.col("l_suppkey") == 3).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("own_leg"))
    theirs = lines.join(own.select(F.col("o").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi")
    legs = a.nested(theirs, "l_orderkey", ["l_linenumber", "l_suppkey"], "legs")
    relays = load(spark, sf_dir, "orders").select("o_orderkey").join(own, F.col("o_orderkey") == F.col("o")).join(legs, F.col("o_orderkey") == F.col("l_orderkey"))
    return relays.select("own_leg", "o_orderkey", F.size("legs").cast("long").alias("n_legs"), F.array_join(F.transform("legs", lambda x: x["l_suppkey"].cast("string")), " ").alias("members"))


@query("""
SELECT month, count(*) AS items, count(*) FILTER (WHERE type = 'relay') AS relays, round(sum(mark), 2) AS marks FROM (
  SELECT strftime(ts, '%m') AS month, 'individual' AS type, round(value, 2) AS mark FROM events
  UNION ALL SELECT strftime(o_orderdate, '%m'), 'relay', o_totalprice FROM orders) GROUP BY month
""")
def history_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individual and relay performances together by month."""
    own = performances(spark, sf_dir).select(F.date_format("ts", "MM").alias("month"), F.col("seconds").alias("mark"))
    relays = load(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "MM").alias("month"), F.col("o_totalprice").alias("mark"))
    both = combined(own, relays)
    return both.groupBy("month").agg(F.count("*").alias("items"), F.count_if(F.col("type") == "relay").alias("relays"), F.round(F.sum("mark"), 2).alias("marks"))


@query("SELECT event_id, round(value, 2) AS seconds, round(value, 2) >= 60 AS has_minutes FROM events")
def mark_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written as marks and read again."""
    rows = load(spark, sf_dir, "events").select("event_id", marks.mark_text(F.round("value", 2)).alias("mark"))
    return rows.select("event_id", F.round(marks.mark_seconds(F.col("mark")), 2).alias("seconds"), F.col("mark").contains(":").alias("has_minutes"))


STROKE_OF = "list_extract(['Freestyle', 'Backstroke', 'Breaststroke', 'Butterfly', 'IM'], (p_partkey % 5)::INTEGER + 1)"
GENDER_OF = "list_extract(['Boys', 'Girls', 'Men', 'Women'], (p_partkey % 4)::INTEGER + 1)"


@query(f"""
SELECT p_partkey, {GENDER_OF} AS gender, CASE WHEN p_size % 2 = 0 THEN '13-14' ELSE '18 & Over' END AS age_group, 50 * p_size AS distance,
       {STROKE_OF} AS stroke, CASE WHEN p_size % 3 = 0 THEN 'SC' ELSE 'LC' END AS course, NOT contains({STROKE_OF}, 'x') AS clean FROM part
""")
def event_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts composed into event names, cleaned and taken apart again."""
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    pick = lambda words, key: F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))
    gender, stroke = pick(["Boys", "Girls", "Men", "Women"], F.col("p_partkey")), pick(["Freestyle", "Backstroke", "Breaststroke", "Butterfly", "IM"], F.col("p_partkey"))
    age = F.when(F.col("p_size") % 2 == 0, "13-14").otherwise("18 & Over")
    course = F.when(F.col("p_size") % 3 == 0, "SC Meter").otherwise("LC Meter")
    ending = pick(["", " Super Final", " A - Final", " b - final"], F.col("p_partkey"))
    name = marks.clean_event_name(F.concat(F.concat_ws(" ", gender, age, F.col("p_size") * 50, course, stroke), ending))
    return rows.select("p_partkey", marks.event_parts(name).alias("e"), (~F.lower(name).contains("final")).alias("clean")).select("p_partkey", "e.*", "clean")


@query("""
WITH newest AS (SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY max(o_orderdate) DESC, o_custkey LIMIT 5)
SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS meets, (SELECT count(*) FROM customer) AS athletes, (SELECT count(*) FROM orders) AS results,
       (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT o_custkey FROM newest)) AS recent_total
""")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    meets = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    newest = meets.orderBy(F.desc("last"), "o_custkey").limit(5)
    return one_row(
        meets.agg(F.count("*").alias("meets")), load(spark, sf_dir, "customer").agg(F.count("*").alias("athletes")), orders.agg(F.count("*").alias("results")),
        orders.join(newest, "o_custkey", "left_semi").agg(F.count("*").alias("recent_total")),
    )


@query("""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events)
SELECT event_type, event_id AS last_run, user_id AS triggered_by, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at FROM ranked WHERE n = 1
""")
def latest_run_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each rule."""
    runs = load(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "ts")
    last = a.latest(runs, ["event_type"], [F.desc("ts"), F.col("event_id")])
    return last.select("event_type", F.col("event_id").alias("last_run"), F.col("user_id").alias("triggered_by"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query("""
WITH n AS (SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i,
                  count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS c FROM lineitem)
SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM n WHERE c <= 13 OR i <= 10 OR i > c - 3
""")
def preview_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten and the last three rows of each group."""
    rows = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber")
    return a.head_and_tail(rows, ["l_suppkey", "l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_shipdate")
