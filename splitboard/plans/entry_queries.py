"""The public questions over a store mapped from the given tables.

Roles: customers are athletes, months of orders are competitions, orders are individual results and, each again, relays
whose legs are the order's lineitems (a supplier's key is the athlete's; every seventh leg has no athlete).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.functions import marks
from splitboard.operators import entries as e
from splitboard.plans.base import query
from splitboard.sources import load

EVENT_OF = {
    "1-URGENT": "Boys 13-14 100 LC Meter Freestyle", "2-HIGH": "Girls 13-14 200 LC Meter IM", "3-MEDIUM": "Men 18 & Over 50 SC Meter Butterfly",
    "4-NOT SPECIFIED": "Women 18 & Over 100 LC Meter Backstroke", "5-LOW": "Boys 11-12 50 LC Meter Breaststroke",
}
RELAYS = ["Mixed 13-14 4x50 LC Meter Medley Relay", "Women 18 & Over 4x100 LC Meter Freestyle Relay"]
MEET = 199703


def mapped(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The store's tables, as plans over the given ones."""
    orders = load(spark, sf_dir, "orders")
    key, month = F.col("o_orderkey"), (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("meet_key")
    cents = F.round(F.col("o_totalprice") * 100).cast("long") % 20000 + 2000
    event = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.lit(n)) for p, n in EVENT_OF.items()])
    dq, relay_dq = key % 11 == 0, key % 13 == 0
    place = lambda n: F.nullif((key % n).cast("int"), F.lit(0))
    whole: Column = F.when(F.col("o_orderstatus") == "F", "Final").when(F.col("o_orderstatus") == "O", "Prelim").otherwise("Heats")
    customers = load(spark, sf_dir, "customer")
    lines = load(spark, sf_dir, "lineitem")
    return {
        "athlete": customers.select(F.col("c_custkey").alias("athlete_key"), F.col("c_name").alias("name"), (F.col("c_custkey") % 60 + 8).cast("int").alias("age"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("team")),
        "meet": orders.select(month, F.concat(F.lit("Meet "), F.date_format("o_orderdate", "yyyy-MM")).alias("name"), F.to_date(F.trunc("o_orderdate", "month")).alias("start_date"), F.lit(None).cast("string").alias("location")).distinct(),
        "result": orders.select(
            key.alias("result_key"), F.col("o_custkey").alias("athlete_key"), month, event.alias("event"), F.when(~dq, marks.mark_text(cents / 100)).alias("time"),
            F.when(key % 5 == 0, "NT").otherwise(marks.mark_text((cents + key % 200) / 100)).alias("seed_time"), F.when(~dq, place(9)).alias("placement"), dq.alias("is_dq"), F.when(dq, "SW 7.4c").alias("dq_code"),
            F.lit(None).cast("string").alias("dq_description"), (key % 17 == 0).alias("is_guest"), F.lit(None).cast("string").alias("qualifier"), F.lit("0.70").alias("reaction_time"), F.lit(None).cast("string").alias("splits"),
            whole.alias("round"), F.when(key % 4 != 0, F.to_date("o_orderdate")).alias("swim_date"),
        ),
        "relay_result": orders.select(
            key.alias("relay_key"), month, F.when(key % 2 == 0, RELAYS[0]).otherwise(RELAYS[1]).alias("event"), F.concat(F.lit("Team "), F.col("o_custkey") % 40).alias("team_name"), F.char(key % 3 + 65).alias("relay_letter"),
            F.when(~relay_dq, marks.mark_text(cents / 100)).alias("time"), place(6).alias("placement"), relay_dq.alias("is_dq"), F.lit(None).cast("string").alias("splits"),
        ),
        "relay_leg": lines.select(
            F.col("l_orderkey").alias("relay_key"), F.col("l_linenumber").alias("leg_number"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("athlete_key"), F.concat(F.lit("Leg P"), "l_partkey").alias("athlete_name"),
            F.lit(None).cast("int").alias("age"), F.col("l_returnflag").alias("gender"), (F.col("l_linenumber") == 2).alias("is_guest"), F.lit(None).cast("string").alias("reaction_time"), F.lit(None).cast("string").alias("split_time"), F.lit(None).cast("string").alias("splits"),
        ),
    }


def written(cents: str) -> str:
    """mark_text as SQL."""
    return f"CASE WHEN {cents} >= 6000 THEN ({cents} // 6000)::VARCHAR || ':' ELSE '' END || lpad(({cents} % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad(({cents} % 100)::VARCHAR, 2, '0')"


MAPPED = f"""
athlete AS (SELECT c_custkey AS athlete_key, c_name AS name, (c_custkey % 60 + 8)::INTEGER AS age, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS team FROM customer),
o AS (SELECT *, (o_totalprice * 100)::BIGINT % 20000 + 2000 AS cents, (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS meet_key, o_orderkey % 11 = 0 AS dq FROM orders),
meet AS (SELECT DISTINCT meet_key, 'Meet ' || strftime(o_orderdate, '%Y-%m') AS name, date_trunc('month', o_orderdate)::DATE AS start_date FROM o),
result AS (SELECT o_orderkey AS result_key, o_custkey AS athlete_key, o.meet_key, CASE o_orderpriority {" ".join(f"WHEN '{p}' THEN '{n}'" for p, n in EVENT_OF.items())} END AS event,
  CASE WHEN NOT dq THEN {written("cents")} END AS time, CASE WHEN NOT dq THEN cents / 100.0 END::DOUBLE AS seconds, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (cents + o_orderkey % 200) / 100.0 END::DOUBLE AS seed,
  CASE WHEN NOT dq THEN nullif(o_orderkey % 9, 0) END::INTEGER AS placement, dq AS is_dq, CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'O' THEN 'Prelim' ELSE 'Heats' END AS round,
  start_date, strftime(coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END, start_date), '%Y-%m-%d') AS date FROM o JOIN meet USING (meet_key)),
relay AS (SELECT o_orderkey AS relay_key, meet_key, CASE WHEN o_orderkey % 2 = 0 THEN '{RELAYS[0]}' ELSE '{RELAYS[1]}' END AS event, 'Team ' || (o_custkey % 40) AS team_name,
  CASE WHEN o_orderkey % 13 <> 0 THEN {written("cents")} END AS time, nullif(o_orderkey % 6, 0)::INTEGER AS placement, o_orderkey % 13 = 0 AS is_dq FROM o),
leg AS (SELECT l_orderkey AS relay_key, l_linenumber AS leg_number, a.athlete_key, coalesce(a.athlete_key, 0) AS id, coalesce(a.name, 'Leg P' || l_partkey) AS name
  FROM lineitem LEFT JOIN athlete a ON l_suppkey % 7 <> 0 AND a.athlete_key = l_suppkey),
members AS (SELECT relay_key, count(*) AS n_legs, string_agg(leg_number || '/' || id || '/' || name, ' ' ORDER BY leg_number, id, name) AS members FROM leg GROUP BY relay_key)
"""


def told(legs: str) -> Column:
    return F.array_join(F.transform(legs, lambda x: F.concat_ws("/", x["leg_number"], x["athlete"]["id"], x["athlete"]["name"])), " ")


@query(f"""
WITH {MAPPED} SELECT meet_key, name, strftime(start_date, '%Y-%m-%d') AS start_date, count(result_key) AS result_count, count(DISTINCT athlete_key) AS athlete_count
FROM meet m LEFT JOIN (SELECT meet_key, result_key, athlete_key FROM result) r USING (meet_key) WHERE name ILIKE '%-0%' GROUP BY ALL ORDER BY start_date DESC, meet_key LIMIT 20 OFFSET 20
""")
def list_meets_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = e.list_meets(mapped(spark, sf_dir), page=2, limit=20, search="-0").rows
    return rows.select("meet_key", "name", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"), "result_count", "athlete_count")


@query(f"""
WITH {MAPPED} SELECT event, row_number() OVER (PARTITION BY event ORDER BY placement NULLS LAST, result_key) AS nth, result_key, a.name, time, is_dq
FROM result LEFT JOIN athlete a USING (athlete_key) WHERE meet_key = {MEET} AND event LIKE '% 13-14 %'
""")
def meet_results_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One competition's results by event, the unplaced last."""
    rows = e.get_meet(mapped(spark, sf_dir), MEET, age_group="13-14").select("event", F.posexplode("results").alias("i", "r"))
    return rows.select("event", (F.col("i") + 1).alias("nth"), "r.order.result_key", "r.athlete.name", "r.time", "r.is_dq")


@query(f"""
WITH {MAPPED} SELECT athlete_key, name, team, age, count(result_key) AS result_count, count(DISTINCT meet_key) AS meet_count, strftime(max(start_date), '%Y-%m-%d') AS latest_date
FROM athlete LEFT JOIN (SELECT athlete_key, result_key, meet_key, start_date FROM result) r USING (athlete_key) WHERE name ILIKE '%1%' AND age BETWEEN 20 AND 50 GROUP BY ALL
ORDER BY team DESC NULLS FIRST, athlete_key LIMIT 20 OFFSET 20
""")
def list_athletes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = e.list_athletes(mapped(spark, sf_dir), page=2, limit=20, search="1", sort="team", order="desc", ages=(20, 50)).rows
    return rows.select("athlete_key", "name", "team", "age", "result_count", "meet_count", "latest_date")


@query(f"""
WITH {MAPPED}, b AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY seconds, date, result_key) AS n FROM result WHERE athlete_key = 7 AND NOT is_dq)
SELECT event, seconds, date, result_key, time, meet_key FROM b WHERE n = 1
""")
def profile_bests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.athlete_bests(mapped(spark, sf_dir), 7)


@query(f"WITH {MAPPED} SELECT result_key, event, time, strftime(start_date, '%Y-%m-%d') AS started FROM result WHERE athlete_key = 7 ORDER BY start_date DESC, result_key LIMIT 5")
def profile_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.athlete_recent(mapped(spark, sf_dir), 7, 5).select("result_key", "event", "time", F.date_format("meet_start", "yyyy-MM-dd").alias("started"))


@query(f"""
WITH {MAPPED} SELECT count(*) AS results, count(DISTINCT event) AS events, count(DISTINCT meet_key) AS meets, count(*) FILTER (WHERE is_dq) AS dqs,
strftime(min(start_date), '%Y-%m-%d') AS first_date, strftime(max(start_date), '%Y-%m-%d') AS latest_date FROM result WHERE athlete_key = 7
""")
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.athlete_stats(mapped(spark, sf_dir), 7)


@query(f"WITH {MAPPED} SELECT event FROM result WHERE meet_key = {MEET} UNION SELECT event FROM relay WHERE meet_key = {MEET}")
def event_names_of_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.list_events(mapped(spark, sf_dir), MEET)


@query(f"""
WITH {MAPPED}, found AS (SELECT * FROM relay WHERE event ILIKE '%medley%' AND relay_key IN (SELECT relay_key FROM leg WHERE name ILIKE '%leg p1%') ORDER BY event, placement NULLS LAST, relay_key LIMIT 50)
SELECT relay_key, event, team_name, placement, n_legs, members FROM found JOIN members USING (relay_key)
""")
def list_relays_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relays with a searched member, with all their legs; legs without an athlete have the name they were swum under."""
    rows = e.list_relays(mapped(spark, sf_dir), limit=50, event="medley", athlete="leg p1").rows
    return rows.select("relay_key", "event", "team_name", "placement", F.size("legs").cast("long").alias("n_legs"), told("legs").alias("members"))


@query(f"WITH {MAPPED} SELECT l.leg_number AS own_leg, relay_key, team_name, n_legs, members FROM leg l JOIN relay USING (relay_key) JOIN members USING (relay_key) WHERE l.athlete_key = 8")
def profile_relays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = e.athlete_relays(mapped(spark, sf_dir), 8)
    return rows.select("own_leg", "relay_key", "team_name", F.size("legs").cast("long").alias("n_legs"), told("legs").alias("members"))


@query(f"""
WITH {MAPPED}, own AS (SELECT 'individual' AS type, result_key AS key, event, placement, time FROM result WHERE athlete_key IN (SELECT athlete_key FROM athlete WHERE name ILIKE '%00001%') AND event ILIKE '%meter%' AND NOT is_dq),
teams AS (SELECT 'relay', relay_key, event, placement, time FROM relay WHERE relay_key IN (SELECT relay_key FROM leg WHERE name ILIKE '%00001%') AND event ILIKE '%meter%' AND NOT is_dq)
SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM teams) ORDER BY event, CASE WHEN coalesce(placement, 0) = 0 THEN 9999 ELSE placement END, type, key LIMIT 50 OFFSET 50
""")
def list_all_results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individual and relay results of searched people in one list, second page."""
    return e.list_all_results(mapped(spark, sf_dir), page=2, limit=50, athlete="00001", event="meter", is_dq=False).rows.select("type", "key", "event", "placement", "time")


@query(f"""
WITH {MAPPED} SELECT result_key, a.name, a.team, time, m.name AS meet_name FROM result JOIN athlete a USING (athlete_key) JOIN meet m USING (meet_key)
WHERE a.team ILIKE '%build%' AND NOT is_dq ORDER BY time, result_key LIMIT 50 OFFSET 50
""")
def list_results_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in the order of their text, as lists show them."""
    return e.list_results(mapped(spark, sf_dir), page=2, limit=50, team="build", is_dq=False, sort="time", order="asc").rows.select("result_key", "name", "team", "time", "meet_name")


@query(f"WITH {MAPPED} SELECT result_key, seconds, placement, event FROM result WHERE placement BETWEEN 2 AND 6 AND meet_key = {MEET} ORDER BY seconds DESC, result_key LIMIT 50")
def list_results_by_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = e.list_results(mapped(spark, sf_dir), limit=50, meet_key=MEET, sort="seconds", order="desc", placement=(2, 6)).rows
    return rows.select("result_key", "seconds", "placement", "event")


@query(f"WITH {MAPPED} SELECT result_key, a.name AS athlete, a.age, m.name AS meet, event, time, is_dq, '0.70' AS reaction_time FROM result LEFT JOIN athlete a USING (athlete_key) LEFT JOIN meet m USING (meet_key) WHERE result_key = 22")
def one_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = e.get_result(mapped(spark, sf_dir), 22)
    return rows.select("result_key", F.col("athlete.name").alias("athlete"), "athlete.age", F.col("meet.name").alias("meet"), "event", "time", "is_dq", "reaction_time")


FIRST_EVENT = EVENT_OF["1-URGENT"]
SERIES = f"s AS (SELECT * FROM result WHERE athlete_key BETWEEN 1 AND 40 AND event = '{FIRST_EVENT}' AND NOT is_dq AND date >= '1996-01-01')"


@query(f"""
WITH {MAPPED}, {SERIES} SELECT athlete_key, row_number() OVER w AS nth, date, time, seconds, round(seconds - lag(seconds) OVER w, 6) AS change, min(seconds) OVER (w ROWS UNBOUNDED PRECEDING) AS best_so_far, m.name AS meet_name
FROM s JOIN meet m USING (meet_key) WINDOW w AS (PARTITION BY athlete_key ORDER BY date, result_key)
""")
def overlaid_progressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of one event for forty athletes laid over each other, from a date on."""
    points, _ = e.progression(mapped(spark, sf_dir), list(range(1, 41)), FIRST_EVENT, start="1996-01-01")
    return points.select("athlete_key", "nth", "date", "time", "seconds", F.round("change", 6).alias("change"), "best_so_far", "meet_name")


@query(f"""
WITH {MAPPED}, {SERIES}, r AS (SELECT *, first_value(seconds) OVER (PARTITION BY athlete_key ORDER BY date, result_key) AS f, row_number() OVER (PARTITION BY athlete_key ORDER BY seconds, date, result_key) AS n, count(*) OVER (PARTITION BY athlete_key) AS points FROM s)
SELECT athlete_key, points, seconds AS best, date AS best_date, f AS first, CASE WHEN points >= 2 THEN round(f - seconds, 6) END AS improvement, CASE WHEN points >= 2 THEN round((f - seconds) / f * 100, 2) END AS improvement_percent FROM r WHERE n = 1
""")
def overlaid_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, summary = e.progression(mapped(spark, sf_dir), list(range(1, 41)), FIRST_EVENT, start="1996-01-01")
    return summary.withColumn("improvement", F.round("improvement", 6))


@query(f"""
WITH {MAPPED} SELECT event, round, CASE round WHEN 'Final' THEN 1 WHEN 'Prelim' THEN 2 ELSE 0 END AS round_rank, count(*) AS n_results, count(*) FILTER (WHERE is_dq) AS dqs,
string_agg(result_key || ':' || CASE placement WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' ELSE '-' END, ' ' ORDER BY placement NULLS LAST, result_key) AS results
FROM result WHERE meet_key = {MEET} AND lower(event) LIKE '%boys%' GROUP BY event, round
""")
def meet_rounds_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = e.meet_by_round(mapped(spark, sf_dir), MEET, search="BOYS")
    badges = F.array_join(F.transform("results", lambda x: F.concat_ws(":", x["result_key"], F.coalesce(x["medal"], F.lit("-")))), " ")
    return rows.select("event", "round", "round_rank", F.size("results").cast("long").alias("n_results"), "dqs", badges.alias("results"))


@query(f"""
WITH {MAPPED}, items AS (SELECT meet_key, event, 'individual' AS type, time, placement, result_key AS key FROM result WHERE athlete_key = 8
  UNION ALL SELECT meet_key, event, 'relay', time, placement, relay_key FROM relay WHERE relay_key IN (SELECT relay_key FROM leg WHERE athlete_key = 8))
SELECT meet_key, m.name AS meet, count(*) AS n_items, string_agg(type || key, ' ' ORDER BY event, type, time NULLS FIRST, placement NULLS FIRST, key) AS items FROM items JOIN meet m USING (meet_key) GROUP BY meet_key, m.name
""")
def profile_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and relays of an athlete by competition."""
    rows = e.athlete_history(mapped(spark, sf_dir), 8)
    listed = F.array_join(F.transform("items", lambda x: F.concat(x["type"], x["key"])), " ")
    return rows.select("meet_key", F.col("meet_name").alias("meet"), F.size("items").cast("long").alias("n_items"), listed.alias("items"))


@query(f"""
WITH {MAPPED} SELECT (SELECT count(*) FROM meet) AS meets, (SELECT count(*) FROM athlete) AS athletes, (SELECT count(*) FROM result) AS results, (SELECT count(*) FROM relay) AS relays,
(SELECT count(*) FROM result WHERE meet_key IN (SELECT meet_key FROM meet ORDER BY start_date DESC, meet_key LIMIT 5)) AS recent_total
""")
def dashboard_of_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.dashboard(mapped(spark, sf_dir))


@query(f"WITH {MAPPED} SELECT result_key, athlete_key, round(seed - seconds, 2) AS gain, abs(seed - seconds) <= 1.005 AS is_near FROM result WHERE meet_key = {MEET} AND seed IS NOT NULL AND NOT is_dq")
def seed_gains_of_meet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.seed_gains(mapped(spark, sf_dir), MEET, 1.005).select("result_key", "athlete_key", F.round("gain", 2).alias("gain"), "is_near")
