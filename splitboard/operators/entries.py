"""The public questions: directories, profiles, results, relays and progressions.

``store`` is a mapping of DataFrames: athlete, meet, result, relay_result and relay_leg, with the
columns of ``splitboard.sources.schemas``. Nothing here collects; a list gives a Page.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitboard.functions import marks
from splitboard.operators import filters as f
from splitboard.operators.analytics import best_marks, nested, series, series_summary, with_counts
from splitboard.operators.paging import Page, ordered, paged

Store = Mapping[str, DataFrame]
UNPLACED = 9999


def meet_brief(df: DataFrame) -> DataFrame:
    return df.select("meet_key", F.struct(F.col("meet_key").alias("id"), "name", F.col("start_date").alias("date"), "location").alias("meet"), F.col("start_date").alias("meet_start"), F.col("name").alias("meet_name"))


def athlete_brief(df: DataFrame) -> DataFrame:
    return df.select("athlete_key", F.struct(F.col("athlete_key").alias("id"), "name", "age", "team").alias("athlete"))


def dated(store: Store) -> DataFrame:
    """Results with seconds, competition and effective date."""
    rows = store["result"].join(meet_brief(store["meet"]), "meet_key")
    return rows.select("*", marks.mark_seconds(F.col("time")).alias("seconds"), marks.effective_date(F.col("swim_date"), F.col("meet_start")).alias("date"))


def list_meets(store: Store, page: int = 1, limit: int = 20, search: str | None = None, sort: str = "date", order: str = "desc", start: str | None = None, end: str | None = None) -> Page:
    """Competitions with their number of individual results and of athletes."""
    meets = f.between(f.like(store["meet"], "name", search), "start_date", start, end)
    counted = with_counts(meets, store["result"], "meet_key", "meet_key", {"result_count": F.count("*"), "athlete_count": F.count_distinct("athlete_key")})
    by = ordered({"date": "start_date", "name": "name"}, sort, order == "desc", "date")
    return paged(counted, [by, F.col("meet_key")], page, min(limit, 100))


def get_meet(store: Store, meet_key: int, age_group: str | None = None, gender: str | None = None) -> DataFrame:
    """One row per event of a competition, its results in order of placement."""
    rows = store["result"].where(F.col("meet_key") == meet_key).join(athlete_brief(store["athlete"]), "athlete_key", "left")
    parts = marks.event_parts(F.col("event"))
    rows = f.equal(f.equal(rows.withColumns({"age_group": parts["age_group"], "gender": parts["gender"]}), "age_group", age_group), "gender", gender)
    place = F.struct(F.col("placement").isNull().alias("unplaced"), "placement", "result_key")
    item = F.struct(place.alias("order"), "athlete", "time", "seed_time", "is_dq", "dq_code", "dq_description", "is_guest", "qualifier", "round")
    return rows.groupBy("event").agg(F.array_sort(F.collect_list(item)).alias("results")).orderBy("event")


def meet_by_round(store: Store, meet_key: int, search: str | None = None) -> DataFrame:
    """A competition's events by round (Final, Prelim, Results; others first), with medals, round labels and DQs."""
    rows = store["result"].where(F.col("meet_key") == meet_key)
    rows = rows.where(F.lower("event").contains(search.lower())) if search else rows
    item = F.struct(F.col("placement").isNull().alias("unplaced"), "placement", "result_key", "athlete_key", "time", marks.medal(F.col("placement"), F.col("is_dq")).alias("medal"))
    rounds = rows.groupBy("event", "round").agg(F.array_sort(F.collect_list(item)).alias("results"), F.count_if("is_dq").alias("dqs"))
    rank = F.array_position(F.array(F.lit("Final"), F.lit("Prelim"), F.lit("Results")), F.col("round"))
    return rounds.withColumn("round_rank", F.coalesce(rank, F.lit(0))).orderBy("event", "round_rank", "round")


def list_athletes(store: Store, page: int = 1, limit: int = 20, search: str | None = None, team: str | None = None, sort: str = "name", order: str = "asc", ages: tuple[int | None, int | None] = (None, None)) -> Page:
    rows = f.between(f.like(f.like(store["athlete"], "name", search), "team", team), "age", *ages)
    counts = {"result_count": F.count("*"), "meet_count": F.count_distinct("meet_key"), "latest_date": F.date_format(F.max("meet_start"), "yyyy-MM-dd")}
    counted = with_counts(rows, store["result"].join(meet_brief(store["meet"]), "meet_key"), "athlete_key", "athlete_key", counts)
    by = ordered({"name": "name", "team": "team", "age": "age"}, sort, order == "desc", "name")
    return paged(counted, [by, F.col("athlete_key")], page, min(limit, 100))


def athlete_bests(store: Store, athlete_key: int) -> DataFrame:
    """The best mark of each event; relays do not count, guests do."""
    rows = f.valid_marks(dated(store).where(F.col("athlete_key") == athlete_key), "is_dq", "seconds")
    return best_marks(rows, ["event"], "seconds", "date", "result_key", ["time", "meet_key"]).orderBy("event")


def athlete_recent(store: Store, athlete_key: int, n: int = 20) -> DataFrame:
    return dated(store).where(F.col("athlete_key") == athlete_key).orderBy(F.desc_nulls_first("meet_start"), "result_key").limit(n)


def athlete_stats(store: Store, athlete_key: int) -> DataFrame:
    rows = dated(store).where(F.col("athlete_key") == athlete_key)
    return rows.agg(
        F.count("*").alias("results"), F.count_distinct("event").alias("events"), F.count_distinct("meet_key").alias("meets"), F.count_if("is_dq").alias("dqs"),
        F.date_format(F.min("meet_start"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("meet_start"), "yyyy-MM-dd").alias("latest_date"),
    )


def list_events(store: Store, meet_key: int | None = None) -> DataFrame:
    """Names of individual and relay events, once each, in order."""
    names = [f.equal(store[t], "meet_key", meet_key).select("event") for t in ("result", "relay_result")]
    return names[0].union(names[1]).distinct().orderBy("event")


def relays_with_legs(store: Store, relays: DataFrame) -> DataFrame:
    """Relays with their legs in order; a leg without an athlete keeps the name it was swum under, with id 0."""
    legs = store["relay_leg"].join(relays.select("relay_key").distinct(), "relay_key", "left_semi")
    known = athlete_brief(store["athlete"])
    brief = F.struct(F.coalesce("athlete.id", F.lit(0)).alias("id"), F.coalesce("athlete.name", "athlete_name").alias("name"), F.coalesce("athlete.age", "age").alias("age"), F.col("athlete.team").alias("team"))
    fields = legs.join(known, "athlete_key", "left").select("relay_key", "leg_number", brief.alias("athlete"), "gender", "is_guest", "reaction_time", "split_time", "splits")
    arrays = nested(fields, "relay_key", [c for c in fields.columns if c != "relay_key"], "legs")
    return relays.join(arrays, "relay_key", "left")


def swum_by(store: Store, relays: DataFrame, name: str | None = None, athlete_key: int | None = None) -> DataFrame:
    """Relays with a leg that meets all given conditions, each relay once."""
    if not name and not athlete_key:
        return relays
    legs = f.equal(store["relay_leg"], "athlete_key", athlete_key)
    if name:
        known = store["athlete"].select("athlete_key", F.col("name").alias("known_name"))
        legs = f.like(legs.join(known, "athlete_key", "left").withColumn("any_name", F.coalesce("known_name", "athlete_name")), "any_name", name)
    return relays.join(legs.select("relay_key"), "relay_key", "left_semi")


def list_relays(store: Store, page: int = 1, limit: int = 50, meet_key: int | None = None, event: str | None = None, athlete: str | None = None) -> Page:
    rows = swum_by(store, f.like(f.equal(store["relay_result"], "meet_key", meet_key), "event", event), athlete)
    found = paged(rows, [F.asc_nulls_last("event"), F.asc_nulls_last("placement"), F.col("relay_key")], page, min(limit, 200))
    return Page(relays_with_legs(store, found.rows), found.page, found.limit, found.total)


def athlete_relays(store: Store, athlete_key: int) -> DataFrame:
    """One row per own leg, with the whole relay."""
    own = store["relay_leg"].where(F.col("athlete_key") == athlete_key).select("relay_key", F.col("leg_number").alias("own_leg"))
    return relays_with_legs(store, store["relay_result"].join(own, "relay_key"))


def combined(individual: DataFrame, relays: DataFrame) -> DataFrame:
    """Individual and relay results as one list, fields of the other kind null."""
    return individual.withColumn("type", F.lit("individual")).unionByName(relays.withColumn("type", F.lit("relay")), allowMissingColumns=True)


def combined_order(key: str) -> list[Column]:
    """Event, placement (none and 0 last), individual before relay, key."""
    place = F.when(F.coalesce("placement", F.lit(0)) == 0, UNPLACED).otherwise(F.col("placement"))
    return [F.asc_nulls_last("event"), place, F.col("type"), F.col(key)]


def list_all_results(store: Store, page: int = 1, limit: int = 50, athlete: str | None = None, athlete_key: int | None = None, meet_key: int | None = None, event: str | None = None, is_dq: bool | None = None) -> Page:
    def common(df: DataFrame) -> DataFrame:
        return f.flag(f.like(f.equal(df, "meet_key", meet_key), "event", event), "is_dq", is_dq)

    own = f.equal(common(store["result"]), "athlete_key", athlete_key)
    if athlete:
        own = own.join(f.like(store["athlete"], "name", athlete).select("athlete_key"), "athlete_key", "left_semi")
    relays = swum_by(store, common(store["relay_result"]), athlete, athlete_key)
    both = combined(own.withColumn("key", F.col("result_key")).drop("splits"), relays.withColumn("key", F.col("relay_key")).drop("splits"))
    return paged(both, combined_order("key"), page, min(limit, 200))


def list_results(
    store: Store, page: int = 1, limit: int = 50, athlete: str | None = None, athlete_key: int | None = None, meet_key: int | None = None, event: str | None = None,
    is_dq: bool | None = None, team: str | None = None, sort: str = "date", order: str = "desc", placement: tuple[int | None, int | None] = (None, None),
) -> Page:
    """Individual results. sort "time" orders the marks as text, "seconds" as numbers."""
    who = store["athlete"].select("athlete_key", "name", "age", "team")
    rows = f.flag(f.like(f.equal(f.equal(store["result"], "meet_key", meet_key), "athlete_key", athlete_key), "event", event), "is_dq", is_dq)
    rows = f.between(rows, "placement", *placement).drop("splits", "reaction_time")
    rows = rows.join(f.like(f.like(who, "name", athlete), "team", team), "athlete_key", "inner" if athlete or team else "left")
    rows = rows.join(meet_brief(store["meet"]), "meet_key", "left").withColumn("seconds", marks.mark_seconds(F.col("time")))
    by = ordered({"time": "time", "seconds": "seconds", "date": "meet_start", "placement": "placement", "event": "event"}, sort, order == "desc", "date")
    return paged(rows, [by, F.col("result_key")], page, min(limit, 200))


def get_result(store: Store, result_key: int) -> DataFrame:
    """One result with splits and reaction time."""
    return store["result"].where(F.col("result_key") == result_key).join(athlete_brief(store["athlete"]), "athlete_key", "left").join(meet_brief(store["meet"]), "meet_key", "left")


def progression(store: Store, athlete_keys: list[int], event: str, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Points and summary of one event, for one athlete or several to lay over each other."""
    rows = dated(store).where(F.col("athlete_key").isin(athlete_keys) & (F.col("event") == event))
    rows = f.between(f.valid_marks(rows, "is_dq", "seconds"), "date", start, end)
    points = series(rows, ["athlete_key"], "seconds", "date", "result_key").select("athlete_key", "nth", "date", "time", "seconds", "change", "best_so_far", "meet_name", "round")
    return points, series_summary(rows, ["athlete_key"], "seconds", "date", "result_key")


def athlete_history(store: Store, athlete_key: int) -> DataFrame:
    """Results and relays of an athlete, grouped by competition, the latest first."""
    own = store["result"].where(F.col("athlete_key") == athlete_key).select("meet_key", "event", "time", "placement", F.col("result_key").alias("key"))
    legs = store["relay_leg"].where(F.col("athlete_key") == athlete_key).select("relay_key")
    relays = store["relay_result"].join(legs, "relay_key", "left_semi").select("meet_key", "event", "time", "placement", F.col("relay_key").alias("key"))
    items = F.array_sort(F.collect_list(F.struct("event", "type", "time", "placement", "key")))
    return combined(own, relays).groupBy("meet_key").agg(items.alias("items")).join(meet_brief(store["meet"]), "meet_key").orderBy(F.desc_nulls_last("meet_start"), "meet_key")


def dashboard(store: Store, recent: int = 5) -> DataFrame:
    """Totals; recent_total counts the individual results of the latest competitions alone."""
    newest = store["meet"].orderBy(F.desc_nulls_last("start_date"), "meet_key").limit(recent).select("meet_key")
    totals = [store[t].agg(F.count("*").alias(n)) for t, n in (("meet", "meets"), ("athlete", "athletes"), ("result", "results"), ("relay_result", "relays"))]
    last = store["result"].join(newest, "meet_key", "left_semi").agg(F.count("*").alias("recent_total"))
    return one_row(*totals, last)


def one_row(*singles: DataFrame) -> DataFrame:
    """Global aggregates, one row each, side by side: joined on a constant, one row a side."""
    first, *others = [s.withColumn("__one", F.lit(1)) for s in singles]
    for other in others:
        first = first.join(other, "__one")
    return first.drop("__one")


def seed_gains(store: Store, meet_key: int, near: float = 1.0) -> DataFrame:
    """Marks against seeds of one competition: the gain in seconds, and whether a mark is within near seconds of its seed."""
    gain = marks.mark_seconds(F.col("seed_time")) - marks.mark_seconds(F.col("time"))
    rows = store["result"].where(F.col("meet_key") == meet_key).withColumn("gain", gain).where("gain IS NOT NULL")
    return rows.select("result_key", "athlete_key", "event", "seed_time", "time", "gain", (F.abs("gain") <= near).alias("is_near"))
