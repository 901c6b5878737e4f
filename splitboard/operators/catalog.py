"""Change tracking of a catalog: discovered events and documents against the stored ones, and the run's counters.

A refresh is one full outer comparison per table and gives new snapshots; nothing is written before all of it is known to be valid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitboard.functions.documents import READINESS, canonical_url, year
from splitboard.operators.analytics import histogram, latest, nested
from splitboard.operators.entries import one_row

#: Categories of the default policy.
DEFAULT_POLICY = {
    "cadence": "manual_only_v0", "schedule": "not_configured", "active_window": "manual_only_v0", "stale_window": "manual_only_v0",
    "categories_to_archive": ["event_information", "start_list", "overall_results", "age_group_results", "medal_tally", "other_pdf"],
    "categories_to_preview": ["overall_results", "other_pdf"], "categories_allowed_for_import": ["overall_results", "other_pdf"], "auto_import_policy": "preview_only",
}

#: The fields whose change is an update.
COMPARED = ["title", "page_title", "readiness_status", "pdf_count", "result_pdf_count", "category_counts"]


class RefusedRun(ValueError):
    """The rule is missing or disabled, or a discovered row is not valid; nothing was written."""


def first_present(column: str) -> Column:
    return F.min(F.when(F.col(column).isNotNull(), F.struct("ord", F.col(column).alias("v"))))["v"].alias(column)


def normalized(discovered: DataFrame, index_url: str) -> tuple[DataFrame, DataFrame]:
    """(events, documents) of discovered (ord, title, page_title, url, readiness_status, source_year, source_date_label, status_reason, documents).

    URLs in one form; of rows for one event the first title and the first present details stay, results_available wins;
    of documents with one url the last stays. Counts are made anew from the documents.
    """
    rows = discovered.withColumn("url", canonical_url(F.col("url"), F.lit(index_url)))
    docs = rows.select("ord", F.col("url").alias("event_url"), F.posexplode("documents").alias("pos", "d"))
    docs = docs.select("event_url", canonical_url(F.col("d.url"), F.col("event_url")).alias("url"), F.struct("ord", "pos", F.col("d.filename").alias("filename"), F.col("d.category").alias("category")).alias("d"))
    documents = docs.groupBy("event_url", "url").agg(F.max("d").alias("d")).select("event_url", "url", "d.filename", "d.category")
    ready = F.when(F.bool_or(F.col("readiness_status") == "results_available"), "results_available").otherwise(F.min(F.struct("ord", "readiness_status"))["readiness_status"])
    events = rows.groupBy("url").agg(
        F.min(F.struct("ord", "title"))["title"].alias("title"), first_present("page_title"), ready.alias("readiness_status"), first_present("source_year"), first_present("source_date_label"), first_present("status_reason")
    )
    counts = histogram(documents, ["event_url"], "category", "category_counts").withColumnRenamed("event_url", "url")
    sizes = documents.groupBy(F.col("event_url").alias("url")).agg(F.count("*").cast("int").alias("pdf_count"), F.count_if(F.col("category") == "overall_results").cast("int").alias("result_pdf_count"))
    events = events.join(counts.hint("merge"), "url", "left").join(sizes.hint("merge"), "url", "left")  # from a generator: no automatic broadcast
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    return events.withColumns({"category_counts": F.coalesce("category_counts", none), "pdf_count": F.coalesce("pdf_count", F.lit(0)), "result_pdf_count": F.coalesce("result_pdf_count", F.lit(0))}), documents


def comparable(column: Column, name: str) -> Column:
    return F.to_json(F.array_sort(F.map_entries(column))) if name == "category_counts" else column


@dataclass(frozen=True)
class Refresh:
    events: DataFrame
    documents: DataFrame
    counters: DataFrame


def refresh(events: DataFrame, documents: DataFrame, found_events: DataFrame, found_documents: DataFrame, now: Column) -> Refresh:
    """The catalog after a run: each row with its change_type, and the counters in one row.

    events: added, updated (one of seven fields differs, being listed among them), unchanged, absent (newly unlisted) or gone
    (unlisted before). documents, of found events alone: added, updated (listed again, other details, or newly absent), unchanged, gone;
    those of other events are kept. A change of documents renews an event's last_changed_at and does not make it updated.
    """
    doc = documents.select(*[F.col(c).alias(f"o_{c}") for c in ("event_url", "url", "filename", "category", "is_currently_listed", "first_seen_at", "last_seen_at", "last_checked_at")])
    scope = found_events.select(F.col("url").alias("s_url")).hint("merge")  # may come from a generator: no automatic broadcast
    inside = doc.join(scope, doc["o_event_url"] == scope["s_url"], "left_semi")
    both = found_documents.hint("merge").join(inside, (found_documents["event_url"] == inside["o_event_url"]) & (found_documents["url"] == inside["o_url"]), "full_outer")
    new, gone = F.col("o_url").isNull(), F.col("url").isNull()
    differs = ~F.col("filename").eqNullSafe(F.col("o_filename")) | ~F.col("category").eqNullSafe(F.col("o_category"))
    kind = F.when(new, "added").when(gone, F.when(F.col("o_is_currently_listed"), "updated").otherwise("gone")).when(differs | ~F.col("o_is_currently_listed"), "updated").otherwise("unchanged")
    pick = lambda c: F.when(gone, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c)
    touched = ~gone | F.col("o_is_currently_listed")
    docs_after = both.select(
        pick("event_url"), pick("url"), pick("filename"), pick("category"), F.coalesce("o_first_seen_at", now).alias("first_seen_at"), F.when(gone, F.col("o_last_seen_at")).otherwise(now).alias("last_seen_at"),
        F.when(touched, now).otherwise(F.col("o_last_checked_at")).alias("last_checked_at"), (~gone).alias("is_currently_listed"), kind.alias("change_type"),
    )
    outside = doc.join(scope, doc["o_event_url"] == scope["s_url"], "left_anti").select(*[F.col(c).alias(c[2:]) for c in doc.columns]).withColumn("change_type", F.lit("kept"))
    all_docs = docs_after.unionByName(outside)

    changed_docs = docs_after.where(F.col("change_type").isin("added", "updated")).select(F.col("event_url").alias("c_url")).distinct()
    fields = [*COMPARED, "url", "source_year", "source_date_label", "status_reason", "is_currently_listed", "first_seen_at", "last_seen_in_index_at", "last_checked_at", "last_changed_at"]
    old = events.select(*[F.col(c).alias(f"o_{c}") for c in fields])
    both = found_events.hint("merge").join(old, found_events["url"] == old["o_url"], "full_outer").join(changed_docs.hint("merge"), F.col("url") == F.col("c_url"), "left")
    differs = ~F.col("o_is_currently_listed")
    for c in COMPARED:
        differs = differs | ~comparable(F.col(c), c).eqNullSafe(comparable(F.col(f"o_{c}"), c))
    kind = F.when(new, "added").when(gone, F.when(F.col("o_is_currently_listed"), "absent").otherwise("gone")).when(differs, "updated").otherwise("unchanged")
    both = both.withColumn("change_type", kind)
    moved = F.col("change_type").isin("added", "updated", "absent") | F.col("c_url").isNotNull()
    checked = F.col("change_type") != "gone"
    source_year = F.when(gone, F.col("o_source_year")).otherwise(F.coalesce("source_year", "o_source_year", year(F.col("title"))))
    events_after = both.select(
        *[pick(c) for c in ("url", "title", "page_title", "readiness_status", "status_reason", "source_date_label", "pdf_count", "result_pdf_count", "category_counts")], source_year.alias("source_year"),
        (~gone).alias("is_currently_listed"), F.coalesce("o_first_seen_at", now).alias("first_seen_at"), F.when(gone, F.col("o_last_seen_in_index_at")).otherwise(now).alias("last_seen_in_index_at"),
        F.when(checked, now).otherwise(F.col("o_last_checked_at")).alias("last_checked_at"), F.when(moved, now).otherwise(F.col("o_last_changed_at")).alias("last_changed_at"), "change_type",
    )
    return Refresh(events_after, all_docs, counters(events_after, all_docs))


def counters(events: DataFrame, documents: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("change_type") == kind)
    seen = F.col("is_currently_listed")
    e = events.agg(
        F.count_if(seen).alias("events_discovered"), F.count_if(seen & (F.col("readiness_status") == "results_available")).alias("events_with_results"), of("added").alias("added_events"), of("updated").alias("updated_events"),
        of("unchanged").alias("unchanged_events"), of("absent").alias("absent_from_index_events"), F.count_if(seen & (F.col("result_pdf_count") > 0)).alias("action_required_count"),
    )
    return one_row(e, documents.agg(of("added").alias("added_documents"), of("updated").alias("updated_documents"), of("unchanged").alias("unchanged_documents")))


def run_discovery(rule: DataFrame, events: DataFrame, documents: DataFrame, discovered: DataFrame, now: Column) -> Refresh:
    """One rule's refresh. Raises RefusedRun for a missing or disabled rule and for an unknown readiness; the caller writes a failed run then."""
    row = rule.first()
    if row is None or not row.enabled:
        raise RefusedRun("the rule is missing or disabled")
    wrong = discovered.where(~F.coalesce(F.col("readiness_status").isin(READINESS), F.lit(False))).select("readiness_status").first()
    if wrong is not None:
        raise RefusedRun(f"unknown readiness status: {wrong.readiness_status}")
    found_events, found_documents = normalized(discovered, row.index_url)
    return refresh(events, documents, found_events, found_documents, now)


def audited(spark, rule_id: int, run_id: int, snapshot: str, started: Column, finished: Column, work) -> tuple[Refresh | None, DataFrame]:
    """work() and the audit row of its run: succeeded with counters and summary, or failed with the message of a refusal or of an error of the source.

    Other errors are the program's own and are raised.
    """
    base = [F.lit(run_id).cast("long").alias("run_id"), F.lit(rule_id).cast("long").alias("rule_id"), F.lit(snapshot).alias("rule_config_snapshot"), started.alias("started_at"), finished.alias("finished_at")]
    try:
        found = work()
    except (RefusedRun, PySparkException, OSError) as error:
        message = f"{type(error).__name__}: {error}"
        return None, spark.range(1).select(*base, F.lit("failed").alias("status"), F.lit(message).alias("error_message"))
    summary = F.to_json(F.struct(*sorted(found.counters.columns)))
    return found, found.counters.select(*base, F.lit("succeeded").alias("status"), "*", F.lit(None).cast("string").alias("error_message"), summary.alias("summary"))


def with_defaults(stored: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the default rows whose keys are not there yet."""
    return stored.unionByName(defaults.join(stored.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def list_sources(sites: DataFrame, rules: DataFrame, runs: DataFrame) -> DataFrame:
    """Sites with their rules, each with its latest run."""
    last = latest(runs, ["rule_id"], [F.desc_nulls_last("started_at"), F.desc("run_id")])
    fields = [c for c in last.columns if c != "rule_id"]
    joined = rules.join(last.select("rule_id", F.struct(*fields).alias("last_run")), "rule_id", "left")
    arrays = nested(joined, "site_id", ["rule_id", *[c for c in joined.columns if c not in ("site_id", "rule_id")]], "rules")
    return sites.join(arrays, "site_id", "left").orderBy("site_id")


def list_source_events(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Events with their number of documents: listed ones first, then by year and title."""
    counts = documents.groupBy(F.col("event_url").alias("url")).agg(F.count("*").alias("document_count"))
    rows = events.join(counts, "url", "left").withColumn("document_count", F.coalesce("document_count", F.lit(0)))
    return rows.orderBy(F.desc("is_currently_listed"), F.desc_nulls_first("source_year"), "title", "url")


def list_monitor_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.orderBy(F.desc_nulls_first("started_at"), F.desc("run_id")).limit(n)


def catalog_totals(sites: DataFrame, rules: DataFrame, events: DataFrame, documents: DataFrame) -> DataFrame:
    listed = F.col("is_currently_listed")
    return one_row(
        sites.agg(F.count("*").alias("sources")), rules.agg(F.count("*").alias("rules")), documents.agg(F.count("*").alias("documents")),
        events.agg(F.count("*").alias("events"), F.count_if(F.col("readiness_status") == "results_available").alias("result_ready"), F.count_if(listed & (F.col("result_pdf_count") > 0)).alias("action_required")),
    )
