import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from splitboard.functions import documents as d
from splitboard.operators import catalog as c
from splitboard.operators import links, manifests

FOUND = "ord int, title string, page_title string, url string, readiness_status string, source_year string, source_date_label string, status_reason string, documents array<struct<url:string,filename:string,category:string>>"
EVENTS = "url string, title string, page_title string, readiness_status string, status_reason string, source_date_label string, pdf_count int, result_pdf_count int, category_counts map<string,int>, source_year string, is_currently_listed boolean, first_seen_at timestamp, last_seen_in_index_at timestamp, last_checked_at timestamp, last_changed_at timestamp"
DOCS = "event_url string, url string, filename string, category string, first_seen_at timestamp, last_seen_at timestamp, last_checked_at timestamp, is_currently_listed boolean"
INDEX = "https://Example.com/events/"


def found(spark, *rows):
    return spark.createDataFrame([(i, t, None, u, s, None, None, None, docs) for i, (t, u, s, docs) in enumerate(rows)], FOUND)


def run(spark, state, discovered, day):
    rule = spark.createDataFrame([(True, INDEX)], "enabled boolean, index_url string")
    done = c.run_discovery(rule, *state, discovered, F.to_timestamp(F.lit(f"2026-01-{day:02d}")))
    counts = {k: v for k, v in done.counters.first().asDict().items() if v}
    keep = lambda df, schema: spark.createDataFrame(df.drop("change_type").select([x.split()[0] for x in schema.split(", ")]).collect(), schema)
    return (keep(done.events, EVENTS), keep(done.documents, DOCS)), counts, done


def test_refreshes(spark):
    state = spark.createDataFrame([], EVENTS), spark.createDataFrame([], DOCS)
    pdf = ("/a/Result.pdf#v1", "Result.pdf", "overall_results")
    first = found(spark, ("Meet 2026", "/event/#section", "results_available", [pdf]), ("Other", "/event", "no_documents_found", [("/a/Result.pdf", "Renamed.pdf", "overall_results")]))
    state, counts, done = run(spark, state, first, 1)
    assert counts == {"events_discovered": 1, "events_with_results": 1, "added_events": 1, "action_required_count": 1, "added_documents": 1}
    event = done.events.first()
    assert (event.url, event.title, event.source_year, event.readiness_status, event.category_counts) == ("https://example.com/event", "Meet 2026", "2026", "results_available", {"overall_results": 1})
    assert done.documents.first().filename == "Renamed.pdf"
    state, counts, _ = run(spark, state, first, 2)
    assert counts == {"events_discovered": 1, "events_with_results": 1, "unchanged_events": 1, "action_required_count": 1, "unchanged_documents": 1}
    state, counts, done = run(spark, state, found(spark), 3)
    assert counts == {"absent_from_index_events": 1} and not done.events.first().is_currently_listed and done.documents.first().is_currently_listed
    state, counts, _ = run(spark, state, found(spark), 4)
    assert counts == {}
    state, counts, done = run(spark, state, found(spark, ("Meet 2026", "/event", "results_available", [])), 5)
    assert counts == {"events_discovered": 1, "events_with_results": 1, "updated_events": 1, "updated_documents": 1}
    assert str(done.events.first().first_seen_at)[:10] == "2026-01-01" and str(done.events.first().last_changed_at)[:10] == "2026-01-05"


def test_refusals_are_audited(spark):
    empty = spark.createDataFrame([], EVENTS), spark.createDataFrame([], DOCS)
    now = F.current_timestamp()
    bad = found(spark, ("A", "/a", "results_available", []), ("B", "/b", "sideways", []))
    done, audit = c.audited(spark, 1, 7, "{}", now, now, lambda: run(spark, empty, bad, 1)[2])
    assert done is None and audit.first().status == "failed" and "sideways" in audit.first().error_message
    with pytest.raises(c.RefusedRun):
        c.run_discovery(spark.createDataFrame([(False, INDEX)], "enabled boolean, index_url string"), *empty, bad, now)
    done, audit = c.audited(spark, 1, 8, "{}", now, now, lambda: run(spark, empty, found(spark), 1)[2])
    assert audit.first().status == "succeeded" and '"added_events":0' in audit.first().summary


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.COM/a%20b/?b=2&a=1#x", "https://example.com/a%20b?a=1&b=2"), ("https://e.com/", "https://e.com/"), ("/x/y/", "https://example.com/x/y"), ("x", "https://example.com/events/x"),
        ("//h.org/p", "https://h.org/p"), ("https://e.com/a+b/c%2Fd?q=a+b&e=", "https://e.com/a%2Bb/c/d?e=&q=a+b"), (" https://e.com/é~ ", "https://e.com/%C3%A9~"), ("", "https://example.com/events"),
    ],
)
def test_canonical_urls(spark, url, want):
    got = spark.range(1).select(d.canonical_url(F.lit(url), F.lit(INDEX))).first()[0]
    assert got == want


def test_file_names(spark):
    names = {
        "day-1-start-list.pdf": "start_list", "Medal-Tally.pdf": "medal_tally", "finals-by-age-group-day1.pdf": "age_group_results", "56th-Championships-Results.pdf": "overall_results",
        "national-championships.pdf": "event_information", "notes.pdf": "other_pdf", "event-notes.pdf": "other_pdf",
    }
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", d.category(F.col("n")).alias("c"), d.category(F.col("n"), True).alias("x")).collect()
    assert {r.n: r.c for r in rows} == names and {r.x for r in rows if r.n == "event-notes.pdf"} == {"event_information"}


def test_pages(spark):
    html = """<title>T &amp; x</title><H1 class=a>Big <b>Meet</b>
      2026</h1><a href="/swimming/events/one/">One</a><a href='/swimming/events/one/'>Again</a><a href="/about">About</a><a href="/x">56th SNAG</a><a href="https://other.org/swimming/events/z">Z</a>
      <a href="/files/day1-results.pdf">R</a> see https://e.com/files/day1-results.pdf and https://e.com/files/medal%20tally.pdf"""
    pages = spark.createDataFrame([(1, "https://e.com/swimming/", html, None), (2, "https://e.com/b", "files to be uploaded: coming soon", None), (3, "https://e.com/c", None, "timeout"), (4, "https://e.com/d", "", None)], "page int, page_url string, html string, error string")
    assert [r.url for r in links.event_links(pages, ["page"]).orderBy("pos").collect()] == ["https://e.com/swimming/events/one/", "https://e.com/x"]
    rows = {r.page: r for r in links.inspect(pages, ["page"]).collect()}
    assert rows[1].page_title == "Big Meet 2026" and rows[1].status == "results_available" and rows[1].category_counts == {"medal_tally": 1, "overall_results": 1}
    assert [rows[i].status for i in (2, 3, 4)] == ["pending_no_documents", "error:timeout", "no_documents_found"]
    part = spark.range(1).select(d.focused(F.lit("abcSTARTxyzENDrest"), ["START", "NO"], ["END"], 2)).first()[0]
    assert part == "bcSTARTxyz"


def test_manifest_diff(spark):
    schema = "ord int, url string, filename string, category string, sha256 string, saved string"
    old = spark.createDataFrame([(0, "u1", "a", "overall_results", "h1", None), (1, "u2", "b", None, "h2", None), (2, "u3", "c", "other_pdf", "h3", None), (3, "u5", "e", "x", None, None)], schema)
    new = spark.createDataFrame([(0, "u1", "a", "overall_results", "H1", None), (1, "u2", "b", None, "h2", None), (2, "u3", "c", "medal_tally", "h3", None), (3, "u4", "d", "overall_results", "h4", None)], schema)
    changes = manifests.diff(old, new)
    assert sorted((r.change_type, r.url, r.importable) for r in changes.collect()) == [("added", "u3", False), ("added", "u4", True), ("category", "u3", False), ("changed", "u1", True), ("removed", "u3", True)]
    assert tuple(manifests.summary(changes).first()) == (2, 1, 1, 1, 1, 1)
    fetched = spark.createDataFrame([(0, "u", "a.pdf", "x", b"1"), (1, "u", "b.pdf", "x", b"2")], "ord int, url string, filename string, category string, content binary")
    before = spark.createDataFrame([(0, "x", "a.pdf", "other")], "ord int, category string, filename string, sha256 string")
    one, two = manifests.build(fetched, before, "root").orderBy("ord").collect()
    assert one.filename_reused_with_new_hash and one.filename_saved == f"a-{one.sha256[:8]}.pdf" and two.saved == "root/x/b.pdf"


def test_arrivals_are_loaded_once(spark, tmp_path):
    from splitboard.sources.store import Store
    from splitboard.streaming.arrivals import ARRIVALS, load_arrivals
    from tests.test_sheets import PAGE

    root = f"{tmp_path}/{uuid.uuid4().hex}"
    store, told = Store(spark, f"{root}/store"), []
    row = ("r", b"%PDF", "results.pdf", "watch", None, None, None, 0, [(1, PAGE)])
    spark.createDataFrame([row], ARRIVALS).coalesce(1).write.parquet(f"{root}/in")
    for _ in range(2):
        load_arrivals(spark, f"{root}/in", store, f"{root}/checkpoint", told.append).awaitTermination(120)
    assert [x.inserted for x in told] == [6] and store["result"].count() == 6


def test_a_batch_that_died_is_loaded_anew(spark, tmp_path, monkeypatch):
    """A stream that dies at a late write, its restart, and a restart without its checkpoint leave each row once, after a replacing load, too."""
    from splitboard.operators.ingest import load_sheets
    from splitboard.sources.store import Store
    from splitboard.streaming.arrivals import ARRIVALS, load_arrivals
    from tests.test_ingest import batch
    from tests.test_sheets import PAGE, RELAYS

    root = f"{tmp_path}/{uuid.uuid4().hex}"
    store, told = Store(spark, f"{root}/store", buckets=4), []
    load_sheets(store, *batch(spark, "before", page=PAGE.replace("Lantern", "Other")), replace=True)
    rows = [(f"r{i}", f"%PDF {i}".encode(), f"results-{i}.pdf", "watch", None, None, None, i, [(1, PAGE + "\n" + RELAYS)]) for i in range(2)]
    spark.createDataFrame(rows, ARRIVALS).coalesce(1).write.parquet(f"{root}/in")
    real = store.add

    def dying(name, df, run_id):
        real(name, df, run_id)
        if name == "relay_result":
            raise RuntimeError("the driver dies here")

    monkeypatch.setattr(store, "add", dying)
    with pytest.raises(StreamingQueryException):
        load_arrivals(spark, f"{root}/in", store, f"{root}/checkpoint", told.append, name="watch").awaitTermination(120)
    monkeypatch.setattr(store, "add", real)
    store.refresh()
    assert told == [] and store["result"].count() == 6 and store["relay_leg"].count() == 0
    for checkpoint in ("checkpoint", "another"):
        load_arrivals(spark, f"{root}/in", store, f"{root}/{checkpoint}", told.append, name="watch").awaitTermination(120)
    assert [(x.inserted, x.duplicates) for x in told] == [(10, 10)]
    fresh = Store(spark, f"{root}/store")
    assert fresh["result"].count() == 13 and fresh["relay_leg"].count() == 4 and fresh["ingestion_run"].where("status = 'succeeded'").count() == 2
    assert fresh.committed("watch", 0) and not fresh.committed("watch", 1) and not fresh.committed("other", 0)


def test_lists(spark):
    sites = spark.createDataFrame([(1, "s"), (2, "t")], "site_id long, name string")
    rules = spark.createDataFrame([(10, 1, "r"), (11, 1, "q")], "rule_id long, site_id long, name string")
    runs = spark.createDataFrame([(1, 10, 5), (2, 10, 7)], "run_id long, rule_id long, started_at long")
    listed = c.list_sources(sites, rules, runs).collect()
    assert [(x.rule_id, x.last_run and x.last_run.run_id) for x in listed[0].rules] == [(10, 2), (11, None)] and listed[1].rules is None
    assert c.list_monitor_runs(runs, 1).first().run_id == 2
    assert c.with_defaults(rules, spark.createDataFrame([(10, 1, "zzz"), (12, 2, "new")], rules.schema), ["rule_id"]).count() == 3
    events = spark.createDataFrame([("u", "t", "2026", True, "results_available", 1), ("v", "t", None, False, "no_documents_found", 0)], "url string, title string, source_year string, is_currently_listed boolean, readiness_status string, result_pdf_count int")
    docs = spark.createDataFrame([("u", "d")], "event_url string, url string")
    assert [r.document_count for r in c.list_source_events(events, docs).collect()] == [1, 0]
    assert c.catalog_totals(sites, rules, events, docs).first().result_ready == 1
    picked = links.archive_selection(spark.createDataFrame([(0, "56th SNAG!", None, "u", "x"), (1, "", None, "v", "x")], "ord int, title string, page_title string, url string, status string"), [], ["x"])
    assert [r.target for r in picked.collect()] == ["56th-snag", "event"]


def test_relative_urls_climb(spark):
    from urllib.parse import urljoin

    bases = ["http://a/b/c/d", "http://a", "http://a/b/", "https://h.example/x/y.html?q=../z"]
    links = ["../g", "../../g", "../../../g", "./g", "g/./h", "g/../h", "/x/../y", "..", ".", "../", "g/..", "/..", "g?x=../y", "g#s/../t", "g", "/p/q", "//h/..", "http://k/../m"]
    rows = spark.createDataFrame([(b, x, urljoin(b, x)) for b in bases for x in links], "base string, link string, want string")
    assert rows.select("*", d.resolved(F.col("link"), F.col("base")).alias("got")).where("NOT got <=> want").collect() == []
