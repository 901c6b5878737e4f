import uuid

import pytest
from pyspark.errors import AnalysisException

from splitboard.operators import entries as e
from splitboard.operators import ingest as g
from splitboard.sources.store import Store, among
from tests.test_sheets import PAGE, RELAYS

DOCS = "doc_id string, content binary, filename string, source_type string, source_label string, source_url string, source_page_url string, ord int"
PAGES = "doc_id string, page_no int, text string"


def batch(spark, *names, page=PAGE + "\n" + RELAYS):
    docs = [(n, f"%PDF {n}".encode(), f"{n}.pdf", "upload", None, None, None, i) for i, n in enumerate(names)]
    pages = [(n, 1, page) for n in names]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(pages, PAGES)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/{uuid.uuid4().hex}", buckets=16)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """A store with one load, for tests that only read."""
    store = Store(spark, f"{tmp_path_factory.mktemp('store')}/{uuid.uuid4().hex}", buckets=16)
    g.load_sheets(store, *batch(spark, "day1-results"))
    return store


def test_load_twice_then_replace(spark, store):
    docs, pages = batch(spark, "day1-results")
    one = g.load_sheets(store, docs, pages)
    assert (one.run_id, one.status, one.inserted, one.duplicates, one.created_athletes) == (1, "succeeded", 10, 0, 9)
    two = g.load_sheets(store, docs, pages)
    assert (two.run_id, two.inserted, two.duplicates, two.created_athletes) == (2, 0, 10, 0)
    assert store["result"].count() == 7 and store["relay_leg"].count() == 4 and store["raw_document"].count() == 1
    assert store["source_reference"].count() == store["document_classification"].count() == 1
    meet = store["meet"].first()
    assert (meet.name, str(meet.start_date), str(meet.end_date)) == ("Lantern Cup 2025", "2025-07-04", "2025-07-06")
    first = store["result"].where("placement = 1 AND event LIKE '%Backstroke'").first()
    assert first.round == "Final" and str(first.swim_date) == "2025-07-05" and '"distance":50' in first.splits

    shorter = batch(spark, "day1-results-v2", page=PAGE)
    three = g.load_sheets(store, *shorter, replace=True)
    assert (three.inserted, three.duplicates, three.replaced) == (6, 0, 10)
    assert store["result"].count() == 6 and store["relay_result"].count() == 0 and store["relay_leg"].count() == 0  # the new document has no relays
    store.vacuum()
    assert store["result"].count() == 6 and store["relay_leg"].count() == 0 and store.numbers("relay_leg") == []
    assert [r.status for r in store["ingestion_run"].orderBy("run_id").collect()] == ["succeeded"] * 3


def test_deleted_competitions_may_come_back(spark, store):
    docs, pages = batch(spark, "day1-results")
    g.load_sheets(store, docs, pages)
    meet = store["meet"].select("meet_key")
    other = batch(spark, "other-results", page=PAGE.replace("Lantern Cup", "Other Cup"))
    g.load_sheets(store, *other)
    assert g.delete_meets(store, meet) == {"relay_leg": 4, "relay_result": 3, "result": 7, "meet": 1}
    assert [r.name for r in store["meet"].collect()] == ["Other Cup 2025"] and store["result"].count() == 6 and store["relay_leg"].count() == 0
    assert Store(spark, store.root)["result"].count() == 6 and store["athlete"].count() == 9
    store.vacuum()
    assert len(store.numbers("result")) == 1 and store.numbers("relay_result") == [] and store["result"].count() == 6
    back = g.load_sheets(store, docs, pages)
    assert (back.inserted, back.created_athletes) == (10, 0) and store["result"].count() == 13 and store["meet"].count() == 2
    assert g.delete_meets(store, meet.limit(0)) == {"relay_leg": 0, "relay_result": 0, "result": 0, "meet": 0} and store["result"].count() == 13


def test_a_run_that_dies_leaves_nothing(spark, store, monkeypatch):
    """Whatever it dies at, nothing of it is read, the audit says so, and the next run does it all; vacuum takes the rest away."""
    docs, pages = batch(spark, "day1-results")
    real = store.add

    def dying(at):
        def add(name, rows, run_id):
            real(name, rows, run_id)
            if name == at:
                spark.read.parquet("/no/such/place").count()

        return add

    for at in ("source_reference", "result"):
        monkeypatch.setattr(store, "add", dying(at))
        with pytest.raises(AnalysisException):
            g.load_sheets(store, docs, pages)
        monkeypatch.setattr(store, "add", real)
        assert store["result"].count() == store["relay_leg"].count() == store["source_reference"].count() == store["raw_document"].count() == store["athlete"].count() == 0
    done = g.load_sheets(store, docs, pages)
    assert (done.inserted, done.created_athletes) == (10, 9)
    for _ in range(2):
        assert store["result"].count() == 7 and store["relay_result"].count() == 3 and store["relay_leg"].count() == 4
        assert store["document_classification"].count() == store["source_reference"].count() == store["parse_job"].count() == 1
        store.vacuum()
    assert spark.read.parquet(f"{store.root}/result").select("ingestion_run_id").distinct().count() == 1
    assert [(r.run_id, r.status, (r.validation_errors or "")[:8]) for r in store["ingestion_run"].orderBy("run_id").collect()] == [(1, "failed", "Analysis"), (3, "failed", "Analysis"), (5, "succeeded", "")]


def test_a_load_writes_the_buckets_it_touches(spark, store):
    people = spark.createDataFrame([(f"N{i}", "T", 9) for i in range(500)], "name string, team string, age int")
    people = g.upsert_athletes(store["athlete"], people)
    run = store.begin()
    store.put("athlete", people, store.buckets_of("athlete", people), run)
    store.commit(run)
    assert len(store.numbers("athlete/run=1")) == store.buckets
    docs, pages = batch(spark, "day1-results", page=PAGE)
    g.load_sheets(store, docs, pages)
    assert 1 <= len(store.numbers("athlete/run=2")) <= 6 < store.buckets and store["athlete"].count() == 505
    plan = store.in_buckets("athlete", [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan[plan.index("PartitionFilters") :]
    store.vacuum()
    assert Store(spark, store.root, buckets=3)["athlete"].count() == 505  # the log knows the number of buckets
    assert len(store.numbers("athlete/run=1")) + len(store.numbers("athlete/run=2")) == store.buckets


def test_known_hashes_are_sought_in_the_competitions_of_the_batch(spark, loaded):
    store = loaded
    rows = spark.createDataFrame([(store["meet"].first().meet_key, store["result"].first().content_hash, 1), (5, "new", 2), (5, "new", 1)], "meet_key long, content_hash string, pos int")
    new, old = g.split_new(rows, store["result"], ["pos"])
    assert [tuple(r) for r in new.collect()] == [(5, "new", 1)] and sorted(r.pos for r in old.collect()) == [1, 2]
    plan = among(store["result"], "meet_key", rows)._jdf.queryExecution().toString()
    assert "PartitionFilters: [meet_key" in plan or "PartitionFilters: [isnotnull(meet_key" in plan


def test_many_errors_have_a_bounded_summary(spark):
    jobs = spark.range(1000).selectExpr("IF(id % 2 = 0, concat('reason ', id % 100), NULL) AS error_message")
    told = g.error_summary(jobs, 3)
    assert told == "reason 0 (10); reason 10 (10); reason 12 (10); others (470)" and g.error_summary(jobs.limit(0)) is None


def test_archive_preview(spark):
    page = PAGE + "\n" + RELAYS
    manifest = spark.createDataFrame(
        [(1, "day-1-results.pdf", "overall_results", "a/1"), (2, "medal.pdf", "medal_tally", "a/2"), (3, "day-2-results.pdf", "overall_results", "a/3"), (4, "day-3-results.pdf", "overall_results", None), (5, "x.pdf", "other_pdf", "a/5")],
        "ord int, filename string, category string, saved string",
    )
    pages = spark.createDataFrame([("a/1", 1, page), ("a/2", 1, page), ("a/5", 1, "HY-TEK's MEET MANAGER\nnoise\nnoise")], "saved string, page_no int, text string")
    rows, totals = g.archive_preview(manifest, pages)
    assert [(r.ord, r.status, r.events, r.individual, r.relays, r.people) for r in rows.orderBy("ord").collect()] == [(1, "parsed", 3, 7, 3, 9), (3, "no_text", 0, 0, 0, 0), (5, "low_confidence", 0, 0, 0, 0)]
    assert totals.first().asDict() == {"files": 3, "failed": 2, "events": 3, "individual": 7, "relays": 3, "people": 9}


def test_rejections_are_audited(spark, store):
    docs = spark.createDataFrame([("m", b"x", "medal-tally.pdf", "u", None, None, None, 0), ("n", b"y", "results.pdf", "u", None, None, None, 1), ("w", b"z", "other.pdf", "u", None, None, None, 2)], DOCS)
    pages = spark.createDataFrame([("m", 1, PAGE), ("n", 1, "no sheet"), ("w", 1, "HY-TEK's MEET MANAGER\nnoise\nnoise")], PAGES)
    done = g.load_sheets(store, docs, pages)
    assert done.status == "failed" and done.inserted == 0
    jobs = {r.doc_id: (r.status, r.error_message.split(";")[0].split(":")[0]) for r in done.jobs.collect()}
    assert jobs == {"m": ("rejected", "not for import"), "n": ("failed", "no known format"), "w": ("rejected", "low confidence")}
    run = store["ingestion_run"].first()
    assert run.status == "failed" and "medal_tally" in run.validation_errors
    assert store["parse_job"].count() == 3 and store["result"].count() == 0


def test_documents_and_references(spark, store):
    same = [(str(i), b"%PDF same", name, "crawl", None, url, None, i) for i, (name, url) in enumerate([(None, "u1"), ("results.pdf", "u1"), ("results.pdf", "u2")])]
    docs = spark.createDataFrame(same, DOCS)
    docs = g.hashed_documents(docs)
    row = g.register_documents(docs, store["raw_document"], "a").first()
    assert row.original_filename == "results.pdf" and row.category == "overall_results" and row.is_valid_pdf and row.storage_path == f"a/sha256/{row.sha256[:2]}/{row.sha256}.pdf"
    references = g.register_references(docs, store["source_reference"])
    assert references.count() == 3  # the first has no file name
    run = store.begin()
    store.add("source_reference", references, run)
    store.commit(run)
    assert g.register_references(docs, store["source_reference"]).count() == 0


def test_ages_rise_and_null_teams_are_equal(spark, store):
    seen = spark.createDataFrame([("A", None, 0), ("A", None, 11), ("A", "T", 12)], "name string, team string, age int")
    first = g.upsert_athletes(store["athlete"], seen)
    assert sorted((r.team or "", r.age, r.created) for r in first.collect()) == [("", 11, True), ("T", 12, True)]
    later = spark.createDataFrame([("A", "T", 9), ("A", None, 13)], "name string, team string, age int")
    assert sorted((r.team or "", r.age, r.created) for r in g.upsert_athletes(first.drop("created"), later).collect()) == [("", 13, False), ("T", 12, False)]


def test_preview_writes_nothing(spark):
    _, pages = batch(spark, "p")
    events, sample, totals = g.preview(pages)
    assert {(r.event_no, r.individual, r.relays) for r in events.collect()} == {("12", 6, 0), ("13", 1, 0), ("20", 0, 3)}
    assert sample.count() == 7 and totals.first().people == 9


def test_entries_over_a_loaded_store(spark, loaded):
    store = loaded
    meet = store["meet"].first().meet_key
    listed = e.list_meets(store, search="lantern").rows.first()
    assert (listed.result_count, listed.athlete_count) == (7, 6)
    assert [r.event for r in e.get_meet(store, meet).collect()] == ["Women 16-18 100 SC Meter Backstroke", "Women 16-18 50 SC Meter Freestyle"]
    assert e.get_meet(store, meet).first().results[0].order.placement == 1
    swimmer = store["athlete"].where("name LIKE 'Okafor%'").first().athlete_key
    assert sorted(r.seconds for r in e.athlete_bests(store, swimmer).collect()) == [26.88, 65.44]
    assert e.athlete_stats(store, swimmer).first().results == 2 and e.athlete_recent(store, swimmer).count() == 2
    found = e.list_all_results(store, event="meter", limit=3)
    assert found.total == 10 and found.total_pages == 4 and found.rows.count() == 3
    assert e.list_all_results(store, athlete="haddad").total == 1
    assert e.list_results(store, sort="seconds", order="asc").rows.first().time == "26.88"
    assert e.list_results(store, team="kestrel", athlete="okafor").total == 2 and e.list_results(store, is_dq=True).total == 1
    relay = e.list_relays(store, athlete="haddad").rows.first()
    assert [x.athlete.name for x in relay.legs] == ["Moreau, Lise", "Haddad, Sam", "Boateng, Eli", "Lund, Ivo"]
    second = store["athlete"].where("name LIKE 'Haddad%'").first().athlete_key
    assert e.athlete_relays(store, second).first().own_leg == 2
    assert len(e.athlete_history(store, second).first()["items"]) == 1
    assert e.list_events(store).count() == 3
    assert [(r.round, r.dqs) for r in e.meet_by_round(store, meet).where("event LIKE '%Backstroke'").collect()] == [("Final", 1)]
    points, summary = e.progression(store, [swimmer], "Women 16-18 100 SC Meter Backstroke")
    assert points.first().nth == 1 and summary.first().improvement is None
    assert e.dashboard(store).first().recent_total == 7
    assert e.get_result(store, points.sparkSession.createDataFrame([(0,)], "k long").first().k).count() == 0
    assert e.list_athletes(store, search="l", ages=(14, 14)).total == 1


def test_a_batch_is_shuffled_and_written_once(spark, monkeypatch):
    """New rows and duplicates come of one written table whose plan has one exchange, and nothing stored is joined where there is none."""
    plans, real = [], g.stage
    monkeypatch.setattr(g, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    rows = spark.createDataFrame([(5, "a", 2), (5, "a", 1), (6, "a", 3)], "meet_key long, content_hash string, pos int")
    new, old = g.split_new(rows, rows.limit(0), ["pos"])
    assert sorted(r.pos for r in new.collect()) == [1, 3] and [r.pos for r in old.collect()] == [2]
    assert len(plans) == 1 and plans[0].count("Exchange ") == 1 and "Join" not in plans[0]


def test_the_first_page_decides_the_format(spark):
    pages = spark.createDataFrame([("a", 2, "HY-TEK"), ("a", 1, "other"), ("b", 1, "HY-TEK"), ("c", 1, None)], PAGES)
    rules = spark.createDataFrame(g.RULES, "rule_pos int, format_name string, parser_version string, pattern string, confidence int")
    found = g.first_formats(pages, rules)
    assert {r.doc_id: r.format_name for r in found.collect()} == {"a": None, "b": "meet-manager-text", "c": None}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_load_leaves_no_copies_of_its_batch(spark, store, monkeypatch, tmp_path):
    """Sheets and facts that a load stages are gone after it; digests, which travel as bytes, are stored as the same text as before."""
    import hashlib

    from splitboard.sources import tables

    monkeypatch.setattr(tables, "shared_dir", lambda _: str(tmp_path))
    docs, pages = batch(spark, "day1-results")
    done = g.load_sheets(store, docs, pages)
    staged = [p.name for p in (tmp_path / "staged").iterdir()]
    assert staged and not [n for n in staged if n.startswith(("sheets-", "batch-")) and not n.startswith(("batch-documents-", "batch-meets-"))]
    assert done.inserted == 10 and done.duplicate_rows.count() == 0
    rows = store["result"].select("content_hash", "source_document_sha256").collect()
    assert {r.source_document_sha256 for r in rows} == {hashlib.sha256(b"%PDF day1-results").hexdigest()}
    assert all(len(r.content_hash) == 64 and r.content_hash == r.content_hash.lower() for r in rows)
