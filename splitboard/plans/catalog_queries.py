"""Ingestion, pages, links, catalogs and manifests over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.functions import documents as d
from splitboard.functions import marks
from splitboard.operators import catalog, ingest, links, manifests
from splitboard.plans.base import query
from splitboard.sources import empty, load
from splitboard.sources.schemas import TABLES


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("results-"), "doc_id", F.lit(".pdf"))
    text = F.when(F.col("lang") == "en", F.concat(F.lit("%PDF "), "text")).otherwise(F.col("text"))
    return rows.select(text.cast("binary").alias("content"), name.alias("filename"), F.lit("crawl").alias("source_type"), F.col("lang").alias("source_label"), F.col("source").alias("source_url"), none.alias("source_page_url"), F.col("doc_id").alias("ord"))


CONTENT = "c AS (SELECT *, CASE WHEN lang = 'en' THEN '%PDF ' || text ELSE text END AS content FROM documents)"


@query(f"""
WITH {CONTENT}, first AS (SELECT sha256(content) AS sha256, min(doc_id) AS doc_id, any_value(octet_length(encode(content))) AS byte_size, any_value(content LIKE '%PDF%' AND content[1:4] = '%PDF') AS is_valid_pdf FROM c GROUP BY 1)
SELECT sha256, byte_size, 'results-' || doc_id || '.pdf' AS original_filename, 'overall_results' AS category, 'archive/sha256/' || sha256[1:2] || '/' || sha256 || '.pdf' AS storage_path, is_valid_pdf FROM first
""")
def document_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by content hash: exact copies are one."""
    stored = empty(spark, TABLES["raw_document"])
    return ingest.register_documents(ingest.hashed_documents(incoming(spark, sf_dir)), stored, "archive").select("sha256", "byte_size", "original_filename", "category", "storage_path", "is_valid_pdf")


@query(f"""
WITH {CONTENT} SELECT sha256(content) AS sha256, count(DISTINCT (lang, source)) AS n_references, min(sha256('{{"filename":"","source_label":"' || lang || '","source_page_url":"","source_type":"crawl","source_url":"' || source || '"}}')) AS first_identity
FROM c GROUP BY 1
""")
def document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources each content has; one reference per source and content."""
    rows = incoming(spark, sf_dir).withColumn("filename", F.lit(None).cast("string"))
    found = ingest.register_references(ingest.hashed_documents(rows), empty(spark, TABLES["source_reference"]))
    return found.groupBy("sha256").agg(F.count("*").alias("n_references"), F.min("source_identity").alias("first_identity"))


def orders_as_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: customer is the athlete, priority the event, status the round, year the competition; the price has no cents, so that hashes meet."""
    rows = load(spark, sf_dir, "orders")
    meet = F.year("o_orderdate").cast("long")
    price = F.floor(F.col("o_totalprice") / 10000).cast("long")
    rows = rows.select(F.col("o_orderkey").alias("pos"), meet.alias("meet_key"), F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("event"), F.col("o_orderstatus").alias("round"), price.alias("time"))
    return rows.withColumn("content_hash", marks.content_hash(*[F.col(c) for c in ("meet_key", "event", "name", "round", "time")]))


FACTS = "facts AS (SELECT o_orderkey AS pos, year(o_orderdate) AS meet_key, o_custkey AS name, o_orderpriority AS event, o_orderstatus AS round, floor(o_totalprice / 10000)::BIGINT AS time FROM orders)"


@query(f"""
WITH {FACTS}, stored AS (SELECT DISTINCT meet_key, event, name, round, time FROM facts WHERE pos % 3 <> 1),
batch AS (SELECT *, row_number() OVER (PARTITION BY meet_key, event, name, round, time ORDER BY pos) AS nth FROM facts WHERE pos % 3 <> 0)
SELECT b.meet_key, count(*) FILTER (WHERE nth = 1 AND s.name IS NULL) AS inserted, count(*) FILTER (WHERE nth > 1 OR s.name IS NOT NULL) AS duplicates, sum(CASE WHEN nth = 1 AND s.name IS NULL THEN pos END)::BIGINT AS inserted_rows
FROM batch b LEFT JOIN stored s USING (meet_key, event, name, round, time) GROUP BY b.meet_key
""")
def ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that overlaps the stored rows and itself: what is new and what is a duplicate, by competition."""
    facts = orders_as_facts(spark, sf_dir)
    new, old = ingest.split_new(facts.where("pos % 3 <> 0"), facts.where("pos % 3 <> 1"), ["pos"])
    both = new.withColumn("new", F.lit(True)).union(old.withColumn("new", F.lit(False)))
    return both.groupBy("meet_key").agg(F.count_if("new").alias("inserted"), F.count_if(~F.col("new")).alias("duplicates"), F.sum(F.when(F.col("new"), F.col("pos"))).alias("inserted_rows"))


@query(f"""
WITH {FACTS}, stored AS (SELECT * FROM facts WHERE pos % 3 <> 1 OR meet_key % 2 = 1), batch AS (SELECT * FROM facts WHERE pos % 3 <> 0 AND meet_key % 2 = 0),
after AS (SELECT * FROM stored WHERE meet_key NOT IN (SELECT meet_key FROM batch) UNION ALL (SELECT DISTINCT ON (meet_key, event, name, round, time) * FROM batch ORDER BY pos))
SELECT meet_key, count(*) AS n, sum(pos)::BIGINT AS rows FROM after GROUP BY meet_key
""")
def ingest_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competitions of a batch replaced, the others as they were: written by partition, read back."""
    import uuid

    from splitboard.sources.tables import shared_dir

    facts = orders_as_facts(spark, sf_dir)
    path = f"{shared_dir(spark)}/staged/replace-{uuid.uuid4().hex}"
    facts.where("pos % 3 <> 1 OR meet_key % 2 = 1").write.partitionBy("meet_key").parquet(path)
    batch = facts.where("pos % 3 <> 0 AND meet_key % 2 = 0")
    new, _ = ingest.split_new(batch, facts.limit(0), ["pos"])
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("meet_key").parquet(path)
    after = spark.read.schema(facts.schema).parquet(path)
    return after.groupBy("meet_key").agg(F.count("*").alias("n"), F.sum("pos").alias("rows"))


@query("""
WITH seen AS (SELECT c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS team, (c_custkey % 20)::INTEGER AS age, c_custkey % 2 = 0 AS old FROM customer
              UNION ALL SELECT c_name, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END, (c_custkey % 7)::INTEGER, false FROM customer WHERE c_custkey % 3 = 0)
SELECT name, team, max(CASE WHEN age > 0 THEN age END) AS age, NOT bool_or(old) AS created FROM seen GROUP BY name, team
""")
def dim_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Athletes found or created; ages only rise, null teams are equal."""
    team = F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), team.alias("team"), (F.col("c_custkey") % 20).cast("int").alias("age"))
    stored = rows.where("c_custkey % 2 = 0").withColumn("age", F.when(F.col("age") > 0, F.col("age")))
    again = rows.where("c_custkey % 3 = 0").withColumn("age", (F.col("c_custkey") % 7).cast("int"))
    return ingest.upsert_athletes(stored, rows.where("c_custkey % 2 = 1").union(again)).select("name", "team", "age", "created")


@query(r"""
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') || ' to ' || strftime(o_orderdate + INTERVAL 3 DAY, '%-d/%-m/%Y') WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%Y') ELSE 'soon' END AS told, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start_date, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') END AS end_date,
       CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate + to_days((o_orderkey % 5)::INTEGER), '%Y-%m-%d') END AS swum FROM s
""")
def meet_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as on sheets and read again, with the day of the session."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    one, later = F.date_format("o_orderdate", "d/M/yyyy"), F.date_format(F.date_add("o_orderdate", 3), "d/M/yyyy")
    told = F.when(F.col("o_orderkey") % 3 == 0, F.concat(one, F.lit(" to "), later)).when(F.col("o_orderkey") % 3 == 1, one).otherwise("soon")
    rows = rows.select("o_orderkey", marks.meet_dates(told).alias("d"), F.concat(F.lit("day "), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit(" Session 2")).alias("session"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("o_orderkey", day(F.col("d.start_date")).alias("start_date"), day(F.col("d.end_date")).alias("end_date"), day(marks.swim_date(F.col("d.start_date"), F.col("session"))).alias("swum"))


ENTITY_STEPS = [(e, c.replace("'", "''")) for e, c in d.ENTITIES.items()]


def text_of(html: str) -> str:
    """strip_tags as SQL."""
    out = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    for entity, char in ENTITY_STEPS:
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"), "html")


H1, TITLE = "(?is)<h1[^>]*>(.*?)</h1>", "(?is)<title[^>]*>(.*?)</title>"


@query(f"""
SELECT page_id, CASE WHEN regexp_matches(html, '{H1}') THEN {text_of(f"regexp_extract(html, '{H1}', 1)")}
                     WHEN regexp_matches(html, '{TITLE}') THEN {text_of(f"regexp_extract(html, '{TITLE}', 1)")} END AS title FROM pages
""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first h1 or the title of every page, as text."""
    return page_table(spark, sf_dir).select("page_id", d.page_title(F.col("html")).alias("title"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, replace(html, 'href="/', 'href="/swimming/events/') AS html FROM pages),
a AS (SELECT page_id, site, unnest(regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS label FROM p)
SELECT page_id, count(DISTINCT href) AS n_links, count(DISTINCT href) FILTER (WHERE href ILIKE '%/t%') AS n_t, min(site || href) AS first_url FROM a WHERE trim(label) <> '' AND starts_with(href, '/swimming/events/') GROUP BY page_id
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to event pages on every page, each once; the pages' own links are put below the events' path."""
    pages = page_table(spark, sf_dir).withColumn("html", F.replace("html", F.lit('href="/'), F.lit('href="/swimming/events/')))
    rows = links.event_links(pages, ["page_id"])
    return rows.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(F.col("url").ilike("%/events/t%")).alias("n_t"), F.min("url").alias("first_url"))


def with_documents(pages: DataFrame) -> DataFrame:
    """The pages' own links as links to documents: those that begin with a or e to results, with t or h to other documents."""
    html = F.regexp_replace("html", r'(href="/)([aeAE][^"]*)"', '$1results-$2.pdf"')
    return pages.withColumn("html", F.regexp_replace(html, r'(href="/)([thTH][^"]*)"', '$1$2.pdf"'))


OFFERED = r"""
h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(href="/)([aeAE][^"]*)"', '\1results-\2.pdf"', 'g'), '(href="/)([thTH][^"]*)"', '\1\2.pdf"', 'g') AS html FROM pages),
l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+\.pdf)["'']', 1)) AS href FROM h),
offered AS (SELECT page_id, CASE WHEN bool_or(lower(href) LIKE '%result%') THEN 'results_available' WHEN count(href) > 0 THEN 'documents_available_no_results' ELSE 'no_documents_found' END AS status, count(DISTINCT href)::INTEGER AS pdf_count
            FROM pages LEFT JOIN l USING (page_id) GROUP BY page_id)
"""


@query(f"WITH {OFFERED} SELECT page_id, status, pdf_count FROM offered")
def page_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every page offers, by the links in its html. Links that repeat count once."""
    pages = with_documents(page_table(spark, sf_dir))
    return links.inspect(pages, ["page_id"]).select("page_id", "status", F.col("pdf_count").cast("int").alias("pdf_count"))


def discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages of fifty events each, the given pages as the events' own; every tenth could not be read."""
    site = "https://host.example/swimming/events"
    pages = with_documents(page_table(spark, sf_dir))
    anchor = F.format_string('<a href="/swimming/events/%d">Event %d</a>', "page_id", "page_id")
    index = pages.groupBy(F.floor(F.col("page_id") / 50).alias("index_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", anchor.alias("a")))), lambda x: x["a"]), " ").alias("html")).withColumn("page_url", F.lit(site))
    lost = F.col("page_id") % 10 == 3
    details = pages.select(F.concat(F.lit(f"{site}/"), "page_id").alias("url"), F.when(~lost, F.col("html")).alias("html"), F.when(lost, "timeout").alias("error"))
    return links.discovery_report(index, details)


FOUND = f"{OFFERED}, found AS (SELECT page_id, page_id // 50 AS index_id, CASE WHEN page_id % 10 = 3 THEN 'error:timeout' ELSE status END AS status, CASE WHEN page_id % 10 = 3 THEN 0 ELSE pdf_count END AS pdf_count FROM offered)"


@query(f"WITH {FOUND} SELECT index_id, 'https://host.example/swimming/events/' || page_id AS url, 'Event ' || page_id AS title, status, pdf_count FROM found")
def discovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events found on index pages with what their own pages offer; pages that could not be read are rows, too."""
    return discovery(spark, sf_dir).select("index_id", F.col("event_url").alias("url"), "title", "status", F.col("pdf_count").cast("int").alias("pdf_count"))


@query(f"WITH {FOUND}, c AS (SELECT status, count(*) AS n FROM found GROUP BY status) SELECT 'discovery' AS title, sum(n)::BIGINT AS total, string_agg(status || '=' || n, ',' ORDER BY status) AS counts FROM c")
def discovery_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's header: how many events have which status."""
    from splitboard.sources.documents import report_header

    header = report_header(discovery(spark, sf_dir), "status", "discovery")
    return header.select("title", "total", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("counts"))


@query(f"WITH {FOUND} SELECT page_id AS ord, status, 'event-' || page_id AS target FROM found WHERE ('event ' || page_id) LIKE '%1%' AND status IN ('results_available', 'error:timeout') ORDER BY page_id LIMIT 40")
def archive_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty events that a selector and two statuses take, with their folders."""
    rows = discovery(spark, sf_dir).withColumn("ord", F.element_at(F.split("event_url", "/"), -1).cast("long"))
    return links.archive_selection(rows.select("ord", "title", F.lit(None).cast("string").alias("page_title"), F.lit("").alias("url"), "status"), ["1"], ["results_available", "error:timeout"], 40).select("ord", "status", "target")


FOCUSED = "CASE WHEN strpos(html, '<article>') = 0 THEN html ELSE html[greatest(strpos(html, '<article>') - 50, 1) : strpos(html, '</article>') - 1] END"


@query(f"SELECT page_id, length({FOCUSED}) AS n_chars, md5({FOCUSED}) AS digest FROM pages")
def page_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each page around its article."""
    part = d.focused(F.col("html"), ["<article>"], ["</article>"], before=50)
    return page_table(spark, sf_dir).select("page_id", part.alias("part")).select("page_id", F.length("part").cast("long").alias("n_chars"), F.md5("part").alias("digest"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) AS u FROM pages)
SELECT page_id, lower(u.s) || '://' || lower(u.h) || CASE WHEN length(u.p) > 1 THEN regexp_replace(u.p, '/+$', '') ELSE u.p END || CASE WHEN u.q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(u.q, '&')), '&') END AS canonical FROM p
""")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One form of every page's URL."""
    return load(spark, sf_dir, "pages").select("page_id", d.canonical_url(F.col("url")).alias("canonical"))


def snapshots(spark: SparkSession, sf_dir: str) -> catalog.Refresh:
    """The catalog cut from documents: a source is an event, a document its document; the stored half lacks some and has others differently."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    when = F.to_timestamp(F.lit("2026-01-01"))
    url = F.concat(F.lit("e/"), "source")
    name = F.concat(F.lit("d"), "doc_id")
    stored = docs.where("source = 'src2' OR (source <> 'src1' AND doc_id % 7 <> 0)").select(
        url.alias("event_url"), name.alias("url"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(name).alias("filename"), F.col("lang").alias("category"),
        when.alias("first_seen_at"), when.alias("last_seen_at"), when.alias("last_checked_at"), (F.col("doc_id") % 11 != 0).alias("is_currently_listed"),
    )
    found = docs.where("source <> 'src2' AND (source = 'src1' OR doc_id % 7 = 0 OR doc_id % 13 <> 0)").select(url.alias("event_url"), name.alias("url"), name.alias("filename"), F.col("lang").alias("category"))
    none = F.lit(None).cast("string")

    def events(rows: DataFrame) -> DataFrame:
        n = rows.groupBy("event_url").agg(F.count("*").cast("int").alias("pdf_count"), F.count_if(F.col("category") == "en").cast("int").alias("result_pdf_count"))
        counts = catalog.histogram(rows, ["event_url"], "category", "category_counts")
        both = n.join(counts, "event_url").withColumnRenamed("event_url", "url")
        return both.select("url", F.col("url").alias("title"), none.alias("page_title"), F.lit("results_available").alias("readiness_status"), none.alias("source_year"), none.alias("source_date_label"), none.alias("status_reason"), "pdf_count", "result_pdf_count", "category_counts")

    old = events(stored).withColumns({"is_currently_listed": F.col("url") != "e/src3", **{c: when for c in ("first_seen_at", "last_seen_in_index_at", "last_checked_at", "last_changed_at")}})
    return catalog.refresh(old, stored, events(found), found, F.to_timestamp(F.lit("2026-02-01")))


SNAPSHOTS = """
so AS (SELECT 'e/' || source AS event_url, 'd' || doc_id AS url, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE 'd' || doc_id END AS filename, lang AS category, doc_id % 11 <> 0 AS listed FROM documents WHERE source = 'src2' OR (source <> 'src1' AND doc_id % 7 <> 0)),
sn AS (SELECT 'e/' || source AS event_url, 'd' || doc_id AS url, 'd' || doc_id AS filename, lang AS category FROM documents WHERE source <> 'src2' AND (source = 'src1' OR doc_id % 7 = 0 OR doc_id % 13 <> 0)),
dd AS (SELECT coalesce(sn.event_url, so.event_url) AS event_url, coalesce(sn.url, so.url) AS url,
              CASE WHEN so.url IS NULL THEN 'added' WHEN sn.url IS NULL THEN CASE WHEN so.event_url NOT IN (SELECT event_url FROM sn) THEN 'kept' WHEN listed THEN 'updated' ELSE 'gone' END
                   WHEN sn.filename <> so.filename OR sn.category <> so.category OR NOT listed THEN 'updated' ELSE 'unchanged' END AS change_type,
              CASE WHEN sn.url IS NOT NULL THEN true WHEN so.event_url NOT IN (SELECT event_url FROM sn) THEN listed ELSE false END AS is_currently_listed
       FROM sn FULL JOIN so ON sn.event_url = so.event_url AND sn.url = so.url),
c1 AS (SELECT event_url, category, count(*) AS n FROM so GROUP BY ALL), c2 AS (SELECT event_url, category, count(*) AS n FROM sn GROUP BY ALL),
h1 AS (SELECT event_url, string_agg(category || n, ',' ORDER BY category) AS h FROM c1 GROUP BY 1), h2 AS (SELECT event_url, string_agg(category || n, ',' ORDER BY category) AS h, sum(CASE WHEN category = 'en' THEN n ELSE 0 END)::INTEGER AS results FROM c2 GROUP BY 1),
ee AS (SELECT coalesce(h2.event_url, h1.event_url) AS url, CASE WHEN h1.event_url IS NULL THEN 'added' WHEN h2.event_url IS NULL THEN CASE WHEN h1.event_url <> 'e/src3' THEN 'absent' ELSE 'gone' END
              WHEN h1.h <> h2.h OR h1.event_url = 'e/src3' THEN 'updated' ELSE 'unchanged' END AS change_type, h2.event_url IS NOT NULL AS is_currently_listed, results FROM h2 FULL JOIN h1 ON h1.event_url = h2.event_url)
"""


@query(f"WITH {SNAPSHOTS} SELECT url, change_type, is_currently_listed, CASE WHEN change_type IN ('added', 'updated', 'absent') OR url IN (SELECT event_url FROM dd WHERE change_type IN ('added', 'updated')) THEN '2026-02' ELSE '2026-01' END AS changed FROM ee")
def catalog_refresh_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).events.select("url", "change_type", "is_currently_listed", F.date_format("last_changed_at", "yyyy-MM").alias("changed"))


@query(f"WITH {SNAPSHOTS} SELECT event_url, url, change_type, is_currently_listed FROM dd")
def catalog_refresh_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).documents.select("event_url", "url", "change_type", "is_currently_listed")


@query(f"""
WITH {SNAPSHOTS}, e AS (SELECT count(*) FILTER (WHERE is_currently_listed) AS events_discovered, count(*) FILTER (WHERE is_currently_listed) AS events_with_results, count(*) FILTER (WHERE change_type = 'added') AS added_events,
  count(*) FILTER (WHERE change_type = 'updated') AS updated_events, count(*) FILTER (WHERE change_type = 'unchanged') AS unchanged_events, count(*) FILTER (WHERE change_type = 'absent') AS absent_from_index_events,
  count(*) FILTER (WHERE is_currently_listed AND results > 0) AS action_required_count FROM ee),
d AS (SELECT count(*) FILTER (WHERE change_type = 'added') AS added_documents, count(*) FILTER (WHERE change_type = 'updated') AS updated_documents, count(*) FILTER (WHERE change_type = 'unchanged') AS unchanged_documents FROM dd)
SELECT * FROM e, d
""")
def catalog_refresh_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).counters


@query("""
WITH a AS (SELECT 'u' || doc_id AS url, 'f' || doc_id AS filename, lang AS category, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT 'u' || doc_id AS url, 'f' || doc_id AS filename, CASE WHEN doc_id % 9 = 0 THEN 'other_pdf' ELSE lang END AS category, CASE WHEN doc_id % 10 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 8 <> 0 OR doc_id % 7 = 0),
x AS (SELECT CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' END AS change_type, coalesce(b.url, a.url) AS url, coalesce(b.category, a.category) AS category
      FROM a FULL JOIN b ON a.url = b.url AND a.filename = b.filename AND a.category = b.category)
SELECT change_type, url, category, category = 'other_pdf' AS importable FROM x WHERE change_type IS NOT NULL
UNION ALL SELECT 'category', b.url, b.category, b.category = 'other_pdf' FROM a JOIN b ON a.url = b.url AND a.filename = b.filename WHERE a.category <> b.category
""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests cut from documents and how they differ."""
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("u"), "doc_id").alias("url"), F.concat(F.lit("f"), "doc_id").alias("filename"), F.col("lang").alias("category"), "text")
    hashed = lambda text: F.sha2(text, 256).alias("sha256")
    old = rows.where("ord % 7 <> 0").select("ord", "url", "filename", "category", hashed(F.col("text")))
    new = rows.where("ord % 8 <> 0 OR ord % 7 = 0").withColumn("category", F.when(F.col("ord") % 9 == 0, "other_pdf").otherwise(F.col("category")))
    new = new.select("ord", "url", "filename", "category", hashed(F.when(F.col("ord") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))))
    return manifests.diff(old, new).select("change_type", "url", "category", "importable")


@query("""
WITH docs AS (SELECT source AS url, count(*) AS document_count, count(*) FILTER (WHERE lang = 'en') AS results FROM documents GROUP BY source)
SELECT url, document_count, results > 0 AS is_currently_listed, url AS title FROM docs
""")
def catalog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog events with their number of documents."""
    docs = load(spark, sf_dir, "documents").select(F.col("source").alias("event_url"), F.col("doc_id").alias("url"), "lang")
    events = docs.groupBy(F.col("event_url").alias("url")).agg(F.bool_or(F.col("lang") == "en").alias("is_currently_listed")).withColumns({"title": F.col("url"), "source_year": F.lit(None).cast("string")})
    return catalog.list_source_events(events, docs).select("url", "document_count", "is_currently_listed", "title")


DIFF = """
a AS (SELECT 'u' || doc_id AS url, 'f' || doc_id AS filename, lang AS category, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT 'u' || doc_id AS url, 'f' || doc_id AS filename, CASE WHEN doc_id % 9 = 0 THEN 'other_pdf' ELSE lang END AS category, CASE WHEN doc_id % 10 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 8 <> 0 OR doc_id % 7 = 0),
x AS (SELECT CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' END AS change_type, coalesce(b.category, a.category) AS category
      FROM a FULL JOIN b ON a.url = b.url AND a.filename = b.filename AND a.category = b.category)
"""


@query(f"""
WITH {DIFF} SELECT count(*) FILTER (WHERE change_type = 'added') AS added, count(*) FILTER (WHERE change_type = 'removed') AS removed, count(*) FILTER (WHERE change_type = 'changed') AS changed_same_identity,
  (SELECT count(*) FROM a JOIN b ON a.url = b.url WHERE a.category <> b.category) AS category_changes, count(*) FILTER (WHERE change_type = 'added' AND category = 'other_pdf') AS importable_added,
  count(*) FILTER (WHERE change_type = 'changed' AND category = 'other_pdf') AS importable_changed_same_identity FROM x
""")
def manifest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = manifest_diff(spark, sf_dir)
    return manifests.summary(changes)


@query("""
WITH f AS (SELECT doc_id AS ord, lang AS category, 'f' || (doc_id % 50) || '.pdf' AS filename, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents),
p AS (SELECT DISTINCT ON (lang, doc_id % 50) lang AS category, 'f' || (doc_id % 50) || '.pdf' AS filename, sha256(text) AS k FROM documents WHERE doc_id % 3 = 0 ORDER BY lang, doc_id % 50, doc_id DESC),
j AS (SELECT f.*, coalesce(k <> sha256, false) AS reused FROM f LEFT JOIN p USING (category, filename))
SELECT ord, sha256, bytes::BIGINT AS bytes, reused, CASE WHEN reused THEN replace(filename, '.pdf', '') || '-' || sha256[1:8] || '.pdf' ELSE filename END AS filename_saved FROM j
""")
def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fetched files against an earlier manifest that knows some names with other contents."""
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.lit("u").alias("url"), F.format_string("f%d.pdf", F.col("doc_id") % 50).alias("filename"), F.col("lang").alias("category"), F.col("text").cast("binary").alias("content"))
    before = rows.where("ord % 3 = 0").withColumn("sha256", F.sha2("content", 256))
    return manifests.build(rows, before, "archive").select("ord", "sha256", "bytes", F.col("filename_reused_with_new_hash").alias("reused"), "filename_saved")


@query("SELECT 'p' || (doc_id // 100) AS source_page, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS ord, 'u' || doc_id AS url, lang AS category, sha256(text) AS sha256 FROM documents")
def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents listed in manifest files of a hundred each, written as JSON and read by the manifest reader."""
    import uuid

    from splitboard.sources.documents import manifest
    from splitboard.sources.tables import shared_dir

    rows = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"), F.col("lang").alias("category"), F.sha2("text", 256).alias("sha256"))
    page = F.concat(F.lit("p"), F.floor(F.col("doc_id") / 100)).alias("source_page")
    files = rows.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "url", "category", "sha256"))), lambda x: F.struct(x["url"].alias("url"), x["category"].alias("category"), x["sha256"].alias("sha256"))).alias("files"))
    path = f"{shared_dir(spark)}/staged/manifests-{uuid.uuid4().hex}"
    files.repartition("source_page").write.option("maxRecordsPerFile", 1).json(path)
    return manifest(spark, path).select("source_page", "ord", "url", "category", "sha256")


def pages_as_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a row of a discovery run: its host is the event, in varying spelling, with up to two documents."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    site = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1)
    spelt = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("HTTPS://"), F.upper(site), F.lit("/Index/"))).otherwise(F.concat(F.lit("https://"), site, F.lit("/Index#top")))
    ready = F.when(F.col("page_id") % 3 == 0, "no_documents_found").when(F.col("page_id") % 3 == 1, "documents_available_no_results").otherwise("results_available")
    none = F.lit(None).cast("string")
    one = lambda n, c: F.struct(F.format_string("d%d.pdf", F.col("page_id") % n).alias("url"), F.format_string("p%d.pdf", "page_id").alias("filename"), F.lit(c).alias("category"))
    return pages.select(
        F.col("page_id").alias("ord"), F.format_string("T%d", "page_id").alias("title"), F.when(F.col("page_id") % 5 == 0, F.format_string("P%d", "page_id")).alias("page_title"), spelt.alias("url"), ready.alias("readiness_status"),
        none.alias("source_year"), none.alias("source_date_label"), none.alias("status_reason"), F.array(one(7, "overall_results"), one(11, "start_list")).alias("documents"),
    )


DISCOVERED = r"""
r AS (SELECT page_id, 'https://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS site, page_id % 3 AS k FROM pages),
d AS (SELECT page_id AS ord, 0 AS pos, site, 'd' || (page_id % 7) || '.pdf' AS url, 'overall_results' AS category FROM r UNION ALL SELECT page_id, 1, site, 'd' || (page_id % 11) || '.pdf', 'start_list' FROM r),
dd AS (SELECT site, url, arg_max(category, ord * 2 + pos) AS category, arg_max('p' || ord || '.pdf', ord * 2 + pos) AS filename FROM d GROUP BY site, url),
n AS (SELECT site, count(*)::INTEGER AS pdf_count, (count(*) FILTER (WHERE category = 'overall_results'))::INTEGER AS result_pdf_count FROM dd GROUP BY site),
ev AS (SELECT site, 'T' || min(page_id) AS title, 'P' || min(CASE WHEN page_id % 5 = 0 THEN page_id END) AS page_title, CASE WHEN bool_or(k = 2) THEN 'results_available' WHEN arg_min(k, page_id) = 0 THEN 'no_documents_found' ELSE 'documents_available_no_results' END AS readiness_status FROM r GROUP BY site)
"""


@query(f"WITH {DISCOVERED} SELECT site || '/Index' AS url, title, page_title, readiness_status, pdf_count, result_pdf_count FROM ev JOIN n USING (site)")
def discovered_events_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a discovery run merged to one per event."""
    events, _ = catalog.normalized(pages_as_discovered(spark, sf_dir), "https://index.example/")
    return events.select("url", "title", "page_title", "readiness_status", "pdf_count", "result_pdf_count")


@query(f"WITH {DISCOVERED} SELECT site || '/Index' AS event_url, site || '/' || url AS url, filename, category FROM dd")
def discovered_documents_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a discovery run, the last of each url."""
    return catalog.normalized(pages_as_discovered(spark, sf_dir), "https://index.example/")[1]


@query(f"""
WITH {DISCOVERED} SELECT 1 AS run_id, 'succeeded' AS status, NULL AS error_message, (SELECT count(*) FROM ev) AS added_events, (SELECT count(*) FROM dd) AS added_documents
UNION ALL SELECT 2, 'failed', 'RefusedRun: the rule is missing or disabled', NULL, NULL
UNION ALL SELECT 3, 'failed', 'RefusedRun: unknown readiness status: soon', NULL, NULL
""")
def discovery_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs and their audit rows: a good one on an empty catalog, one of a disabled rule, one with a row that is not valid."""
    found = pages_as_discovered(spark, sf_dir)
    now = F.to_timestamp(F.lit("2026-02-01"))
    good, off = (spark.createDataFrame([(1, on, "https://index.example/")], "rule_id int, enabled boolean, index_url string") for on in (True, False))
    events, documents = catalog.normalized(found.limit(0), "https://index.example/")
    when = {c: F.lit(None).cast("timestamp") for c in ("first_seen_at", "last_seen_in_index_at", "last_seen_at", "last_checked_at", "last_changed_at")}
    events, documents = (x.withColumns({"is_currently_listed": F.lit(True), **when}) for x in (events, documents))
    wrong = found.withColumn("readiness_status", F.when(F.col("ord") == 3, "soon").otherwise(F.col("readiness_status")))
    rows = None
    for run_id, (rule, discovered) in enumerate([(good, found), (off, found), (good, wrong)], 1):
        _, audit = catalog.audited(spark, 1, run_id, "{}", now, now, lambda rule=rule, discovered=discovered: catalog.run_discovery(rule, events, documents, discovered, now))
        rows = audit if rows is None else rows.unionByName(audit, allowMissingColumns=True)
    return rows.select(F.col("run_id").cast("int").alias("run_id"), "status", "error_message", "added_events", "added_documents")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_name ELSE 'default' END AS label FROM supplier")
def default_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults put in where no row is stored."""
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.col("s_name").alias("label"))
    return catalog.with_defaults(rows.where("s_nationkey % 2 = 0").drop("s_nationkey"), rows.select("s_suppkey", F.lit("default").alias("label")), ["s_suppkey"])


@query("""
WITH runs AS (SELECT event_id AS run_id, event_id % 25 AS rule_id, ts, event_type FROM events), last AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts DESC, run_id DESC) AS n FROM runs)
SELECT r_regionkey AS site_id, r_name AS name, string_agg(n_nationkey || ':' || n_name || ':' || coalesce(run_id || '/' || event_type, ''), ' ' ORDER BY n_nationkey) AS rules
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN last ON rule_id = n_nationkey AND n = 1 GROUP BY ALL
""")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as sites with their nations as rules, each with its latest run."""
    sites = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("site_id"), F.col("r_name").alias("name"))
    rules = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule_id"), F.col("n_regionkey").alias("site_id"), F.col("n_name").alias("label"))
    rows = catalog.list_sources(sites, rules, event_runs(spark, sf_dir))
    shown = lambda x: F.concat_ws(":", x["rule_id"], x["label"], F.coalesce(F.concat_ws("/", F.nullif(x["last_run"]["run_id"].cast("string"), F.lit("")), x["last_run"]["status"]), F.lit("")))
    return rows.select("site_id", "name", F.array_join(F.transform("rules", shown), " ").alias("rules"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), (F.col("event_id") % 25).cast("int").alias("rule_id"), F.col("ts").alias("started_at"), F.col("event_type").alias("status"))


@query("SELECT event_id AS run_id, event_type AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty latest runs."""
    return catalog.list_monitor_runs(event_runs(spark, sf_dir)).select("run_id", "status")


@query(f"""
WITH {SNAPSHOTS} SELECT (SELECT count(*) FROM region) AS sources, (SELECT count(*) FROM nation) AS rules, (SELECT count(*) FROM dd) AS documents, (SELECT count(*) FROM ee) AS events, (SELECT count(*) FROM ee) AS result_ready,
(SELECT count(*) FROM ee WHERE is_currently_listed AND results > 0) AS action_required
""")
def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = snapshots(spark, sf_dir)
    return catalog.catalog_totals(load(spark, sf_dir, "region"), load(spark, sf_dir, "nation"), after.events, after.documents)


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Final' WHEN event_type = 'click' THEN 'Prelim' WHEN event_type = 'view' THEN 'Final' ELSE event_type END AS round,
       CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k, CASE WHEN event_id % 4 = 0 THEN 'not ' || props END AS raw, (event_id % 101)::DOUBLE AS percent,
       'Team ' || user_id || CASE WHEN event_id % 2 = 0 THEN ' B' ELSE '' END AS label, 'Solo' || user_id AS display,
       '[{"cumulative":"' || event_id || '","split":null,"distance":50}]' AS splits FROM events
""")
def labels_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round labels, JSON that can be read or not, percents, relay and display names, splits as JSON."""
    rows = load(spark, sf_dir, "events")
    given = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_type") == "click", "Prelim Time").when(F.col("event_type") == "view", "Finals Time").otherwise(F.col("event_type"))
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("not "), "props")).otherwise(F.col("props"))
    split = F.struct(F.col("event_id").cast("string").alias("cumulative"), F.lit(None).cast("string").alias("split"), F.lit(50).alias("distance"))
    return rows.select(
        "event_id", marks.round_label(given).alias("round"), d.json_or_raw(text, "k int").alias("j"), marks.percent(F.col("event_id") % 101 / 100).cast("double").alias("percent"),
        marks.relay_label(F.concat(F.lit("Team "), "user_id"), F.when(F.col("event_id") % 2 == 0, "B").otherwise("")).alias("label"), marks.display_name(F.concat(F.lit("., Solo"), "user_id")).alias("display"),
        marks.splits_json(F.array(split)).alias("splits"),
    ).select("event_id", "round", "j.value.k", "j.raw", "percent", "label", "display", "splits")
