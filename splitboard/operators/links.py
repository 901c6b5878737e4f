"""Source pages: event links, document links, titles and readiness of HTML tables (page_url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitboard.functions import documents as d

#: What a page's links and texts look like.
ANCHOR = r"(?is)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
QUOTED_DOCUMENT = r"(?i)href=[\"']([^\"']+\.pdf)[\"']"
BARE_DOCUMENT = r"(?i)(https?://[^\s\"'<>]+\.pdf)"
EVENT_PATH = "/swimming/events/"
EVENT_LABEL = r"(?i)\b(\d{2}(?:st|nd|rd|th)|SNAG|SNSC|Swim Series|Championship|Invitational|Open Water|ETP)\b"
NO_EVENT_PATH = r"(?i)/swimming/events$|sanctioning-policy|\.pdf|/app/uploads/"
COMING = r"(?i)coming soon|file to be uploaded|to be uploaded"


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/+$", "")


def first_seen(links: DataFrame, keys: list[str]) -> DataFrame:
    """Each url of a page once, with what came with it first, numbered by place."""
    fields = [c for c in links.columns if c not in (*keys, "url")]
    first = F.min(F.struct("pos", *[c for c in fields if c != "pos"])).alias("f")
    return links.groupBy(*keys, "url").agg(first).select(*keys, "url", "f.*")


def anchors(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, url, title) of all anchors with a text; url is resolved against page_url."""
    href, label = (F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    rows = pages.select(*keys, "page_url", F.posexplode(F.arrays_zip(href.alias("href"), label.alias("label"))).alias("pos", "a"))
    rows = rows.select(*keys, "page_url", "pos", d.link_url(F.col("a.href"), F.col("page_url")).alias("url"), d.strip_tags(F.col("a.label")).alias("title"))
    return rows.where("title <> ''")


def event_links(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Links to event pages on the page's own host, by their path or label, each once."""
    rows = anchors(pages, keys)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = (host == "") | (host == host_of(F.col("page_url")))
    other = (path != "") & (path != path_of(F.col("page_url"))) & ~path.rlike(NO_EVENT_PATH)
    looks = path.contains(EVENT_PATH) | F.col("title").rlike(EVENT_LABEL)
    return first_seen(rows.where(own & other & looks).drop("page_url"), keys)


def document_links(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, url, pos, filename, category) of a page's documents: quoted links first, then bare URLs, each once."""
    found = F.concat(F.regexp_extract_all("html", F.lit(QUOTED_DOCUMENT), F.lit(1)), F.regexp_extract_all("html", F.lit(BARE_DOCUMENT), F.lit(1)))
    rows = pages.select(*keys, "page_url", F.posexplode(found).alias("pos", "href")).select(*keys, "pos", d.link_url(F.col("href"), F.col("page_url")).alias("url"))
    name = F.element_at(F.split("url", "/"), -1)
    return first_seen(rows, keys).withColumns({"filename": name, "category": d.category(name, extended=True)})


def readiness(counts: Column, html: Column) -> Column:
    """What a page offers, by its documents' categories (a map) and its text."""
    some = F.coalesce(F.size(counts) > 0, F.lit(False))
    results = F.coalesce(F.try_element_at(counts, F.lit("overall_results")) > 0, F.lit(False))
    return F.when(results, "results_available").when(some, "documents_available_no_results").when(html.rlike(COMING), "pending_no_documents").otherwise("no_documents_found")


def inspect(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Per page its title, documents, counts by category and status. A page that could not be read (null html, error) has the status ``error:<type>``."""
    from splitboard.operators.analytics import histogram

    links = document_links(pages, keys)
    counts = histogram(links, keys, "category", "category_counts")
    listed = links.groupBy(*keys).agg(F.count("*").alias("pdf_count"), F.array_sort(F.collect_list(F.struct("pos", "url", "filename", "category"))).alias("pdfs"))
    # Links come from a generator: no automatic broadcast.
    rows = pages.join(counts.hint("merge"), keys, "left").join(listed.hint("merge"), keys, "left")
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    status = F.when(error.isNotNull() | F.col("html").isNull(), F.concat(F.lit("error:"), F.coalesce(error, F.lit("unread")))).otherwise(readiness(F.col("category_counts"), F.col("html")))
    return rows.select(*keys, "page_url", d.page_title(F.col("html")).alias("page_title"), status.alias("status"), F.coalesce("pdf_count", F.lit(0)).alias("pdf_count"), "category_counts", "pdfs")


def discovery_report(index_pages: DataFrame, details: DataFrame) -> DataFrame:
    """Events of index pages (index_id, page_url, html) with what their own pages (url, html, error) offer: one row per event.

    A page that is not among the details or could not be read is an ``error:`` row. Counts by status: ``sources.documents.report_header``.
    """
    keys = ["index_id", "event_url"]
    events = event_links(index_pages, ["index_id"]).select("index_id", F.col("url").alias("event_url"), "pos", "title")
    read = events.hint("merge").join(details.withColumnRenamed("url", "event_url"), "event_url", "left").withColumn("page_url", F.col("event_url"))
    found = inspect(read.select(*keys, "page_url", "html", "error"), keys)
    return events.hint("merge").join(found, keys).select(*keys, "pos", "title", "page_title", "status", "pdf_count", "category_counts", "pdfs")


def archive_selection(discovered: DataFrame, selectors: list[str], statuses: list[str], limit: int | None = None) -> DataFrame:
    """Discovered events (ord, title, page_title, url, status) to archive, with their folder; empty selectors take all."""
    from splitboard.operators.filters import selected

    rows = selected(discovered, ["title", "page_title", "url"], selectors, "status", statuses).withColumn("target", d.slug(F.coalesce("title", F.lit(""))))
    return rows.orderBy("ord").limit(limit) if limit else rows
