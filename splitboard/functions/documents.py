"""File names, URLs, HTML fragments and identities of source documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splitboard.functions.marks import extract, strip

#: Fixed values: (category, words of which one is in the lower-cased file name), the first that fits counts.
CATEGORY_WORDS = [
    ("medal_tally", ["medal"]),
    ("start_list", ["start-list", "startlist"]),
    ("age_group_results", ["finals-by-age-group", "age-group-result"]),
    ("overall_results", ["result"]),
    ("event_information", ["cships", "championship", "singapore-national-age-group-swimming"]),
]
INFORMATION_WORDS = ["info", "event"]
IMPORTABLE = ["overall_results", "other_pdf"]
READINESS = ["results_available", "documents_available_no_results", "pending_no_documents", "no_documents_found"]

#: Entities that page text uses.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&#8211;": "–", "&#8217;": "’", "&amp;": "&"}


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def category(filename: Column, extended: bool = False) -> Column:
    """What a document is, by its file name; extended also takes info and event words for information."""
    name = F.lower(filename)
    rules = CATEGORY_WORDS + ([("event_information", INFORMATION_WORDS)] if extended else [])
    return F.coalesce(*[F.when(contains_any(name, words), F.lit(c)) for c, words in rules], F.lit("other_pdf"))


def importable(cat: Column) -> Column:
    return F.coalesce(cat.isin(IMPORTABLE), F.lit(False))


def unescape(html: Column) -> Column:
    for entity, char in ENTITIES.items():
        html = F.replace(html, F.lit(entity), F.lit(char))
    return html


def strip_tags(html: Column) -> Column:
    """Text of a fragment: tags off, entities read, white space collapsed."""
    return strip(F.regexp_replace(unescape(F.regexp_replace(html, r"<[^>]+>", " ")), r"(?U)\s+", " "))


def page_title(html: Column) -> Column:
    """The first h1, else the title; null without either."""
    def inside(tag: str) -> Column:
        pattern = rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"
        return F.when(html.rlike(pattern), strip_tags(F.regexp_extract(html, pattern, 1)))

    return F.coalesce(inside("h1"), inside("title"))


def focused(html: Column, starts: list[str], ends: list[str], before: int = 1000) -> Column:
    """The part from ``before`` characters ahead of the first start marker to the first end marker behind it."""
    def first(markers: list[str], behind: Column) -> Column:
        found = [F.nullif(F.call_function("locate", F.lit(m), html, behind), F.lit(0)) for m in markers]
        return F.array_min(F.array_compact(F.array(*found)))

    start = first(starts, F.lit(1))
    end = F.coalesce(first(ends, start), F.length(html) + 1)
    begin = F.greatest(start - before, F.lit(1))
    return F.when(start.isNull(), html).otherwise(F.substring(html, begin, end - begin))


def year(text: Column) -> Column:
    """The first year from 2000 to 2099."""
    return extract(text, r"\b(20\d{2})\b")


def slug(text: Column) -> Column:
    """Lower case letters and digits with single hyphens; ``event`` for nothing."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("event"))


def percent_coded(path: Column, keep: str = "/:@") -> Column:
    """Escapes read and written again, one way for each character; a plus stays a plus."""
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    coded = F.replace(F.replace(F.url_encode(F.coalesce(plain, path)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    coded = F.replace(coded, F.lit("%7E"), F.lit("~"))
    for char in keep:
        coded = F.replace(coded, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return coded


def without_dots(url: Column) -> Column:
    """An absolute URL whose path has no ``.`` and ``..`` segments; more ``..`` than folders lead to the root."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)([\s\S]*)$"
    segments = F.split(F.regexp_extract(url, pattern, 2), "/", -1)
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda kept, s: F.when(s == "..", up(kept)).when(s == ".", kept).otherwise(F.array_append(kept, s)))
    folder = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    path = F.concat(F.array_join(kept, "/"), folder)
    dotted = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*/\.\.?(?:[/?#]|$)")
    return F.when(dotted, F.concat(F.regexp_extract(url, pattern, 1), path, F.regexp_extract(url, pattern, 3))).otherwise(url)


def resolved(url: Column, base: Column) -> Column:
    """An absolute URL from an absolute one, ``//host``, ``/path``, ``path`` (both may climb with ``..``) or nothing."""
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/(?:[^?#/]*/)*)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | base.isNull() | (base == ""), url)
        .when(url == "", base)
        .when(url.startswith("//"), F.concat(scheme, F.lit(":"), url))
        .when(url.startswith("/"), without_dots(F.concat(host, url)))
        .otherwise(without_dots(F.concat(folder, url)))
    )


def canonical_url(url: Column, base: Column | None = None, keep_slash: bool = False) -> Column:
    """One form for all spellings of a URL: absolute, scheme and host in lower case, path coded one way, no closing slash, sorted query, no fragment."""
    full = resolved(strip(url), F.lit(None).cast("string") if base is None else base)
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    scheme, host = F.lower(F.regexp_extract(full, pattern, 1)), F.lower(F.regexp_extract(full, pattern, 2))
    path = percent_coded(F.regexp_extract(full, pattern, 3))
    if not keep_slash:
        path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)

    def pair(p: Column) -> Column:
        def side(x: Column) -> Column:
            plain = F.coalesce(F.try_url_decode(x), x)
            return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

        return F.struct(side(F.get(F.split(p, "=", 2), F.lit(0))).alias("k"), side(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit(""))).alias("v"))

    pairs = F.array_sort(F.transform(F.filter(F.split(F.regexp_extract(full, pattern, 4), "&"), lambda p: p != ""), pair))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    known = full.rlike(pattern)
    whole = F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(known, whole).otherwise(F.regexp_replace(full, "#.*$", ""))


def link_url(href: Column, base: Column) -> Column:
    """A page's link: escapes and entities read, then resolved."""
    plain = F.coalesce(F.try_url_decode(F.replace(strip(href), F.lit("+"), F.lit("%2B"))), strip(href))
    return resolved(unescape(plain), base)


def reference_identity(source_type: Column, label: Column, url: Column, page_url: Column, filename: Column) -> Column:
    """SHA-256 of the sorted compact JSON of a source reference, null as empty."""
    fields = {"filename": filename, "source_label": label, "source_page_url": page_url, "source_type": source_type, "source_url": url}
    return F.sha2(F.to_json(F.struct(*[F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items()])), 256)


def storage_path(root: str, sha256: Column, suffix: str = ".pdf") -> Column:
    """Where content with this hash is kept."""
    return F.concat(F.lit(f"{root}/sha256/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit(suffix))


def json_or_raw(text: Column, schema: str) -> Column:
    """struct(value, raw): the text read as JSON; what cannot be read stays in raw."""
    value = F.from_json(text, schema)
    return F.struct(value.alias("value"), F.when(F.try_parse_json(text).isNull(), text).alias("raw"))
