"""Result sheets as tables: page texts become events, results, relays, legs, splits and a quality report.

A sheet is read line by line, and what a line means depends on the lines before it. That memory is
written as windows over (doc_id) in line order: the last value seen, running counts, first of a kind. Lines
are first sorted into kinds without memory, then the windows add it, then the kinds are settled. Documents
are independent, so the work is dealt by document; one shuffle serves all windows and the grouping that follows. What is
written is one row a document, which every output is read off without another shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from splitboard.functions.marks import DISTANCE, NO_SHOWS, clean_event_name, event_parts, extract, strip
from splitboard.sources import stage

#: The line formats of the sheets.
PAGE_HEADER = r"HY-TEK.s MEET MANAGER"
MEET_HEADER = r"^(.+?)\s*-\s*(\d{1,2}/\d{1,2}/\d{4}(?:\s+to\s+\d{1,2}/\d{1,2}/\d{4})?)$"
SESSION = r"^Results\s*-\s*(.+)$"
EVENT_HEADER = r"^Event\s+(\d+)\s+(.+)$"
CONTINUATION = r"^(?:Preliminaries\s*\.\.\.\s*)?\(Event\s+(\d+)\s+(.+?)\)"
STANDARD = r"^(\d+:\d+\.\d+|\d+\.\d+)\s+.+MTS"
COLUMN_HEADER = r"^Name\s+Age\s+Team\s+(?:Seed\s+Time\s+Prelim|Prelim\s+Time\s+Finals|Seed\s+Time\s+Finals)\s+Time$"
RELAY_HEADER = r"^Team\s+Relay\s+(?:Seed|Prelim)\s+Time\s+(?:Prelim|Finals)\s+Time$"
SECTION = r"^(?:Preliminaries|Finals|[A-Z]\s*-\s*Final)$"
RESULT = r"^(\*?\d+|---)\s+(.+?)\s+(\d{1,2})\s+(.+?)\s+([\d:]+\.\d+|NT)\s+([\d:]+\.\d+|DQ|NS|DNF|DNS|SCR)(?:\s+(qMTS|MTS))?"
RELAY_RESULT = r"^(\*?\d+|---)\s+(.+?)\s+([A-Z])\s+([\d:]+\.\d+|NT)\s+(X?[\d:]+\.\d+|DQ|NS|DNF|DNS|SCR)"
RELAY_LEG = r"(\d)\)\s+(?:r:([\d.-]+)\s+)?(\*?)([^,]+,\s*\S.*?)\s+([MW])?(\d{1,2})"
DQ_CODE = r"^(SW\s+[\d.]+[a-z]?)\s+(.+)$"
REACTION = r"r:\+?(-?[\d.]+)"
TIME_TOKEN = r"\([\d:]+\.\d+\)|\d+:\d+\.\d+|(?<![:(\d.])\d+\.\d+"

SPLIT = "struct<cumulative:string,split:string,distance:int>"


def group(line: Column, pattern: str, n: int) -> Column:
    """A group of the first match, null where it is absent."""
    return F.nullif(F.regexp_extract(line, pattern, n), F.lit(""))


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line): the stripped lines that are not blank; null pages have none."""
    rows = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).where(F.col("raw").rlike(r"(?U)\S"))
    # Most lines have no white space at their ends, which a look at both tells.
    return rows.select("doc_id", "page_no", "line_no", F.when(F.col("raw").rlike(r"(?s)^[!-~].*[!-~]\z"), F.col("raw")).otherwise(strip(F.col("raw"))).alias("line"))


def groups_of(line: Column, pattern: str, n: int) -> Column:
    """All n groups of a pattern that begins with ^, in one match; null where it does not match."""
    mark = "\x01"
    joined = F.regexp_replace(line, rf"(?s){pattern}.*$", mark + mark.join(f"${i}" for i in range(1, n + 1)))
    return F.when(joined.startswith(mark), F.slice(F.split(joined, mark, -1), 2, n))


def matched(lines: DataFrame) -> DataFrame:
    """lines with what each is by itself, as small values; a plain test stands before each expression that needs one of its letters.

    is_page, meet_like; rest: session, event, continuation; layout: columns, relay_columns, section; header: the time that a layout names;
    standard; res and rel: the marks of an individual and a relay result, empty for other lines; has_leg, coded, is_splits.
    """
    line = F.col("line")
    rest = F.when(line.startswith("Results") & line.rlike(SESSION), "session").when(line.startswith("Event") & line.rlike(EVENT_HEADER), "event")
    layout = F.when(line.startswith("Name") & line.rlike(COLUMN_HEADER), "columns").when(line.startswith("Team") & line.rlike(RELAY_HEADER), "relay_columns")
    found = lines.select(
        "*", (line.contains("HY-TEK") & line.rlike(PAGE_HEADER)).alias("is_page"), (line.contains("/") & line.rlike(MEET_HEADER)).alias("meet_like"),
        rest.when(line.contains("(Event") & line.rlike(CONTINUATION), "continuation").alias("rest"), layout.when(line.rlike(SECTION), "section").alias("layout"), (line.contains("MTS") & line.rlike(STANDARD)).alias("standard"),
        F.regexp_extract(line, f"(?s){RESULT}", 6).alias("res"), F.regexp_extract(line, f"(?s){RELAY_RESULT}", 5).alias("rel"), (line.contains(")") & line.rlike(RELAY_LEG)).alias("has_leg"), (line.startswith("SW") & line.rlike(DQ_CODE)).alias("coded"),
    )
    header = F.when(F.col("layout").isin("columns", "relay_columns"), F.when(line.rlike(r"Prelim\s+Time$"), "Prelim Time").otherwise("Finals Time"))
    # A reaction time, or times with differences in brackets, that is no other line.
    times = line.contains("(") & line.rlike(r"^\d{1,2}[.:]\d{2}|^\d+:\d{2}\.\d{2}\s")
    is_splits = line.startswith("r:") | (times & ~F.col("coded") & (F.col("res") == ""))
    return found.select("*", header.alias("header"), is_splits.alias("is_splits")).withColumn("meet_like", F.col("meet_like") & ~F.col("is_page"))


def classify(lines: DataFrame) -> DataFrame:
    """lines with kind, target (the kind of row that a line belongs to) and number (which one in its document), and the memory that the outputs need.

    Three orders serve all windows: by name, by line, by event. A block is what stands below a line that names an event; in it
    a state of 0 tells that no result is open, 1 that one is, 2 that it was disqualified.
    """
    line = F.col("line")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    pages = Window.partitionBy("doc_id").orderBy("page_no", "line_no").rowsBetween(first, Window.currentRow)
    so_far = Window.partitionBy("doc_id").orderBy("at").rowsBetween(first, Window.currentRow)

    rows = matched(lines).select("*", F.row_number().over(pages).alias("at"), F.count_if("meet_like").over(pages).alias("meets_so_far")).drop("page_no", "line_no")
    head = F.when(F.col("is_page"), "page").when(F.col("meet_like") & (F.col("meets_so_far") == 1), "meet").otherwise(F.col("rest"))
    rows = rows.withColumn("head", head).drop("is_page", "meets_so_far", "rest")
    named = F.when(F.col("head") == "event", F.concat_ws("-", group(line, EVENT_HEADER, 1), clean_event_name(F.regexp_extract(line, EVENT_HEADER, 2))))
    named = named.when(F.col("head") == "continuation", F.concat_ws("-", group(line, CONTINUATION, 1), strip(F.regexp_extract(line, CONTINUATION, 2))))
    rows = rows.withColumn("named", named)

    seen = F.count_if(F.col("head") == "event").over(Window.partitionBy("doc_id", "named").orderBy("at").rowsBetween(first, Window.currentRow))
    rows = rows.withColumn("opens", F.when(F.col("named").isNotNull() & (seen > 0), F.col("named")))

    free = F.col("head").isNull()
    turns = F.when(F.col("opens").isNotNull(), F.col("opens").contains("Relay")).when(free & (F.col("layout") == "columns"), False).when(free & (F.col("layout") == "relay_columns"), True)
    rows = rows.select("*", F.last("opens", ignorenulls=True).over(so_far).alias("event_key"), F.coalesce(F.last(turns, ignorenulls=True).over(so_far), F.lit(False)).alias("in_relay"))

    # No line is a standard and a result, so a result needs no look at the standards before it.
    plain = free & F.col("layout").isNull() & F.col("event_key").isNotNull()
    relay = plain & F.col("in_relay") & (F.col("rel") != "") & ~F.col("has_leg")
    result = plain & ~relay & (F.col("res") != "") & ~F.col("is_splits")
    rows = rows.select("*", relay.alias("is_relay"), result.alias("is_result"), F.col("named").isNotNull().alias("names")).drop("named", "opens")

    def state(own: str, mark: str) -> Column:
        now = F.when(F.col(own), F.when(F.col(mark) == "DQ", 2).otherwise(1)).when(F.col("names"), 0)
        return F.coalesce(F.last(now, ignorenulls=True).over(so_far), F.lit(0))

    rows = rows.select("*", state("is_relay", "rel").alias("relay_state"), state("is_result", "res").alias("result_state"), F.count_if("is_relay").over(so_far).alias("relay_no"), F.count_if("is_result").over(so_far).alias("result_no")).drop("res", "rel", "names")

    of_event = Window.partitionBy("doc_id", "event_key").orderBy("at")
    until, whole = of_event.rowsBetween(first, Window.currentRow), of_event.rowsBetween(first, last)
    candidate = free & F.col("event_key").isNotNull() & F.col("standard")
    header = F.when(free, F.col("header"))
    unset = F.lit("Prelim Time")
    rows = rows.select(
        "*", F.count_if(candidate).over(until).alias("nth_standard"), F.coalesce(F.last(header, ignorenulls=True).over(until), unset).alias("time_type"),
        F.coalesce(F.last(header, ignorenulls=True).over(whole), unset).alias("event_time_type"),
    )

    kind = F.when(~free, F.col("head")).when(candidate & (F.col("nth_standard") == 1), "standard").otherwise(F.col("layout"))
    rows = rows.withColumn("kind", kind)
    left = F.col("kind").isNull()
    open_relay, open_result = F.col("in_relay") & (F.col("relay_state") > 0), F.col("result_state") > 0
    coded, legs, splits = F.col("coded"), F.col("has_leg"), F.col("is_splits")
    target = F.when(F.col("is_relay"), "relay").when(F.col("is_result"), "result")
    target = target.when(left & coded, F.when(open_relay & (F.col("relay_state") == 2), "relay").when(F.col("result_state") == 2, "result"))
    target = target.when(left & (splits | legs), F.when(open_relay, "relay").when(open_result & splits, "result"))
    rows = rows.withColumn("target", target)
    kind = F.when(~left, F.col("kind")).when(open_relay & legs, "legs").when(F.col("is_relay"), "relay").when(coded & F.col("target").isNotNull(), "dq_code")
    kind = kind.when(splits, "splits").when(F.col("is_result"), "result").when(F.col("meet_like") | line.rlike(r"^\d+$"), "noise").otherwise("unmatched")
    number = F.when(F.col("target") == "relay", F.col("relay_no")).when(F.col("target") == "result", F.col("result_no"))
    rows = rows.select("doc_id", "at", "line", kind.alias("kind"), "event_key", "target", number.alias("number"), "time_type", "event_time_type")
    return rows.select("*", *[F.count_if(F.col("kind") == k).over(over).alias(n) for k, over, n in (("unmatched", until, "nth_unmatched"), ("result", until, "nth_result"), ("result", whole, "n_results"), ("relay", whole, "n_relays"))])


def split_pairs(line: Column) -> Column:
    """The times of a line as (cumulative, split): a time in brackets belongs to the one before it, alone it is dropped."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(line, REACTION, ""), r"\bDQ\b", ""), F.lit(TIME_TOKEN), F.lit(0))
    brackets = r"^\(|\)$"

    def paired(all_of: Column) -> Column:
        after = lambda i: F.get(all_of, i + 1)
        pairs = F.transform(all_of, lambda token, i: F.struct(token.alias("cumulative"), F.when(after(i).startswith("("), F.regexp_replace(after(i), brackets, "")).alias("split")))
        return F.filter(pairs, lambda x: ~x["cumulative"].startswith("("))

    # The tokens are an element of a list, so that they are found once.
    return F.get(F.transform(F.array(tokens), paired), F.lit(0))


def with_distances(splits: Column, distance: Column) -> Column:
    """Splits numbered by distance in equal steps; without an event distance they have none."""
    step = F.floor(distance / F.size(splits)).cast("int")
    return F.transform(splits, lambda x, i: F.struct(x["cumulative"].alias("cumulative"), x["split"].alias("split"), (step * (i + 1)).alias("distance"))).cast(f"array<{SPLIT}>")


#: What documents hold of events, results and relays, as lines; ev is an event's place among its document's, from 1 on.
EVENT = "struct<at:int,key:string,header:string,standard:string,individual:int,relays:int>"
RESULT_LINES = "struct<at:int,ev:int,nth:int,time_type:string,line:string,mark:string,dq:string,splits:array<string>>"
RELAY_LINES = "struct<at:int,ev:int,time_type:string,line:string,dq:string,splits:array<string>,legs:array<string>>"
#: What a document is read with: its rows so far (the last ones apart, so that adding one copies few), and the memory.
MEMORY = {
    "meet": "string", "session": "string", "ev": "int", "in_relay": "boolean", "relay_state": "int", "result_state": "int", "event": EVENT, "events": f"array<{EVENT}>",
    "own": RESULT_LINES, "results": f"array<{RESULT_LINES}>", "full": f"array<array<{RESULT_LINES}>>", "team": RELAY_LINES, "relays": f"array<{RELAY_LINES}>", "full_relays": f"array<array<{RELAY_LINES}>>",
    "unmatched": "array<string>", "n_unmatched": "int",
}
TOGETHER = 64
PAGE_LINE, SESSION_LINE, EVENT_LINE, CONTINUED, COLUMNS, RELAY_COLUMNS, SECTION_LINE, STANDARD_LINE, SPLITS, CODED = range(1, 11)
UNSET = "Prelim Time"


def is_times(line: Column) -> Column:
    """Times with differences in brackets."""
    return line.contains("(") & line.rlike(r"^\d{1,2}[.:]\d{2}|^\d+:\d{2}\.\d{2}\s")


def told(line: Column, at: Column) -> Column:
    """What a line is by itself: sort (the first that holds), whether it may name the meet, the key of the event it names, its mark as a result."""
    sort = F.when(line.contains("HY-TEK") & line.rlike(PAGE_HEADER), PAGE_LINE).when(line.startswith("Results") & line.rlike(SESSION), SESSION_LINE).when(line.startswith("Event") & line.rlike(EVENT_HEADER), EVENT_LINE)
    sort = sort.when(line.contains("(Event") & line.rlike(CONTINUATION), CONTINUED).when(line.startswith("Name") & line.rlike(COLUMN_HEADER), COLUMNS).when(line.startswith("Team") & line.rlike(RELAY_HEADER), RELAY_COLUMNS)
    sort = sort.when(line.rlike(SECTION), SECTION_LINE).when(line.contains("MTS") & line.rlike(STANDARD), STANDARD_LINE).when(line.startswith("r:") | is_times(line), SPLITS).when(line.startswith("SW") & line.rlike(DQ_CODE), CODED)
    named = F.when(line.startswith("Event") & line.rlike(EVENT_HEADER), F.concat_ws("-", group(line, EVENT_HEADER, 1), clean_event_name(F.regexp_extract(line, EVENT_HEADER, 2))))
    named = named.when(line.contains("(Event") & line.rlike(CONTINUATION), F.concat_ws("-", group(line, CONTINUATION, 1), strip(F.regexp_extract(line, CONTINUATION, 2))))
    meet_like = line.contains("/") & line.rlike(MEET_HEADER) & ~(line.contains("HY-TEK") & line.rlike(PAGE_HEADER))
    return F.struct((at + 1).alias("at"), line.alias("line"), sort.otherwise(0).alias("sort"), meet_like.alias("meet_like"), named.alias("named"), F.regexp_extract(line, f"(?s){RESULT}", 6).alias("mark"))


def lines_of(text: Column) -> Column:
    """The stripped lines of a text that are not blank."""
    # Most lines have no white space at their ends, which a look at both tells.
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(r"(?s)^[!-~].*[!-~]\z"), x).otherwise(strip(x))), lambda x: x != "")


def row_of(kind: str, **values: Column) -> Column:
    """A struct of a kind; fields that are not given are null, lists empty."""
    fields = StructType.fromDDL(kind.removeprefix("struct<").removesuffix(">"))
    none = lambda f: (F.array() if isinstance(f.dataType, ArrayType) else F.lit(None)).cast(f.dataType)
    return F.struct(*[values.get(f.name, none(f)).alias(f.name) for f in fields])


def fields(row: Column, kind: str | dict) -> dict[str, Column]:
    """The fields of a struct of a kind by name; they are made once, since each is a call to the JVM."""
    names = kind if isinstance(kind, dict) else StructType.fromDDL(kind.removeprefix("struct<").removesuffix(">")).names
    return {n: row[n].alias(n) for n in names}


def changed(row: dict[str, Column], **values: Column) -> Column:
    """A struct of these fields with other values."""
    return F.struct(*[values[n].alias(n) if n in values else c for n, c in row.items()])


def added(rows: Column, row: Column) -> Column:
    return F.concat(rows, F.array(row))


def after_line(m: Column, x: Column) -> Column:
    """The memory m after a line x (of told); what is frequent stands first."""
    line, sort, at = x["line"], x["sort"], x["at"]
    of_event, in_relay = m["ev"] > 0, m["in_relay"]
    own, team, event = m["own"], m["team"], m["event"]
    opened, open_result = in_relay & (m["relay_state"] > 0), m["result_state"] > 0
    has_leg = line.contains(")") & line.rlike(RELAY_LEG)
    time_type = F.coalesce(event["header"], F.lit(UNSET))
    no_meet = x["meet_like"] & m["meet"].isNull()
    memory, of_own, of_team, about = fields(m, MEMORY), fields(own, RESULT_LINES), fields(team, RELAY_LINES), fields(event, EVENT)
    now = lambda **values: changed(memory, **values)

    def closed(row: str, rows: str, full: str) -> dict[str, Column]:
        """The open row goes to the last ones, which go to the others when they are many."""
        many, more = F.size(m[rows]) >= TOGETHER, m[row].isNotNull()
        return {rows: F.when(~more, m[rows]).when(many, F.array(m[row])).otherwise(added(m[rows], m[row])), full: F.when(more & many, added(m[full], m[rows])).otherwise(m[full])}

    def result(whole: bool) -> Column:
        new = row_of(RESULT_LINES, at=at, ev=m["ev"], nth=event["individual"] + 1, time_type=time_type, line=line, mark=x["mark"]) if whole else row_of(RESULT_LINES)
        counted = {"event": changed(about, individual=event["individual"] + 1)} if whole else {}
        return now(own=new, result_state=F.when(x["mark"] == "DQ", 2).otherwise(1), **counted, **closed("own", "results", "full"))

    relay = now(
        team=row_of(RELAY_LINES, at=at, ev=m["ev"], time_type=time_type, line=line), relay_state=F.when(F.regexp_extract(line, f"(?s){RELAY_RESULT}", 5) == "DQ", 2).otherwise(1),
        event=changed(about, relays=event["relays"] + 1), **closed("team", "relays", "full_relays"),
    )
    # The memory of an event rests in events while another one is read.
    kept = F.when(of_event, F.concat(F.slice(m["events"], 1, m["ev"] - 1), F.array(event), F.slice(m["events"], m["ev"] + 1, F.size(m["events"])))).otherwise(m["events"])
    place = F.array_position(F.transform(m["events"], lambda e: e["key"]), x["named"]).cast("int")
    fresh = row_of(EVENT, at=at, key=x["named"], individual=F.lit(0), relays=F.lit(0))
    block = {"relay_state": F.lit(0), "result_state": F.lit(0)}
    turns = {"in_relay": x["named"].contains("Relay"), **block}
    again = now(ev=place, event=F.get(kept, place - 1), events=kept, **turns)
    header = F.when(line.rlike(r"Prelim\s+Time$"), "Prelim Time").otherwise("Finals Time")
    layout = lambda relay: now(in_relay=F.lit(relay), event=changed(about, header=header))
    to_result = lambda **values: now(own=changed(of_own, **values))
    to_relay = lambda **values: now(team=changed(of_team, **values))
    plain, splits, coded = sort == 0, (sort == SPLITS) | ((sort == STANDARD_LINE) & is_times(line)), sort == CODED
    missed = now(n_unmatched=m["n_unmatched"] + 1, unmatched=F.when(F.size(m["unmatched"]) < UNMATCHED_SHOWN, added(m["unmatched"], line)).otherwise(m["unmatched"]))

    return (
        F.when(no_meet, now(meet=line))
        .when(plain & (x["mark"] != "") & of_event & ~in_relay, result(True))
        .when((sort == SPLITS) & open_result & ~in_relay, to_result(splits=added(own["splits"], line)))
        .when(sort.isin(PAGE_LINE, SECTION_LINE), m)
        .when(sort == SESSION_LINE, now(session=line))
        .when(sort == EVENT_LINE, F.when(place > 0, again).otherwise(now(ev=F.size(m["events"]) + 1, event=fresh, events=added(kept, fresh), **turns)))
        .when(sort == CONTINUED, F.when(place > 0, again).otherwise(now(**block)))
        .when(sort == COLUMNS, layout(False))
        .when(sort == RELAY_COLUMNS, layout(True))
        .when((sort == STANDARD_LINE) & of_event & event["standard"].isNull(), now(event=changed(about, standard=line)))
        .when(plain & of_event & in_relay & line.rlike(f"(?s){RELAY_RESULT}") & ~has_leg, relay)
        .when(plain & (x["mark"] != "") & of_event, F.when(opened & has_leg, result(False)).otherwise(result(True)))
        # From here on a line belongs to what is open, or to nothing.
        .when(opened & has_leg, F.when(~coded | (m["relay_state"] == 2), to_relay(legs=added(team["legs"], line))).otherwise(m))
        .when(coded & opened & (m["relay_state"] == 2), to_relay(dq=line))
        .when(coded & (m["result_state"] == 2), to_result(dq=line))
        .when(splits, F.when(opened, to_relay(splits=added(team["splits"], line))).when(open_result, to_result(splits=added(own["splits"], line))).otherwise(m))
        .when(x["meet_like"] | line.rlike(r"^\d+$"), m)
        .otherwise(missed)
    )


def read(m: Column) -> Column:
    """What is written of a document, from the memory after its last line."""
    all_of = lambda row, rows, full: F.concat(F.flatten(m[full]), m[rows], F.when(m[row].isNotNull(), F.array(m[row])).otherwise(F.array().cast(MEMORY[rows])))
    events = F.when(m["ev"] > 0, F.concat(F.slice(m["events"], 1, m["ev"] - 1), F.array(m["event"]), F.slice(m["events"], m["ev"] + 1, F.size(m["events"])))).otherwise(m["events"])
    return F.struct(
        m["meet"].alias("meet"), m["session"].alias("session"), m["n_unmatched"].alias("n_unmatched"), m["unmatched"].alias("unmatched_lines"), events.alias("events"),
        all_of("own", "results", "full").alias("results"), all_of("team", "relays", "full_relays").alias("relays"),
    )


@cache
def reading(jvm) -> Column:
    """lines as read; thousands of calls to this JVM make it, so it is made once."""
    zero = {"ev": F.lit(0), "in_relay": F.lit(False), "relay_state": F.lit(0), "result_state": F.lit(0), "n_unmatched": F.lit(0), "event": row_of(EVENT, individual=F.lit(0), relays=F.lit(0))}
    return F.aggregate(F.transform("lines", told), row_of(",".join(f"{n}:{t}" for n, t in MEMORY.items()), **zero), after_line, read)


def documents(pages: DataFrame) -> DataFrame:
    """One row a document of pages (doc_id, page_no, text), as gathered has it: its lines are read one after the other, with a memory."""
    texts = pages.where("text IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
    # What is generated is made once; columns that are used twice would be put in the place of their names, and made twice.
    rows = texts.select("doc_id", F.explode(F.array(F.flatten(F.transform("pages", lambda p: lines_of(p["text"]))))).alias("lines")).where(F.size("lines") > 0)
    rows = rows.select("doc_id", F.size("lines").alias("total_lines"), F.inline(F.array(reading(pages.sparkSession.sparkContext._jvm))))
    return rows.withColumn("classified_lines", F.col("total_lines") - F.col("n_unmatched")).drop("n_unmatched")


@dataclass(frozen=True)
class Sheets:
    """Tables of sheets; each is planned when it is asked for."""

    docs: DataFrame
    pages: DataFrame

    @cached_property
    def lines(self) -> DataFrame:
        return classify(page_lines(self.pages))

    @cached_property
    def meets(self) -> DataFrame:
        return self.docs.select("doc_id", "meet_name", "meet_dates", "session")

    @cached_property
    def events(self) -> DataFrame:
        return events_of(self.docs, "doc_id")

    @cached_property
    def results(self) -> DataFrame:
        return results_of(self.docs, "doc_id")

    @cached_property
    def relays(self) -> DataFrame:
        return relays_of(self.docs, "doc_id")

    @cached_property
    def legs(self) -> DataFrame:
        return self.relays.select("doc_id", F.col("pos").alias("relay_pos"), F.inline("legs"))

    @cached_property
    def quality(self) -> DataFrame:
        return quality(self.docs)


def read_sheets(pages: DataFrame, about: DataFrame | None = None, by_line: bool = False, once: bool = False, made: list[str] | None = None) -> Sheets:
    """All tables of the sheets in pages (doc_id, page_no, text), read off docs, one row a document that holds its lines by what they belong to, without a shuffle.

    docs are written, so that several tables need one reading; with once they are not, for callers that use one table alone. With by_line they come of
    windows over rows of lines, whose sorts spill, for documents that are too long to be read as one value. about (doc_id, unique, and columns of the
    caller's) is joined to docs before they are written; made takes their place, for ``discard``.
    """
    docs = gathered(classify(page_lines(pages))) if by_line else documents(pages)
    docs = docs if about is None else docs.join(about.hint("shuffle_hash"), "doc_id")
    return Sheets(with_names(docs if once else stage(docs, "sheets", made)), pages)


#: Kinds of lines that no output reads.
PASSED_OVER = ["page", "continuation", "section", "noise"]


def gathered(lines: DataFrame) -> DataFrame:
    """One row a document of classified lines: what it says of itself, counts, the first unmatched lines, and the lines of events, results and relays in their order.

    Lines are put together twice, by what they belong to and by document, both within the tasks that classified them.
    """
    kept = ~F.col("kind").isin(PASSED_OVER) & ((F.col("kind") != "unmatched") | (F.col("nth_unmatched") <= UNMATCHED_SHOWN))
    about = F.struct("at", "kind", "line", "time_type", "event_time_type", "nth_result", "n_results", "n_relays")
    parts = lines.groupBy("doc_id", "event_key", "target", "number").agg(
        F.array_sort(F.collect_list(F.when(kept, about))).alias("l"), F.count("*").alias("n_lines"), F.count_if(F.col("kind") == "unmatched").alias("n_unmatched")
    )

    def of(kind: str) -> Column:
        return F.filter("l", lambda x: x["kind"] == kind)

    def texts(kind: str) -> Column:
        return F.transform(of(kind), lambda x: x["line"])

    one, end, lone = lambda a: F.get(a, F.lit(0)), lambda a: F.try_element_at(a, F.lit(-1)), F.col("target").isNull()
    own, is_result, is_relay, in_event = end(F.filter("l", lambda x: x["kind"] == F.col("target"))), F.col("target") == "result", F.col("target") == "relay", F.col("event_key").isNotNull()
    parts = parts.select(
        "doc_id", "event_key", "n_lines", "n_unmatched", is_result.alias("is_result"), is_relay.alias("is_relay"), F.when(~lone, own).alias("own"), F.when(~lone, end(texts("dq_code"))).alias("dq"), F.when(~lone, texts("splits")).alias("splits"), F.when(is_relay, texts("legs")).alias("legs"),
        F.when(lone & in_event, one(of("event"))).alias("event"), F.when(lone & in_event, one(texts("standard"))).alias("standard"), F.when(lone, one(texts("meet"))).alias("meet"), F.when(lone, end(of("session"))).alias("session"),
        F.when(lone, F.transform(of("unmatched"), lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line")))).alias("unmatched"),
    )
    number = lambda c: F.col(c).cast("int")
    event = row_of(EVENT, at=F.col("event.at"), key=F.col("event_key"), header=F.col("event.event_time_type"), standard=F.col("standard"), individual=number("event.n_results"), relays=number("event.n_relays"))
    mine = {"at": F.col("own.at"), "line": F.col("own.line"), "time_type": F.col("own.time_type"), "dq": F.col("dq"), "splits": F.col("splits")}
    result = row_of(RESULT_LINES, nth=number("own.nth_result"), mark=F.regexp_extract("own.line", f"(?s){RESULT}", 6), **mine)
    key, place = F.when(F.col("own").isNotNull(), F.col("event_key")).alias("key"), F.coalesce("own.at", F.lit(0)).alias("at")
    found = parts.groupBy("doc_id").agg(
        F.sum("n_lines").cast("int").alias("total_lines"), (F.sum("n_lines") - F.sum("n_unmatched")).cast("int").alias("classified_lines"), F.max("meet").alias("meet"), F.max(F.struct("session.at", "session.line"))["line"].alias("session"),
        F.slice(F.array_sort(F.flatten(F.collect_list("unmatched"))), 1, UNMATCHED_SHOWN).alias("unmatched_lines"), F.array_sort(F.collect_list(F.when(F.col("event").isNotNull(), event))).alias("events"),
        F.array_sort(F.collect_list(F.when(F.col("is_result"), F.struct(place, key, result.alias("row"))))).alias("results"), F.array_sort(F.collect_list(F.when(F.col("is_relay"), F.struct(place, key, row_of(RELAY_LINES, legs=F.col("legs"), **mine).alias("row"))))).alias("relays"),
    )
    ev = lambda x: F.array_position(F.transform("events", lambda e: e["key"]), x["key"]).cast("int")
    rows = {name: F.transform(name, lambda x: changed(fields(x["row"], kind), ev=ev(x))) for name, kind in (("results", RESULT_LINES), ("relays", RELAY_LINES))}
    return found.withColumns({"unmatched_lines": F.transform("unmatched_lines", lambda x: x["line"]), **rows})


def with_names(docs: DataFrame) -> DataFrame:
    """docs with meet_name, meet_dates and session in the place of the lines that say them."""
    names = {"meet_name": strip(group(F.col("meet"), MEET_HEADER, 1)), "meet_dates": group(F.col("meet"), MEET_HEADER, 2), "session": strip(F.regexp_extract("session", SESSION, 1))}
    return docs.withColumns(names).drop("meet")


def event_number(key: Column) -> Column:
    """The number of an event; its key is the number and the name."""
    return F.regexp_extract(key, r"^(\d+)-", 1)


def event_name(key: Column) -> Column:
    return F.regexp_extract(key, r"(?s)^\d+-(.*)$", 1)


def events_of(docs: DataFrame, *more: str) -> DataFrame:
    """The events of docs beside more of their columns."""
    rows = docs.select(*more, F.explode("events").alias("e"))
    rows = rows.select(*more, "e", event_name(F.col("e.key")).alias("event_name")).withColumn("p", event_parts(F.col("event_name")))
    return rows.select(
        *more, F.col("e.at").alias("event_pos"), F.col("e.key").alias("event_key"), event_number(F.col("e.key")).alias("event_no"), "event_name", "p.*", group(F.col("e.standard"), STANDARD, 1).alias("time_standard"),
        F.coalesce("e.header", F.lit(UNSET)).alias("time_type"), F.col("event_name").contains("Relay").alias("is_relay"), F.col("e.individual").cast("long").alias("individual"), F.col("e.relays").cast("long").alias("relays"),
    )


def rows_of(docs: DataFrame, name: str, pattern: str, groups: int, *more: str) -> DataFrame:
    """more, the rows r of results or relays, g the groups of their lines, and e their event."""
    about = lambda e: F.struct(
        e["key"].alias("key"), event_number(e["key"]).alias("event_no"), event_name(e["key"]).alias("event_name"), extract(event_name(e["key"]), DISTANCE).try_cast("int").alias("distance"),
        F.coalesce(e["header"], F.lit(UNSET)).alias("time_type"), e["individual"].cast("long").alias("individual"),
    )
    rows = docs.select(*more, name, F.transform("events", about).alias("e")).select(*more, "e", F.explode(name).alias("r"))
    return rows.select(*more, "r", F.get("e", F.col("r.ev") - 1).alias("e"), groups_of(F.col("r.line"), pattern, groups).alias("g"), F.flatten(F.transform("r.splits", split_pairs)).alias("s"))


def details() -> list[Column]:
    """What results and relays have in common after their own columns, of rows_of."""
    reaction = F.get(F.filter("r.splits", lambda x: x.rlike(REACTION)), F.lit(0))
    return [
        group(F.col("r.dq"), DQ_CODE, 1).alias("dq_code"), strip(F.regexp_extract("r.dq", DQ_CODE, 2)).alias("dq_description"), group(reaction, REACTION, 1).alias("reaction_time"), F.col("e.event_no").alias("event_no"),
        F.col("e.event_name").alias("event_name"), F.col("e.distance").alias("event_distance"), F.col("e.time_type").alias("event_time_type"), with_distances(F.col("s"), F.col("e.distance")).alias("splits"),
    ]


def placed(text: Column) -> Column:
    return F.when(text != "---", F.regexp_replace(text, r"^\*", "").try_cast("int"))


def swum(text: Column) -> Column:
    return F.when(~text.isin("DQ", *NO_SHOWS), text)


def name_in(text: Column) -> Column:
    """The name in the second group of a result."""
    return strip(F.regexp_replace(text, r"^\*+", ""))


BEFORE = [("e.key", "event_key"), ("r.at", "pos"), ("r.time_type", "time_type")]


def results_of(docs: DataFrame, *more: str) -> DataFrame:
    """The results of docs beside more of their columns."""
    g = lambda n: F.get("g", F.lit(n - 1))
    return rows_of(docs, "results", RESULT, 7, *more).select(
        *more, *[F.col(c).alias(n) for c, n in BEFORE], placed(g(1)).alias("placement"), g(1).startswith("*").alias("is_tied"), name_in(g(2)).alias("name"), g(2).startswith("*").alias("is_guest"),
        g(3).try_cast("int").alias("age"), strip(g(4)).alias("team"), g(5).alias("seed_time"), swum(g(6)).alias("mark"), (g(6) == "DQ").alias("is_dq"), g(6).isin(NO_SHOWS).alias("is_ns"),
        F.nullif(g(7), F.lit("")).alias("qualifier"), *details(), F.col("r.nth").cast("long").alias("nth_of_event"), F.col("e.individual").alias("n_of_event"),
    )


def team_in(line: Column) -> Column:
    """The team of a relay's line."""
    return strip(F.regexp_extract(line, f"(?s){RELAY_RESULT}", 2))


def legs_in(line: Column) -> Column:
    """The legs that a line tells, as texts."""
    groups = ["leg_number", "reaction_time", "guest", "name", "gender", "age"]
    return F.arrays_zip(*[F.regexp_extract_all(line, F.lit(RELAY_LEG), F.lit(i)).alias(n) for i, n in enumerate(groups, 1)])


def relays_of(docs: DataFrame, *more: str) -> DataFrame:
    """The relays of docs with their legs beside more of the documents' columns."""
    g = lambda n: F.get("g", F.lit(n - 1))
    rows = made_once(rows_of(docs, "relays", RELAY_RESULT, 5, *more), "g", "s").withColumn("m", F.regexp_replace(g(5), "^X", ""))
    rows = rows.select(
        *more, *[F.col(c).alias(n) for c, n in BEFORE], placed(g(1)).alias("placement"), strip(g(2)).alias("team_name"), g(3).alias("relay_letter"), g(4).alias("seed_time"), swum(F.col("m")).alias("mark"), (F.col("m") == "DQ").alias("is_dq"),
        g(5).startswith("X").alias("is_exhibition"), F.flatten(F.transform("r.legs", legs_in)).alias("found_legs"), *details(),
    )
    return with_legs(made_once(rows, "found_legs", "reaction_time", "splits"))


def made_once(rows: DataFrame, *columns: str) -> DataFrame:
    """rows whose columns, which other rows' functions read for each element, are not put in the place of their names there."""
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline(F.array(F.struct(*columns)))).select(*rows.columns)


def with_legs(relays: DataFrame) -> DataFrame:
    """Relays with legs in the place of found_legs: the legs' part of the team's splits and their time.

    Leg 1's time is cumulative, a later leg's is the last difference of its part; leg 1 takes the team's reaction
    time if it has none. Distances of a leg's splits start anew; the team's stay cumulative.
    """
    n_legs = F.when(F.size("found_legs") == 0, 4).otherwise(F.size("found_legs"))
    rows = relays.withColumn("per_leg", F.floor(F.size("splits") / n_legs).cast("int"))
    step = F.get("splits", F.lit(0))["distance"]

    def part(i: Column) -> Column:
        return F.when(F.col("per_leg") > 0, F.slice("splits", i * F.col("per_leg") + 1, F.col("per_leg")))

    rows = rows.withColumn("found_legs", F.transform("found_legs", lambda x, i: F.struct(x.alias("leg"), i.alias("i"), part(i).alias("own"))))

    def leg(x: Column) -> Column:
        of, own, is_first = x["leg"], x["own"], x["i"] == 0
        last, reaction = F.try_element_at(own, F.lit(-1)), F.nullif(of["reaction_time"], F.lit(""))
        renumbered = F.transform(own, lambda y, j: F.struct(y["cumulative"].alias("cumulative"), y["split"].alias("split"), (step * (j + 1)).cast("int").alias("distance")))
        return F.struct(
            of["leg_number"].try_cast("int").alias("leg_number"), strip(of["name"]).alias("name"), (of["guest"] == "*").alias("is_guest"), of["age"].try_cast("int").alias("age"), F.nullif(of["gender"], F.lit("")).alias("gender"),
            F.when(is_first & reaction.isNull(), F.col("reaction_time")).otherwise(reaction).alias("reaction_time"),
            F.when(F.size(own) > 0, F.when(is_first, last["cumulative"]).otherwise(last["split"])).alias("split_time"), renumbered.alias("splits"),
        )

    return rows.withColumn("legs", F.transform("found_legs", leg)).drop("found_legs", "per_leg")


CHECKS = ["meet_name", "meet_dates", "has_events", "has_results", "all_events_typed", "line_coverage", "no_empty_names", "valid_times"]
PASS_SCORE = 0.6
UNMATCHED_SHOWN = 20


def quality(docs: DataFrame, *more: str) -> DataFrame:
    """Per document eight checks, their share, and the first 20 lines that nothing matched. Checks over nothing hold. Further columns of docs are kept on demand."""
    events, results = F.col("events"), F.col("results")
    # Of lines with one blank and then a letter or digit it is plain that there is a name.
    has_name = lambda r: r["line"].isNull() | r["line"].rlike(r"^(?:\*?\d+|---)\s[0-9A-Za-z]") | (name_in(F.regexp_extract(r["line"], f"(?s){RESULT}", 2)) != "")
    fine = lambda m: m.isNull() | m.isin("DQ", *NO_SHOWS) | m.rlike(r"^\d+:[\d.]+$|^[\d.]+$")
    checks = [
        F.col("meet_name").isNotNull(), F.col("meet_dates").isNotNull(), F.size(events) > 0, F.size(results) > 0, F.forall(events, lambda e: F.coalesce(e["header"], F.lit(UNSET)).isin("Prelim Time", "Finals Time")),
        F.col("classified_lines") / F.greatest("total_lines", F.lit(1)) > 0.8, F.forall(results, has_name), F.forall(results, lambda r: fine(r["mark"])),
    ]
    score = F.round(sum((F.get("c", F.lit(i)).cast("int") for i in range(len(CHECKS))), F.lit(0)) / len(CHECKS), 3)
    some = lambda test: F.size(F.filter(results, test)).cast("long")
    in_lines = lambda n: F.transform(results, lambda r: F.regexp_extract(r["line"], f"(?s){RESULT}", n))
    has_pairs = lambda r: F.exists(r["splits"], lambda x: F.size(split_pairs(x)) > 0)
    counts = {
        "n_events": F.size(events).cast("long"), "n_results": F.size(results).cast("long"), "n_relays": F.size("relays").cast("long"), "n_people": F.size(F.array_distinct(people())).cast("long"),
        "n_dq": some(lambda r: r["mark"] == "DQ"), "n_ns": some(lambda r: r["mark"].isin(NO_SHOWS)), "n_guests": F.size(F.filter(in_lines(2), lambda x: x.startswith("*"))).cast("long"), "n_with_splits": some(has_pairs),
        "n_with_reaction": some(lambda r: F.exists(r["splits"], lambda x: x.rlike(REACTION))),
    }
    return docs.withColumn("c", F.array(*checks)).select(
        "doc_id", score.alias("score"), (score >= PASS_SCORE).alias("passed"), F.map_from_arrays(F.array(*map(F.lit, CHECKS)), "c").alias("checks"), "total_lines", "classified_lines", "unmatched_lines",
        *[c.alias(n) for n, c in counts.items()], F.array_sort(F.array_distinct(F.array_compact(F.transform(in_lines(4), strip)))).alias("teams"), *more,
    )


def people(no_team: Column | None = None) -> Column:
    """Names with teams of the results in a row of docs, as person gives them; no_team stands for a team that is null."""
    found = F.transform("results", lambda r: groups_of(r["line"], RESULT, 4))
    team = lambda g: strip(F.get(g, F.lit(3)))
    return F.array_compact(F.transform(found, lambda g: person(name_in(F.get(g, F.lit(1))), team(g) if no_team is None else F.coalesce(team(g), no_team))))


def person(name: Column, team: Column) -> Column:
    """One string for a name and a team, different for different ones; null where one is null."""
    return F.concat(F.length(name), F.lit(":"), name, team)


#: The lines of the fixed-width sheets.
FIXED_RESULT = r"^\s*(---|\d+)\s+(\S+(?:,\s*\S+(?:\s+\S+)*))\s+(\d{1,2})\s+(.+?)\s{2,}(\S+)?\s+(\S+)\s*$"


def read_fixed_width(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meets, results) of fixed-width sheets in pages (doc_id, page_no, text); results bear the meet's name, too.

    The first plain line names the meet. DQ, DNS and DNF all count as disqualified; a DQ's reason is the line after
    it, if that is no result, ruler or event.
    """
    rows = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).withColumn("line", strip(F.col("raw")))
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    raw, line = F.col("raw"), F.col("line")
    plain = (line != "") & ~line.startswith("Results") & ~line.startswith("Event")
    header = F.when(line.startswith("Event") & line.rlike(EVENT_HEADER), F.struct(group(line, EVENT_HEADER, 1).try_cast("int").alias("event_no"), strip(F.regexp_extract(line, EVENT_HEADER, 2)).alias("event_name")))
    # One order serves all windows, and the meet's name stands in each row, so that nothing is read twice or joined.
    held = rows.select(
        "*", F.row_number().over(order).alias("at"), F.lead("raw").over(order).alias("next_raw"), F.last(header, ignorenulls=True).over(so_far).alias("event"),
        F.coalesce(F.first(F.when(plain, line), ignorenulls=True).over(whole), F.lit("")).alias("meet_name"),
    )
    meets = held.where("at = 1").select("doc_id", "meet_name")
    follows = strip(F.col("next_raw"))
    reason = F.when((follows != "") & ~follows.startswith("===") & ~F.col("next_raw").rlike(FIXED_RESULT) & ~follows.startswith("Event"), follows)
    found = held.where(F.col("event").isNotNull() & ~line.startswith("===") & ~line.startswith("Name")).withColumn("f", groups_of(raw, FIXED_RESULT, 6)).where("f IS NOT NULL")
    g = lambda n: F.get("f", F.lit(n - 1))
    out = g(6).isin("DQ", "DNS", "DNF")
    results = found.select(
        "doc_id", "event.*", F.col("at").alias("pos"), F.when(g(1) != "---", g(1).try_cast("int")).alias("placement"), strip(g(2)).alias("name"), g(3).try_cast("int").alias("age"), strip(g(4)).alias("team"),
        F.nullif(g(5), F.lit("")).alias("seed_time"), F.when(~out, g(6)).alias("mark"), out.alias("is_dq"), F.when(g(6) == "DQ", reason).when(out, g(6)).alias("dq_reason"), "meet_name",
    )
    return meets, results


def detect_formats(firsts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per document of firsts (doc_id, text of page 1) the best rule of rules (rule_pos, format_name, parser_version, pattern, confidence).

    The highest positive confidence wins, the earliest of equals; without one format_name is null and
    checked names all formats. Rules are a short list: one row per document and matching rule is made at most.
    """
    from functools import reduce

    listed = rules.orderBy("rule_pos").collect()
    scored = [F.when(F.col("text").rlike(r.pattern), F.struct(F.lit(-r.confidence).alias("rank"), F.lit(r.rule_pos).alias("pos"), F.lit(r.format_name).alias("format_name"), F.lit(r.parser_version).alias("parser_version"), F.lit(r.confidence).alias("confidence"))) for r in listed if r.confidence > 0]
    best = F.array_min(F.array_compact(F.array(*scored))) if scored else F.lit(None).cast("struct<rank:int,pos:int,format_name:string,parser_version:string,confidence:int>")
    checked = F.when(F.col("best").isNull(), F.lit(reduce(lambda a, r: f"{a}, {r.format_name}" if a else r.format_name, listed, "")))
    return firsts.withColumn("best", best).select("doc_id", "best.format_name", "best.parser_version", "best.confidence", checked.alias("checked"))
