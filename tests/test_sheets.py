import pytest

from splitboard.operators import sheets as sh

PAGE = """Quayside Timing: HY-TEK's MEET MANAGER 7.0, page 1
Lantern Cup 2025 - 4/7/2025 to 6/7/2025
Results - Day 2 Session 3
Event 12 Women 16-18 100 SC Meter Backstroke
1:09.90 16-18 MTS MTS
Name Age Team Prelim Time Finals Time
A - Final
--- Imre, Zofia 17 Kestrel Swim School 1:08.75 DNS
1 Okafor, Ada 16 Kestrel Swim School 1:07.20 1:05.44
r:+0.58 31.90 1:05.44 (33.54)
an announcement between heats
*2 Lund, Petra 18 Saltmarsh S.C. 1:06.10 1:06.02 qMTS
32.40 1:06.02 (33.62)
*2 *Moreau, Lise 16 Dune Runners 1:06.90 1:06.02 MTS
--- Tanaka, Yui 17 Dune Runners NT DQ
SW 6.3a Left the wall before the signal
Event 13 Women 16-18 50 SC Meter Freestyle
Name Age Team Seed Time Finals Time
1 Okafor, Ada 16 Kestrel Swim School 27.10 26.88
and one more announcement"""

RELAYS = """Event 20 Mixed 14 & Over 4x100 SC Meter Freestyle Relay C - Final
Team Relay Prelim Time Finals Time
--- Saltmarsh S.C. B 4:20.00 X4:18.35
--- Kestrel Swim School A 4:09.99 DQ
SW 10.10 Team entered twice
2 Dune Runners A NT 4:11.70
1) Moreau, Lise W16 2) r:0.21 *Haddad, Sam M15
3) r:-0.04 Boateng, Eli 17 4) Lund, Ivo M14
r:+0.66 30.10 1:02.30 (32.20) 1:33.40 (31.10) 2:05.50 (63.20) 2:36.00 (30.50) 3:08.90 (63.40) 3:39.80 (30.90) 4:11.70 (62.80)
(Event 12 Women 16-18 100 SC Meter Backstroke)
4 Quist, Mia 17 Dune Runners 1:08.00 1:07.31"""


@pytest.fixture(scope="module")
def sheets(spark):
    rows = [("a", 1, PAGE), ("a", 2, ""), ("a", 3, None), ("a", 4, RELAYS), ("empty", 1, None), ("blank", 1, " \n\t\n")]
    return sh.read_sheets(spark.createDataFrame(rows, "doc_id string, page_no int, text string"))


def test_events(sheets):
    back, free, relay = sheets.events.orderBy("event_pos").collect()
    assert (back.event_no, back.gender, back.age_group, back.distance, back.stroke, back.course) == ("12", "Women", "16-18", 100, "Backstroke", "SC")
    assert (back.time_standard, back.time_type, back.is_relay) == ("1:09.90", "Finals Time", False)
    assert (free.event_no, free.distance, free.time_standard) == ("13", 50, None)
    assert (relay.event_name, relay.age_group, relay.is_relay) == ("Mixed 14 & Over 4x100 SC Meter Freestyle Relay", "14 & Over", True)
    meet = sheets.meets.where("doc_id = 'a'").first()
    assert (meet.meet_name, meet.meet_dates, meet.session) == ("Lantern Cup 2025", "4/7/2025 to 6/7/2025", "Day 2 Session 3")


def test_results(sheets):
    absent, first, tied, guest, dq, short, late = sheets.results.orderBy("pos").collect()
    assert absent.is_ns and not absent.is_dq and absent.mark is None and absent.splits == [] and absent.placement is None
    assert (first.placement, first.name, first.age, first.team, first.seed_time, first.mark, first.qualifier, first.reaction_time) == (1, "Okafor, Ada", 16, "Kestrel Swim School", "1:07.20", "1:05.44", None, "0.58")
    assert [(s.cumulative, s.split, s.distance) for s in first.splits] == [("31.90", None, 50), ("1:05.44", "33.54", 100)]
    assert tied.is_tied and tied.placement == 2 and tied.qualifier == "qMTS" and len(tied.splits) == 2 and tied.reaction_time is None
    assert guest.is_tied and guest.is_guest and guest.name == "Moreau, Lise" and guest.qualifier == "MTS" and guest.splits == []
    assert dq.is_dq and dq.mark is None and dq.seed_time == "NT" and (dq.dq_code, dq.dq_description) == ("SW 6.3a", "Left the wall before the signal")
    assert (short.event_no, short.mark, short.time_type) == ("13", "26.88", "Finals Time")
    assert late.event_no == "12" and late.placement == 4 and late.event_name.endswith("Backstroke")


def test_relays_and_legs(sheets):
    extra, dq, second = sheets.relays.orderBy("pos").collect()
    assert extra.is_exhibition and extra.mark == "4:18.35" and extra.placement is None and extra.relay_letter == "B"
    assert dq.is_dq and dq.dq_code == "SW 10.10" and dq.mark is None
    assert (second.team_name, second.relay_letter, second.mark, second.seed_time, second.reaction_time, len(second.splits)) == ("Dune Runners", "A", "4:11.70", "NT", "0.66", 8)
    legs = sheets.legs.orderBy("leg_number").collect()
    assert [(x.leg_number, x.name, x.is_guest, x.gender, x.age, x.reaction_time, x.split_time) for x in legs] == [
        (1, "Moreau, Lise", False, "W", 16, "0.66", "1:02.30"), (2, "Haddad, Sam", True, "M", 15, "0.21", "63.20"),
        (3, "Boateng, Eli", False, None, 17, "-0.04", "63.40"), (4, "Lund, Ivo", False, "M", 14, None, "62.80"),
    ]
    assert [len(x.splits) for x in legs] == [2, 2, 2, 2]


def test_quality(sheets):
    good = sheets.quality.where("doc_id = 'a'").first()
    assert good.score == 1.0 and good.passed and good.unmatched_lines == ["an announcement between heats", "and one more announcement"]
    assert (good.n_results, good.n_dq, good.n_ns, good.n_guests, good.n_people, good.n_with_splits, good.n_relays) == (7, 1, 1, 1, 6, 2, 3)
    assert {r.doc_id for r in sheets.quality.collect()} == {"a"}


def test_the_memory_of_blocks(spark):
    """A continued event goes on with its own layout; a continuation of no known event keeps the one before; details hang on the last result of their block."""
    page = """Harvest Gala - 1/9/2025
Event 1 Men 50 LC Meter Butterfly
Name Age Team Seed Time Prelim Time
1 One, A 20 Club X 30.00 29.00
Event 2 Men 50 LC Meter Freestyle
Name Age Team Seed Time Finals Time
1 Two, B 20 Club X 30.00 28.00
(Event 9 Men 50 LC Meter Unknown)
SW 1.1 hangs on nothing here
2 Three, C 20 Club X 30.00 28.50
(Event 1 Men 50 LC Meter Butterfly)
2 Four, D 20 Club X 30.00 DQ
SW 2.2 own reason
Spring Gala - 2/9/2025"""
    read = sh.read_sheets(spark.createDataFrame([("m", 1, page)], "doc_id string, page_no int, text string"))
    rows = [(r.name, r.event_no, r.time_type, r.dq_code) for r in read.results.orderBy("pos").collect()]
    assert rows == [("One, A", "1", "Prelim Time", None), ("Two, B", "2", "Finals Time", None), ("Three, C", "2", "Finals Time", None), ("Four, D", "1", "Prelim Time", "SW 2.2")]
    kinds = {r.line: r.kind for r in read.lines.collect()}
    assert kinds["SW 1.1 hangs on nothing here"] == "unmatched" and kinds["Spring Gala - 2/9/2025"] == "noise" and kinds["Harvest Gala - 1/9/2025"] == "meet"


def test_splits_lines(spark):
    lines = ["31.20 1:14.10 (42.90) 1:57.31 (43.21) DQ (38.05)", "r:+0.62", "3:22.10 (42.05) 4:04.15 (42.05) 4:46.80 (42.65) 5:29.60 (42.80)", "r:-0.05 25.00 50.10 (25.10)"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    found = rows.select(sh.split_pairs(rows["line"]).alias("s"), sh.group(rows["line"], sh.REACTION, 1).alias("r")).collect()
    assert [len(r.s) for r in found] == [3, 0, 4, 2] and [r.r for r in found] == [None, "0.62", None, "-0.05"] and found[2].s[0].split == "42.05"


def test_formats(spark):
    rules = spark.createDataFrame([(0, "a", "1", "MEET MANAGER", 65), (1, "b", "1", "HY-TEK", 92), (2, "c", "1", "NEVER", 99), (3, "d", "1", "HY-TEK", 92)], "rule_pos int, format_name string, parser_version string, pattern string, confidence int")
    docs = spark.createDataFrame([("x", PAGE), ("y", "other"), ("z", None)], "doc_id string, text string")
    found = {r.doc_id: r for r in sh.detect_formats(docs, rules).collect()}
    assert found["x"].format_name == "b" and found["x"].checked is None
    assert found["y"].format_name is None and found["y"].checked == found["z"].checked == "a, b, c, d"


def test_fixed_width(spark):
    page = """

  Spring Invitational 2024
Event 1  Boys 13-14 100 Fly
===============
Name                    Age Team                 Seed     Finals
  1 ROWE, Alan             14 Aqua Team            1:05.00   1:04.10
  --- HALE, Bo            13 Bay Club             1:09.00      DQ
      One hand touch - Butterfly
  --- WREN, Cy            13 Bay Club             1:10.00      DNS
Event 2  Girls 13-14 100 Fly
  1 FINN, Di               14 Aqua Team            1:06.00   1:05.10"""
    meets, results = sh.read_fixed_width(spark.createDataFrame([("f", 1, page)], "doc_id string, page_no int, text string"))
    assert meets.first().meet_name == "Spring Invitational 2024"
    rows = [(r.event_no, r.placement, r.name, r.mark, r.is_dq, r.dq_reason) for r in results.orderBy("pos").collect()]
    assert rows == [(1, 1, "ROWE, Alan", "1:04.10", False, None), (1, None, "HALE, Bo", None, True, "One hand touch - Butterfly"), (1, None, "WREN, Cy", None, True, "DNS"), (2, 1, "FINN, Di", "1:05.10", False, None)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_sheet_is_shuffled_once(spark):
    """Lines are dealt by document once and sorted four times; what is read off the written documents is neither shuffled nor joined."""
    pages = spark.createDataFrame([("m", 1, PAGE)], "doc_id string, page_no int, text string")
    read = sh.read_sheets(pages)
    plan = plan_of(sh.gathered(read.lines))
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 4
    for table in (read.meets, read.events, read.results, read.relays, read.legs, read.quality):
        assert "Exchange" not in plan_of(table) and "Join" not in plan_of(table)
    meets, results = sh.read_fixed_width(pages)
    assert plan_of(results).count("Exchange ") == plan_of(results).count("Sort [") == 1 and "meet_name" in results.columns


def test_tasks_grow_with_the_table(spark, monkeypatch):
    from splitboard.sources import dealt, tables

    rows = spark.range(1000)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(rows, rows, "id").rdd.getNumPartitions() == least
    monkeypatch.setattr(tables, "ROWS_A_TASK", 40)
    assert dealt(rows, rows, "id").rdd.getNumPartitions() == 25


def test_equal_line_numbers_keep_their_order(spark, tmp_path):
    """Rows of one order and line stand in the order of part, supplier and price."""
    from splitboard.plans.sheet_queries import rendered

    rows = [(1, 1, p, s, float(x), None) for p, s, x in ((9, 1, 50), (2, 7, 60), (2, 3, 80), (2, 3, 70))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_comment string").write.parquet(f"{tmp_path}/lineitem.parquet")
    text = rendered(spark, str(tmp_path)).first().text
    found = [tuple(x.split(" ")[i] for i in (1, 5, 9)) for x in text.split("\n") if "Swimmer" in x]
    assert found == [("P2,", "S3", "1:40.00"), ("P2,", "S3", "1:50.00"), ("P2,", "S7", "1:30.00"), ("P9,", "S1", "1:20.00")]


def test_a_document_is_read_once_without_windows(spark):
    """What is read off documents that are not written has no window, one shuffle, and one pass over the lines."""
    read = sh.read_sheets(spark.createDataFrame([("m", 1, PAGE + "\n" + RELAYS)], "doc_id string, page_no int, text string"), once=True)
    for table in (read.events, read.results, read.relays, read.legs, read.quality):
        plan = plan_of(table)
        assert "Window" not in plan and plan.count("Exchange ") == 1
        assert table._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert read.results.count() == 7 and read.legs.count() == 4


def test_both_readings_agree(spark):
    """Sheets of mixed lines read the same in one pass and by windows over rows of lines."""
    import random

    r = random.Random(7)
    lines = [*PAGE.split("\n"), *RELAYS.split("\n"), "(Event 13 Women 16-18 50 SC Meter Freestyle)", "(Event 99 Men Unknown)", "1 One, A 14 Club 1) Z, W 15 1.00 DQ", "SW 1.1 own 1) C, D 15", "2:05.00 x MTS (2.00) 1) A, B 14", "17", "  "]
    rows = [(f"d{i}", p, "\n".join(r.choices(lines, k=r.choice([1, 20, 150])))) for i in range(60) for p in range(r.choice([1, 2]))]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    one, other = sh.read_sheets(pages), sh.read_sheets(pages, by_line=True)
    for name in ("meets", "events", "results", "relays", "legs", "quality"):
        a, b = (sorted(map(str, getattr(x, name).collect())) for x in (one, other))
        assert a == b and a
