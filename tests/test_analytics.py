"""Windows that send bounded rows a key."""

import random

from splitboard.operators import analytics as a
from splitboard.operators import filters
from splitboard.operators import sheets as sh
from splitboard.sources import store as st


def test_head_and_tail_equals_slices(spark):
    """Groups of every size, ties, null keys and equal rows; both ends are limited before the shuffle."""
    draw = random.Random(2)
    rows = [(k, draw.randrange(6), i % 4) for k in [None, *range(1, 22)] for i in range(40 if k is None else k)] + [(99, 1, 1)] * 20
    df = spark.createDataFrame(rows, "k int, at int, v int")
    found = a.head_and_tail(df, ["k"], ["at"])
    got = {}
    for r in found.collect():
        got.setdefault(r.k, []).append(r.at)
    for k in {r[0] for r in rows}:
        ats = sorted(r[1] for r in rows if r[0] == k)
        want = ats if len(ats) <= 13 else ats[:10] + ats[-3:]
        assert sorted(got[k]) == want, k
    assert found._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
    assert found.columns == df.columns and a.head_and_tail(df.limit(0), ["k"], ["at"]).count() == 0


def test_unmatched_lines_are_a_bounded_sample(spark):
    noise = "\n".join(f"some words that fit nothing {i}" for i in range(30_000))
    pages = spark.createDataFrame([("n", 1, "Meet - 1/3/2026\n" + noise), ("m", 1, "odd line"), ("e", 1, "")], "doc_id string, page_no int, text string")
    found = {r.doc_id: r for r in sh.read_sheets(pages).quality.collect()}
    assert found["n"].total_lines == 30_001 and found["n"].classified_lines == 1
    assert found["n"].unmatched_lines == [f"some words that fit nothing {i}" for i in range(20)] and found["m"].unmatched_lines == ["odd line"]
    lines = spark.createDataFrame([], "doc_id string, at long, line string, kind string")
    first = a.top_per_key(lines.where("kind = 'unmatched'"), ["doc_id"], [lines["at"]], 20)
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString() or spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == "-1"


def test_the_bit_map_loses_no_key(spark):
    """Rows of the keys all pass, few others do, and its rows are bounded."""
    rows = spark.range(20_000).selectExpr("id % 7 AS m", "'h' || id AS h")
    keys = rows.where("h IN (SELECT 'h' || id * 40 FROM range(500))").union(rows.limit(1).selectExpr("99 AS m", "CAST(NULL AS STRING) AS h"))
    passed = filters.might_be_in(rows, keys, ["m", "h"])
    assert passed.columns == rows.columns and passed.join(keys, ["m", "h"]).count() == 500 and passed.count() < 4000
    assert filters.might_be_in(rows, keys.limit(0), ["m", "h"]).count() == 0


def test_many_keys_are_a_semi_join(spark, monkeypatch):
    rows, keys = spark.range(100).selectExpr("id AS k"), spark.createDataFrame([(3,), (3,), (5,), (None,), (500,)], "k long")
    few = sorted(r.k for r in st.among(rows, "k", keys).collect())
    monkeypatch.setattr(st, "LISTED", 1)
    assert few == [3, 5] == sorted(r.k for r in st.among(rows, "k", keys).collect())
