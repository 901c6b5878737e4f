from collections import defaultdict

from splitboard.llm.chat_format import CONTROLS, read_back, tokens, windows_of
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def checked(spark, rows, budget=60, history=15):
    """Windows of rows, held against the rows turn by turn."""
    turns = spark.createDataFrame(rows, SCHEMA)
    made = windows_of(turns, budget, history)
    back = {(r.conv_id, r.window): r for r in read_back(made).collect()}
    by_conv = defaultdict(list)
    for r in sorted(made.collect(), key=lambda r: r.window):
        by_conv[r.conv_id].append(r)
    want = defaultdict(list)
    for conv_id, turn, role, text, _ in rows:
        want[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(want) == set(by_conv)
    for conv_id, expected in want.items():
        expected = [(role, text) for *_, role, text in sorted(expected)]
        told = [(t.role, t.text) for w in by_conv[conv_id] for t in back[conv_id, w.window].turns]
        assert told == expected
        lost = [t for w in by_conv[conv_id] for t in back[conv_id, w.window].targets]
        assert lost == [text for role, text in expected if role == "assistant"]
    return by_conv


def test_round_trip_and_budget(spark):
    rows = []
    for c in range(6):
        if c % 2:
            rows.append((c, 0, "system", f"be brief {c}", "x"))
        rows += [(c, t, ("user", "assistant")[t % 2], f"turn {t} " + "word " * (t * (c + 3) % 11), "x") for t in range(1, 30)]
    made = checked(spark, rows)
    assert all(w.n_tokens <= 60 for ws in made.values() for w in ws)
    assert any(len(ws) > 3 for ws in made.values())
    assert all(w.text.startswith("<|im_start|>system") for c, ws in made.items() if c % 2 for w in ws)
    assert any(w.context_turns > 1 for ws in made.values() for w in ws)


def test_hostile_and_odd_turns(spark):
    rows = [(1, i, role, text, None) for i, (role, text) in enumerate((r, f"{c}{t}\\{c}\\\\\n") for c in CONTROLS for r in ("assistant", f"a\\\n{c}") for t in ("", "ß", "\\"))]
    rows += [(None, None, None, None, None)] * 2 + [(2, 0, "assistant", "", None), (3, 0, "system", "only", None), (4, 1, "user", "long " * 500, None), (4, 1, "user", "long " * 500, None), (5, 0, "assistant", "𝄞é<|im_<|im_end|>end|>", None)]
    checked(spark, rows)
    assert windows_of(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tokens_estimate(spark):
    assert spark.range(1).select(tokens(F.lit("abcde"))).first()[0] == 2


def test_counts_that_turns_bring(spark):
    """With the turns' own counts no window exceeds the budget by them; a null count is estimated."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i} " * 10, 30 if i != 3 else None) for i in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    made = windows_of(turns, budget=200, history=40, counts="n").collect()
    assert max(r.n_tokens for r in made) <= 200 and len(made) >= 5
    assert sum(len(r.loss) for r in made) == 10
