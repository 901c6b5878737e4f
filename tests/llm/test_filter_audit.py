"""The audit against plain loops over all orders."""

import re
from itertools import permutations

import numpy as np
import pandas as pd

from splitboard.llm import filter_audit

DOC = "doc_id long, text string, lang string, failed int, good boolean, part string"


def test_carry_save_counts_equal_plain_ones():
    draw = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000, 5003, 70_001):
        words = draw.integers(0, 2**32, n, dtype=np.uint32)
        assert filter_audit.positional_popcounts(words).tolist() == [int((words >> i & 1).sum()) for i in range(32)]


def test_many_parts_are_sent_on_in_between(monkeypatch):
    monkeypatch.setattr(filter_audit, "MOST_PARTS", 3)
    frames = [pd.DataFrame({"part": [f"p{i % 7}" for i in range(50)], "failed": [i % 32 for i in range(50)], "good": [True] * 50, "toxic": [False] * 50})] * 2
    sent = pd.concat(filter_audit.survivor_sums(iter(frames)))
    assert sum(n[0] for n in sent["survivors"]) == 100 == sum(n[0] for n in sent["good"]) and sum(n[0] for n in sent["toxic"]) == 0


def brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    parts = {}
    for i, text, lang in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
        smaller = [j for j, u, _ in rows if (u or "") == t and i is not None and j is not None and j < i]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": bool(smaller),
        }
        parts.setdefault(lang or "", []).append(({f for f, failed in fails.items() if failed}, i in good, i in toxic))
    out, shares = {}, {}
    for part, members in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                earlier = set(order[: step - 1])
                here = [m for m in members if f in m[0] and not m[0] & earlier]
                kept = [m for m in members if not m[0] & (earlier | {f})]
                out[part, order, step] = [len(kept), len(here), sum(f in m[0] and bool(m[0] & earlier) for m in members), sum(m[0] == {f} for m in members), sum(m[1] for m in here), sum(m[2] for m in here)]
                shares[part, f] = shares.get((part, f), 0) + len(here)
    return {k: [*v, shares[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def test_audit_equals_loops(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, long, "en"), (2, long, "de"), (3, long, "en"), (4, None, None), (5, "", "en"), (6, "w " * 150, "fr"), (7, long.upper(), "fr"), (8, f"{long} #", "en"), (8, f"{long} #", "en"), (None, long, "en"),
        (None, None, ""), (9, "ABC & short short", "de"), (10, f"{long} {long}", "en"), (11, "word " * 200_000, "en"), (12, "é" * 30 + "ABC", "fr"), (13, long, None),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (8, 1, None), (8, 0, 1), (9, None, 1), (99, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*r, 0, True, "x") for r in rows], DOC)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audited(filter_audit.survivors(table, marks)).collect()}
    assert got == brute(rows, labels)
    assert filter_audit.audited(filter_audit.survivors(table.limit(0), marks)).count() == 0
    bare = filter_audit.audited(filter_audit.survivors(table, marks.limit(0)))
    assert bare.where("good_lost + toxic_lost > 0").count() == 0 and bare.count() == len(got)
