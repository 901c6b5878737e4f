"""Exact dedup: the cases that its docstring defines, and hot groups beside many small ones."""

import hashlib
import random
from collections import defaultdict

from splitboard.llm import exact_dedup

DOC = "doc_id long, text string, length int, shared int, digest string, row int, last int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "", 0, 0) for r in rows], DOC)


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    last = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    return sorted(((i, last[fold(t)], len(groups[fold(t)])) for i, t in rows), key=str)


def seen(df):
    return df.selectExpr("doc_id", "CASE WHEN last IS NULL THEN doc_id ELSE last.doc_id END AS keep", "coalesce(group_size, 1) AS n").collect()


CASES = [
    (1, "Some Text"), (2, "some text"), (3, "some  text"), (4, None), (5, ""), (6, "Ärger"), (7, "ärger"), (8, "x" * 500_000 + "a"), (9, "X" * 500_000 + "a"), (10, "x" * 500_000 + "b"),
    (None, "some TEXT"), (None, "only null ids"), (None, "Only null ids"), (11, "twice"), (11, "twice"), (12, "same length a"), (13, "same length b"), (14, "alone"),
]


def test_cases(spark):
    table = docs(spark, CASES)
    found = exact_dedup.grouped(table)
    assert sorted(map(tuple, seen(found)), key=str) == brute(CASES)
    stays = found.where("last IS NULL OR last.row = row").count()
    assert stays == len({fold(t) for _, t in CASES})
    kept = exact_dedup.one_of_each(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, fold(r.text)) for r in kept.collect()), key=str)
    assert got == sorted({(keep, fold(t)) for (_, t), keep in zip(CASES, [next(k for i2, k, n in brute([(j, u) for j, u in CASES if fold(u) == fold(t)])) for _, t in CASES], strict=True)}, key=str)
    assert exact_dedup.grouped(table.limit(0)).count() == 0 and exact_dedup.one_of_each(table.limit(0)).count() == 0


def test_case_counts_without_fold(spark):
    found = {(r.doc_id, r.keep) for r in seen(exact_dedup.grouped(docs(spark, CASES), fold=False))}
    assert (1, 1) in found and (2, 2) in found and (11, 11) in found and (4, 5) in found


def test_rows_left_alone_have_no_digest(spark):
    """Only rows whose length and beginning are shared are read whole."""
    rows = exact_dedup.digests(docs(spark, CASES))
    got = {r.doc_id: r.digest for r in rows.collect() if r.doc_id is not None}
    assert got[14] is None and got[3] is None and got[12] is None
    assert got[8] == got[9] != got[10] and got[10] is not None and got[1] == hashlib.sha256(b"some text").hexdigest()


def test_hot_groups_and_the_bit_map(spark, monkeypatch):
    """A third of all rows in one group, and keys beyond the broadcast: same result."""
    draw = random.Random(5)
    rows = [(i, "the hot one" if i % 3 == 0 else f"text {draw.randrange(400)} " + "tail " * draw.randrange(3)) for i in range(3000)]
    table = docs(spark, rows)
    assert sorted(map(tuple, seen(exact_dedup.grouped(table))), key=str) == brute(rows)
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 3)
    monkeypatch.setattr(exact_dedup, "MAP_BITS", 10)
    assert sorted(map(tuple, seen(exact_dedup.grouped(table))), key=str) == brute(rows)
    assert exact_dedup.one_of_each(table).count() == len({t for _, t in rows})
