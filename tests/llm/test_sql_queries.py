"""Queries that SQL can express against it, and the cases that the operators' docstrings define."""

import pytest

from splitboard.llm import decontaminate, license_scan, line_dedup
from splitboard.llm.registry import ORACLES, QUERIES
from tests.oracle import compare

DOC = "doc_id long, text string, h1 int, rank int, words int, size int"


def docs(spark, *rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], DOC)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, sf), ORACLES[name], sf)


def kept(df):
    rows = line_dedup.with_bitmaps(df)
    shown = rows.select("doc_id", line_dedup.kept_text(rows["text"], rows["dropped"]).alias("t"), line_dedup.n_dropped(rows["dropped"]).alias("n"))
    return sorted(((r.doc_id, r.t, r.n) for r in shown.collect()), key=str)


def test_line_dedup_cases(spark):
    line = "A line that is long enough to count"
    table = docs(
        spark, (1, f"x\n {line.upper()}\t\ny\n{line}\n"), (2, f"{line}\nshort"), (2, f"{line}\nother"), (3, f"{line}\n{line}"), (None, f"{line}\nkept"), (4, None), (5, ""), (6, "short"), (7, "short\n\n" * 50_000),
    )
    got = kept(table)
    assert (1, "x\ny\n", 2) in got and (2, "short", 1) in got and (2, "other", 1) in got
    assert (3, f"{line}\n{line}", 0) in got and (None, f"{line}\nkept", 0) in got and (4, "", 0) in got and (5, "", 0) in got
    assert next(r for r in got if r[0] == 7)[2] == 0
    assert kept(docs(spark, (1, line), (1, line), (2, line))) == [(1, line, 0), (1, line, 0), (2, line, 0)]  # two documents only
    assert kept(table.limit(0)) == []


def test_line_dedup_of_one_key_everywhere(spark):
    line = "the very same line in all the documents"
    got = kept(docs(spark, *[(i, f"{line}\nown {i}\n{line}") for i in range(300)]))
    assert sum(n for *_, n in got) == 2 * 299 and (299, f"{line}\nown 299\n{line}", 0) in got and (5, "own 5", 2) in got


def test_license_cases(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    table = docs(spark, (1, f"a\nUNDER the MIT license, under-the mit LICENSE\n{notice}"), (2, None), (3, ""), (4, "é ß apache license"), (5, "w " * 30_000 + "cc-by-NC"), (6, notice), (6, notice), (None, "under the\nmit license"))
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan(table).collect()}
    first = got[1, 17]
    assert (first.n_base, first.first_word, first.last_word, first.base_labels, first.labels, first.score) == (3, 1, 12, "apache-2,mit", "apache-2,mit", 1.0)
    assert got[2, 0].labels == "" and got[2, 0].score == 0 and got[2, 0].first_word is None and got[4, 4].labels == ""
    assert got[5, 30_003].first_word == 30_000 and got[None, 4].n_base == 1
    assert license_scan.scan(table).count() == 8 and license_scan.scan(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(table, [license_scan.Template("x", "w " * 401)])


def test_licenses_over_lines_and_siblings(spark):
    """Notices wrapped in any way and behind comment signs are found; siblings are told apart; scattered words are no notice.

    The phrase "cc by nc" stands in the longer names of its family, too, so its base label stays beside theirs.
    """
    grant = "# Permission is hereby\n# granted, free of charge, to any person\n# obtaining a copy of this software and so on"
    scattered = " ".join(f"{w} and then much else was said here {i}" for i, w in enumerate("permission is hereby granted free of charge to any person obtaining a copy of this software".split()))
    cases = {
        1: (grant, "mit"), 2: (" * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided", "bsd"),
        3: ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. */", "mpl-2"),
        4: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 5: ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        6: ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"), 7: ("This work is licensed under a Creative Commons Attribution 4.0\nInternational License.", "cc-by"),
        8: (scattered, ""), 9: ("released under the new license of ours", ""), 10: ("word " * 500 + grant + " word" * 500, "mit"), 11: (f"{grant}\n" * 300, "mit"),
        12: ("Licensed under the GNU Lesser General Public License, version 3.", ""), 13: ("Licensed under CC BY 4.0.", "cc-by"), 14: ("Licensed under CC BY-ND 4.0.", "cc-by-nd"),
        15: ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa"), 16: ("Licensed under CC BY-NC-ND 4.0.", "cc-by-nc,cc-by-nc-nd"),
        17: ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
        18: ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
        19: ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
        20: ("license " * 20_000 + "Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    }
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, *[(i, t) for i, (t, _) in cases.items()])).collect()}
    assert {i: r.labels for i, r in got.items()} == {i: want for i, (_, want) in cases.items()}
    assert got[1].score == 1.0 and 0.8 <= got[2].score <= 1.0


def test_decontaminate_cases(spark):
    item = " ".join(f"word{i}" for i in range(30))
    items = spark.createDataFrame([(1, item, 0), (2, "Tiny Item", 0), (3, None, 0), (4, "", 0), (1, item, 0)], "item_id long, text string, n int")
    edited = item.replace("word15", "changed")
    table = docs(
        spark, (1, f"before {item.upper().replace(' ', ', ')} after"), (2, edited), (3, edited.replace("word5 ", "x ")), (4, "a tiny-item here"), (5, None), (6, ""), (None, item), (7, ("pad " * 50_000) + item), (8, item), (8, item), (9, "word1 word2"),
    )
    got = sorted(((r.doc_id, r.item_id, r.containment) for r in decontaminate.contained(table, items).collect()), key=str)
    assert got == sorted([(1, 1, 1.0), (2, 1, round(21 / 26, 6)), (4, 2, 1.0), (None, 1, 1.0), (7, 1, 1.0), (8, 1, 1.0)], key=str)
    left = [r.doc_id for r in decontaminate.without_contaminated(table, items).collect()]
    assert sorted(left) == [3, 5, 6, 9]
    assert decontaminate.contained(table.limit(0), items).count() == 0 and decontaminate.contained(table, items.limit(0)).count() == 0


def test_decontaminate_beyond_the_broadcast(spark, monkeypatch):
    """Past the broadcast's limit the bit map and the salted join give the same pairs, short items included."""
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(3 + 9 * i)), 0) for i in range(30)], "item_id long, text string, n int")
    texts = {r.item_id: r.text for r in items.collect()}
    table = docs(spark, *[(d, f"start {texts[d % 30]} middle {texts[(d * 7) % 30]} end") for d in range(60)], *[(100 + d, f"all hold {texts[29]} and {d}") for d in range(200)])
    few = sorted(map(tuple, decontaminate.contained(table, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(decontaminate, "FILTER_WORDS", 64)
    assert sorted(map(tuple, decontaminate.contained(table, items).collect())) == few and len(few) >= 300


def test_short_items_equal_the_sql(spark, tmp_path):
    from tests.oracle import connect, plain

    sf = "/root/testdata/sf0.001"
    words = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(5).collect()]
    rows = [(i, " ".join(t.split()[3 : 3 + n])) for i, (t, n) in enumerate(zip(words, (1, 2, 4, 5, 40), strict=True))] + [(9, ""), (10, None)]
    found = decontaminate.contained(spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame(rows, "item_id long, text string")).drop("text_id")
    with connect(sf) as db:
        db.execute("CREATE OR REPLACE TABLE own (item_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO own VALUES (?, ?)", rows)
        result = db.execute(decontaminate.OP2_SQL.replace("FROM benchmark", "FROM own"))
        wanted = sorted(tuple(map(plain, r)) for r in result.fetchall())
        columns = [c[0] for c in result.description]
    assert sorted(tuple(map(plain, r)) for r in found.select(*columns).collect()) == wanted and len(wanted) > 5
