"""Collocations against plain counters, and texts longer than a chunk."""

import random
import re
from collections import Counter

import pytest

from splitboard.llm import collocations

DOC = "doc_id long, text string, lang string, n int, k int, part int, phrase string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 0, 0, 0, "") for i, (t, g) in enumerate(rows)], DOC)


def brute(rows, min_count, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", folded):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    longer = Counter()
    for g, a in f.items():
        if len(g) == 4 and a >= min_count:
            for inner in (g[:3], (g[0], *g[2:])):
                longer[inner] = max(longer[inner], a)
    out = {}
    for (lang, *g), a in f.items():
        if len(g) > 1 and a >= min_count and 100 * longer[lang, *g] < 50 * a:
            score, _, left, right = min((10**6 * a * a // (f[lang, *g[:k]] * f[lang, *g[k:]]), k, f[lang, *g[:k]], f[lang, *g[k:]]) for k in range(1, len(g)))
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def prose(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Über", "über", "a b", "\x1c", "A"]
    return [("".join(draw.choice(words) + draw.choice("    \t.,\n!") for _ in range(draw.randrange(60))), draw.choice(["en", "en", "de", None])) for _ in range(n)]


def seen(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("chunk", [8 << 20, 40, 7])
def test_collocations_equal_counters(spark, monkeypatch, chunk):
    """Chunks of any length give the same counts: words at a cut are counted once, phrases over it too."""
    rows = [*prose(1, 150), (None, "en"), ("", "fr"), (" \t ", "fr"), ("so so so so so so so so so so so so", "so"), ("x" * 200 + " y", "x")] + [("once upon a time", "en")] * 40
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    assert seen(collocations.collocations(docs(spark, rows), 4, 50)) == brute(rows, 4, 50)


def test_odd_tables(spark, monkeypatch):
    assert collocations.collocations(docs(spark, [("a b", "en")]).limit(0)).count() == 0
    assert collocations.collocations(docs(spark, [(None, "en"), ("", None)])).count() == 0
    hot = [("the very hot phrase", "en")] * 500 + [(f"the {i % 20} thing", "en") for i in range(400)] + [("word " * 300_000, "xx")]
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 2)
    assert seen(collocations.collocations(docs(spark, hot))) == brute(hot, 10, 2000)


def test_products_beyond_64_bits(spark):
    """The decimal expression that scores are made of."""
    a, left, right = 10**12, 10**12 + 7, 10**12 + 9
    row = spark.sql(f"SELECT (1000000BD * cast({a}L AS decimal(13,0)) * cast({a}L AS decimal(13,0))) div (cast({left}L AS decimal(13,0)) * cast({right}L AS decimal(13,0))) AS s").first()
    assert row.s == 10**6 * a * a // (left * right)
