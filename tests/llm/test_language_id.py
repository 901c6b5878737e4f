import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitboard.llm import language_id as ln


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = ln.op3_language_id(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(truth) and len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) >= 0.98


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (5, ln.WINDOW)).astype(np.uint8)
    model = ln.train(windows, np.array([0, 1, 2, 0, 1]), 3)
    pooled = []
    for w in ln.WIDTHS:
        out = [[sum(model[f"w{w}"][j][x[i + j]] for j in range(w)) for i in range(ln.PLACES)] for x in windows]
        pooled.append(np.array(out).max(axis=1))
    hidden = np.maximum(np.concatenate(pooled, axis=1) + model["offset"], 0)
    want = ln.softmax(hidden @ model["out"] + model["bias"])
    assert np.allclose(ln.probabilities(windows, model, *ln.tables(model)), want, atol=1e-5)


def test_windows_cover_every_place():
    for n in (0, 1, 255, 256, 257, 508, 509, 510, 5000):
        raw = bytes(97 + i % 26 for i in range(n))
        windows = ln.windows_of(raw.decode())
        joined = b"".join(w[: ln.PLACES].tobytes() for w in windows[:-1]) + windows[-1].tobytes()
        assert joined[:n] == raw and not joined[n:].strip(b"\0")


def test_odd_rows(spark):
    base = [(i, f"{'the cat and dog' if i % 2 else 'der hund und katze'} {i}", "en" if i % 2 else "de", "x") for i in range(60)]
    odd = [(None, None, None, "x"), (100, "", "en", "x"), (101, "123 ...", "de", "x"), (102, "der und " * 20_000, None, "x"), (102, "the and", "en", None)]
    docs = spark.createDataFrame(base + odd, "doc_id long, text string, lang string, score string")
    found = {(r.doc_id, (r.text or "")[:7]): r for r in ln.identify(docs).collect()}
    assert found[None, ""].lang_pred == found[100, ""].lang_pred == found[101, "123 ..."].lang_pred == "und"
    assert found[102, "der und"].lang_pred == "de" and found[102, "the and"].lang_pred == "en"
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in ln.identify(unlabelled).collect()} == {"und"}
    assert ln.identify(docs.limit(0)).count() == 0


def test_repeated_rows_are_one_document_of_the_sample(spark):
    """A language of very many rows but few ids is learned like any other; one of few rows, too."""
    base = [(i, f"{'the cat and dog went' if i % 2 else 'der hund und die katze'} {i}", "en" if i % 2 else "de") for i in range(200)]
    few = spark.createDataFrame([*base, (1000, "le chat et le chien", "fr"), (1001, "où est le chat", "fr")], "doc_id long, text string, lang string")
    same = spark.range(100_000).selectExpr("2000 + id % 3 AS doc_id", "'kot i pies w domu ' || (id % 3) AS text", "'pl' AS lang")
    found = ln.identify(few.union(same)).groupBy("lang", "lang_pred").count().collect()
    assert {(r.lang, r.lang_pred): r["count"] for r in found if r.lang == "pl"} == {("pl", "pl"): 100_000}
    assert all(r.lang == r.lang_pred for r in found if r.lang in ("en", "de"))
    assert ln.learn(few.union(same), F.lit(True))[0] == ["de", "en", "fr", "pl"]


def test_languages_without_end_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(ln, "MAX_LANGS", 5)
    docs = spark.range(30).selectExpr("id AS doc_id", "'text' AS text", "'l' || id AS lang")
    with pytest.raises(ValueError, match="more than 5"):
        ln.identify(docs)
