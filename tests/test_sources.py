import json

from splitboard.sources.documents import discovered_events, document_set, manifest, write_report


def test_document_set(spark, tmp_path):
    for name in ("b.pdf", "a.PDF", "notes.txt", "__MACOSX/b.pdf", "deep/c.pdf"):
        path = tmp_path / "set" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"%PDF" + name.encode())
    rows = document_set(spark, f"{tmp_path}/set").orderBy("filename").collect()
    assert [r.filename for r in rows] == ["a.PDF", "b.pdf", "c.pdf"] and bytes(rows[0].content).startswith(b"%PDF")


def test_two_generations_of_manifests(spark, tmp_path):
    (tmp_path / "new.json").write_text(json.dumps({"source_page": "p", "category_counts": {"x": 1}, "files": [{"url": "u", "filename": "f", "category": "x", "sha256": "h", "bytes": 3}]}, indent=1))
    (tmp_path / "old.json").write_text(json.dumps({"source_page": "q", "count": 2, "files": [{"url": "u", "filename": "f", "sha256": "h"}, {"url": "v", "filename": "g"}]}, indent=1))
    rows = {(r.source_page, r.ord): r for r in manifest(spark, f"{tmp_path}/*.json").collect()}
    assert rows["p", 0].category == "x" and rows["p", 0].bytes == 3 and rows["q", 1].category is None and len(rows) == 3


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([(0, "ok", "a"), (1, "ok", "b"), (2, "error", "c")], "ord int, status string, url string")
    write_report(rows, "status", "run", f"{tmp_path}/report")
    read = spark.read.json(f"{tmp_path}/report/header").first()
    assert (read.title, read.total) == ("run", 3) and read.counts.asDict() == {"error": 1, "ok": 2}
    assert sorted(r.url for r in spark.read.json(f"{tmp_path}/report/rows").collect()) == ["a", "b", "c"]


def test_discovery_file(spark, tmp_path):
    (tmp_path / "found.json").write_text(json.dumps({"events": [{"title": "T", "url": "u", "status": "results_available", "pdf_count": 1, "pdfs": [{"url": "v", "filename": "f", "category": "c"}]}, {"title": "S", "url": "w"}]}, indent=1))
    rows = discovered_events(spark, f"{tmp_path}/found.json").orderBy("ord").collect()
    assert [(r.ord, r.title, r.pdf_count) for r in rows] == [(0, "T", 1), (1, "S", None)] and rows[0].pdfs[0].filename == "f"
