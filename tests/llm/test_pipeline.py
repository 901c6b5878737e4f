import numpy as np

import corpus_pipeline
from splitboard.llm import simhash_dedup


def test_all_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    counts = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_small)
        rows = out.collect()
        assert out.columns == docs.columns, name
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_empty_and_odd_documents(spark, sf_small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = "the quick brown fox jumps over the lazy dog and runs away from it "
    rows = [(1, prose * 9, "en", None, None), (2, prose * 9 + "today", None, "s", 1), (3, None, "en", "s", 1), (4, "", None, None, None), (5, "123 456", "en", "s", 1), (None, "some other words that nobody else has written", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    for some in (docs, docs.limit(0)):
        for _, step in corpus_pipeline.STAGES[:-1]:
            some = spark.createDataFrame(step(spark, some, sf_small).collect(), schema)
        ids = {r.doc_id for r in some.collect()}
        assert ids in ({1, None}, set())
        corpus_pipeline.STAGES[-1][1](spark, some, sf_small).collect()


def test_clashing_columns(spark, sf_small):
    """Columns that stages use inside do no harm, and only those of documents come back."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(60)
    for name in ("lang_pred", "score", "dropped", "own_doc", "text_id", "code", "root", "w_doc", "c_doc", "h1"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    rows = docs.collect()
    docs = spark.createDataFrame(rows, docs.schema)
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, sf_small).columns == corpus_pipeline.COLUMNS, name
        assert 0 < step(spark, docs, sf_small).count() <= len(rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).count() >= len(rows)


def test_near_copies(spark):
    """Exact and near copies leave one; texts that share half their words stay; the smallest doc_id is kept."""
    words = [f"w{i * 7919 % 1009}x{i}" for i in range(400)]
    text = " ".join(words)
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (50, 120, 300)]
    half = " ".join([*words[:200], *[f"other{i}" for i in range(200)]])
    rows = [(9, text), (4, text), *[(20 + i, t) for i, t in enumerate(near)], (30, half), (31, "short text"), (32, "short text"), (33, None), (34, ""), (40, half[::-1]), (40, half[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_dedup.one_of_each(df).collect()) == [4, 30, 31, 33, 40]


def test_chunks_of_large_buckets_lose_nothing(spark):
    from pyspark.sql import functions as F

    from splitboard.llm.components import components

    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven eight nine ten " * 20), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("")).alias("text"))
    codes = simhash_dedup.sketches(docs).withColumn("code", F.xxhash64("fp", *[f"s{i}" for i in range(simhash_dedup.SKETCH)])).dropDuplicates(["code"]).drop("doc_id", "text_id")
    whole, cut = (sorted(map(tuple, components(simhash_dedup.near_links(codes, bucket)).collect())) for bucket in (4096, 7))
    assert whole == cut and len(whole) > 30


def edited(rng, kind, n, similarity):
    """Two texts of n five-word shingles or so at the similarity or just above it, and their exact similarity."""
    words = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
    if kind == "appended":
        other = words + [f"a{x}" for x in rng.integers(0, 10**9, int(n / similarity) - n)]
    elif kind == "cut":
        other = words[: int(np.ceil(n * similarity)) + 4]
    else:  # each changed word far from the others takes five shingles from both
        other, most = list(words), int(n * (1 - similarity) / (1 + similarity) / 5)
        for i in np.linspace(5, n - 6, most).astype(int):
            other[i] = f"c{rng.integers(10**9)}"
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (words, other))
    return " ".join(words), " ".join(other), len(x & y) / len(x | y)


def test_recall_and_precision_of_near_copies(spark):
    """Pairs at 0.8 are found whatever the edit; pairs at 0.75 stay two documents."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for similarity in (0.8, 0.75):
        for kind in ("appended", "cut", "substituted"):
            for _ in range(150):
                a, b, exact = edited(rng, kind, 200, similarity)
                want[len(rows) + 1] = kind, exact
                rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = {r.doc_id for r in simhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, (_, exact) in want.items() if exact < 0.8} <= kept
    for kind in ("appended", "cut", "substituted"):
        near = [i for i, (k, exact) in want.items() if k == kind and exact >= 0.8]
        assert len(near) >= 150 and sum(i not in kept for i in near) >= 0.99 * len(near)


def test_large_groups_of_near_copies_are_verified(spark):
    """In a bucket too large for all its pairs, chains are followed and no pair below 0.8 is linked."""
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(204)]
    rows = [(i, " ".join([*words[: 204 - 4 * (i % 30)], *[f"x{i // 30}y{k}" for k in range(2)]])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(simhash_dedup.shingle_set(t).tolist()) for _, t in rows]
    root = list(range(90))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    made = simhash_dedup.sketches(docs).withColumn("code", F.col("fp"))
    for small, chunk in ((16, 2048), (2, 7)):
        roots = {r.code: r.root for r in simhash_dedup.near_components(docs, made, small, chunk).collect()}
        code = {r.doc_id: r.code for r in made.collect()}
        got = [roots.get(code[i], code[i]) for i in range(90)]
        assert len(set(got)) == len(set(root)) == len(set(zip(got, root, strict=True)))


def test_fingerprints_give_candidates(spark, monkeypatch):
    """Without shared keys the links come from fingerprints at two or fewer bits, and each is verified."""
    words = [f"w{i * 7919 % 1009}x{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words[:1400])), (4, "a b c d e f"), (5, "A  b c d e f"), (6, None), (7, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = simhash_dedup.sketches(docs).collect()
    prints = {r.doc_id: r.print for r in made}
    assert prints[1] == simhash_dedup.fingerprint(rows[0][1], simhash_dedup.NEAR_WORDS) and bin((prints[1] ^ prints[2]) % 2**64).count("1") <= 2
    monkeypatch.setattr(simhash_dedup, "pairs_of", lambda buckets, small: buckets.where("false").selectExpr("code AS a", "code AS b"))
    assert sorted(r.doc_id for r in simhash_dedup.one_of_each(docs).collect()) == [1, 3, 4, 6, 7]


def test_keys_of_long_texts(monkeypatch):
    """Keys are the same however many shingles are hashed at a time."""
    family = np.random.default_rng(1).integers(0, 2**64, (2, simhash_dedup.SKETCH * simhash_dedup.KEY_MINIMA), dtype=np.uint64)
    grams = np.unique(np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64))
    whole = simhash_dedup.minima_keys(grams, family)
    monkeypatch.setattr(simhash_dedup, "BLOCK", 7)
    assert simhash_dedup.minima_keys(grams, family) == whole


def test_sets_are_made_where_texts_are_read(spark, monkeypatch):
    """No text is shuffled or sorted for its set; repeated rows still give one set a code."""
    plans, stage = [], simhash_dedup.stage

    def seen(df, name):
        if name == "shingle-sets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(simhash_dedup, "stage", seen)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(5 + i))) for i in range(40)]
    for repeats in (1, 3):
        docs = spark.createDataFrame(rows * repeats, "doc_id long, text string")
        codes = simhash_dedup.sketches(docs).withColumn("code", simhash_dedup.F.col("fp")).dropDuplicates(["code"])
        code = {r.doc_id: r.code for r in codes.collect()}
        plans.clear()
        got = simhash_dedup.near_sets(docs, codes.select("code", "doc_id", "text_id"))
        if repeats == 1:
            assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and not any(x in plans[0] for x in ("hashpartitioning", "Sort"))
        assert sorted((r.code, r.grams) for r in got.collect()) == sorted((code[i], simhash_dedup.shingle_set(t).view("<i8").tolist()) for i, t in rows)


def test_a_batch_goes_back_in_parts():
    """However many texts Spark sends at once, few sets are held at a time, all of them come back."""
    import pyarrow as pa

    texts = [" ".join(f"w{i}x{k}" for k in range(i % 9)) for i in range(1000)]
    out = list(simhash_dedup.sets_of(iter([pa.RecordBatch.from_pydict({"code": list(range(1000)), "text": texts})])))
    assert max(b.num_rows for b in out) <= simhash_dedup.PART
    got = [(r["code"], r["grams"]) for b in out for r in b.to_pylist()]
    assert got == [(i, simhash_dedup.shingle_set(t).view("<i8").tolist()) for i, t in enumerate(texts)]


def test_python_gets_few_texts_at_a_time(spark, tmp_path):
    """Batches are small inside, and the session's setting is back afterwards, also after an error."""
    import pytest

    from splitboard.sources import small_batches

    name, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", lambda batches: (b.slice(0, 0).from_pydict({"n": [b.num_rows]}) for b in batches)
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), small_batches(spark):
        spark.range(5000, numPartitions=1).mapInArrow(sizes, "n long").write.parquet(f"{tmp_path}/sizes")
        1 / 0  # noqa: B018
    rows = [r.n for r in spark.read.parquet(f"{tmp_path}/sizes").collect()]
    assert spark.conf.get(name) == before and sum(rows) == 5000 and max(rows) <= 1000
