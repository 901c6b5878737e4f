"""Phrase collocation mining with stripes: each prefix keys an associative counter of the words that follow it.

A stripe belongs to a language and a prefix of no, one or two words, and counts by next word. The empty prefix counts words, so it
has the totals of all prefixes of one word; stripes of one word have the totals of prefixes of two; those of two words are the
longest extensions. All three orders travel as one structure and are merged elementwise:

1. tasks cut texts into words in chunks of CHUNK bytes, number the chunk's words and count its n-grams by sorting integers (numpy).
   Each chunk sends its stripes in sorted coordinate form (prefix, next, count), a column after the other in the smallest integers that
   hold them, with the words they use;
2. stripes are dealt over parts by a hash of prefix and next word, so that of a frequent word is split over all parts and no task holds
   one whole; the number of parts grows with the bytes of text, one for PART_BYTES;
3. a part's stripes of one language are merged: words are numbered anew, equal (prefix, next) are added. Extensions below
   ``min_count`` go: no candidate holds them, since a phrase is never more frequent than what it contains;
4. cuts and subsumption are joins and maxima over what is left. Tables of parts of phrases are broadcast up to BROADCAST_ROWS rows, else
   joined by sort-merge, where adaptive execution splits the rows of a hot word. Scores are exact: products are decimals of 38 digits.

Defined cases: a null text is empty; a null lang is ``und``; a text without words counts nothing; repeated rows count each for itself; an empty
table gives an empty result; further columns are left alone. A text longer than a chunk is cut between words, and the next
chunk begins with the last two words, counted once; a single word is never cut.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splitboard.llm.text import sized
from splitboard.sources import load, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package installed

MIN_COUNT = 10
TOP = 2000
CHUNK = 4 << 20
PART_BYTES = 16 << 20
ROWS_SENT = 32
LEAST_PARTS = 128
BROADCAST_ROWS = 400_000
SALTS = 4
#: A-Z become a-z, a tab a blank, and what ends a piece a line feed.
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
ORDERS = (1, 2, 3)
STRIPES = "lang string, part int, words string, id_type string, n_type string, " + ", ".join(f"w{k} binary, n{k} binary" for k in ORDERS)
MERGED = "lang string, k int, w1 string, w2 string, w3 string, n long"


def slices(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A folded text in slices of about CHUNK bytes, each with the number of words at its start that an earlier one has counted."""
    start, skip, gap = 0, 0, re.compile(rb"[ \n]")
    at = CHUNK
    while (found := gap.search(text, at)) is not None and found.start() < len(text) - 1:
        cut = found.start()
        yield text[start:cut], skip
        start, skip = cut, 0
        if text[cut] == 32:  # go back over two words of the same piece
            for _ in range(2):
                end = start
                while end and text[end - 1] == 32:
                    end -= 1
                if not end or text[end - 1] == 10:
                    break
                start = max(text.rfind(b" ", 0, end), text.rfind(b"\n", 0, end)) + 1
                skip += 1
        at = max(start, cut) + CHUNK
    yield text[start:], skip


def tokens(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of folded bytes and the number of each word's piece."""
    raw = np.frombuffer(data, np.uint8)
    inside = (raw != 32) & (raw != 10)
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, np.searchsorted(np.flatnonzero(raw == 10), starts)


def counted(lang: str, data: bytes, skip: int, parts: int) -> Iterator[dict]:
    """The stripes of one chunk as STRIPES, one row for each part."""
    words, piece = tokens(data)
    if len(words) <= skip:
        return
    coded = words.dictionary_encode()
    ids, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    size = len(vocabulary)
    ones = np.bincount(ids[skip:], minlength=size)
    # A position is that of an n-gram's last word.
    at2 = np.flatnonzero(piece[1:] == piece[:-1]) + 1
    pairs, pair_of = np.unique(ids[at2 - 1] * size + ids[at2], return_inverse=True)
    twos = np.bincount(pair_of[at2 >= skip], minlength=len(pairs))
    pair_at = np.full(len(ids), -1)
    pair_at[at2] = pair_of
    at3 = np.flatnonzero(piece[2:] == piece[:-2]) + 2
    triples, threes = np.unique(pair_at[at3 - 1] * size + ids[at3], return_counts=True)
    found = {
        1: (np.arange(size)[:, None], ones),
        2: (np.stack([pairs // size, pairs % size], axis=1), twos),
        3: (np.stack([pairs[triples // size] // size, pairs[triples // size] % size, triples % size], axis=1), threes),
    }
    hashes = np.array([zlib.crc32(w) for w in vocabulary.to_pylist()], np.uint64)
    dealt = {}
    for k, (grams, n) in found.items():
        grams, n = grams[n > 0], n[n > 0]
        mixed = np.zeros(len(grams), np.uint64)
        for column in grams.T:
            mixed = (mixed + hashes[column] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        dealt[k] = grams[order], n[order], np.searchsorted(part[order], np.arange(parts + 1))
    names = vocabulary.to_numpy(zero_copy_only=False)
    for part in range(parts):
        own = {k: (grams[bounds[part] : bounds[part + 1]], n[bounds[part] : bounds[part + 1]]) for k, (grams, n, bounds) in dealt.items()}
        used, local = np.unique(np.concatenate([grams.ravel() for grams, _ in own.values()]), return_inverse=True)
        if not len(used):
            continue
        id_type, n_type = np.min_scalar_type(len(used)), np.min_scalar_type(max(n.max(initial=0) for _, n in own.values()))
        row = {"lang": lang, "part": part, "words": b" ".join(names[used]).decode(), "id_type": id_type.str, "n_type": n_type.str}
        begin = 0
        for k, (grams, n) in own.items():
            ids = local[begin : begin + grams.size].reshape(grams.shape)
            row |= {f"w{k}": ids.T.astype(id_type).tobytes(), f"n{k}": n.astype(n_type).tobytes()}
            begin += grams.size
        yield row


def chunk_stripes(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, text) as STRIPES; texts of one language are gathered until they fill a chunk."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def sent(lang: str) -> Iterator[pa.RecordBatch]:
        sizes.pop(lang)
        for data, skip in slices(b"\n".join(held.pop(lang))):
            rows = counted(lang, data, skip, parts)
            while some := list(islice(rows, ROWS_SENT)):
                yield pa.RecordBatch.from_pylist(some, schema=SCHEMA)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_buffer().to_pybytes().translate(FOLDED) if text.is_valid else b""
            held.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data) + 64
            if sizes[lang] >= CHUNK:
                yield from sent(lang)
            if sum(sizes.values()) >= 2 * CHUNK:
                for every in list(held):
                    yield from sent(every)
    for lang in list(held):
        yield from sent(lang)


ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in (field.split(" ") for field in STRIPES.split(", "))])
MERGED_SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in (field.split(" ") for field in MERGED.split(", "))])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], np.add.reduceat(n[order], firsts) if len(keys) else n


def merged_stripes(table: pa.Table, min_count: int) -> pa.Table:
    """All stripes of one language and part, added elementwise; k = 0 has the number of words."""
    lang = table["lang"][0].as_py()
    split = pc.split_pattern(table["words"].combine_chunks(), " ")
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    coded = split.flatten().dictionary_encode()
    ids, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    id_types, n_types = table["id_type"].to_pylist(), table["n_type"].to_pylist()
    begins, size = split.offsets.to_numpy().astype(np.int64), len(vocabulary)
    out = []
    for k in ORDERS:
        grams = np.concatenate([ids[np.frombuffer(w, t).reshape(k, -1).T + begin] for w, t, begin in zip(table[f"w{k}"].to_pylist(), id_types, begins[:-1], strict=True)])
        n = np.concatenate([np.frombuffer(w, t).astype(np.int64) for w, t in zip(table[f"n{k}"].to_pylist(), n_types, strict=True)])
        if k == 1:
            out.append((0, [], np.array([n.sum()])))
        # The prefix is numbered first where prefix and word do not fit one integer.
        keys, heads = grams[:, 0], np.arange(size)[:, None]
        for i in range(1, k):
            keys = keys * size + grams[:, i]
            if i < k - 1:
                distinct, keys = np.unique(keys, return_inverse=True)
                heads = np.concatenate([heads[distinct // size], (distinct % size)[:, None]], axis=1)
        keys, n = summed(keys, n)
        keys, n = keys[n >= min_count], n[n >= min_count]
        grams = heads[keys] if k == 1 else np.concatenate([heads[keys // size], (keys % size)[:, None]], axis=1)
        out.append((k, [vocabulary.take(pa.array(g)) for g in grams.T], n))
    blank = lambda n: pa.nulls(n, pa.string())
    tables = []
    for k, words, n in out:
        columns = [*words, *[blank(len(n)) for _ in range(3 - len(words))]]
        tables.append(pa.Table.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), k, np.int32)), *columns, pa.array(n)], schema=MERGED_SCHEMA))
    return pa.concat_tables(tables)


def phrase_counts(docs: DataFrame, min_count: int) -> DataFrame:
    """MERGED of docs (lang, text): all words, pairs and triples of at least min_count occurrences, written; k = 0: parts of the number of words."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    octets = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, octets // PART_BYTES)
    stripes = rows.mapInArrow(lambda batches: chunk_stripes(batches, parts), STRIPES)
    merged = stripes.groupBy("lang", "part").applyInArrow(lambda table: merged_stripes(table, min_count), MERGED)
    return stage(merged, "phrase-counts")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the first top phrases of two and three words by their weakest cut.

    A phrase inside a longer candidate that has half of its occurrences or more is left out.
    """
    counts = phrase_counts(docs, min_count)
    of = lambda k: counts.where(F.col("k") == k)
    ones = sized(stage(of(1).select("lang", "w1", "n"), "words"), BROADCAST_ROWS, "merge")
    twos = sized(stage(of(2).select("lang", "w1", "w2", "n"), "pairs"), BROADCAST_ROWS, "merge")

    def with_count(rows: DataFrame, known: DataFrame, words: list[str], name: str) -> DataFrame:
        renamed = known.select("lang", *[F.col(f"w{i + 1}").alias(w) for i, w in enumerate(words)], F.col("n").alias(name))
        return rows.join(renamed, ["lang", *words])

    def scored(left: str, right: str) -> Column:
        a, x, y = (f"cast({c} AS decimal(13, 0))" for c in ("n", left, right))
        return F.expr(f"struct((1000000BD * {a} * {a}) div ({x} * {y}) AS score, {left} AS l, {right} AS r)")

    pairs = with_count(with_count(of(2), ones, ["w1"], "f1"), ones, ["w2"], "f2").withColumn("cut", scored("f1", "f2"))
    triples = with_count(with_count(of(3), ones, ["w1"], "f1"), twos, ["w2", "w3"], "f23")
    triples = with_count(with_count(triples, twos, ["w1", "w2"], "f12"), ones, ["w3"], "f3")
    first, second = scored("f1", "f23"), scored("f12", "f3")
    triples = triples.withColumns({"c1": first, "c2": second}).withColumn("cut", F.when(F.col("c2.score") < F.col("c1.score"), F.col("c2")).otherwise(F.col("c1")))

    longest = of(3).select("lang", "w1", "w2", "n").union(of(3).select("lang", "w2", "w3", "n")).groupBy("lang", "w1", "w2").agg(F.max("n").alias("longer"))
    subsumed = sized(stage(longest, "extensions"), BROADCAST_ROWS, "merge")
    pairs = pairs.join(subsumed, ["lang", "w1", "w2"], "left").where("longer IS NULL OR 100 * longer < 50 * n")

    phrase = F.concat_ws(" ", "w1", "w2", "w3").alias("phrase")
    every = pairs.select("lang", phrase, F.col("n").alias("a"), "cut.*").unionByName(triples.select("lang", phrase, F.col("n").alias("a"), "cut.*"))
    # A language may hold most phrases: its first ones are chosen in SALTS parts, so the task that ranks them gets SALTS times top rows at most.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")
    first = every.select("*", part).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= top)
    ranked = first.drop("salt", "nth").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = of(0).groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals.hint("shuffle_hash"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases."""
    return collocations(load(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS (SELECT lang, w[i : i + k - 1] AS g FROM words, (VALUES (1), (2), (3)) AS o(k), unnest(range(1, len(w) - k + 2)) AS r(i)
), f AS (SELECT lang, g, count(*) AS n FROM grams GROUP BY lang, g
), totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang
), candidates AS (SELECT lang, g, n AS a FROM f WHERE len(g) > 1 AND n >= 10
), cuts AS (SELECT lang, g, a, k, g[1 : k] AS g1, g[k + 1 :] AS g2 FROM candidates, (VALUES (1), (2)) AS o(k) WHERE k < len(g)
), scored AS (
  SELECT c.lang, c.g, c.a, x.n AS l, y.n AS r, k, (1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g1 JOIN f y ON y.lang = c.lang AND y.g = c.g2
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), longer AS (
  SELECT lang, g, max(a) AS m FROM (SELECT lang, g[1 : 2] AS g, a FROM candidates WHERE len(g) = 3 UNION ALL SELECT lang, g[2 : 3], a FROM candidates WHERE len(g) = 3) GROUP BY lang, g
), kept AS (SELECT w.*, array_to_string(w.g, ' ') AS phrase FROM weakest w LEFT JOIN longer o ON o.lang = w.lang AND o.g = w.g WHERE o.m IS NULL OR 100 * o.m < 50 * w.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
