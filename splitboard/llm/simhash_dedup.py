"""SimHash near-dedup: fingerprints of documents, links at a small Hamming distance, components.

1. A document's fingerprint is made in the task that reads it: XXH64 of its shingles, a bit is 1
   if more than half the hashes set it.
2. Equal fingerprints are one class, taken together by a partial aggregate; a third of all documents with one
   fingerprint is one row from there on.
3. Classes are dealt to buckets: 64 bits are four blocks of 16; fingerprints at two or fewer
   differing bits agree in two whole blocks, so for each of the six pairs of blocks those that agree
   there meet in a bucket. A bucket of more than BUCKET classes is dealt again by the four blocks
   of eight of its other 32 bits, after which no bucket holds more than 2^16 classes, whatever
   the input: nothing is capped or dropped.
4. Inside a bucket the classes are sorted by Gray rank and indexed bottom-up: a node over FANOUT
   neighbours holds the bits that they share (a mask and a pattern). A search goes down from
   the top, adds up the differences in the bits that each level newly fixes, and leaves a whole group as
   soon as the sum exceeds the distance. All searches of a bucket go down together, in blocks.
5. A bucket returns links to its own components only, one row per class, never all pairs.
   The components of all buckets' links follow by contraction.

Defined cases: a text without words (null, empty) has fingerprint zero and links like any other; rows
without a doc_id get a fingerprint and a component, but give it no number: a component of such rows alone
is null; repeated rows link with each other; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.llm.components import Forest, components
from splitboard.llm.text import sized
from splitboard.operators.filters import might_be_in
from splitboard.sources import load, small_batches, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 3
DISTANCE = 2
BUCKET = 4096
FANOUT = 8
PAIRS = 1 << 18
LEADERS = 64
SEED = 42


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each sequence of width words (of all words, if they are fewer), repeats included."""
    import xxhash

    hashed, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(words)) - 1
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    return np.array([hashed(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that more than half the hashes set, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):  # bits of 8192 hashes at a time
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def words_of(text: str) -> list[bytes]:
    """bytes.lower() and bytes.split() act on A-Z and on ASCII white space alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str, width: int) -> int:
    """Fingerprint of a text's shingles; zero without words."""
    words = words_of(text)
    return majority(shingle_hashes(words, width)) if words else 0


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for each row of docs (doc_id, text)."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": [fingerprint(t or "", width) for t in batch["text"]]})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(made, "doc_id long, fp long")


class GrayIndex:
    """Hierarchical index over distinct 64-bit codes, sorted by Gray rank."""

    def __init__(self, codes: np.ndarray):
        rank = codes.copy()
        for shift in (1, 2, 4, 8, 16, 32):  # Gray code to binary
            rank ^= rank >> np.uint64(shift)
        self.order = np.argsort(rank, kind="stable")
        self.codes = codes[self.order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        mask, pattern = np.full(len(codes), full), self.codes
        self.levels = [(mask, pattern)]  # from the leaves up
        while len(pattern) > 1:
            firsts = np.arange(0, len(pattern), FANOUT)
            all_ones = np.bitwise_and.reduceat(pattern, firsts)
            any_one = np.bitwise_or.reduceat(pattern, firsts)
            same = np.bitwise_and.reduceat(mask, firsts) & ~(all_ones ^ any_one)
            mask, pattern = same, all_ones & same
            self.levels.append((mask, pattern))

    def within(self, queries: np.ndarray, distance: int, block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of the query, number of the code) at no more than the distance.

        As many searches go down together as cannot hold more than PAIRS codes at once, however dense the codes lie.
        """
        block = block or max(1, PAIRS // len(self.codes))
        for at in range(0, len(queries), block):
            part = queries[at : at + block]
            mask, pattern = self.levels[-1]
            q, node = np.arange(len(part)), np.zeros(len(part), dtype=np.int64)
            far = np.bitwise_count((part ^ pattern[0]) & mask[0]).astype(np.int64)
            keep = far <= distance
            q, node, far, above = q[keep], node[keep], far[keep], mask[node[keep]]
            for mask, pattern in self.levels[-2::-1]:
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, far, above = np.repeat(q, FANOUT), np.repeat(far, FANOUT), np.repeat(above, FANOUT)
                real = child < len(pattern)
                q, far, above, child = q[real], far[real], above[real], child[real]
                far = far + np.bitwise_count((part[q] ^ pattern[child]) & mask[child] & ~above)
                keep = far <= distance
                q, far, node = q[keep], far[keep], child[keep]
                above = mask[node]
            yield q + at, self.order[node]


def linked(rows: np.ndarray, distance: int, sketch_distance: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each row's code (column 0) with one of its component in this bucket.

    Column 1 is the fingerprint to search by; further columns are the words of a longer sketch
    that must lie within sketch_distance as well. In a large bucket some rows are compared with all others first;
    what that makes the largest component is connected already, so only the rows outside it are searched for, against all.
    """
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    codes, sketches = np.ascontiguousarray(rows[:, 1]).view("<u8"), np.ascontiguousarray(rows[:, 2:]).view("<u8")
    forest, queries = Forest(len(rows)), np.arange(len(rows))

    def alike(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64) <= sketch_distance if sketches.shape[1] else np.ones(len(b), dtype=bool)

    if len(rows) > 4 * LEADERS:
        for leader in np.linspace(0, len(rows) - 1, LEADERS).astype(int):
            near = np.flatnonzero(np.bitwise_count(codes[leader] ^ codes) <= distance)
            near = near[alike(leader, near)]
            forest.join(near, np.full(len(near), leader))
        root = forest.roots()
        queries = np.flatnonzero(root != np.bincount(root).argmax())
    for a, b in GrayIndex(codes).within(codes[queries], distance):
        a = queries[a]
        near = (a != b) & alike(a, b)
        forest.join(a[near], b[near])
    root = forest.roots()
    own = np.flatnonzero(root != np.arange(len(rows)))
    return rows[own, 0], rows[root[own], 0]


def agreeing(code: Column, width: int, bits: list[int]) -> list[Column]:
    """Masked codes, one for each two of the blocks of this width that start at the given bits."""
    block = (1 << width) - 1
    masks = [(block << a) | (block << b) for a, b in combinations(bits, 2)]
    return [code.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in masks]


def bucket_links(buckets: DataFrame, keys: list[str], values: list[str], distance: int, sketch_distance: int = 0) -> DataFrame:
    """Links (a, b) inside buckets: the rows of equal keys meet in one task and are searched together (see linked)."""

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of = [], None  # of the bucket that the last batch ended in
        none = np.zeros(0, "<i8")

        def close() -> tuple[np.ndarray, np.ndarray]:
            return linked(np.concatenate(held), distance, sketch_distance) if sum(map(len, held)) > 1 else (none, none)

        for batch in batches:
            if not len(batch):
                continue
            key, value = batch[keys].to_numpy(dtype="<i8"), batch[values].to_numpy(dtype="<i8")
            changed = np.concatenate(([of is None or (key[0] != of).any()], (key[1:] != key[:-1]).any(axis=1)))
            out, of = [], key[-1]
            for i, part in enumerate(np.split(value, np.flatnonzero(changed))):
                if i:  # the part before the first change goes on with what is held
                    out.append(close())
                    held.clear()
                held.append(part)
            yield pd.DataFrame({"a": np.concatenate([none, *[x for x, _ in out]]), "b": np.concatenate([none, *[y for _, y in out]])})
        a, b = close()
        yield pd.DataFrame({"a": a, "b": b})

    dealt = buckets.select(*keys, *values).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(searched, "a long, b long")


def links_within(codes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect whatever codes (fp, distinct) at two or fewer bits connect."""
    if not 0 <= distance <= 2:
        raise ValueError("two of four blocks agree only up to a distance of 2")
    wide = [F.struct(F.lit(t).alias("t"), k.alias("key")) for t, k in enumerate(agreeing(F.col("fp"), 16, [0, 16, 32, 48]))]
    first = stage(codes.select("fp", F.explode(F.array(*wide)).alias("b")).select("b.t", "b.key", "fp", F.col("fp").alias("code")), "buckets")
    counted = stage(first.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    small = first.join(counted.where(F.col("n") <= bucket).select("t", "key"), ["t", "key"], "left_semi")
    links = bucket_links(small, ["t", "key"], ["code", "fp"], distance)
    if counted.where(F.col("n") > bucket).isEmpty():
        return links
    large = first.join(counted.where(F.col("n") > bucket).select("t", "key"), ["t", "key"], "left_semi")
    fine = F.lit(None)
    for t, kept in enumerate(combinations([0, 16, 32, 48], 2)):
        bits = [s + half for s in (0, 16, 32, 48) if s not in kept for half in (0, 8)]
        own = [F.struct(F.lit(u).alias("u"), k.alias("fine")) for u, k in enumerate(agreeing(F.col("fp"), 8, bits))]
        fine = F.when(F.col("t") == t, F.array(*own)).otherwise(fine)
    again = large.select("t", "key", "fp", "code", F.explode(fine).alias("f")).select("t", "key", "f.u", "f.fine", "fp", "code")
    return links.union(bucket_links(again, ["t", "key", "u", "fine"], ["code", "fp"], distance))


def classes(docs: DataFrame, width: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text)."""
    made = stage(fingerprints(docs, width), "fingerprints")
    return with_components(made, links_within(stage(made.select("fp").distinct(), "codes"), distance))


def with_components(made: DataFrame, links: DataFrame) -> DataFrame:
    """made (doc_id, fp) with component_id, the smallest doc_id among the rows whose fp links lead to."""
    roots = components(links).select(F.col("node").alias("fp"), "root")
    codes = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = codes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(ids, "root").select("fp", "component_id"), "components")
    # No build side with a proven bound: a sorted join, whose large partitions Spark splits.
    return made.join(named.hint("merge"), "fp")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    found = classes(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


NEAR_WORDS = 5
#: Near copies share this much of their distinct shingles, as a fraction (intersection over union).
NEAR, OF = 4, 5
#: Candidates share one of SKETCH keys, each of the least shingles under KEY_MINIMA hash functions: a pair
#: at a similarity of 0.8 shares none with a chance of (1 - 0.8^4)^20 = 0.00003, whatever the edit.
SKETCH, KEY_MINIMA = 20, 4
#: Pairs of a small bucket are all verified one by one; larger buckets are cut into chunks.
SMALL, CHUNK = 16, 2048
#: Shingles that are hashed by all functions at a time.
BLOCK = 8192
#: Texts of an Arrow batch that become Python strings, and rows that go back to Spark, at a time.
PART = 64
#: Codes whose texts are found by a broadcast; more of them by a bit map and a shuffle.
BROADCAST_ROWS = 400_000


def shingle_set(text: str, width: int = NEAR_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; none without words."""
    words = words_of(text)
    return np.unique(shingle_hashes(words, width)) if words else np.zeros(0, "<u8")


def minima_keys(grams: np.ndarray, family: np.ndarray) -> list[int]:
    """SKETCH keys of a set of shingle hashes, as signed numbers; BLOCK of them at a time, however long the text."""
    import xxhash

    least = np.full(SKETCH * KEY_MINIMA, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(grams), BLOCK):
        mixed = grams[None, at : at + BLOCK] ^ family[0][:, None]
        mixed *= family[1][:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    least = least.reshape(SKETCH, KEY_MINIMA)
    return np.array([xxhash.xxh64_intdigest(k.tobytes(), i) for i, k in enumerate(least)], dtype="<u8").view("<i8").tolist()


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most PART at a time, so that a worker holds no batch twice, as Arrow and as Python strings or arrays."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def sketches(docs: DataFrame, width: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, text_id, fp, n, print, s0, s1, ...) for each row of docs (doc_id, text): a hash of its set of shingles, their number, its fingerprint, and the set's keys."""
    columns = ["fp", "n", "print", *[f"s{i}" for i in range(SKETCH)]]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        family = np.random.default_rng(SEED).integers(0, 2**64, (2, SKETCH * KEY_MINIMA), dtype=np.uint64)
        family[1] |= np.uint64(1)
        for part in parts(batches):
            rows = np.zeros((part.num_rows, len(columns)), dtype="<i8")
            for i, text in enumerate(part.column("text").to_pylist()):
                words = words_of(text)
                hashes = shingle_hashes(words, width) if words else np.zeros(0, "<u8")
                grams = np.unique(hashes)
                own = xxhash.xxh64_intdigest(grams.tobytes(), SEED)
                rows[i, :2] = own - (own >> 63 << 64), len(grams)
                if words:
                    rows[i, 2], rows[i, 3:] = majority(hashes), minima_keys(grams, family)
            found = [pa.array(c) for c in np.ascontiguousarray(rows.T)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_id"), *found], names=["doc_id", "text_id", *columns])

    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    return read.mapInArrow(made, "doc_id long, text_id long, " + ", ".join(f"{c} long" for c in columns))


def print_pairs(codes: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m) of codes (code, n, print, ...), distinct, by their fingerprints: links at two or fewer bits from the Gray-order index
    in the buckets of agreeing blocks, between the least codes of two fingerprints; and each code with the least one of its own."""
    own = codes.where("n > 0").select("print", "code", "n")
    least = stage(own.groupBy("print").agg(F.min(F.struct("code", "n")).alias("least")), "prints")
    links = stage(links_within(least.select(F.col("print").alias("fp"))), "print-links")
    of_a, of_b = (least.select(F.col("print").alias(c), F.col("least.code").alias(f"code_{c}"), F.col("least.n").alias(f"n_{c}")) for c in ("a", "b"))
    apart = links.join(of_a.hint("merge"), "a").join(of_b.hint("merge"), "b").select(F.col("code_a").alias("a"), F.col("code_b").alias("b"), F.col("n_a").alias("n"), F.col("n_b").alias("m"))
    equal = own.join(least.hint("merge"), "print").where(F.col("code") != F.col("least.code")).select(F.col("least.code").alias("a"), F.col("code").alias("b"), F.col("least.n").alias("n"), F.col("n").alias("m"))
    return apart.union(equal)


def close_in_size(pairs: DataFrame) -> DataFrame:
    """The distinct (a, b) with a < b of pairs (a, b, n, m) whose numbers of shingles allow the similarity."""
    close = pairs.where(F.least("n", "m") * OF >= F.greatest("n", "m") * NEAR)
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def key_buckets(codes: DataFrame) -> DataFrame:
    """(key, code, n, size, least) for every key that codes (code, n, s0, s1, ...), distinct, share with others; least is the least (code, n) that has it."""
    dealt = codes.where("n > 0").select("code", "n", F.explode(F.array(*[f"s{i}" for i in range(SKETCH)])).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("code", "n")).alias("least")).where("size > 1")
    return stage(dealt.join(stage(sizes, "bucket-sizes").hint("merge"), "key").select("key", "code", "n", "size", "least"), "buckets")


def pairs_of(buckets: DataFrame, small: int) -> DataFrame:
    """Pairs (a, b) of codes to verify: all of a bucket of at most small codes, each with the least one in a larger bucket."""
    few, many = buckets.where(F.col("size") <= small), buckets.where(F.col("size") > small)
    other = few.select("key", F.col("code").alias("b"), F.col("n").alias("m"))
    every = few.withColumnRenamed("code", "a").join(other.hint("merge"), "key").where("a < b").select("a", "b", "n", "m")
    star = many.where(F.col("code") != F.col("least.code")).select(F.col("least.code").alias("a"), F.col("code").alias("b"), F.col("least.n").alias("n"), F.col("n").alias("m"))
    return close_in_size(every.union(star))


def near_links(codes: DataFrame, bucket: int = SMALL) -> DataFrame:
    """Candidate links (a, b) among codes (code, n, s0, s1, ...), distinct, to be verified."""
    return pairs_of(key_buckets(codes), bucket)


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, grams) of batches of (code, text), at most PART rows at a time."""
    for part in parts(batches):
        grams = [shingle_set(t).view("<i8") for t in part.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, grams)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([part.column("code"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))], names=["code", "grams"])


def near_sets(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, grams): the shingle sets of codes (code, doc_id, text_id), distinct, each from the text of its own document, so that a text that
    many documents share meets in no task. Sets are made where the texts are read; only repeated rows, which give a set each, are made one afterwards."""
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"), "text")
    own = stage(codes.select("code", F.col("doc_id").alias("own_doc"), F.col("text_id").alias("own_text")), "own-texts")
    asked = own.count()
    if asked > BROADCAST_ROWS:  # texts that nobody asks for are not sent
        texts = might_be_in(texts, own.withColumnRenamed("own_text", "text_id"), ["text_id"])
    same = texts["doc_id"].eqNullSafe(own["own_doc"]) & (texts["text_id"] == own["own_text"])
    found = texts.join(sized(own, BROADCAST_ROWS), same).select("code", "text")
    with small_batches(docs.sparkSession):
        sets = stage(found.mapInArrow(sets_of, "code long, grams array<long>"), "shingle-sets")
    return sets if sets.count() == asked else stage(sets.groupBy("code").agg(F.first("grams").alias("grams")), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    a, b = sets.select(F.col("code").alias("a"), F.col("grams").alias("x")), sets.select(F.col("code").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    similar = both * (NEAR + OF) >= (F.size("x") + F.size("y")) * NEAR
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(similar).select("a", "b")


def similar_links(code: np.ndarray, root: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links between similar sets, as far as the sets are not connected by their roots; what is outside the largest component is compared with all."""
    _, first, component = np.unique(root, return_index=True, return_inverse=True)
    forest, n = Forest(len(code)), np.array([len(g) for g in grams])
    forest.join(np.arange(len(code)), first[component])
    flat, owner = np.concatenate(grams), np.repeat(np.arange(len(code)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    a, b = [], []
    for q in np.flatnonzero(component != np.bincount(component).argmax()):
        lo, hi = np.searchsorted(flat, grams[q], "left"), np.searchsorted(flat, grams[q], "right")
        many = hi - lo
        held = owner[np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]
        both = np.bincount(held, minlength=len(code))
        near = np.flatnonzero(both * (NEAR + OF) >= (n[q] + n) * NEAR)
        near = near[component[near] != component[q]]
        apart = near[forest.find(near) != forest.find(np.array([q]))]
        for x in apart:
            if forest.find(np.array([x]))[0] != forest.find(np.array([q]))[0]:
                forest.join(np.array([x]), np.array([q]))
                a.append(code[q])
                b.append(code[x])
    return np.array(a, dtype="<i8"), np.array(b, dtype="<i8")


def links_of_large(buckets: DataFrame, sets: DataFrame, links: DataFrame, small: int = SMALL, chunk: int = CHUNK) -> DataFrame | None:
    """The links that the larger buckets hold besides those found: each two chunks of a bucket that links leave in several
    components meet in a task of their own, so memory stays bounded and every pair across components is compared."""
    large = buckets.where(F.col("size") > small)
    if large.isEmpty():
        return None
    roots = components(links).withColumnRenamed("node", "code")
    rooted = stage(large.join(roots, "code", "left").select("key", "code", "size", F.coalesce("root", "code").alias("root")), "rooted")
    ends = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("code"), chunks).cast("int")
    units = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = rooted.join(ends.hint("merge"), "key").withColumn("unit", F.explode(units)).select("key", "unit.i", "unit.j", "code", "root")
    keys = ["key", "i", "j"]
    # units that one component fills have nothing to add, and their sets are not sent
    mixed = dealt.groupBy(*keys).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(*keys)
    open_units = stage(dealt.join(mixed.hint("merge"), keys), "open-units")
    if open_units.isEmpty():
        return None
    rows = open_units.join(sets.hint("merge"), "code").select(*keys, "code", "root", "grams")

    def compared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = similar_links(rows["code"].to_numpy(), rows["root"].to_numpy(), [np.asarray(g, dtype="<i8") for g in rows["grams"]])
        return pd.DataFrame({"a": a, "b": b})

    return rows.groupBy(*keys).applyInPandas(compared, "a long, b long")


def near_components(docs: DataFrame, codes: DataFrame, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """(code, root) of the codes (code, doc_id, text_id, n, print, s0, s1, ...) that are near copies of others: candidates by fingerprints
    and by shared keys, since fingerprints of similar texts often differ at more than two bits; all of them are verified."""
    printed = stage(close_in_size(print_pairs(codes)), "print-pairs")
    buckets = key_buckets(codes)
    met = buckets.select("code").union(printed.select("a")).union(printed.select("b")).distinct()
    involved = codes.select("code", "doc_id", "text_id").join(met.hint("shuffle_hash"), "code", "left_semi")
    sets = near_sets(docs, involved)
    pairs = pairs_of(buckets, small).union(printed).distinct()
    links = stage(verified(pairs, sets), "near-links")
    more = links_of_large(buckets, sets, links, small, chunk)
    return components(links if more is None else links.union(stage(more, "near-links"))).withColumnRenamed("node", "code")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) without near copies: of each group of documents that links of similar
    five-word shingles lead to, the row with the smallest doc_id stays (null ids last, ties by the text's hash).
    Every link is verified by the exact similarity of the two sets of shingles."""
    with small_batches(docs.sparkSession):
        made = stage(sketches(docs).withColumnRenamed("fp", "code"), "sketches")
    roots = near_components(docs, stage(made.dropDuplicates(["code"]), "codes"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    best = made.groupBy("code").agg(F.min(place).alias("best")).join(roots, "code", "left")
    winners = best.groupBy(F.coalesce("root", "code").alias("root")).agg(F.min("best").alias("best"))
    winners = stage(winners.select(F.col("best.doc_id").alias("w_doc"), F.col("best.text_id").alias("w_text")), "winners")
    kept = docs.join(winners.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(winners["w_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == winners["w_text"]), "left_semi")
    repeated = made.groupBy("doc_id", "text_id").count().where("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
