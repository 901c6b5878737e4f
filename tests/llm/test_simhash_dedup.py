import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from splitboard.llm import simhash_dedup as s
from splitboard.llm.components import Forest, components


def plain_fingerprint(text, width):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=2):
    codes = sorted(set(fps))
    up = {c: c for c in codes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    array = np.array(codes, dtype=np.uint64)
    for c in codes:
        for d in array[np.bitwise_count(array ^ np.uint64(c)) <= distance]:
            a, b = find(c), find(int(d))
            up[max(a, b)] = min(a, b)
    return {c: find(c) for c in codes}


def held_against_brute_force(spark, rows, width=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = s.classes(docs, width).collect()
    want = [(i, plain_fingerprint(t, width)) for i, t, _ in rows]
    assert sorted((r.doc_id, r.fp % 2**64) for r in got) == sorted(want)
    roots = plain_components([f for _, f in want])
    least = {}
    for i, f in want:
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert {r.doc_id: r.component_id for r in got} == {i: least[roots[f]] for i, f in want}
    return got


def test_documents(spark, sf_small):
    rows = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = held_against_brute_force(spark, rows)
    assert any(r.doc_id != r.component_id for r in got)


def test_edge_texts(spark):
    texts = ["", None, " \t\n", "one", "ONE", "one two", "É x y", "é x y", "a b c", "a  b\x0bc", "z" * 100_000, "w " * 30_000, "q r s t"]
    held_against_brute_force(spark, [(i, t, None) for i, t in enumerate(texts)])
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "lonely")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in s.classes(nulls).collect()), key=str) == [(3, 3), (None, 3), (None, 3), (None, None)]
    assert s.classes(nulls.limit(0)).count() == 0


def test_large_buckets_are_dealt_again(spark):
    rng = np.random.default_rng(3)
    codes = {0}
    while len(codes) < 900:  # one dense cluster and some far codes
        codes.add(int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))) if len(codes) < 700 else int(rng.integers(0, 2**63)))
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    roots = {r.node: r.root for r in components(s.links_within(df, bucket=20)).collect()}
    want = plain_components(codes)
    groups, got = {}, {}
    for c in codes:
        x = c - 2**64 if c >> 63 else c
        groups.setdefault(want[c], set()).add(c)
        got.setdefault(roots.get(x, x), set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1) | st.integers(0, 300), min_size=1, max_size=200), st.integers(0, 5))
def test_index_finds_all_pairs(codes, distance):
    array = np.array(sorted(codes), dtype="<u8")
    pairs = {(int(a), int(b)) for q, c in s.GrayIndex(array).within(array, distance, block=16) for a, b in zip(q, c, strict=True)}
    far = np.bitwise_count(array[:, None] ^ array[None, :])
    assert pairs == {(int(a), int(b)) for a, b in np.argwhere(far <= distance)}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[100 + i] == 100 for i in range(60))


@pytest.mark.parametrize(("distance", "sketch_distance"), [(2, 0), (2, 120), (4, 126)])
def test_large_buckets_keep_their_components(distance, sketch_distance):
    """Comparing some rows first and searching only for the rest gives the components of all pairs."""
    rng, n = np.random.default_rng(2), 1500
    centres, found = rng.integers(0, 2**63, 5).astype("<u8"), set()
    while len(found) < n:
        code = int(centres[rng.integers(5)])
        for b in rng.choice(64, rng.integers(0, 7)):
            code ^= 1 << int(b)
        found.add(code)
    codes, sketches = np.array(sorted(found), dtype="<u8"), rng.integers(0, 2**63, (n, 4)).astype("<i8")
    want, got = Forest(n), Forest(n)
    for i in range(n):
        near = (np.bitwise_count(codes[i] ^ codes) <= distance) & (np.bitwise_count(sketches[i] ^ sketches).sum(axis=1) <= sketch_distance)
        want.join(np.full(near.sum(), i), np.flatnonzero(near))
    a, b = s.linked(np.column_stack([np.arange(n) * 7, codes.view("<i8"), sketches]), distance, sketch_distance)
    got.join(a // 7, b // 7)
    assert (want.roots() == got.roots()).all()
