import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from splitboard.llm.packing import Packer, encoder, op6_packing, pack


def check_pieces(rows, texts, limit=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
        total += at
    assert padding == 0
    return total


def test_every_id_is_in_one_piece(spark, sf_small):
    rows = op6_packing(spark, sf_small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    check_pieces(rows, texts)


def test_edge_texts(spark):
    texts = {1: None, 2: "", 3: "<|endoftext|> plain <|endoftext|><|endoftext|>x <|endoftext", 4: "word " * 9000, 5: "ß ퟿ 漢字" * 50}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, sequence_id string")
    check_pieces(pack(docs).collect(), texts)
    assert pack(docs.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert sum(r.length for r in pack(null_id).collect()) == 2 * 4


def test_ids_are_those_of_the_json_tokenizer():
    from splitboard.llm.packing import encoder

    tokenizer, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder(None)
    rng = random.Random(2)
    signs = [*"aZ9 '\n\t.,_-é漢\u00a0\u2003\U0001f600\u0301", "  ", "the", "'s", "<|endoftext|>", "<|", "|>", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 30)))
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert encode("<|endoftext|> hi") == [50256, 23105]


def test_loss_from(spark):
    """Null: all tokens bear loss; the limit on loss-bearing tokens binds; every id is placed once."""
    rows = [(i, "word " * n, loss) for i, (n, loss) in enumerate([(5, None), (50, 3), (40, 1000), (3000, 0), (7, -5), (0, None), (3000, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, loss_from long")
    placed = pack(docs, max_tokens=64, max_segments=4, max_loss=20).collect()
    assert sum(r.length for r in placed) == sum(d for d in {r.doc_id: r.doc_tokens for r in placed}.values())
    by_sequence = defaultdict(int)
    froms = {i: min(max(loss or 0, 0), 10**9) for i, _, loss in rows}
    for r in placed:
        by_sequence[r.sequence_id] += max(0, r.start + r.length - max(r.start, froms[r.doc_id]))
    assert max(by_sequence.values()) <= 20


def test_limits_hold_together():
    rng = random.Random(5)
    packer = Packer(64, 5, 20, pool=40)
    pieces = [(i, 0, n := rng.choice([1, 2, 3, 9, 30, 70, 200]), rng.randint(0, n)) for i in range(400)]
    closed = [s for p in pieces for s in packer.add(p)] + list(packer.fill())
    covered = defaultdict(list)
    for placed in closed:
        assert sum(p[2] for p, _ in placed) <= 64 and len(placed) <= 5 and sum(p[3] for p, _ in placed) <= 20
        for (key, start, n, loss), _ in placed:
            covered[key].append((start, n, loss))
    for key, _, n, loss in pieces:
        at = 0
        for start, m, _ in sorted(covered[key]):
            assert start == at
            at += m
        assert at == n and sum(x[2] for x in covered[key]) == loss


def test_very_long_white_space_has_the_ids_of_tokenizers():
    plain, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder(None)
    for text in (" " * 1_000_000 + "x", "\n" * 2_000_000 + "x", "a" + " \n\t" * 500_000, " " * 1_500_000):
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids
