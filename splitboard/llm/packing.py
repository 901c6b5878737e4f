"""Packing: token sequences filled under several limits at once.

Documents are tokenized and packed inside the task that reads them; nothing is
shuffled. A full sequence is cut from a long document at once. The rests go to a
bounded pool, and bins are filled from it by vector bin packing: each example is a
vector (tokens, segments, loss-bearing tokens), and the next one is that with the
largest dot product of its vector and the bin's remaining capacity among those
that fit. When none fits, the example with the largest product is cut to fill the bin.
A bin that ends short of the full length is cut back to a power of two and its tail
goes back to the pool, so sequences need no padding at either kind of length.

Defined cases: null text is empty and gives the closing id alone; a null loss_from is 0, one beyond the
text leaves no token with loss; ties of the product go to the piece that waits longest; repeated rows are packed each for itself; an empty table gives an empty result; further columns of
the input are not read.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.sources import load

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package installed

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
END_ID = 1
#: Pieces that wait for a place in one task; the bins are filled down to half of it whenever it is full.
POOL = 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class Packer:
    """Bins under limits on tokens, segments and loss-bearing tokens, for the pieces of one task.

    A piece is (key, start, length, loss): loss of its tokens, the last ones, bear loss.
    take() gives lists of (piece, offset) for every sequence that is closed.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int = POOL):
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=np.int64)
        self.pool: list[tuple] = []
        self.size = pool

    def add(self, piece: tuple) -> Iterator[list[tuple]]:
        key, start, length, loss = piece
        whole = int(self.limits[0])
        while length > whole:  # the loss tokens are the last ones of a piece
            rest = length - whole
            head_loss = max(0, loss - rest)
            if head_loss > self.limits[2]:
                break
            yield [((key, start, whole, head_loss), 0)]
            start, length, loss = start + whole, rest, min(loss, rest)
        self.pool.append((key, start, length, loss))
        if len(self.pool) >= self.size:
            yield from self.fill(self.size // 2)

    def fill(self, keep: int = 0) -> Iterator[list[tuple]]:
        """Close sequences until at most keep pieces wait."""
        while len(self.pool) > keep:
            yield self.one()

    @staticmethod
    def cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
        key, start, length, loss = piece
        rest = length - at
        return (key, start, at, max(0, loss - rest)), (key, start + at, rest, min(loss, rest))

    def one(self) -> list[tuple]:
        """Fill one sequence from the pool."""
        need = np.array([(p[2], 1, p[3]) for p in self.pool], dtype=np.int64)
        scaled = need / self.limits
        left, free, chosen = self.limits.copy(), np.ones(len(need), dtype=bool), []
        rest = None
        while left[0] > 0 and left[1] > 0 and free.any():
            score = np.where(free, scaled @ (left / self.limits), -1.0)
            fits = free & (need <= left).all(axis=1)
            if fits.any():
                i = int(np.where(fits, score, -1.0).argmax())
                chosen.append(self.pool[i])
                left -= need[i]
                free[i] = False
                continue
            i = int(score.argmax())  # none fits whole: cut the best one
            piece = self.pool[i]
            outside = piece[2] - piece[3]
            at = int(min(left[0], piece[2], outside + left[2]))
            if at <= 0:
                rest_free = free & (need[:, 0] > need[:, 2])
                if not rest_free.any():
                    break
                i = int(np.where(rest_free, score, -1.0).argmax())
                piece = self.pool[i]
                at = int(min(left[0], piece[2] - piece[3]))
            free[i] = False
            head, rest = self.cut(piece, at)
            chosen.append(head)
            break
        total = sum(p[2] for p in chosen)
        back = [] if rest is None else [rest]
        if total < self.limits[0]:
            surplus = total - (1 << (total.bit_length() - 1))
            while surplus:
                piece = chosen.pop()
                if piece[2] > surplus:
                    piece, tail = self.cut(piece, piece[2] - surplus)
                    chosen.append(piece)
                    back.append(tail)
                    surplus = 0
                else:
                    back.append(piece)
                    surplus -= piece[2]
        self.pool = [p for p, f in zip(self.pool, free, strict=True) if f] + back
        placed, at = [], 0
        for piece in chosen:
            placed.append((piece, at))
            at += piece[2]
        return placed


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others, in order, for 256 and on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(tokenizer: str | None) -> Callable[[str], list[int]]:
    """Texts to the ids of a byte-level BPE of the library tokenizers, given its JSON file (add_special_tokens=False).

    The strings of added tokens in a text get these tokens' ids, as that library gives them. Its ids grow with the rank of
    their merges, so the same vocabulary drives tiktoken, which is four times as fast (tests compare both). A text that its
    pattern can't take apart, such as one with a million blanks in a row, goes to tokenizers itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    added = {t["content"]: t["id"] for t in held["added_tokens"]}
    to_byte = byte_of()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    plain: list[Tokenizer] = []  # read for the first such text

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:
            if not plain:
                plain.append(Tokenizer.from_file(path))
            return plain[0].encode(text, add_special_tokens=False).ids

    return encode


def pack(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """Pack the texts of docs (doc_id, text, and loss_from if only the tokens from there on bear loss; null: all).

    One row per piece. sequence_id is the task's number and the sequence's number
    in it: a task that is run again gives the same rows.
    """
    loss_limit = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, loss_limit) < 1:
        raise ValueError("limits must be positive")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        packer = Packer(max_tokens, max_segments, loss_limit)
        base = TaskContext.get().partitionId() << 40
        ids: dict[int, list] = {}  # of documents with a piece in the pool: ids not placed yet, doc_id, all tokens, the first one held
        left: dict[int, int] = {}  # tokens not placed yet
        made, n_docs, rows = 0, 0, []

        def close(sequences: Iterator[list[tuple]]) -> None:
            nonlocal made
            for placed in sequences:
                length = sum(p[2] for p, _ in placed)
                for (key, start, n, _), offset in placed:
                    held, doc_id, total, first = ids[key]
                    crc = zlib.crc32(held[start - first : start - first + n].tobytes())
                    rows.append((doc_id, start, n, crc, total, base + made, offset, length))
                    left[key] -= n
                    if not left[key]:
                        del ids[key], left[key]
                made += 1

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
            rows.clear()
            return out

        for batch in batches:
            froms = batch["loss_from"] if "loss_from" in batch else [0] * len(batch)
            for doc_id, text, loss_from in zip(batch["doc_id"], batch["text"], froms, strict=True):
                found = np.array([*encode(text or ""), END_ID], dtype="<u4")
                total, free = len(found), 0 if pd.isna(loss_from) else min(max(int(loss_from), 0), len(found))
                ids[n_docs], left[n_docs] = [found, None if pd.isna(doc_id) else int(doc_id), total, 0], total
                close(packer.add((n_docs, 0, total, total - free)))
                if 0 < left.get(n_docs, 0) < total:  # a tail that waits holds its own ids, not the document's
                    first = min(p[1] for p in packer.pool if p[0] == n_docs)
                    ids[n_docs][0], ids[n_docs][3] = found[first:].copy(), first
                n_docs += 1
                if len(rows) >= 10_000:
                    yield flush()
        close(packer.fill())
        yield flush()

    wanted = ["doc_id", "text", *(["loss_from"] if "loss_from" in docs.columns else [])]
    return docs.select(*wanted).mapInPandas(packed, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
