"""Embedding near-dedup: a navigable small-world graph per shard, every shard queried.

1. Equal vectors are one class (grouped by their normalised components, partial aggregate first), so exact copies of
   one vector are one row however many there are.
2. Classes are dealt evenly to shards by hash, never by label. A shard has at most about SHARD_ROWS
   classes; each shard's hierarchical graph is built in one task and written as one row to the shared folder.
3. Every block of classes is sent to every shard. All searches of a batch go through the graph in step: greedy
   through the upper layers, then a beam on the lowest.
4. Again and again an audit compares drawn searches of a task with the whole shard, until it has seen AUDIT_PAIRS true
   near pairs; while their recall is below RECALL the task's beams widen, up to WIDEST, which is audited too.
   Where WIDEST fails, or AUDIT_MOST searches show too few pairs, the whole shard answers the task's searches; so it does for
   batches while an audit is still short of pairs. A search whose beam is full of links has more of them than
   the beam can tell: it is answered by the whole shard, so no group of near copies is cut short.
5. Candidates are verified by their cosine in double precision. A task returns for each search how many
   vectors it found, and a link to each of the shard's own components that it touches, never all pairs.
6. The components of these links follow by contraction, and the counts of the shards are added up.

Querying every shard costs (classes x shards) searches; the number of shards is constant until shards are full
and grows with the input from there. That is the named method's price. A shard travels once with each block of BLOCK_ROWS
searches, which adds SHARD_ROWS / BLOCK_ROWS to what the searches send anyway; tasks read no file, since on a cluster only
Spark's readers reach the shared folder. The units of a shard and a block grow with the square of the classes; beyond MOST_TASKS
a task works through several of them, one shard in memory at a time, so the driver's work stays bounded.

Defined cases: null and zero vectors and vectors with null or non-finite components link with nothing and are
their own component; vectors of different lengths never link; rows without a vec_id count as links of others and take part in
components, but give them no number; repeated rows link with each other; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.llm.components import Forest, components
from splitboard.sources import load, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COSINE = 0.9
SHARDS = 6  # at least
SHARD_ROWS = 20_000
BLOCK_ROWS = 50_000
MOST_TASKS = 20_000
NEIGHBOURS = 12  # links of a node on upper layers; twice as many on the lowest
TOP = 256  # rows of the uppermost layer
ENTRIES = 8
BUILD_BEAM = 48
BEAM = 48
WIDEST = 256
AUDIT = 32
AUDIT_PAIRS = 64  # pairs an audit must see before it tells anything
AUDIT_MOST = 4096  # searches of one audit; with fewer pairs than that in them, the whole shard answers
AUDIT_MARGIN = 0.1  # pairs that are a little less alike count too, so that an audit has some to look for
RECALL = 0.97
EXPAND = 4  # nodes of a beam opened in one step
BATCH = 256


class Graph:
    """Hierarchical navigable small-world graph over unit vectors, built and searched in batches.

    The rows stand in a drawn order; a layer holds the first of them, each layer NEIGHBOURS times the one above.
    The uppermost has at most TOP rows and is compared whole, so a search starts near every group that is drawn to it.
    """

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers  # links of the lowest layer first, -1 for none

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        sizes = [len(x)]
        while sizes[-1] > TOP:
            sizes.append(-(-sizes[-1] // NEIGHBOURS))
        made = cls(x, [])
        for depth in range(len(sizes) - 1, -1, -1):
            links = np.full((sizes[depth], 2 * NEIGHBOURS if depth == 0 else NEIGHBOURS), -1, dtype=np.int32)
            done = 0
            if made.layers:
                above = made.layers[0]
                links[: len(above), : above.shape[1]] = above
                done = len(above)
            while done < len(links):
                new = np.arange(done, min(len(links), max(2 * done, TOP), done + 1024))
                within = x[new] @ x[new].T
                np.fill_diagonal(within, -2)
                near = min(links.shape[1], len(new) - 1)
                ids = new[np.argpartition(-within, near - 1, axis=1)[:, :near]] if near > 0 else np.zeros((len(new), 0), dtype=int)
                if done:
                    found, _ = beam(x, links, x[new], made.enter(x[new]), BUILD_BEAM)
                    ids = np.concatenate([ids, found], axis=1)
                cls.connect(x, links, new, ids)
                done = new[-1] + 1
            made.layers.insert(0, links)
        return made

    @staticmethod
    def spread(x: np.ndarray, node: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
        """Up to width of the candidates per node: the near ones that are nearer to it than to those chosen before, then the nearest others."""
        sims = np.where(ids >= 0, np.einsum("nkd,nd->nk", x[ids], x[node]), -2)
        order = np.argsort(-sims, axis=1)[:, : 3 * width]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        between = np.matmul(x[ids], x[ids].transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, dtype=bool)
        for k in range(ids.shape[1]):
            repeat = (ids[:, :k] == ids[:, k : k + 1]).any(axis=1)
            covered = (chosen[:, :k] & (between[:, k, :k] > sims[:, k : k + 1])).any(axis=1)
            chosen[:, k] = (ids[:, k] >= 0) & ~covered & ~repeat & (chosen[:, :k].sum(axis=1) < width)
            ids[repeat, k] = -1
        rank = np.where(ids < 0, 3, np.where(chosen, 0, 1))
        keep = np.argsort(rank, axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(ids, keep, axis=1)
        return np.pad(out, ((0, 0), (0, max(0, width - out.shape[1]))), constant_values=-1).astype(np.int32)

    @classmethod
    def connect(cls, x: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray) -> None:
        """Links from the new nodes to the best candidates, and back."""
        width = links.shape[1]
        if not ids.shape[1]:
            return
        half = width // 2
        links[new, :half] = cls.spread(x, new, ids, half)
        source, target = np.repeat(new, half), links[new, :half].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, firsts, counts = np.unique(target, return_index=True, return_counts=True)
        most = min(int(counts.max(initial=0)), 4 * width)
        for at in range(0, len(nodes), 512):
            some = nodes[at : at + 512]
            more = np.full((len(some), most), -1, dtype=np.int64)
            for i, (f, c) in enumerate(zip(firsts[at : at + 512], counts[at : at + 512], strict=True)):
                more[i, : min(c, most)] = source[f : f + min(c, most)]
            links[some] = cls.spread(x, some, np.concatenate([links[some], more], axis=1), width)

    def enter(self, q: np.ndarray) -> np.ndarray:
        """Where searches enter the layer below those there are: up to ENTRIES near rows each."""
        top = self.layers[-1]
        near = min(ENTRIES, len(top))
        at = np.argpartition(-(q @ self.x[: len(top)].T), near - 1, axis=1)[:, :near]
        for links in self.layers[-2::-1]:
            at = beam(self.x, links, q, at, 2 * ENTRIES)[0][:, :ENTRIES]
        return at

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef rows nearest to each of q, as far as a beam of that width finds them (-1: none), and their cosines."""
        upper = Graph(self.x, self.layers[1:])
        at = upper.enter(q) if upper.layers else np.zeros((len(q), 1), dtype=np.int64)
        return beam(self.x, self.layers[0], q, at, min(max(ef, ENTRIES), len(self.x)))


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """All searches in step: each opens the EXPAND best nodes of its beam that are not open until none is left."""
    ids = np.full((len(q), ef), -1, dtype=np.int64)
    sims = np.full((len(q), ef), -2, dtype=x.dtype)
    opened = np.ones((len(q), ef), dtype=bool)
    seen = np.zeros((len(q), len(x)), dtype=bool)
    near = entry.shape[1]
    real = entry >= 0
    ids[:, :near], opened[:, :near] = entry, ~real
    sims[:, :near] = np.where(real, np.einsum("ned,nd->ne", x[entry], q), -2)
    rows, columns = np.nonzero(real)
    seen[rows, entry[rows, columns]] = True
    active = np.arange(len(q))
    while len(active):
        open_now = np.argsort(np.where(opened[active], 3.0, -sims[active]), axis=1)[:, :EXPAND]
        fresh = ~np.take_along_axis(opened[active], open_now, axis=1)
        node = np.where(fresh, np.take_along_axis(ids[active], open_now, axis=1), -1)
        opened[active[:, None], open_now] = True
        next_ids = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(active), -1)
        next_ids = np.sort(next_ids, axis=1)
        next_ids[:, 1:][next_ids[:, 1:] == next_ids[:, :-1]] = -1
        known = (next_ids < 0) | seen[active[:, None], next_ids]
        next_ids[known] = -1
        rows, columns = np.nonzero(next_ids >= 0)
        seen[active[rows], next_ids[rows, columns]] = True
        next_sims = np.full(next_ids.shape, -2, dtype=x.dtype)
        next_sims[rows, columns] = np.einsum("nd,nd->n", x[next_ids[rows, columns]], q[active[rows]])
        all_sims = np.concatenate([sims[active], next_sims], axis=1)
        best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[active] = np.take_along_axis(np.concatenate([ids[active], next_ids], axis=1), best, axis=1)
        sims[active] = np.take_along_axis(all_sims, best, axis=1)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], next_ids < 0], axis=1), best, axis=1)
        active = active[(~opened[active]).any(axis=1)]
    order = np.argsort(-sims, axis=1)
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square over- or underflows."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Shard:
    """One shard's vectors and graph, as written by build_shard."""

    def __init__(self, payload: bytes, cosine: float):
        with np.load(io.BytesIO(payload)) as held:
            self.cls, self.n, self.x = held["cls"], held["n"], held["x"]
            self.graph = Graph(self.x.astype(np.float32), [held[f"links{i}"] for i in range(int(held["layers"]))])
        self.small = self.graph.x
        self.cosine, self.ef, self.batches = cosine, BEAM, 0
        self.audited, self.truth, self.seen, self.due = self.small[:0], np.zeros(0, dtype=np.int64), 0, False
        self.forest = Forest(len(self.cls))

    def whole(self, q: np.ndarray) -> np.ndarray:
        """Cosines with the whole shard."""
        return q @ self.small.T

    def audit(self, q: np.ndarray) -> None:
        """Widen the beams until searches drawn from q find enough of what the whole shard holds near the threshold.

        Searches are drawn, AUDIT at a time, until AUDIT_PAIRS such pairs are seen or q is at its end; with fewer
        pairs the batches after it are audited too. If the widest beam fails, the whole shard answers.
        """
        least, drawn, truth = self.cosine - AUDIT_MARGIN, np.random.default_rng(self.batches).permutation(len(q)), np.zeros(0, dtype=np.int64)
        while len(truth) < len(q) and self.seen + truth.sum() < AUDIT_PAIRS:
            truth = np.append(truth, (self.whole(q[drawn[len(truth) : len(truth) + AUDIT]]) >= least).sum(axis=1))
        self.audited, some = np.concatenate([self.audited, q[drawn[: len(truth)]]]), truth.sum()
        self.truth, self.seen = np.append(self.truth, truth), self.seen + some
        while self.seen and self.ef < len(self.small):
            found, want = 0, 0
            for at in range(0, len(self.audited), BATCH):
                _, sims = self.graph.search(self.audited[at : at + BATCH], self.ef)
                room = sims[:, -1] < least  # other beams are full; their searches go to the whole shard
                found, want = found + (sims[room] >= least).sum(), want + self.truth[at : at + BATCH][room].sum()
            if found >= RECALL * want:
                break
            self.ef = min(2 * self.ef, WIDEST) if self.ef < WIDEST else len(self.small)
        self.due = self.seen < AUDIT_PAIRS
        if not self.due or len(self.audited) >= AUDIT_MOST:
            if self.due:  # so few pairs tell nothing of the graph
                self.ef = len(self.small)
            self.due = False
            self.audited, self.truth, self.seen = self.audited[:0], self.truth[:0], 0

    def candidates(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the search, row) wherever the cosine may reach the threshold."""
        least = self.cosine - 1e-4
        unaudited = False
        if (self.due or self.batches % 64 == 0) and self.ef < len(self.small) and len(self.small) > TOP:
            self.audit(q)
            unaudited = self.due
        self.batches += 1
        todo, found = np.arange(len(q)), []
        if self.ef < len(self.small) and TOP < len(self.small) and not unaudited:  # a batch before the first verdict goes to the whole shard
            ids, sims = self.graph.search(q, self.ef)
            full = sims[:, -1] >= least
            at, column = np.nonzero((sims >= least) & ~full[:, None])
            found.append((at, ids[at, column]))
            todo = todo[full]
        for part in np.array_split(todo, max(1, len(todo) // 64)):
            at, row = np.nonzero(self.whole(q[part]) >= least)
            found.append((part[at], row))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def search(self, cls: np.ndarray, q: np.ndarray) -> pd.DataFrame:
        """Per search how many vectors it links with, and a link to one of them; all of them are joined in the forest."""
        at, row = self.candidates(q.astype(np.float32))
        good = (np.einsum("nd,nd->n", q[at], self.x[row]) >= self.cosine) & (cls[at] != self.cls[row])
        at, row = at[good], row[good]
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        n = np.bincount(at, weights=self.n[row], minlength=len(cls)).astype(np.int64)
        own, firsts = np.unique(at, return_index=True)
        self.forest.join(row, np.repeat(row[firsts], np.diff(np.append(firsts, len(row)))))
        out = pd.DataFrame({"a": cls[own], "b": self.cls[row[firsts]], "n": n[own]})
        return out.astype("Int64")

    def links(self) -> pd.DataFrame:
        root = self.forest.roots()
        own = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": self.cls[own], "b": self.cls[root[own]], "n": np.zeros(len(own), dtype=np.int64)}).astype("Int64")


def build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cls").sample(frac=1, random_state=5)  # the order that Graph asks for
    x = unit(rows["embedding"])
    layers = Graph.build(x.astype(np.float32)).layers
    parts = {"cls": rows["cls"].to_numpy(), "n": rows["n"].to_numpy(), "x": x, "layers": len(layers)}
    np.savez(out := io.BytesIO(), **parts, **{f"links{i}": links for i, links in enumerate(layers)})
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "payload": [out.getvalue()]})


def find_links(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n) of classes (cls, dim, n, embedding): a links with b; n of a's links with other classes' vectors are counted in this row."""
    total = classes.count()
    n_shards, n_blocks = max(SHARDS, -(-total // SHARD_ROWS)), max(1, -(-total // BLOCK_ROWS))
    placed = classes.withColumn("shard", F.pmod(F.xxhash64("cls"), F.lit(n_shards)).cast("int"))
    shards = stage(placed.groupBy("dim", "shard").applyInPandas(build_shard, "dim int, shard int, payload binary"), "shards")

    every_block = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    graphs = shards.select("dim", "shard", F.explode(every_block).alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("cls"), F.lit(None).cast("array<double>").alias("embedding"), "payload")
    block = F.pmod(F.xxhash64(F.lit(1), "cls"), F.lit(n_blocks)).cast("int").alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")
    queries = classes.select("dim", every_shard, block, F.lit(1).alias("kind"), "cls", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).cast("binary").alias("payload"))
    unit_key = ["dim", "shard", "block"]
    dealt = graphs.unionByName(queries).repartitionByRange(min(n_shards * n_blocks, MOST_TASKS), *unit_key).sortWithinPartitions(*unit_key, "kind", "cls")

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, key = None, None
        for batch in batches:
            changed = (batch[unit_key] != batch[unit_key].shift()).any(axis=1) | (batch["kind"] == 0)
            for _, part in batch.groupby(changed.cumsum(), sort=False):
                if part["kind"].iloc[0] == 0:
                    if shard is not None:
                        yield shard.links()
                    shard, key = Shard(part["payload"].iloc[0], cosine), tuple(part[unit_key].iloc[0])
                    part = part.iloc[1:]
                if not len(part) or tuple(part[unit_key].iloc[0]) != key:
                    continue  # no class of this length is in the shard
                for at in range(0, len(part), BATCH):
                    some = part.iloc[at : at + BATCH]
                    yield shard.search(some["cls"].to_numpy().astype(np.int64), unit(some["embedding"]))
        if shard is not None:
            yield shard.links()

    return dealt.mapInPandas(searched, "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings (vec_id, embedding)."""
    rows = embeddings.select("vec_id", "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    valid = rows.where(F.col("embedding").isNotNull()).where(~bad & some)
    grouped = valid.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = stage(grouped.select(F.monotonically_increasing_id().alias("cls"), F.size("embedding").alias("dim"), "*"), "classes")
    found = stage(find_links(classes.select("cls", "dim", "n", "embedding"), cosine), "embedding-links")
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "cls")
    rooted = classes.drop("embedding").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = classes.select("cls", "embedding", "n").join(rooted.select("cls", "root"), "cls").join(ids, "root").join(counts, "cls", "left")
    told = stage(told.select("embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "embedding-components")
    # No build side with a proven bound: a sorted join, whose large partitions Spark splits.
    # A hash goes first, so that sorting seldom compares whole vectors.
    own = F.xxhash64("embedding").alias("own_hash")
    back = rows.select("*", own).join(told.select("*", own).hint("merge"), ["own_hash", "embedding"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return back.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links and component."""
    return near_duplicates(load(spark, sf_dir, "embeddings"))
