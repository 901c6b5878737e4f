"""Language ID: a byte convolutional network, trained here, over every window of a text.

A text's UTF-8 bytes, A-Z lower-cased, are cut into windows of WINDOW bytes that overlap by the
largest filter less one, so each place of each filter lies in exactly one window and the whole text
is read. Filters of 2, 3 and 4 bytes, max pooling over a window, ReLU and softmax give a window's
probabilities; a text's are their mean, weighted by the windows' bytes.

The languages are all those that labelled rows have. Training uses a bounded sample: of each language the labelled documents
with the smallest hash of their id, an equal share of SAMPLE_DOCS but LEAST_PER_LANG at least and MOST_PER_LANG at
most, so rare languages are learned and a hot source is no more than its share; SAMPLE_WINDOWS windows of each. Rows that share a
doc_id count as one document there. More than MAX_LANGS languages are an error. Training runs in numpy on the driver; the sample and the
model (some ten thousand numbers) are the only things there. Prediction is one pass over the table, without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0; so is every text if no
row is labelled; rows without a doc_id do not train and are not held out; repeated rows each get a row; an
empty table gives an empty result; further columns stay, but those named lang_pred and score are replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splitboard.llm.text import fresh
from splitboard.sources import load

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
PLACES = WINDOW - max(WIDTHS) + 1
SAMPLE_DOCS, LEAST_PER_LANG, MOST_PER_LANG = 2000, 50, 1000
MAX_LANGS = 1000
SAMPLE_WINDOWS = 4
EPOCHS = 8
UNKNOWN = "und"


def windows_of(text: str) -> np.ndarray:
    """The windows of one text, one per row, the last filled with zero bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    n = max(1, -(-(len(raw) - WINDOW) // PLACES) + 1)
    padded = np.zeros((n - 1) * PLACES + WINDOW, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW), (PLACES, 1))


def train(windows: np.ndarray, labels: np.ndarray, n_classes: int, seed: int = 11) -> dict[str, np.ndarray]:
    """Filters (per width: place, byte, filter), their offsets, and the last layer, by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    model = {f"w{w}": rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS}
    model |= {"offset": np.zeros(FILTERS * len(WIDTHS)), "out": rng.normal(0, 0.3, (FILTERS * len(WIDTHS), n_classes)), "bias": np.zeros(n_classes)}
    model = {k: v.astype(np.float32) for k, v in model.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // 64)):
            x, y = windows[at], labels[at]
            pooled, where = [], []
            for w in WIDTHS:
                out = sum(model[f"w{w}"][j][x[:, j : j + PLACES]] for j in range(w))
                where.append(out.argmax(axis=1))
                pooled.append(np.take_along_axis(out, where[-1][:, None, :], axis=1)[:, 0])
            hidden = np.maximum(np.concatenate(pooled, axis=1) + model["offset"], 0)
            p = softmax(hidden @ model["out"] + model["bias"])
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ model["out"].T) * (hidden > 0)
            slope = {"out": hidden.T @ p, "bias": p.sum(axis=0), "offset": back.sum(axis=0)}
            for k, w in enumerate(WIDTHS):
                slope[f"w{w}"] = np.zeros_like(model[f"w{w}"])
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    seen = np.take_along_axis(x, where[k] + j, axis=1)
                    np.add.at(slope[f"w{w}"][j], (seen, np.arange(FILTERS)), own)
            step += 1
            for name, g in slope.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model[name] -= 0.01 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def tables(model: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What two neighbouring bytes add to all filters: as the first two bytes of a place, and as its third and fourth."""
    w2, w3, w4 = (model[f"w{w}"] for w in WIDTHS)
    ahead = np.concatenate([w[0][:, None, :] + w[1][None, :, :] for w in (w2, w3, w4)], axis=2).reshape(65536, -1)
    third = np.broadcast_to(w3[2][:, None, :], (256, 256, FILTERS))
    behind = np.concatenate([third, w4[2][:, None, :] + w4[3][None, :, :]], axis=2).reshape(65536, -1)
    return np.ascontiguousarray(ahead, dtype=np.float32), np.ascontiguousarray(behind, dtype=np.float32)


def probabilities(windows: np.ndarray, model: dict[str, np.ndarray], ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Per window the classes' probabilities; 32 windows at a time, so that the sums stay in the cache."""
    out = []
    for at in range(0, len(windows), 32):
        part = windows[at : at + 32].astype(np.int32)
        pairs = part[:, :-1] * 256 + part[:, 1:]
        sums = ahead.take(pairs[:, :PLACES], axis=0)
        sums[:, :, FILTERS:] += behind.take(pairs[:, 2:], axis=0)
        out.append(sums.max(axis=1))
    hidden = np.maximum(np.concatenate(out) + model["offset"], 0)
    return softmax(hidden @ model["out"] + model["bias"])


def id_remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def learn(docs: DataFrame, trains: Column) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """The languages and the model, from the labelled rows of docs (doc_id, text, lang) that train."""
    key = F.xxhash64("doc_id")
    labelled = docs.where(trains & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    step = F.length("text") / SAMPLE_WINDOWS
    cuts = F.array(*[F.substring("text", (F.lit(1) + F.floor(step * k)).cast("int"), F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)])
    # Different ids, since rows that share one are one place in the order of hashes; an estimate does, it only bounds what is ranked.
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct(key, 0.05).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return [], None
    counted = {r.lang: max(1, r.n) for r in sizes}
    langs = sorted(counted)
    most = min(MOST_PER_LANG, max(LEAST_PER_LANG, SAMPLE_DOCS // len(langs)))
    # Hashes are even, so the part of their range that four times as many fall into holds the smallest ones of a language; only those are ranked.
    bounds = [(lang, min(2**63 - 1, int(-(2**63) + 2**64 * min(1, 4 * most / n)))) for lang, n in counted.items()]
    bounded = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    drawn = labelled.select("lang", key.alias("key"), cuts.alias("cuts")).join(bounded, "lang").where("key <= bound").groupBy("lang", "key").agg(F.min("cuts").alias("cuts"))
    ranked = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("nth") <= most)
    rows = sorted(ranked.select("lang", "key", "cuts").collect())
    if missing := set(langs) - {r.lang for r in rows}:
        raise ValueError(f"no documents drawn of {sorted(missing)}")
    found = [(windows_of(c)[0], langs.index(r.lang)) for r in rows for c in r.cuts if c]
    return langs, train(np.array([w for w, _ in found]), np.array([y for _, y in found]), len(langs))


def identify(docs: DataFrame, trains: Column | None = None) -> DataFrame:
    """docs with lang_pred and score, in place of columns of these names; trains says which labelled rows the model may learn from, all by default."""
    docs = docs.drop("lang_pred", "score")
    langs, model = learn(docs, F.lit(True) if trains is None else trains)
    lettered = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    if model is None:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ahead, behind = tables(shared.value)

        def of(texts: list[str]) -> np.ndarray:
            cut = [windows_of(t) for t in texts]
            p = probabilities(np.concatenate(cut), shared.value, ahead, behind)
            firsts = np.cumsum([0, *[len(c) for c in cut[:-1]]])
            weight = np.full(len(p), float(WINDOW))
            weight[firsts + np.array([len(c) for c in cut]) - 1] = [max(1, (c[-1] != 0).sum()) for c in cut]
            total = np.add.reduceat(p * weight[:, None], firsts, axis=0)
            return total / np.add.reduceat(weight, firsts)[:, None]

        for batch in batches:
            texts = batch.fillna("").tolist()
            p = np.concatenate([of(texts[i : i + 64]) for i in range(0, len(texts), 64)]) if texts else np.zeros((0, len(langs)))
            yield pd.DataFrame({"lang": [langs[i] for i in p.argmax(axis=1)], "score": np.minimum(p.max(axis=1, initial=0), 1.0).astype(float)})

    made = fresh(docs, "predicted")
    found = docs.withColumn(made, predict(F.when(lettered, F.col("text"))))
    return found.select(
        *docs.columns,
        F.when(lettered, F.col(f"{made}.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(lettered, F.round(f"{made}.score", 6)).otherwise(F.lit(0.0)).alias("score"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder() == 1, F.lit(False))
    found = identify(docs, id_remainder() != 1)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
