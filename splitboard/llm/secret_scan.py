"""Secret scans: candidates in whole texts, and a random forest that removes false positives.

1. Words and character transitions of ordinary text are counted over the whole texts of all documents. The
   dictionary is every word of three to LONGEST_WORD letters (longer runs of letters are no words) that makes up at least one in WORD_SHARE of all words (so
   there are at most WORD_SHARE of them, whatever the input) and occurs LEAST_TIMES; transitions are a 37 x 37 table.
2. One pass over the documents cuts out candidates: values assigned to names that speak of secrets, with prefixes,
   suffixes and quotes; passwords in URLs; web tokens; key blocks; and runs of 16 or more key characters.
   Each becomes numbers: length, character classes and changes between them, how likely its character transitions are
   in prose and in secrets, how much of it the dictionary covers, whether it stands in a path, URL or
   address, and how the name and the neighbouring words speak for or against a secret. This small table
   of places and numbers is written out; no secret leaves the task, only its digest.
3. The forest is trained from labelled findings (``secret_findings``, or the caller's own), placed in text and cut
   out by the same pass, and from the documents' own findings that carry a label: issued formats are true,
   unnamed letters, numbers and URL parts are false. SAMPLE of each of the latter are used, those with the smallest hash,
   none from held-out documents (crc32 of doc_id mod 3 is 1).
4. Every candidate gets the share of trees that take it for a secret.

Defined cases: null and empty texts have no candidates; rows without a doc_id are scanned and do not train; repeated rows each
give their findings; without a dictionary (an empty table, no words) the fixed words of the labelled findings remain; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.llm.secret_findings import USUAL, Finding, labelled_findings
from splitboard.llm.text import smallest
from splitboard.sources import load, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_SHARE, LEAST_TIMES, LONGEST_WORD = 100_000, 3, 24
SAMPLE = 1500
TREES, DEPTH, LEAF = 40, 10, 3
LEAST_SCORE = 0.5

#: Published formats of issued secrets.
FORMATS = {
    "aws-access-key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github-token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "slack-token": r"xox[abpr]-[A-Za-z0-9-]{10,}",
    "stripe-key": r"[sr]k_(?:live|test)_[A-Za-z0-9]{24,}",
    "google-key": r"AIza[A-Za-z0-9_-]{35}",
    "mail-key": r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}",
    "package-token": r"npm_[A-Za-z0-9]{36}",
    "web-token": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
}

STRUCTURED = re.compile(
    r"(?:password|passwd|passphrase|pwd|token|secret|api[_-]?key|auth|credential|key)[a-z0-9_\-]{0,24}[\"']?[ \t]{0,3}(?:=>|:=|=|:)[ \t]{0,3}"
    r"(?:\"(?P<double>[^\"\s]{6,})\"|'(?P<single>[^'\s]{6,})'|(?P<plain>[^\s\"'`,;<>(){}\[\]]{8,}))"
    r"|://[^\s/:@'\"<>]{1,64}:(?P<url>[^\s/@'\"<>]{4,})@"
    r"|(?P<web>eyJ[a-z0-9_\-]{6,}\.[a-z0-9_\-]{6,}\.[a-z0-9_\-]{6,})"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?P<block>[^\-]{16,})-----END",
    re.IGNORECASE,
)
NAMED = ("double", "single", "plain")
#: Whatever STRUCTURED matches holds one of these.
SIGNS = ["pass", "pwd", "token", "secret", "auth", "credential", "key", "://", "eyj"]
BARE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}")
WORD = re.compile(r"[^\W\d_]+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Candidate(NamedTuple):
    start: int
    end: int
    named_at: int  # start of the name; of the value if it has none
    name: str
    form: str


def candidates(text: str) -> list[Candidate]:
    """Everything in a text that looks as if it were a secret, in order; structured ones win over bare runs."""
    found, low = [], text.lower()
    for m in STRUCTURED.finditer(text) if any(x in low for x in SIGNS) else ():
        form = m.lastgroup
        start, end = m.span(form)
        named_at, name = start, ""
        if form == "plain":
            end = start + len(m[form].rstrip(".!?:"))
            if end - start < 8:
                continue
        if form in NAMED:
            named_at = m.start()
            while named_at and (text[named_at - 1].isalnum() or text[named_at - 1] in "_-.") and m.start() - named_at < 40:
                named_at -= 1
            name = re.split(r"[\"'\s=:]", text[named_at:start], maxsplit=1)[0]
        found.append(Candidate(start, end, named_at, name, form))
    taken, at = list(found), 0
    for m in BARE.finditer(text):
        while at < len(taken) and taken[at].end <= m.start():
            at += 1
        if at == len(taken) or m.end() <= taken[at].named_at:
            found.append(Candidate(m.start(), m.end(), m.start(), "", "bare"))
    return sorted(found)


def codes(text: str) -> np.ndarray:
    """a-z as 0-25, digits as 26-35, the rest as 36."""
    raw = np.frombuffer(text.lower().encode("ascii", "replace"), dtype=np.uint8).astype(int)
    return np.where((raw >= 97) & (raw <= 122), raw - 97, np.where((raw >= 48) & (raw <= 57), raw - 22, 36))


def transitions(counted: dict[str, float]) -> np.ndarray:
    """Log chances of the next character, from counted pairs."""
    counts = np.ones((37, 37))
    for pair, n in counted.items():
        a, b = codes(pair)
        counts[a, b] += n
    return np.log(counts / counts.sum(axis=1, keepdims=True))


class Tables(NamedTuple):
    """What the features are measured by: bounded tables, small enough to send to every task."""

    words: frozenset[str]
    prose: np.ndarray
    secret: np.ndarray
    odds: dict[str, float]  # of neighbouring words, name parts (#) and first signs (^)


def coverage(text: str, words: frozenset[str]) -> float:
    """Share of the characters in dictionary words, taken greedily from the left, the longest first."""
    low, at, covered = text.lower(), 0, 0
    while at < len(low):
        step = next((n for n in range(min(LONGEST_WORD, len(low) - at), 2, -1) if low[at : at + n] in words), 0) if low[at].isalpha() else 0
        covered += step
        at += step or 1
    return covered / max(1, len(low))


def told_by(text: str, c: Candidate) -> tuple[list[str], list[str], list[str]]:
    """The words around, the parts of the name, and the first signs of a candidate, as keys of Tables.odds."""
    near = WORD.findall(text[max(0, c.named_at - 40) : c.named_at])[-3:] + WORD.findall(text[c.end : c.end + 40])[:3]
    shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", text[c.end : c.end + 1])))
    return [w.lower() for w in near], [f"#{p.lower()}" for p in PARTS.findall(c.name)], [f"^{text[c.start : c.start + 4].lower()}", f"${shape}"]


def features(text: str, c: Candidate, tables: Tables) -> list[float]:
    value, n = text[c.start : c.end], c.end - c.start
    kinds = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.islower() else "s" for x in value]
    share, seen = Counter(kinds), np.array(list(Counter(value).values())) / n
    before, after = text[max(0, c.named_at - 40) : c.named_at], text[c.end : c.end + 40]
    token = before.rsplit(None, 1)[-1] if before.strip() and not before[-1:].isspace() else ""
    near, name, signs = told_by(text, c)
    at = codes(value)
    odds = [tables.odds.get(w, 0.0) for w in near]
    return [
        n,
        len(seen) / n,
        float(-(seen * np.log2(seen)).sum()),
        *(share[k] / n for k in "duls"),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(tables.prose[at[:-1], at[1:]].mean()) if n > 1 else 0.0,
        float(tables.secret[at[:-1], at[1:]].mean()) if n > 1 else 0.0,
        coverage(value, tables.words),
        max((len(r) for r in re.findall(r"[A-Za-z]+", value)), default=0),
        float(all(x in "0123456789abcdefABCDEF" for x in value)),
        sum(x in "-_." for x in value) / n,
        value.count("/"),
        float(value[:1] in "./" or re.search(r"\.[A-Za-z]{1,4}$", value) is not None),
        float(value[:1] in "$%{<*" or value[-1:] in ">}*)"),
        float(before[-1:] in ("/", "@", ".")),
        float(after[:1] in ("@", ".") and after[1:2].isalnum()),
        float("://" in token),
        float(c.form == "url"),
        float(c.form in NAMED),
        float(before.rstrip()[-1:] in ("=", ":")),
        float(before[-1:] in ('"', "'") or c.form in ("double", "single")),
        sum(odds),
        min(odds, default=0.0),
        sum(tables.odds.get(w, 0.0) for w in name),
        sum(tables.odds.get(w, 0.0) for w in signs),
        float(np.mean([w in tables.words for w in near])) if near else 0.0,
    ]


N_FEATURES = 29


def cut_out(finding: Finding) -> tuple[str, Candidate] | None:
    """A labelled finding as the scan sees it; None if it sees no candidate there."""
    text, start = finding.before + finding.value + finding.after, len(finding.before)
    overlap = lambda c: min(c.end, start + len(finding.value)) - max(c.start, start)
    best = max(candidates(text), key=overlap, default=None)
    return (text, best) if best is not None and overlap(best) > 0 else None


def measured_by(words: list[str], pairs: dict[str, float], findings: list[Finding]) -> Tables:
    """The tables: prose from the documents' counts, the odds of words and first signs from labelled findings."""
    inside: Counter[str] = Counter()
    held: dict[str, np.ndarray] = defaultdict(lambda: np.ones(2))
    for finding in findings:
        seen = cut_out(finding)
        if seen:
            value = finding.value.lower()
            if finding.is_secret:
                inside.update(value[i : i + 2] for i in range(len(value) - 1))
            for key in {k for keys in told_by(*seen) for k in keys}:
                held[key][int(finding.is_secret)] += 1
    total = np.array([sum(not f.is_secret for f in findings), sum(f.is_secret for f in findings)]) + 2
    odds = {k: float(np.clip(np.log(v[1] / total[1]) - np.log(v[0] / total[0]), -3, 3)) for k, v in held.items() if v.sum() >= 5}
    ascii_pairs = {p: n for p, n in inside.items() if len(p.encode("ascii", "replace")) == 2}
    return Tables(frozenset(words) | frozenset(USUAL), transitions(pairs), transitions(ascii_pairs), odds)


def kind_of(value: str, form: str) -> str:
    known = next((k for k, p in FORMATS.items() if re.fullmatch(p, value)), None)
    return known or {"url": "url-password", "block": "private-key", "bare": "unnamed"}.get(form, "named")


def label(kind: str, c: Candidate, row: list[float]) -> float | None:
    """1 for an issued secret, 0 for what is surely none, None where nobody has looked."""
    if kind in FORMATS:
        return 1.0
    letters_or_digits = row[3] == 0 or row[3] == 1
    return 0.0 if c.form == "bare" and (letters_or_digits or row[18] or row[19]) else None


def count_prose(docs: DataFrame) -> tuple[list[str], dict[str, float]]:
    """The dictionary and the pairs of characters in words, counted over the whole texts of docs (text)."""
    word = F.explode(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+", -1)).alias("word")
    counted = docs.select(word).where(F.length("word").between(2, LONGEST_WORD) & F.col("word").rlike(r"^\p{L}+$")).groupBy("word").agg(F.count("*").alias("n"))
    counted = stage(counted, "word-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = counted.where((F.col("n") * WORD_SHARE >= total) & (F.col("n") >= LEAST_TIMES) & (F.length("word") > 2))
    words = [r.word for r in often.orderBy(F.desc("n"), "word").select("word").collect()]  # at most WORD_SHARE
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("plain") - 1), lambda i: F.substring("plain", i, F.lit(2))))
    pairs = counted.select(F.regexp_replace("word", "[^a-z]", "*").alias("plain"), "n").select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    return words, {r.pair: float(r.n) for r in pairs.collect()}  # at most 27 x 27


def find_candidates(docs: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, start, length, kind, label, digest, features) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(tables))  # of bounded size

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Tables(*shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for c in candidates(text or ""):
                    value, row = text[c.start : c.end], features(text, c, held)
                    kind = kind_of(value, c.form)
                    digest = hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((None if pd.isna(doc_id) else int(doc_id), c.start, c.end - c.start, kind, label(kind, c, row), digest, row))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "kind", "label", "digest", "features"])
            yield out.astype({"doc_id": "Int64", "label": "Float64"})

    return docs.select("doc_id", "text").mapInPandas(found, "doc_id long, start long, length long, kind string, label double, digest string, features array<double>")


def grow(x: np.ndarray, y: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One tree over quantile splits, with a drawn subset of features at each node: nodes (feature or -1, split, left, right, share of true findings)."""
    nodes: list[list[float]] = []

    def node(rows: np.ndarray, depth: int) -> int:
        own, share = len(nodes), y[rows].mean()
        nodes.append([-1, 0, 0, 0, share])
        if depth == DEPTH or len(rows) < 2 * LEAF or share in (0, 1):
            return own
        best = None
        for f in rng.choice(x.shape[1], int(np.ceil(np.sqrt(x.shape[1]))), replace=False):
            v = x[rows, f]
            for split in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 19))):
                left = v <= split
                n = left.sum()
                if LEAF <= n <= len(rows) - LEAF:
                    a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                    impurity = n * a * (1 - a) + (len(rows) - n) * b * (1 - b)
                    if best is None or impurity < best[0]:
                        best = impurity, f, split
        if best is not None:
            left = x[rows, best[1]] <= best[2]
            nodes[own][:2] = best[1:]
            nodes[own][2] = node(rows[left], depth + 1)
            nodes[own][3] = node(rows[~left], depth + 1)
        return own

    node(rows, 0)
    return np.array(nodes)


def train_forest(x: np.ndarray, y: np.ndarray, seed: int = 3) -> list[np.ndarray]:
    """TREES trees, each on a bootstrap sample."""
    rng = np.random.default_rng(seed)
    return [grow(x, y, rng.integers(0, len(x), len(x)), rng) for _ in range(TREES)]


def votes(trees: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean share of true findings over the trees, for each row of x."""
    total = np.zeros(len(x))
    for tree in trees:
        at = np.zeros(len(x), dtype=int)
        for _ in range(DEPTH):
            f = tree[at, 0].astype(int)
            left = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
            at = np.where(f < 0, at, np.where(left, tree[at, 2], tree[at, 3]).astype(int))
        total += tree[at, 4]
    return total / len(trees)


def trains() -> Column:
    """Rows outside the held-out third."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))


def learn(words: list[str], pairs: dict[str, float], findings: list[Finding] | None = None) -> tuple[Tables, np.ndarray, np.ndarray]:
    """(tables, features, labels) of labelled findings. Every second one settles the odds of words, the others train the forest, so no finding speaks for itself."""
    findings = findings or labelled_findings(seed=11, words=words[:500])
    tables = measured_by(words, pairs, findings[::2])
    seen = [(f, cut) for f in findings[1::2] if (cut := cut_out(f))]
    return tables, np.array([features(*cut, tables) for _, cut in seen]).reshape(-1, N_FEATURES), np.array([float(f.is_secret) for f, _ in seen])


def scan(docs: DataFrame, findings: list[Finding] | None = None) -> DataFrame:
    """Every candidate of docs (doc_id, text) with the forest's score and verdict; findings: labelled ones to train from."""
    docs = docs.select("doc_id", "text")
    words, pairs = count_prose(docs)
    tables, x, y = learn(words, pairs, findings)
    found = stage(find_candidates(docs, tables), "secret-candidates")
    drawn = F.xxhash64("doc_id", "start", "digest")
    for truth in (1.0, 0.0):
        own = found.where(trains() & (F.col("label") == truth)).select("doc_id", "start", "digest", "features")
        rows = smallest(own, drawn, SAMPLE, "doc_id", "start", "digest").collect()
        x = np.concatenate([x, np.array([r.features for r in rows]).reshape(-1, N_FEATURES)])
        y = np.append(y, np.full(len(rows), truth))
    shared = docs.sparkSession.sparkContext.broadcast(train_forest(x, y))  # arrays of bounded size

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, N_FEATURES))
            yield pd.Series(votes(shared.value, rows))

    scored = found.withColumn("score", F.round(score("features"), 6))
    return scored.select("doc_id", "start", "length", "kind", F.col("digest").alias("secret_sha256"), "score", (F.col("score") >= LEAST_SCORE).alias("is_secret"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its verdict."""
    return scan(load(spark, sf_dir, "documents"))
