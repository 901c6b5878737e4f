"""URL filters: rules, and a character language-model ratio for what no rule decides.

Only DataFrame operations. URLs that a rule allows or blocks train two variable-order
Markov models over a folded alphabet of 32 symbols (a-z, digits as one, four marks,
the rest as one). The probability of a symbol blends the orders 0 to 3: each order adds
its counts, smoothed by SMOOTHING times what the shorter context says, so contexts
with little evidence fall back by themselves. A URL's score is the mean over its symbols of the
log-likelihood difference, accepted minus rejected.

Every labelled URL counts. One in CALIBRATION_FOLDS (by hash of the URL) is held out of the
counts; the threshold is the score that splits the held-out ones best.

Size: a gram is four symbols of five bits, so the model has at most 2^20 rows whatever the
input, which bounds its broadcast. Grams are counted with a partial aggregate, so hosts with
a third of all URLs meet in no task. Scoring explodes a URL inside its task and sums again
before the shuffle.

Defined cases: a null URL, and one without ``://``, has an empty host and path, no rule and
score 0; equal URLs get equal verdicts, each row its own; with no labelled URL on one side
the threshold is 0; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splitboard.llm.text import let, lower_ascii
from splitboard.sources import load, stage

#: (verdict, host/path-prefix)
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.-_"  # and one more for the rest
ORDER = 3
SMOOTHING = 4.0
CALIBRATION_FOLDS = 5
#: Scores are compared in steps of this size when the threshold is chosen, between -LIMIT and LIMIT.
STEP, LIMIT = 0.01, 5.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://``; A-Z of the host lower-cased."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def fits(host: Column, path: Column, rule: str) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's."""
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


def judged(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    by_length = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = F.coalesce(*[F.when(fits(host, path, r), F.lit(r)) for _, r in by_length])
    verdict = F.coalesce(*[F.when(fits(host, path, r), F.lit(v)) for v, r in by_length])
    return rule, verdict


def grams(text: Column) -> Column:
    """A text's codes, one per character: the symbol in the low five bits above its ORDER predecessors."""

    folded = F.regexp_replace(F.regexp_replace(lower_ascii(text), "[0-9]", "0"), r"[^a-z0/._-]", "~")
    symbols = F.filter(F.split(folded, ""), lambda c: c != "")
    numbers = F.transform(symbols, lambda c: F.when(c == "~", F.lit(31)).otherwise(F.instr(F.lit(SYMBOLS), c) - 1))

    def with_history(ids: Column) -> Column:
        def code(x: Column, i: Column) -> Column:
            back = [F.coalesce(F.get(ids, i - k), F.lit(31)) for k in range(1, ORDER + 1)]
            return reduce(lambda total, part: total + part, [x] + [F.shiftleft(b, 5 * k) for k, b in enumerate(back, 1)])

        return F.transform(ids, code)

    return let(numbers, with_history)


def model(labelled: DataFrame) -> DataFrame:
    """(gram, ratio): log-likelihood difference of every gram that occurs in labelled (gram, verdict).

    verdict is null for URLs that do not train; their grams get a ratio too.
    """
    counts = labelled.groupBy("gram").agg(
        F.count_if(F.col("verdict") == "allow").alias("n_allow"), F.count_if(F.col("verdict") == "block").alias("n_block")
    )
    for side in ("allow", "block"):
        counts = counts.withColumn(f"p_{side}", F.lit(1.0 / 32))
    for order in range(ORDER + 1):
        symbols = 1 << (5 * (order + 1))
        gram = F.col("gram") % symbols
        context = F.shiftright(gram, 5)
        w_gram, w_context = Window.partitionBy(gram), Window.partitionBy(context)
        for side in ("allow", "block"):
            seen, of = F.sum(f"n_{side}").over(w_gram), F.sum(f"n_{side}").over(w_context)
            counts = counts.withColumn(f"p_{side}", (seen + SMOOTHING * F.col(f"p_{side}")) / (of + SMOOTHING))
    return counts.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score that splits the labelled rows of scored (score, verdict) best: the highest sum of both sides' rates.

    Rows are binned by STEP between -LIMIT and LIMIT, which bounds what is compared.
    """
    bins = F.floor(F.least(F.greatest("score", F.lit(-LIMIT)), F.lit(LIMIT)) / STEP).cast("int")
    sides = scored.groupBy(bins.alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block")
    )
    whole, below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    n_allow, n_block = F.sum("allow").over(whole), F.sum("block").over(whole)
    right = (n_allow - F.coalesce(F.sum("allow").over(below), F.lit(0))) / n_allow + F.coalesce(F.sum("block").over(below), F.lit(0)) / n_block
    both = sides.select("bin", F.when((n_allow > 0) & (n_block > 0), right).alias("right")).where("right IS NOT NULL")
    best = both.orderBy(F.desc("right"), F.abs("bin"), "bin").first()
    return 0.0 if best is None else best.bin * STEP


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages (page_id, url)."""
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    fold = F.pmod(F.xxhash64("host", "path"), F.lit(CALIBRATION_FOLDS))
    urls = urls.select("*", rule.alias("rule"), verdict.alias("verdict"), (fold == 0).alias("held_out"))
    text = F.concat("host", "path")
    trains = F.when(~F.col("held_out"), F.col("verdict")).alias("verdict")
    ratios = stage(model(urls.select(F.explode(grams(text)).alias("gram"), trains)), "url-model")

    kept = ["row", "page_id", "host", "path", "rule", "verdict", "held_out"]
    probes = urls.select(*kept, F.explode_outer(grams(text)).alias("gram"))
    means = probes.join(F.broadcast(ratios), "gram", "left").groupBy(*kept).agg(F.avg("ratio").alias("score"))
    scored = stage(means.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6)), "url-scores")
    least = threshold(scored.where("held_out AND verdict IS NOT NULL"))
    method = F.when(F.col("score") >= least, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged."""
    return filter_urls(load(spark, sf_dir, "pages").select("page_id", "url"))
