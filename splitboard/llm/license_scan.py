"""License scans: phrases at exact places, and an exact set-similarity join of text blocks with templates.

Only DataFrame operations. A block is a stretch of consecutive words, across line breaks and comment signs, that
begins with a word of the template and is at most STRETCH times as long as the template. It meets the template
if it holds at least ``threshold`` of the template's distinct words (containment), all of its telling
words, and none that tell of another template. The join finds every such block:

- words are ordered by how rare they are over all documents (ties by the word), the
  rarest first. Only words of some template can add to an overlap, so only these are counted;
- prefix filter: a block that meets a template of n words with a needed overlap of a holds one of the n - a + 1 first
  words of the template, so only the surroundings of such words are looked at. The rarest word that a block
  shares with a template is its anchor;
- length filter: the surroundings hold at least a different template words;
- positional filter: an anchor at place i of the template's words and j of the m in the surroundings leaves at
  most 1 + min(n - 1 - i, m - 1 - j) shared words, which must reach a;
- pairs that remain are verified by the exact overlap of every block around the anchor.

Templates are a parameter, MAX_TEMPLATES at most with MAX_TEMPLATE_WORDS words each (of a long license its notice or its
first paragraph), so their tables have a proven bound: they are broadcast, and their words stand in the
plan as literals. No text is shuffled; an anchor carries the template words around it alone.

Defined cases: null text is empty; a document without words has no labels, score 0; rows without a doc_id are scanned like
others; repeated rows each give a row; ties of the score do not matter, all labels are given; an empty table gives an empty
result; further columns are left alone.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitboard.llm.text import let, lower_ascii
from splitboard.sources import load

THRESHOLD, STRETCH = 0.8, 1.5
MAX_TEMPLATES, MAX_TEMPLATE_WORDS = 64, 400


class Template(NamedTuple):
    """A notice; must: its words without which it is another one; never: words that make it another one."""

    label: str
    text: str
    must: str = ""
    never: str = ""


#: Phrases whose places are reported, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Usual notices of public licenses. Each of a family names what tells it from the others.
CC, CC_END, NO_CHANGES = "This work is licensed under a Creative Commons", "4.0 International License.", "noderivatives noderivs"
TEMPLATES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Template("mit", "Released under the MIT License.", "mit license"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    Template("cc-by", "Licensed under CC BY 4.0.", "cc by", "nc sa nd"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc", "sa nd"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa", "nc nd"),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0.", "cc by nd", "nc sa"),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa", "nd"),
    Template("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0.", "cc by nc nd", "sa"),
    Template("cc-by", f"{CC} Attribution {CC_END}", "commons attribution", f"noncommercial sharealike {NO_CHANGES}"),
    Template("cc-by-nc", f"{CC} Attribution-NonCommercial {CC_END}", "commons noncommercial", f"sharealike {NO_CHANGES}"),
    Template("cc-by-sa", f"{CC} Attribution-ShareAlike {CC_END}", "commons sharealike", f"noncommercial {NO_CHANGES}"),
    Template("cc-by-nd", f"{CC} Attribution-NoDerivatives {CC_END}", "commons noderivatives", "noncommercial sharealike"),
    Template("cc-by-nc-sa", f"{CC} Attribution-NonCommercial-ShareAlike {CC_END}", "commons noncommercial sharealike", NO_CHANGES),
    Template("cc-by-nc-nd", f"{CC} Attribution-NonCommercial-NoDerivatives {CC_END}", "commons noncommercial noderivatives", "sharealike"),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3.", "gnu 3", "lesser affero"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2"),
    Template("all-rights-reserved", "Copyright. All rights reserved.", "rights reserved"),
]

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """A-Z lower-cased, words apart by one space, none at the ends."""
    return F.btrim(F.regexp_replace(lower_ascii(text), NOT_WORD, " "), F.lit(" "))


def words_of(plain: Column) -> Column:
    """The words of a spaced() text."""
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1))


def template_words(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(template, label, span, must, never, word): the distinct words of the templates."""
    if len(templates) > MAX_TEMPLATES or any(len(t.text.split()) > MAX_TEMPLATE_WORDS for t in templates):
        raise ValueError(f"at most {MAX_TEMPLATES} templates of {MAX_TEMPLATE_WORDS} words")
    rows = spark.createDataFrame([(i, *Template(*t)) for i, t in enumerate(templates)], "template int, label string, text string, must string, never string")
    words = words_of(spaced(F.col("text")))
    rows = rows.withColumns({"words": words, "span": F.ceil(F.size(words) * F.lit(STRETCH)).cast("int"), "must": words_of(spaced(F.col("must"))), "never": words_of(spaced(F.col("never")))})
    return rows.select("template", "label", "span", "must", "never", F.explode(F.array_distinct("words")).alias("word"))


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, the globally rarest word first; counted over all documents."""
    spoken = docs.select(F.explode(F.filter(words_of(spaced(F.coalesce("text", F.lit("")))), lambda w: w.isin(vocabulary))).alias("word"))
    counted = {r.word: r.n for r in spoken.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each word of the vocabulary at most
    return sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs (doc_id, text): its words, the places of the phrases, labels and the best containment."""
    spark = docs.sparkSession
    own = template_words(spark, templates)
    known = own.select("word", "span", "never").collect()
    order = global_order(docs, sorted({r.word for r in known} | {w for r in known for w in r.never}))
    rank = spark.createDataFrame(list(enumerate(order)), "word_rank int, word string")

    listed = own.join(F.broadcast(rank), "word").groupBy("template", "label", "span", "must", "never").agg(F.array_sort(F.collect_list(F.struct("word_rank", "word"))).alias("t"))
    listed = listed.select("label", "span", "must", "never", F.transform("t", lambda x: x["word"]).alias("t_words"), F.ceil(F.size("t") * F.lit(threshold) - 1e-9).cast("int").alias("need"))
    index = listed.select("*", F.posexplode("t_words").alias("i", "anchor")).where(F.col("i") <= F.size("t_words") - F.col("need"))
    spans = {r.anchor: r.span for r in index.groupBy("anchor").agg(F.max("span").alias("span")).collect()}  # of the templates that a prefix word stands for
    prefix = sorted(spans)
    span_of = F.create_map(*[F.lit(x) for item in sorted(spans.items()) for x in item])

    def anchors(words: Column) -> Column:
        """The places of prefix words with the template words around them; texts without any are not taken further apart."""
        hits = F.array_compact(F.transform(words, lambda w, at: F.when(w.isin(order), F.struct(at.alias("at"), w.alias("word")))))

        def around(hits: Column) -> Column:
            def near(h: Column, i: Column) -> Column:
                span = F.element_at(span_of, h["word"])
                return F.slice(hits, F.greatest(i - span + 2, F.lit(1)), 2 * span - 1)

            places = F.transform(hits, lambda h, i: F.when(h["word"].isin(prefix), F.struct(h["at"].alias("at"), h["word"].alias("word"), near(h, i).alias("near"))))
            return F.array_compact(places)

        return F.when(F.arrays_overlap(words, F.array(*map(F.lit, prefix))), let(hits, around))

    def parts(plain: Column) -> Column:
        return F.struct(count_words(plain).alias("n_words"), *[places(plain, p).alias(label) for p, label in PHRASES.items()], let(words_of(plain), anchors).alias("anchors"))

    per_row = docs.select("doc_id", let(spaced(F.coalesce("text", F.lit(""))), parts).alias("found")).withColumn("row", F.monotonically_increasing_id())
    starts = F.flatten(F.array(*[F.col(f"found.`{label}`") for label in PHRASES.values()]))
    base = F.array_compact(F.array(*[F.when(F.size(F.col(f"found.`{label}`")) > 0, F.lit(label)) for label in PHRASES.values()]))
    # Summed up before the anchors become rows, so that no row carries the others or all places.
    summed = per_row.select(
        "row", "doc_id", F.col("found.n_words").alias("n_words"), F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), base.alias("base"), F.col("found.anchors").alias("anchors"),
    )
    own_columns = [c for c in summed.columns if c != "anchors"]
    flat = summed.select(*own_columns, F.explode_outer("anchors").alias("a"))

    # The surroundings' different words and how many of them are rarer than the anchor.
    ranks = F.array(*map(F.lit, order))
    block = F.array_distinct(F.transform("a.near", lambda x: x["word"]))
    probes = flat.select("*", F.size(block).alias("m"), F.size(F.filter(block, lambda w: F.array_position(ranks, w) < F.array_position(ranks, F.col("a.word")))).alias("j"))
    n, m = F.size("t_words"), F.col("m")
    left = F.lit(1) + F.least(n - 1 - F.col("i"), m - 1 - F.col("j"))
    met = probes.join(F.broadcast(index), (F.col("a.word") == index["anchor"]) & (m >= F.col("need")) & (left >= F.col("need")), "left")

    at, near = F.col("a.at"), F.filter("a.near", lambda x: F.abs(x["at"] - F.col("a.at")) < F.col("span"))
    mine = F.filter(near, lambda x: F.array_contains("t_words", x["word"]))

    def overlap(start: Column) -> Column:
        """Shared words of the block that begins here; null if a telling word is missing or another's is there."""
        held = F.transform(F.filter(near, lambda x: x["at"].between(start["at"], start["at"] + F.col("span") - 1)), lambda x: x["word"])
        fine = (F.size(F.array_intersect("must", held)) == F.size(F.array_distinct("must"))) & ~F.arrays_overlap("never", held)
        return F.when(fine, F.size(F.array_intersect("t_words", held)))

    best = F.when(F.col("label").isNotNull(), F.array_max(F.transform(F.filter(mine, lambda x: x["at"] <= at), overlap)))
    good = F.coalesce(F.col("best") >= F.col("need"), F.lit(False))
    result = met.withColumn("best", best).groupBy(*own_columns).agg(
        F.collect_set(F.when(good, F.col("label"))).alias("met"), F.max(F.when(good, F.col("best") / n)).alias("best")
    )
    labels = F.array_sort(F.array_distinct(F.concat("base", "met")))
    return result.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def count_words(plain: Column) -> Column:
    spaces = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.when(plain == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def places(plain: Column, phrase: str) -> Column:
    """Where the words of the phrase stand consecutively; texts without the phrase are not taken apart."""
    want = phrase.split(" ")

    def starts(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - len(want))
        return F.filter(at, lambda i: reduce(Column.__and__, [F.get(words, i + k) == w for k, w in enumerate(want)]))

    held = F.contains(F.concat(F.lit(" "), plain, F.lit(" ")), F.lit(f" {phrase} "))
    return F.when(held, let(words_of(plain), starts)).otherwise(F.array().cast("array<int>"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its license phrases and the labels of the templates that it holds."""
    return scan(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sql() -> str:
    template_rows = ", ".join(f"({i}, '{t.label}', '{t.text}', '{t.must}', '{t.never}')" for i, t in enumerate(TEMPLATES))
    phrase_rows = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in PHRASES.items())
    word = "'[a-z0-9]+'"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), worded AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs
), phrases(label, p) AS (VALUES {phrase_rows}
), places AS (
  SELECT rid, label, i - 1 AS pos FROM worded, phrases, unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p
), base AS (
  SELECT rid, count(*) AS n, min(pos) AS a, max(pos) AS b, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY rid
), templates(k, label, text, must, never) AS (VALUES {template_rows}
), tw AS (
  SELECT DISTINCT k, unnest(regexp_extract_all(lower(text), {word})) AS word FROM templates
), rules AS (
  SELECT k, label, ceil(len(regexp_extract_all(lower(text), {word})) * {STRETCH})::BIGINT AS span, ceil((SELECT count(*) FROM tw WHERE tw.k = t.k) * {THRESHOLD} - 1e-9) AS need,
         (SELECT count(*) FROM tw WHERE tw.k = t.k) AS n, regexp_extract_all(must, {word}) AS must, regexp_extract_all(never, {word}) AS never FROM templates t
), spoken AS (
  SELECT rid, i AS spot, w[i] AS word FROM worded, unnest(range(1, len(w) + 1)) AS r(i)
), own AS (
  SELECT rid, k, spot, word FROM spoken JOIN tw USING (word)
), held AS (
  SELECT a.rid, a.k, a.spot, count(DISTINCT b.word) AS c FROM own a JOIN rules r ON r.k = a.k JOIN own b ON b.rid = a.rid AND b.k = a.k AND b.spot BETWEEN a.spot AND a.spot + r.span - 1
  GROUP BY a.rid, a.k, a.spot HAVING count(DISTINCT b.word) >= any_value(r.need)
), told AS (
  SELECT h.rid, r.label, h.c / r.n AS c, list_distinct(w[h.spot : h.spot + r.span - 1]) AS words, r.must, r.never FROM held h JOIN rules r USING (k) JOIN worded USING (rid)
), best AS (
  SELECT rid, list(DISTINCT label) AS labels, max(c) AS c FROM told WHERE list_has_all(words, must) AND NOT list_has_any(words, never) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.b AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.c, 0.0) END::DOUBLE AS score
FROM worded LEFT JOIN base USING (rid) LEFT JOIN best USING (rid)
"""
