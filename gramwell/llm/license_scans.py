"""License scans: an exact set-similarity join of text blocks with licence templates.

A block is a line of a text, cut into windows of `block_words` words every half window where it is
longer. Where a text has line breaks, the words around each rare template word are a block too, across
lines, as far as the template is long, so that a wrapped licence is found. A block matches a template when it holds at least `threshold` of the template's distinct
words. Words are put in one global order, rarest in the corpus first; a block and a template that
share enough words must then share one among their first words (prefix filter). The length filter
drops blocks with too few template words, the positional filter pairs whose remaining words cannot
reach the overlap, and an intersection settles the rest. Nothing is missed.

Only DataFrame functions are used. What goes to the driver or is broadcast is the template
vocabulary, whose size the templates bound.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramwell.llm.url_filters import LOWERED, UPPER

#: Base phrases of the op8 query: label, words.
PHRASES = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))

#: Templates: label, text.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("reserved", "All rights reserved"),
)

#: One or more characters outside words, of either case; and a word.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: The words of a template.
TEMPLATE_WORD = rf"{WORD}+"


def word_array(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; empty for a text without words."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWERED), f"{GAP}+"), "")


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(TEMPLATE_WORD, text.translate(str.maketrans(UPPER, LOWERED)))))


def phrase_places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Places (words from 0) where the phrase stands, overlaps included."""

    def here(i: Column) -> Column:
        out = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return F.coalesce(out, F.lit(False))

    return F.filter(F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>")), here)


def word_frequencies(texts: DataFrame, text_column: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in all texts; one row a word reaches the driver."""
    one = texts.select(F.explode(F.split(text_column, f"{GAP}+")).alias("w")).where(F.lower("w").isin([w.lower() for w in vocabulary]))
    return {r["w"]: r["count"] for r in one.groupBy(F.translate("w", UPPER, LOWERED).alias("w")).count().collect()}


def license_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, block_words: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every (block, template) pair that meets the threshold.

    Rows: _id, _hash (xxhash64 of the text, so that repeated or null ids stay apart), line, start (word
    in the line; a block across lines has a null line and counts words of the text), label, template (number), overlap, containment. Null and empty texts have no block.
    """
    spark = docs.sparkSession
    sets = [template_words(t) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    base = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    frequent = word_frequencies(base, "_text", vocabulary)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequent.get(w, 0), w)))}
    need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
    index = []
    for t, s in enumerate(sets):
        order = sorted(rank[w] for w in s)
        index += [(r, t, at, len(order), need[t], templates[t][0], order) for at, r in enumerate(order[: len(order) - need[t] + 1])]
    starts = sorted({vocabulary_word for r, *_ in index for vocabulary_word, k in rank.items() if k == r})
    # a text without any word of a template's prefix has no match
    some = rf"(?i)(?<!{WORD})(?:{'|'.join(starts)})(?!{WORD})"
    ranks = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))])
    least = min(need)

    lines = base.where(F.col("_text").rlike(some)).select("_id", F.xxhash64("_text").alias("_hash"), F.posexplode(F.split("_text", "\n")).alias("line", "_line"))
    lines = lines.where(F.col("_line").rlike(some)).withColumn("_words", word_array(F.col("_line"))).where(F.size("_words") >= least)
    half = max(1, block_words // 2)
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_words") - half - 1), F.lit(half))
    blocks = lines.select("_id", "_hash", "line", F.explode(cuts).alias("start"), "_words")
    held = F.slice("_words", F.col("start") + 1, block_words)
    tokens = F.array_sort(F.array_distinct(F.filter(F.transform(held, lambda w: F.element_at(ranks, w)), lambda k: k.isNotNull())))
    blocks = blocks.select("_id", "_hash", "line", "start", tokens.alias("_tokens")).where(F.size("_tokens") >= least)

    index = spark.createDataFrame(index, "rank int, template int, tpos int, size int, need int, label string, order array<int>")
    first = F.slice("_tokens", F.lit(1), F.size("_tokens") - least + 1)
    pairs = blocks.select("*", F.posexplode(first).alias("bpos", "rank")).join(F.broadcast(index), "rank")
    reach = F.least(F.size("_tokens") - F.col("bpos"), F.col("size") - F.col("tpos"))
    pairs = pairs.where((F.size("_tokens") >= F.col("need")) & (reach >= F.col("need")))
    overlap = F.size(F.array_intersect("_tokens", "order"))
    pairs = pairs.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need"))
    pairs = pairs.withColumn("containment", F.col("overlap") / F.col("size"))
    columns = ("_id", "_hash", "line", "start", "label", "template", "overlap", "containment")
    return pairs.select(*columns).unionByName(_wrapped(base.where(F.col("_text").rlike(some)), templates, sets, need, rank).select(*columns)).distinct()


def _wrapped(texts: DataFrame, templates, sets: list[list[str]], need: list[int], rank: dict[str, int]) -> DataFrame:
    """Matches in texts of several lines: blocks around each prefix word, which hold every passage of the template's length with that word."""
    long = [len(re.findall(TEMPLATE_WORD, t)) for _, t in templates]
    index = []
    for t, s in enumerate(sets):
        order = sorted(s, key=rank.__getitem__)
        index += [(w, t, long[t], len(s), need[t], templates[t][0], order) for w in order[: len(s) - need[t] + 1]]
    starts, most = sorted({r[0] for r in index}), max(long, default=1)
    index = texts.sparkSession.createDataFrame(index, "word string, template int, long int, size int, need int, label string, order array<string>")
    many = texts.where(F.contains("_text", F.lit("\n"))).select("_id", F.xxhash64("_text").alias("_hash"), word_array(F.col("_text")).alias("_words"))
    # a block of the longest template's reach first, so that no row holds a whole text
    low = lambda at, reach: F.greatest(at - reach + 1, F.lit(0))
    held = lambda words, at, reach: F.slice(words, low(at, reach) + 1, at + reach - low(at, reach))
    at = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(starts), i)), lambda i: i.isNotNull())
    each = F.transform(at, lambda i: F.struct(low(i, F.lit(most)).alias("first"), (i - low(i, F.lit(most))).alias("at"), held(F.col("_words"), i, F.lit(most)).alias("words")))
    each = many.select("_id", "_hash", F.explode(each).alias("b")).select("_id", "_hash", "b.*").withColumn("word", F.get("words", F.col("at")))
    pairs = each.join(F.broadcast(index), "word")
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect(held(F.col("words"), F.col("at"), F.col("long")), F.col("order")))).where(F.col("overlap") >= F.col("need"))
    start = F.col("first") + low(F.col("at"), F.col("long"))
    return pairs.withColumns({"line": F.lit(None).cast("int"), "start": start, "containment": F.col("overlap") / F.col("size")})


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.8, block_words: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_words, phrase places, labels and score.

    n_words, n_base, first_word, last_word: words and phrase places of the whole text (words from 0).
    base_labels, labels: distinct, sorted, comma-joined; labels adds those of matching templates.
    score: 1.0 with a phrase, else the best containment of a matching block, else 0.0.
    A null text counts as empty: no words, null places, empty labels, score 0.0. Repeated rows get a row
    each; rows with a null id are judged by their own text.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    any_phrase = "(?i)" + "|".join(f"{GAP}+".join(p) for _, p in phrases)
    base = docs.select(F.col(id_column).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"))
    # splitting at gaps takes an eighth of the time of counting matches
    base = base.withColumn("n_words", F.size(F.array_remove(F.split("_text", f"{GAP}+"), "")).cast("long"))
    words = F.when(F.col("_text").rlike(any_phrase), word_array(F.col("_text")))
    base = base.withColumn("_words", words).drop("_text")
    places = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(phrase_places(F.col("_words"), p), F.array().cast("array<int>")).alias("at")) for label, p in phrases])
    base = base.withColumn("_places", F.when(F.col("_words").isNotNull(), places)).drop("_words")
    every = F.flatten(F.transform("_places", lambda x: x["at"]))
    base = base.select("_id", "_hash", "n_words", F.coalesce(F.size(every), F.lit(0)).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.coalesce(F.array_sort(F.array_distinct(F.transform(F.filter("_places", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]))), F.array().cast("array<string>")).alias("_base"))
    base = base.withColumn("n_base", F.greatest("n_base", F.lit(0)))
    found = license_blocks(docs, templates, threshold, block_words, id_column, text_column)
    found = found.groupBy("_id", "_hash").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"))
    both = base.join(found.withColumnsRenamed({"_id": "_id2", "_hash": "_hash2"}), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0)))
    return both.select(F.col("_id").alias(id_column), "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    words = "string_split(trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ')"
    values = ", ".join(f"('{label}', {template_words(t)}, {max(1, math.ceil(0.8 * len(template_words(t)) - 1e-9))}, {len(template_words(t))})" for label, t in TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter({words.format("coalesce(text, '')")}, lambda x: x <> '') AS w FROM documents),
p AS (
  SELECT doc_id, 'cc-by' AS label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) WHERE w[i + 1] = 'cc' AND w[i + 2] = 'by'
  UNION ALL SELECT doc_id, 'gpl', i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) WHERE w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license'
  UNION ALL SELECT doc_id, 'reserved', i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d) WHERE w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved'),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
l AS (SELECT doc_id, list_filter({words.format("line")}, lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
k AS (SELECT doc_id, list_distinct(w[c + 1 : c + 64]) AS w FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 32), 32)) AS c FROM l)),
t(label, words, need, size) AS (VALUES {values}),
m AS (SELECT doc_id, label, max(len(list_intersect(w, words)) / size) AS c FROM k JOIN t ON len(list_intersect(w, words)) >= need GROUP BY doc_id, label),
x AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS c FROM (SELECT doc_id, label, c FROM m UNION ALL SELECT doc_id, label, 1.0 FROM p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(x.c, 0)::DOUBLE AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN x ON d.doc_id = x.doc_id
"""


OP8_SQL = _sql()
