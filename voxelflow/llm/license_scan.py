"""License scan: an exact set-similarity join of text blocks with license templates.

Only DataFrame functions are used.  A block is a window of consecutive words,
whatever the line ends between them, a quarter longer than the template; a
template is met when its containment in a block, the share of its distinct
tokens that the block has, is ``THRESHOLD`` or more (all of them, for a template
under ``SHORT`` tokens), and the block has every number of the template, so that
another version of a license is not taken for it.  Tokens are ordered by the number of documents that
have them, over the whole corpus, rarest first:

    prefix      a block that reaches the threshold holds one of the first
                n - need + 1 tokens of the template, so only the surroundings
                of these tokens are opened
    length      blocks are as long as the template asks, and the surroundings
                must hold enough of its tokens at all
    position    of the surroundings only blocks that hold the prefix token count
    verify      the intersection has at least ``need`` tokens, all numbers among them

The templates' tokens, a fixed list, are the only thing that goes to every task.

The base count finds each place where a listed phrase's words are consecutive.

Defined results: null text is empty; a document without words has n_words 0 and
null places; a text shorter than a block is one; repeated rows and equal ids get a row
each; null ids pass through; no rows give none; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_collect, read_table

THRESHOLD = 0.8
#: Templates of fewer distinct tokens have to be there as a whole.
SHORT = 8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases to find and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Sentences and notices that name a license or a right, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the license",
    "apache-2.0-terms": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-4.0": "licensed under cc by 4.0",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license version 2.0",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied",
    "rights-reserved": "all rights reserved",
}


def _split(text: str) -> list[str]:
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).lower().split()


TOKENS = {label: list(dict.fromkeys(_split(text))) for label, text in TEMPLATES.items()}
#: Tokens that must be there, by label: versions.
NUMBERS = {label: [t for t in tokens if t.isdigit()] for label, tokens in TOKENS.items()}
VOCABULARY = sorted({t for tokens in TOKENS.values() for t in tokens})
#: Words of a block, by label.
LENGTHS = {label: len(_split(text)) * 5 // 4 for label, text in TEMPLATES.items()}
LONGEST = max(LENGTHS.values())


def _need(n: int, threshold: float) -> int:
    return n if n < SHORT else math.ceil(threshold * n - 1e-9)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def token_order(docs: DataFrame) -> list[str]:
    """The vocabulary by the number of documents that hold each token, rarest first, ties by name."""
    held = docs.select(F.explode(F.array_intersect(_words(F.coalesce("text", F.lit(""))), _array(VOCABULARY))).alias("token"))
    counted = {r["token"]: r["n"] for r in bounded_collect(held.groupBy("token").agg(F.count("*").alias("n")), len(VOCABULARY), "template tokens")}
    return sorted(VOCABULARY, key=lambda t: (counted.get(t, 0), t))


def prefix_index(spark: SparkSession, order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """A row for each prefix token of each template; tokens are their numbers in the global order."""
    number = {t: i + 1 for i, t in enumerate(order)}
    rows = []
    for label, tokens in TOKENS.items():
        ranks = sorted(number[t] for t in tokens)
        need = _need(len(ranks), threshold)
        for i in range(len(ranks) - need + 1):
            rows.append(F.struct(F.lit(ranks[i]).alias("token"), F.lit(label).alias("label"), F.array(*map(F.lit, ranks)).alias("template"), F.array(*(F.lit(number[t]) for t in NUMBERS[label])).cast("array<int>").alias("numbers"), F.lit(need).alias("need"), F.lit(LENGTHS[label]).alias("length")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``."""
    order = token_order(docs)
    number = {t: i + 1 for i, t in enumerate(order)}
    prefixes = sorted({order[r - 1] for tokens in TOKENS.values() for r in sorted(number[t] for t in tokens)[: len(tokens) - _need(len(tokens), threshold) + 1]})
    starters = [p.split()[0] for p in PHRASES]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "row", "text", _words(F.col("text")).alias("words"))

    def starts(label: str, phrase: str) -> str:
        parts = phrase.split()
        holds = " AND ".join(f"get(words, i + {k}) = '{p}'" for k, p in enumerate(parts))
        return f"transform(filter(sequence(0, size(words) - 1), i -> {holds}), i -> named_struct('at', i, 'label', '{label}'))"

    found = f"concat({', '.join(starts(label, phrase) for phrase, label in PHRASES.items())})"
    maybe = F.arrays_overlap("words", _array(sorted({p.split()[-1] for p in PHRASES}))) & F.arrays_overlap("words", _array(starters))
    none = F.array().cast("array<struct<at:int,label:string>>")
    # the surroundings of each prefix token, as the vocabulary numbers of their words, zero for others, and its place there
    wanted, known = _array(prefixes), _array(order)
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(wanted, F.get("words", i)))
    begin = lambda i: F.greatest(i - (LONGEST - 1), F.lit(0))
    number_of = lambda w: F.coalesce(F.array_position(known, w), F.lit(0)).cast("int")
    near = F.transform(at, lambda i: F.struct((i - begin(i)).alias("at"), F.transform(F.slice("words", begin(i) + 1, i - begin(i) + LONGEST), number_of).alias("block")))
    near = F.when((F.size("words") > 0) & F.arrays_overlap("words", wanted), F.array_distinct(near))
    rows = rows.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), F.when((F.size("words") > 0) & maybe, F.expr(found)).otherwise(none).alias("base"), near.alias("near"))
    rows = rows.select("doc_id", "row", "n_words", F.size("base").cast("long").alias("n_base"), F.expr("array_min(base.at)").cast("long").alias("first_word"), F.expr("array_max(base.at)").cast("long").alias("last_word"), F.array_sort(F.array_distinct("base.label")).alias("base_set"), "near")
    probe = rows.select("*", F.explode_outer("near").alias("n")).select("*", "n.*").drop("n", "near").withColumn("token", F.get("block", F.col("at")))
    index = F.broadcast(prefix_index(docs.sparkSession, order, threshold))
    pairs = probe.join(index, "token", "left")
    enough = F.size(F.array_intersect("template", "block")) >= F.col("need")
    blocks = F.sequence(F.greatest(F.col("at") - F.col("length") + 1, F.lit(0)), F.col("at"))
    held = lambda tokens, s: F.size(F.array_intersect(tokens, F.slice("block", s + 1, F.col("length"))))
    reached = F.array_max(F.transform(blocks, lambda s: F.when(held("numbers", s) == F.size("numbers"), held("template", s)).otherwise(0)))
    pairs = pairs.withColumn("reached", F.when(F.col("label").isNotNull() & enough, reached))
    match = F.col("reached") >= F.col("need")
    pairs = pairs.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_set", F.when(match, F.col("label")).alias("met"), F.when(match, F.col("reached") / F.size("template")).alias("share"))

    whole = pairs.groupBy("row").agg(
        *(F.first(x).alias(x) for x in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_set")),
        F.collect_set("met").alias("met"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("share"),
    )
    return whole.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", "met")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.col("share")).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same by brute force: every window of words against every template that the whole text could meet."""
    values = ", ".join(f"('{label}', {tokens!r}, CAST({NUMBERS[label]!r} AS VARCHAR[]), {_need(len(tokens), THRESHOLD)}, {LENGTHS[label]})" for label, tokens in TOKENS.items())
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM places WHERE " + " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split())) for phrase, label in PHRASES.items()
    )
    low = f"translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}')"
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all({low}, '{WORD}') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
base AS ({phrases}),
bases AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY doc_id),
templates AS (SELECT * FROM (VALUES {values}) AS t(label, tokens, numbers, need, length)),
sets AS (SELECT doc_id, w, list_distinct(w) AS d FROM words),
likely AS (SELECT doc_id, w, label, tokens, numbers, need, length FROM sets, templates WHERE len(list_intersect(d, tokens)) >= need),
windows AS (SELECT doc_id, label, tokens, numbers, need, list_slice(w, s, s + length - 1) AS b FROM (SELECT *, unnest(range(1, len(w) + 1)) AS s FROM likely)),
met AS (SELECT doc_id, label, len(list_intersect(list_distinct(b), tokens)) / len(tokens) AS share FROM windows WHERE len(list_intersect(list_distinct(b), tokens)) >= need AND len(list_intersect(list_distinct(b), numbers)) = len(numbers)),
mets AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(share) AS share FROM met GROUP BY doc_id)
SELECT words.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(bases.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(mets.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM words LEFT JOIN bases USING (doc_id) LEFT JOIN mets USING (doc_id)
"""
