"""Operator 13: licence scans by a positional index of rare words (DataFrame functions only).

Licence wording is a table of templates: short phrases, which must stand in full, and notices, of which each names key
phrases that must.  The index maps a word to its places in the templates.  A file is read once and keeps the places of its
licence words.  How many files hold a word gives its IDF; of each template the rarer half of the words is looked up:
each place of such a word in a file proposes where a template would begin, and proposals that enough rare words agree on
are verified word by word against the file's places.
"""
from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.shared import land, table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases that always count, and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: The wording of notices (label, text, key phrases).
NOTICES = (
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "in compliance with the license")),
    ("apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("without any express or implied warranty", "in no event will the authors")),
)
#: Share of a notice's IDF weight that must stand at its place.
LEAST_SHARE = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: frozenset[int]  # places of the words of key phrases
    base: bool


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    out = [Template(label, tuple(text.split()), frozenset(range(len(text.split()))), True) for label, text in phrases]
    for label, text, keys in notices:
        words, places = text.split(), set()
        for phrase in keys:
            p = phrase.split()
            starts = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            if not starts:
                raise ValueError(f"no key phrase {phrase!r} in the notice of {label}")
            places |= {i + j for i in starts for j in range(len(p))}
        out.append(Template(label, tuple(words), frozenset(places), False))
    return out


def places(df: DataFrame, vocabulary: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, found), landed: ``found`` has the places (at, word) of the vocabulary's words in a whole text."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = df.select(F.col(doc_id).alias("doc_id"), F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0)).alias("words"))
    found = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*vocabulary), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    return land(words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), found.alias("found")), "licence-places")


def weights(files: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """A word's IDF in millionths, over all files; the driver gets a count for each word of the vocabulary."""
    held = files.select(F.explode(F.array_distinct(F.transform("found", lambda x: x["word"]))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts, n = {r["word"]: r["n"] for r in held.collect()}, files.count()
    return {w: round((math.log((n + 1) / (counts.get(w, 0) + 1)) + 1) * 1_000_000) for w in vocabulary}


def index(spark: SparkSession, known: list[Template], weight: dict[str, int]) -> DataFrame:
    """The postings: word, template, place, weight, key, rare, and the template's total, keys, need (rare places that must agree),
    label and base.  A row per word of the templates, so a few hundred."""
    rows = []
    for t, x in enumerate(known):
        distinct = sorted(set(x.words), key=lambda w: (-weight[w], w))
        rare = set(distinct[: (len(distinct) + 1) // 2])
        at = [w in rare for w in x.words]
        need = sum(at) if x.base else max(1, sum(at) // 2)
        total = sum(weight[w] for w in x.words)
        rows += [(w, t, i, weight[w], int(i in x.keys), at[i], total, len(x.keys), need, x.label, x.base) for i, w in enumerate(x.words)]
    return spark.createDataFrame(rows, "word string, template int, place int, weight long, key int, rare boolean, total long, keys int, need int, label string, base boolean")


def matches(files: DataFrame, postings: DataFrame) -> DataFrame:
    """(row, label, base, start, share, accepted): every place where a template's key phrases stand, with the share of its weight there.

    Rare words propose; what they propose is verified against the places of all the template's words.  The postings are broadcast:
    their size is that of the templates."""
    rare = [r["word"] for r in postings.where("rare").select("word").distinct().collect()]
    seen = files.select("row", F.explode(F.filter("found", lambda x: x["word"].isin(*rare))).alias("x")).select("row", "x.at", "x.word")
    proposed = seen.join(F.broadcast(postings.where("rare")), "word").withColumn("start", F.col("at") - F.col("place")).where("start >= 0")
    proposed = proposed.groupBy("row", "template", "start").agg(F.count("*").alias("hits"), F.first("need").alias("need")).where("hits >= need").select("row", "template", "start")
    proposed = land(proposed, "licence-proposed")
    asked = proposed.join(F.broadcast(postings), "template").withColumn("at", F.col("start") + F.col("place"))
    held = files.join(proposed.select("row").distinct(), "row", "left_semi").select("row", F.explode("found").alias("x")).select("row", "x.at", "x.word")
    sums = asked.join(held, ["row", "at", "word"]).groupBy("row", "template", "start").agg(
        F.sum("weight").alias("weight"), F.sum("key").alias("hit"), *[F.first(c).alias(c) for c in ("total", "keys", "label", "base")])
    share = F.col("weight") / F.col("total")
    return sums.where("hit = keys").select("row", "label", "base", "start", share.alias("share"), (share >= LEAST_SHARE).alias("accepted"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, places (base, label, start of each accepted place, in order), n_base, first_word, last_word,
    base_labels, labels, score.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.  ``score`` is the largest share of a
    template's IDF weight at a place where its key phrases stand (1 for a phrase in full, 0 without any).  Null and empty
    texts have no words; repeated rows are scanned one by one; an empty table has no rows.
    """
    known = templates(phrases, notices)
    vocabulary = sorted({w for t in known for w in t.words})
    files = places(df, vocabulary, doc_id, text)
    found = matches(files, index(df.sparkSession, known, weights(files, vocabulary)))
    base = F.col("base")
    one = found.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("accepted"), F.struct("start", "label", "base")))).alias("places"),
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set(F.when(F.col("accepted"), F.col("label")))).alias("labels"),
        F.round(F.max("share"), 6).alias("score"))
    none = F.array().cast("array<string>")
    return files.drop("found").join(one, "row", "left").select(
        "doc_id", "n_words", F.coalesce("places", F.array().cast("array<struct<start:int,label:string,base:boolean>>")).alias("places"), F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def scan_sql(phrases=PHRASES, notices=NOTICES) -> str:
    """The scan by definition: every place of every template word proposes, without an index."""
    known = templates(phrases, notices)
    rows = ", ".join(f"('{w}', {t}, {i}, {int(i in x.keys)}, '{x.label}', {str(x.base).lower()})" for t, x in enumerate(known) for i, w in enumerate(x.words))
    return rf"""
WITH p(word, template, place, key, label, base) AS (VALUES {rows}),
f AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORDS}') AS words FROM documents),
o AS MATERIALIZED (SELECT * FROM (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM f) WHERE word IN (SELECT word FROM p)),
w AS (SELECT word, CAST(round((ln(((SELECT count(*) FROM f) + 1) / (coalesce(n, 0) + 1)) + 1) * 1000000) AS BIGINT) AS weight
      FROM (SELECT DISTINCT word FROM p) LEFT JOIN (SELECT word, count(DISTINCT row) AS n FROM o GROUP BY word) USING (word)),
r AS (SELECT template, word, row_number() OVER (PARTITION BY template ORDER BY weight DESC, word) * 2 <= count(*) OVER (PARTITION BY template) + 1 AS rare FROM (SELECT DISTINCT template, word FROM p) JOIN w USING (word)),
x AS MATERIALIZED (SELECT p.*, weight, rare FROM p JOIN w USING (word) JOIN r USING (template, word)),
t AS (SELECT template, sum(weight) AS total, sum(key) AS keys, CASE WHEN any_value(base) THEN count(*) FILTER (WHERE rare) ELSE greatest(1, count(*) FILTER (WHERE rare) // 2) END AS need FROM x GROUP BY template),
m AS (SELECT row, template, pos - place AS start, any_value(label) AS label, any_value(base) AS base, sum(weight) AS weight, sum(key) AS hit, count(*) FILTER (WHERE rare) AS hits
      FROM o JOIN x USING (word) WHERE pos >= place GROUP BY row, template, start),
s AS (SELECT row, label, base, start, weight::DOUBLE / total::DOUBLE AS share FROM m JOIN t USING (template) WHERE hit = keys AND hits >= need),
g AS (SELECT row, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE share >= {LEAST_SHARE}) AS labels, max(share) AS score FROM s GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(round(score, 6), 0.0) AS score
FROM f LEFT JOIN g USING (row)
"""


SQL = scan_sql()
