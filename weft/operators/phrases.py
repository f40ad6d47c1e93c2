"""Phrases of a dictionary table in texts (ours): classification and sentiment with dictionaries of any size.

A phrase is a run of words (lower-cased letter runs).  A text gives its word runs of the lengths that the dictionary has,
each once with its number, and a join finds those that are phrases.  Spark chooses how: a small dictionary is broadcast, so
no run is shuffled; a large one is joined by shuffle, where adaptive execution splits the runs that a third of the texts
hold.  Only runs that are phrases go on to be summed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tasks import _once, term_counts, words


def normalized(phrases: DataFrame, phrase: str, *others: str) -> DataFrame:
    """The dictionary's distinct rows with ``run`` (the phrase's words, a space between two) and ``n`` (their number); phrases without words are left out."""
    w = words(phrase)
    return phrases.select(F.array_join(w, " ").alias("run"), F.size(w).alias("n"), *others).where(F.col("n") > 0).distinct()


def word_runs(tokens: Column, lengths: list[int]) -> Column:
    """array<string>: all runs of ``lengths`` words, a space between two."""
    def of(t: Column, n: int) -> Column:
        if n == 1:
            return t
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")), F.array().cast("array<string>"))

    return _once(tokens, lambda t: F.concat(F.array().cast("array<string>"), *[of(t, n) for n in lengths]))


def phrase_counts(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Rows: key, the dictionary's columns, tf (how often the run stands in the text; runs may overlap).

    ``dictionary`` comes from ``normalized``.  Its lengths, one number each, are all that the driver sees of it.
    """
    lengths = sorted(r["n"] for r in dictionary.select("n").distinct().collect())
    runs = df.select(key, F.explode(term_counts(word_runs(words(text), lengths))).alias("r"))
    return runs.select(key, F.col("r.term").alias("run"), F.col("r.tf").alias("tf")).join(dictionary, "run")


def classify_by_phrases(df: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str = "phrase", category: str = "category",
                        other: str = "other") -> DataFrame:
    """Rows: key, category, hits.  The category whose phrases stand in the text most often (ties: the smaller name), else ``other``.

    One row for each row of ``df`` (keys are unique row keys); null and empty texts are ``other``.
    """
    hits = phrase_counts(df, key, text, normalized(phrases.where(F.col(category).isNotNull()), phrase, F.col(category).alias("_category")))
    summed = hits.groupBy(key, "_category").agg(F.sum("tf").alias("_hits"))
    best = summed.groupBy(key).agg(F.min(F.struct((-F.col("_hits")).alias("less"), "_category")).alias("_best"))
    return df.select(key).join(best, key, "left").select(
        key, F.coalesce("_best._category", F.lit(other)).alias("category"), F.coalesce(-F.col("_best.less"), F.lit(0)).alias("hits"))


def sentiment_by_phrases(df: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str = "phrase", weight: str = "weight") -> DataFrame:
    """Rows: key, score, sentiment: the sign of the phrases' summed weights (a phrase's weights, if several, add up)."""
    weights = normalized(phrases, phrase, F.col(weight).alias("_weight")).groupBy("run", "n").agg(F.sum("_weight").alias("_weight"))
    score = phrase_counts(df, key, text, weights).groupBy(key).agg(F.sum(F.col("tf") * F.col("_weight")).alias("score"))
    out = df.select(key).join(score, key, "left").select(key, F.coalesce("score", F.lit(0)).alias("score"))
    return out.withColumn("sentiment", F.when(F.col("score") > 0, "positive").when(F.col("score") < 0, "negative").otherwise("neutral"))
