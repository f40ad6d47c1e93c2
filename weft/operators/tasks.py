"""Native baselines for the built-in task templates (ours: the original leaves every task to the model).

With a live backend a task is template + ``enrich``.  These baselines run the
same tasks without a model so a job can run offline and be checked:

* ``classify_by_keywords`` / ``sentiment_by_lexicon``: per-row word counts against a
  small fixed dictionary, computed inside the row (no join, no shuffle);
* ``keywords_tfidf``: term frequency x inverse document frequency, top-k per document.
  Terms are counted inside the row; only a document's distinct terms are exploded.
  Document frequency is a partial aggregate and one join brings it to the terms; how it
  is joined, and that a term of a third of all documents is split over tasks, is left to
  the planner and adaptive execution;
* ``summarize_extractive``: the k sentences with the most distinct content words,
  in their original order, chosen inside the row;
* ``summarize_by_frequency``: the k sentences whose distinct content words are in the
  most documents.  Texts move by their key; for the statistic only words move, and the
  numbers of the sentences go back to their key, where they are ranked.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _col

WORD_RE = r"\p{L}+"
SENTENCE_BREAK = r"([.!?])[ \t\n\r]+"

# Our own small dictionaries (not taken from anywhere): stop words that tell the
# four fixture languages apart, and a tiny sentiment lexicon.
LANGUAGE_KEYWORDS = {
    "de": ["der", "die", "und", "das", "mit", "ist", "ein", "sich"],
    "en": ["the", "and", "of", "to", "is", "with", "this", "for"],
    "es": ["el", "los", "las", "del", "que", "por", "una", "con"],
    "fr": ["le", "la", "les", "des", "et", "une", "qui", "pour"],
}
SENTIMENT_LEXICON = {
    "positive": ["good", "great", "excellent", "love", "happy", "bon", "gut", "bueno", "tốt", "tuyệt"],
    "negative": ["bad", "poor", "terrible", "hate", "sad", "mauvais", "schlecht", "malo", "tệ", "kém"],
}


def words(text: str | Column) -> Column:
    """Lower-cased letter runs of a text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_RE), 0)


def _once(tokens: Column, fn) -> Column:
    """``fn(tokens)`` with the tokens bound to a variable: a text is cut into words once, however often they are used."""
    return F.get(F.transform(F.array(tokens), fn), 0)


def _hits(tokens: Column, vocab: list[str]) -> Column:
    arr = F.array(*[F.lit(w) for w in vocab])
    return F.size(F.filter(tokens, lambda t: F.array_contains(arr, t)))


def classify_by_keywords(text: str | Column, categories: dict[str, list[str]] | None = None, other: str = "other") -> Column:
    """Category with the most keyword hits (ties -> smaller name); ``other`` when none."""
    cats = categories or LANGUAGE_KEYWORDS

    def best(tokens: Column) -> Column:
        return F.array_min(F.array(*[F.named_struct(F.lit("h"), -_hits(tokens, ws), F.lit("c"), F.lit(c)) for c, ws in sorted(cats.items())]))

    found = _once(words(text), best)
    return _once(found, lambda b: F.when(b["h"] < 0, b["c"]).otherwise(F.lit(other)))


def sentiment_by_lexicon(text: str | Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """'positive' / 'negative' / 'neutral' from the sign of (positive hits - negative hits)."""
    lex = lexicon or SENTIMENT_LEXICON
    score = _once(words(text), lambda t: _hits(t, lex["positive"]) - _hits(t, lex["negative"]))
    return _once(score, lambda x: F.when(x > 0, "positive").when(x < 0, "negative").otherwise("neutral"))


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of an array of words: sorted, and cut where a word differs from the one before."""

    def cut(s: Column) -> Column:
        places = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return _once(places, lambda at: F.transform(at, lambda i, n: F.struct(
            F.get(s, i).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return _once(F.sort_array(tokens), cut)


def keywords_tfidf(df: DataFrame, key: str, text: str, k: int = 3, min_len: int = 1) -> DataFrame:
    """Top ``k`` terms per document by tf * ln(N / df); ties by term. Rows: key, rank, term."""
    # whole documents move once, so that they are cut into words by all tasks whatever the layout of the files
    docs = df.select(key, text).repartition(F.col(key))
    tokens = words(text) if min_len <= 1 else F.filter(words(text), lambda w: F.length(w) >= min_len)
    terms = docs.select(key, F.explode(term_counts(tokens)).alias("t")).select(key, "t.term", "t.tf")
    freq = terms.groupBy("term").agg(F.count("*").alias("df"))
    total = df.agg(F.count("*").alias("n")).first()["n"]
    scored = terms.join(freq, "term").withColumn("score", F.col("tf") * F.log(F.lit(float(total)) / F.col("df")))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("term"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "rank", "term")


def split_sentences(text: str | Column) -> Column:
    """Sentences with their closing punctuation; empty pieces dropped."""
    marked = F.regexp_replace(_col(text), SENTENCE_BREAK, "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: s != F.lit(""))


def summarize_extractive(text: str | Column, k: int = 2, min_len: int = 4) -> Column:
    """The ``k`` sentences with the most distinct words of ``min_len``+ letters, in text order, joined by a space."""
    sents = split_sentences(text)
    scored = F.transform(sents, lambda s, i: F.named_struct(
        F.lit("neg"), -F.size(F.array_distinct(F.filter(words(s), lambda w: F.length(w) >= min_len))),
        F.lit("pos"), i, F.lit("s"), s))
    top = F.slice(F.array_sort(scored), 1, k)
    ordered = F.array_sort(F.transform(top, lambda x: F.named_struct(F.lit("pos"), x["pos"], F.lit("s"), x["s"])))
    return F.array_join(F.transform(ordered, lambda x: x["s"]), " ")


def distinct_words(text: str | Column, min_len: int) -> Column:
    """The distinct words of ``min_len``+ letters of a text; the pattern leaves out the shorter ones."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(rf"\p{{L}}{{{max(1, min_len)},}}"), F.lit(0)))


def summarize_by_frequency(df: DataFrame, key: str, text: str, k: int = 2, min_len: int = 4) -> DataFrame:
    """The ``k`` sentences of each text with the largest sum of document frequencies over their distinct words, in text order.

    Rows: key, summary, one for each row of ``df`` (keys are unique row keys).  Ties go to the earlier sentence, and sentences
    without such words count 0; a null text has a null summary, a text without sentences an empty one.
    """
    # whole texts move once, for the statistic, the sentences and the summaries; no sentence ends inside a word
    docs = df.select(key, text).repartition(F.col(key))
    freq = docs.select(F.explode(distinct_words(text, min_len)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    sentences = docs.select(key, F.posexplode(split_sentences(text)).alias("at", "s"))
    terms = sentences.select(key, "at", F.explode(distinct_words("s", min_len)).alias("term"))
    # a task's part of the vocabulary has one row for each term, so it is hashed and the many words need no sort
    found = terms.join(freq.hint("shuffle_hash"), "term").select(key, "at", "df").repartition(F.col(key))
    # all of a key's numbers are in one task from here on; no text is in these rows
    scores = found.groupBy(key, "at").agg(F.sum("df").alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "at"))).where(F.col("rank") <= k)
    best = ranked.groupBy(key).agg(F.collect_list("at").alias("_best"))

    def summary(sents: Column) -> Column:
        # fewer than k sentences with words: the first ones without fill the places
        numbers = F.sequence(F.lit(0), F.size(sents) - 1)
        rest = F.slice(F.filter(numbers, lambda i: ~F.array_contains(chosen, i)), F.lit(1), F.lit(k) - F.size(chosen))
        taken = F.sort_array(F.concat(chosen, rest))
        return F.when(F.size(sents) == 0, F.lit("")).otherwise(F.array_join(F.transform(taken, lambda i: F.get(sents, i)), " "))

    chosen = F.coalesce(F.col("_best"), F.array().cast("array<int>"))
    joined = docs.join(best, key, "left")
    return joined.select(key, F.when(F.col(text).isNotNull(), _once(split_sentences(text), summary)).alias("summary"))
