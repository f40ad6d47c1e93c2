"""From raw documents to training rows: language, exact copies, near copies, mix, pieces.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes as Parquet into the shared
folder and reads again as the next stage's ``docs``.  All but the last give the columns of ``docs``.

1. language: learns from the documents whose crc32(doc_id) mod 3 is not 1 (half of them to set the floor), and drops those without a language
   (null, or no letter; where nothing is labelled, all others stay) and those whose best language has less than ``least_score`` of the probability.
2. exact_copies: one row of each group of equal texts stays, the one with the least doc_id.
3. near_copies: one document of each group of near copies (five-word shingles, Jaccard 0.8) stays.
4. mix: sources in the proportions 5 : 2 : 1, repeating; a document comes 0 to 3 times.
5. pieces: adds ``piece_ids``, the ids of the text's SentencePiece pieces, and ``round_trip``, whether decoding them gives the text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import exact_dedup, language, mixing, near_dups, pieces
from weft.llm.shared import land, table

#: One in so many of the learnable documents sets the floor of the scores, and is not trained on.
FLOOR_PART = 2


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learnable = docs.where(language.remainder("doc_id", 3) != 1)
    of_floor = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("floor")), F.lit(FLOOR_PART)) == 0
    net = language.train(language.training_sample(learnable.where(~of_floor)))
    if not net.labels:  # no language is known, so none can be doubted
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text")
    found = language.identify(own, net)
    floor = language.least_score(learnable.where(of_floor), net)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= floor)).select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_per_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(docs, check="round_trip")


STAGES = [("language", by_language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("pieces", to_pieces)]

#: A recurrent network and a piece model can't be written in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
