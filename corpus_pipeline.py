"""From raw documents to packed training sequences.

Five stages, each a call of one operator on all that the stage before kept.  All but the last
return the columns of ``documents``; the last returns one row per packed piece.  A stage reads only the
columns it names; other columns of its input are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synchra.llm import jaccard, langid, packing, quality, substring_dedup
from synchra.llm.common import stored
from synchra.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction below this cosine counts as no language found.
LEAST_SCORE = 0.05


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't predict as 0."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.with_statistics(docs), labels.where(~quality.held_out()))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found: neither ``und`` nor a cosine below ``LEAST_SCORE``."""
    docs = docs.select(*COLUMNS)
    prototypes = langid.learn(docs.where(~langid.held_out()))
    found = langid.predict(docs, prototypes)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id; rows that only share an id, or have none, all stay."""
    return jaccard.without_near_duplicates(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the 50-byte strings that one of a smaller id has; code points cut in part go too."""
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS), keep_text=True, carry=("lang", "source"), as_text=True)
    return cut.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_one_of_similar),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: No SQL: classifiers, tokenizers and suffix arrays can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = stored(out) if k + 1 < len(STAGES) else out
    return docs
