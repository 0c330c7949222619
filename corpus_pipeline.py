"""The corpus pipeline: language, toxicity, near duplicates, mixing, packing.

Each stage reads what its predecessor wrote as Parquet. All but the last return
the columns of ``documents``, whatever they are called.

In all stages rows may repeat, a ``doc_id`` may be null or shared, texts may be
null, empty or of any length, and an empty table gives an empty table. Null and
empty texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm import langid, minhash, mixing, packing, toxicity
from tierflow.llm.common import crc_mod, delete_folder, fresh, spare_names, table
from tierflow.llm.encoding import tokenizer_file

#: A document stays if one language has this share of its words at least.
LEAST_SHARE = 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, those in which no language has ``LEAST_SHARE`` of the words, and those whose ``lang`` names another one.

    A null ``lang`` contradicts nothing. A null ``doc_id`` is judged and never learned from. At most ``langid.MOST_LANGUAGES`` labels,
    those with the most rows, are learned; a document labelled otherwise goes, since what is found in it is one of those.
    """
    found, share = spare_names(docs, "lang_pred", "share")
    model = langid.learn(docs.where(crc_mod("doc_id", 5) != 0))
    judged = langid.predict(docs, model, tuple(docs.columns), (found, share))
    agrees = F.coalesce(F.col(found) == F.col("lang"), F.lit(True))
    return judged.where((F.col(found) != "und") & (F.col(share) >= LEAST_SHARE) & agrees).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic; without labels of both classes nothing is learned, and only a share of toxic labels above the threshold drops rows.

    A null or empty text is scored like any other. Raises ValueError if all labelled texts of a class are longer than ``toxicity.CHARACTERS``.
    """
    score, predicted = spare_names(docs, "score", "predicted")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod("doc_id", 4) != 2)
    model = toxicity.fit(*toxicity.training_sample(docs, labels))
    judged = toxicity.predict(docs, model, tuple(docs.columns), (score, predicted))
    return judged.where(F.col(predicted) == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the smallest id, null last; documents without words all stay, repeated rows once."""
    return minhash.without_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and cut documents so that the sources, of which null is one, meet their targets."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 2048 ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 1)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Trained models and pseudorandom slots have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's rows are deleted when the next has read them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            delete_folder(spark, before)
        before = folder
    return docs
