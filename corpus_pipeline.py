"""The corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage is one operator of ``lodestrata.llm``, works on all rows that its predecessor kept, and is written as
Parquet and read again before the next. The first three return the columns of ``documents`` for the rows they
keep; the last returns the packed pieces of those documents. The learned stages learn from the rows they get and
``labels`` of their training folds. Rows without an id are judged like others and stay unless rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import packing, quality, similar, toxicity
from lodestrata.llm.queries import tokenizer
from lodestrata.storage import materialise, scratch


def _decided(docs: DataFrame, score, keeps) -> DataFrame:
    """Rows whose score ``keeps`` accepts, as they came, whatever their columns are called."""
    rows = docs.select(F.struct("*").alias("row"), score.alias("score"))
    return rows.where(keeps(F.col("score"))).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5; all of them where labels of both classes are missing, as nothing is learned then."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    models = toxicity.fit(docs, labels, "toxic", quality.fold(F.col("doc_id"), 5) != 0)
    if models.constant is not None:
        return docs
    return _decided(docs, toxicity.score(models, F.col("text")), lambda score: score < 0.5)


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    measured = materialise(quality.measure(docs), "statistics")  # so that statistics meet the labels, not texts
    model = quality.fit(measured, labels, "quality", quality.fold(F.col("doc_id"), 3) != 1)
    return _decided(docs, quality.score_text(model, F.col("text")), lambda score: score >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word Jaccard similarity 0.8 or more make, that of the smallest id: by SimHash, then exactly."""
    return similar.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_junk),
    ("SimHash near-dedup", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):  # a stage's own tables go when it is written
            docs = materialise(stage(spark, docs, sf_dir), f"stage{i}", stays=True)
    return docs


ORACLE_SQL = None  # learned models, hashing with a seed and tokenisation can't be put in SQL
