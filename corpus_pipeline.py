"""Training-corpus pipeline: five stages, each applying one operator of ``sluice.llm`` to the rows
that its predecessor kept. Every stage takes ``(spark, docs, sf_dir)``; :func:`run` writes each
result as Parquet in the shared scratch folder and rereads it as the next one's ``docs``.

Null and empty texts pass through as each operator defines; an empty table gives no rows; extra
columns of ``docs`` are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.base import load, stage
from sluice.llm.mixing import mix_documents
from sluice.llm.ngram_jaccard import keep_one
from sluice.llm.pieces import encode_for_training
from sluice.llm.quality import keep_good
from sluice.llm.queries import tokenizer_path
from sluice.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go."""
    return keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of words are cut out of the texts; ``n_chars`` follows the new text."""
    cut = remove_repeats(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them (none to three times)."""
    return mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids, begins, ends, round_trip`` of every row of the mix."""
    return encode_for_training(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings),
          ("mixture", mixture), ("pieces", pieces)]

#: the classifier, the balanced sample and the encoder have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
