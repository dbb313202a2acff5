"""Corpus cleaning pipeline: quality, near copies, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame that the caller writes as Parquet and hands to the next stage.  All but the last
return the columns of documents; the last adds the token ids and the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import chosen_path, decontam, pii, quality_net, sp_bpe
from tillsight.llm._tables import without, written
from tillsight.llm.queries import fold, table, tokenizer_path


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the doc_id, or for a row without one a number above all ids that its text gives it."""
    by_text = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    return docs.withColumn("_key", F.coalesce("doc_id", by_text))


def _without(docs: DataFrame, gone: DataFrame, key: str = "_key") -> DataFrame:
    """``docs`` less the rows whose ``key`` is in ``gone``, in the columns that stages hand on."""
    return without(docs, gone, key).select(*[f"`{c}`" for c in docs.columns if c not in ("_key", "_row")])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be bad go; labels of one fold are never learnt."""
    docs = _keyed(docs)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_key")
    scores = quality_net.quality_scores(docs, labels, fold("_key") != 1, key="_key")
    return _without(docs, scores.where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows that repeat it stay with it."""
    docs = _keyed(docs)
    return _without(docs, chosen_path.near_duplicates(docs, key="_key").where("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exact or edited, go: those texts only, whatever else has their id."""
    docs = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    return _without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), key="_row"), "_row")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and n_chars follows the text."""
    clean = pii.redact(docs, pii.learn(docs, "text"))
    return clean.selectExpr(*["cast(char_length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`"
                              for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's text encoded with the public SentencePiece model, and decoded again."""
    return sp_bpe.encode(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("decontamination", decontaminate),
          ("personal data", redact), ("sentencepiece", encode)]
# SQL can't express the classifier, the alignment or the encoder; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied in order to the documents table, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
