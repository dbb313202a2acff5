"""The operators of this subpackage bound to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import hard_negatives, licences, preference

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillsight.llm import sp_bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sp_bpe.encode(docs, tokenizer_path(), digest=True, keep_text=False)


@query("op4_kd_shards")
def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of near equal bytes, split by size, source, language and position."""
    from tillsight.llm import kd_shards

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text) + 16
    code = lambda c: F.crc32(F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8"))
    got = kd_shards.shard(docs, "doc_id", size, [F.log2(size), code("source"), code("lang"), F.col("doc_id")],
                          n_shards=40, keep={"text_crc32": F.crc32(F.encode(text, "UTF-8"))})
    return got.select("doc_id", F.col("weight").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard",
                      "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillsight.llm import quality_rules

    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_main_text")
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillsight.llm import main_text

    return main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def fold(key: str = "doc_id"):
    """The third that a document falls into by the CRC of its id."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 3


@query("op9_quality_net")
def op9_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillsight.llm import quality_net

    got = quality_net.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold() != 1)
    return got.select("doc_id", (fold() == 1).alias("held_out"), "score", "predicted")


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillsight.llm import decontam

    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillsight.llm import chosen_path

    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillsight.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pii.find_spans(docs, pii.learn(docs, "text"))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"),
                      "spans")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/")]


@query("op11_url_templates")
def op11_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no labels of their own: templates learn from the urls that a rule blocks."""
    from tillsight.llm import url_templates

    return url_templates.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query("op12_hard_negatives", hard_negatives.ORACLE)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    label = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, label=label)


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tillsight.llm import token_align

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_align.link_statistics(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


@query("op1_licences", licences.oracle_sql())
def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.recognise(docs)


@query("op2_preference_pairs", preference.ORACLE)
def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no preferences: conversations 2k and 2k + 1 are taken as chosen and rejected."""
    turns = table(spark, sf_dir, "conversations")
    return preference.format_pairs(turns.withColumn("pair_id", F.expr("conv_id div 2")).withColumn(
        "side", F.pmod("conv_id", F.lit(2))))
