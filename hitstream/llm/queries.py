"""The dealt operators as queries over the tables of a folder: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitstream.llm import ann, chains, langid, licenses, mixing, packing, pii, rabitq, sharding, simhash


#: Entropy that the mixture's weights reach, as a share of the greatest possible.
MIX_ENTROPY = 0.998


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"), target_entropy=MIX_ENTROPY).drop("__key")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(table(spark, sf_dir, "documents"))


def op4_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.classes(chains.passages(table(spark, sf_dir, "documents")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out())


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.findings(table(spark, sf_dir, "documents"))
    counts = {f"n_{k}": F.size(F.filter("spans", pii.is_kind(k))).cast("long") for k in pii.KINDS}
    found = found.withColumns(counts | {"every": F.concat("spans", "terms")})
    texts = {"base_sha256": F.sha2(F.concat_ws(",", pii.ordered("spans")).cast("binary"), 256), "spans": F.concat_ws(",", pii.ordered("every"))}
    return found.select("doc_id", *counts, *[v.alias(k) for k, v in texts.items()])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_licenses": op3_licenses,
    "op4_chains": op4_chains,
    "op5_language": op5_language,
    "op6_neighbours": op6_neighbours,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.oracle_sql(MIX_ENTROPY),
    "op3_licenses": licenses.oracle_sql(),
}
