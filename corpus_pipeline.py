"""A training corpus from ``documents`` in five stages, each over all that its predecessor kept.

1. language: documents whose language is not recognised go.
2. simhash: of each group of near-duplicates one document stays.
3. pii: personal data is masked, terms that reveal it are generalised or removed; no document goes.
4. mixing: sources are brought to their weights by whole passes over the small ones; no document goes. Rows are written in the
   order of their blocks, each of which holds the sources in proportion, so every stretch of a file does.
5. packing: documents become power-of-two pieces of token ids, one sequence each.

All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitstream.llm import langid, mixing, packing, pii, simhash
from hitstream.llm.common import stored
from hitstream.llm.queries import table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(docs.where(~langid.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_rows(docs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "mix_block", "mix_rank").sortWithinPartitions("mix_block", "mix_rank").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("simhash", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("packing", pack)]

#: Machines, fingerprints and tokens are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
