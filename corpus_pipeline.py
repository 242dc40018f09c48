"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

The near-dedup stage links texts whose sets of five-word shingles have a similarity of 0.8 or more:
deletion-variant signatures propose pairs, their exact similarity decides.

Rows are told apart by doc_id and a hash of the text, so rows that share an id, or have none, are
judged one by one, and of repeated rows one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sidewind.llm.bpe import bpe
from sidewind.llm.common import broadcast_within, materialize
from sidewind.llm.decontam import keep_clean
from sidewind.llm.exact_dedup import exact_dedup, normalise
from sidewind.llm.near_copies import near_copies, text_hash
from sidewind.llm.toxicity import fit, keep_below

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that more likely than not have a severity of at least one grade."""
    return keep_below(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _drop(docs: DataFrame, judged: DataFrame, text_hash: Column) -> DataFrame:
    """docs without the rows whose id and text hash judged(doc_id, hash, stays) drops, and with one each of those that stay."""
    out = docs.withColumn("__hash", text_hash)
    keys = judged.select(F.col("doc_id").alias("__a"), F.col("hash").alias("__b"), "stays")
    same = out["doc_id"].cast("long").eqNullSafe(F.col("__a")) & (F.col("__hash") == F.col("__b"))
    out = out.join(broadcast_within(keys.where("NOT stays").select("__a", "__b").distinct()), same, "left_anti")
    again = materialize(keys.where("stays").groupBy("__a", "__b").count().where("count > 1").select("__a", "__b"), "again")
    if again.isEmpty():
        return out.drop("__hash")
    first = Window.partitionBy("doc_id", "__hash").orderBy(F.lit(1))
    one = out.join(broadcast_within(again), same, "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return out.join(broadcast_within(again), same, "left_anti").unionByName(one).drop("__hash")


def keep_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of equal texts, and one of repeated rows."""
    judged = materialize(exact_dedup(docs).where("group_size > 1").select("doc_id", F.col("text_sha256").alias("hash"), F.expr("doc_id <=> keep_id").alias("stays")), "judged")
    return _drop(docs, judged, F.sha2(normalise(docs.text), 256))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group that near copies link, and one of repeated rows."""
    groups = near_copies(docs)
    stays = F.expr("doc_id <=> keep_id AND text_hash = keep_hash")
    judged = materialize(groups.select("doc_id", F.col("text_hash").alias("hash"), stays.alias("stays")), "judged")
    return _drop(docs, judged, text_hash(docs.text))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers."""
    import public_tokenizers

    return bpe(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", keep_unique),
    ("simhash near-dedup", keep_one_of_near),
    ("benchmark decontamination", decontaminate),
    ("bpe", tokenize),
]

#: The model and the merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
